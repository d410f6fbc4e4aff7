"""Schemas of the canonical tables and the values their enum columns may take."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILES = "path string, rel_path string, entry_type string, size long, mtime timestamp"
CHUNKS = (
    "session_id string, global_seq long, length long, slot_id short, crc32 long, "
    "payload binary, arrival_no long"
)
TRAILERS = "session_id string, sha256 string, size long"
SESSION_LOG = "msg string, globalSeq string, missingSeq string, stream int, length long"
EVENTS = "timestamp timestamp, level string, type string, agent string, stream int, message string"
SESSION_HISTORY = (
    "session_id string, agent string, storage string, backup string, mode string, compression string, "
    "started_at timestamp, finished_at timestamp, duration string, bytes_total long, result string"
)
SESSION_SNAPSHOTS = (
    "timestamp timestamp, session_id string, agent string, storage string, backup string, mode string, "
    "compression string, bytes_received long, disk_write_bytes long, active_streams int, max_streams int, "
    "status string"
)
BUCKET_UPLOADS = (
    "timestamp timestamp, agent string, storage string, backup string, session_id string, bucket_name string, "
    "mode string, success boolean, error string, duration string, bytes_uploaded long"
)
BACKUPS = "storage string, agent string, backup string, file_name string, rel_path string, size long"
REMOTE_OBJECTS = "storage string, bucket string, key string, size long, last_modified timestamp"
STORAGES = "name string, base_dir string, max_backups int, compression string, assembler_mode string"
BUCKETS = (
    "storage string, name string, prefix string, bmode string, retain int, sync_strategy string, "
    "async_upload boolean"
)
RATE_SAMPLES = (
    "session_id string, ts timestamp, producer_bps double, drain_bps double, producer_blocked_ms long, "
    "sender_idle_ms long, active int, max_streams int"
)
JOB_RUNS = "job string, status string, duration_s double, timestamp timestamp, handshake_rtt_ms double"
AGENT_STATS = (
    "agent string, timestamp timestamp, cpu_percent double, memory_percent double, "
    "disk_usage_percent double, load_average double"
)
PROGRESS = "session_id string, timestamp timestamp, objects_sent long, total_objects long, walk_complete boolean"

# The enums of the data model.
ALLOWED = {
    "mode": ["single", "parallel"],
    "compression": ["gzip", "zst"],
    "status": ["running", "idle", "degraded", "finalizing"],
    "phase": ["receiving", "assembling", "verifying", "uploading", "done", "failed"],
    "level": ["debug", "info", "warn", "error"],
    "bmode": ["sync", "offload", "archive"],
    "slot_status": ["idle", "receiving", "disconnected", "disabled"],
    "result": ["ok", "checksum_mismatch", "write_error", "control_lost", "flush_timeout", "expired"],
}

# How many rows each store keeps in memory when it is loaded.
STORE_TAIL = {"events": 1000, "history": 200, "snapshots": 4000, "uploads": 200}


def is_allowed(column: str, enum: str) -> Column:
    """Does the column hold one of the values of the named enum?"""
    return F.col(column).isin(ALLOWED[enum])
