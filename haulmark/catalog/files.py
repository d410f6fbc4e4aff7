"""Queries on file listings, stores and written files."""

from __future__ import annotations

import gzip
import io
import tarfile

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from haulmark.catalog.base import Views, query
from haulmark.operators import inventory
from haulmark.plans import archives
from haulmark.schemas import EVENTS
from haulmark.session import scratch_path
from haulmark.sources import listings, stores

DOCS_PER_ARCHIVE = 50


@query("s1_scan_inventory", """
    SELECT CASE WHEN lang IS NULL THEN NULL ELSE 'source=' || source || '/lang=' || lang END AS folder, 'file' AS entry_type,
           CAST(1 AS BIGINT) AS entries, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents GROUP BY source, lang
    UNION ALL SELECT 'source=' || source, 'dir', count(DISTINCT lang), NULL FROM documents GROUP BY source
    UNION ALL SELECT '', 'dir', count(DISTINCT source), NULL FROM documents""")
def scan_inventory(v: Views):
    """A tree of folders and text files written from the documents, as the walk finds it; side files are excluded."""
    path = scratch_path(v.spark, "tree")
    docs = v.table("documents").select("source", "lang", "text").repartition("source", "lang")
    docs.write.partitionBy("source", "lang").text(path)
    found = listings.scan_inventory(v.spark, [path], ["*.crc", "_SUCCESS", ".*"])
    inside = F.regexp_extract("path", r"/tree-[0-9a-f]+/?(.*)$", 1)
    folder = F.regexp_replace(inside, "/?[^/]*$", "")
    placed = found.select(inside.alias("inside"), folder.alias("folder"), "entry_type", "size").filter("inside <> ''")
    return placed.groupBy("folder", "entry_type").agg(
        F.count("*").alias("entries"), F.sum(F.when(F.col("entry_type") == "file", F.col("size"))).alias("bytes"))


@query("s4_scan_backups", """
    WITH f AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'chunks_' || lang || '/00/' ELSE '' END || rel_path AS rel_path
               FROM v_files JOIN documents USING (doc_id))
    SELECT doc_id, rel_path FROM f WHERE (rel_path LIKE '%.tar.gz' OR rel_path LIKE '%.tar.zst') AND doc_id % 5 <> 0""")
def scan_backups(v: Views):
    unfinished = F.concat(F.lit("chunks_"), F.split("rel_path", "/")[1], F.lit("/00/"), "rel_path")
    listing = v.files().withColumn("rel_path", F.when(F.col("doc_id") % 5 == 0, unfinished).otherwise(F.col("rel_path")))
    return listings.list_backups(listing).select("doc_id", "rel_path")


@query("s4_scan_backups_walk", f"""
    WITH a AS (SELECT CAST(doc_id // {DOCS_PER_ARCHIVE} AS BIGINT) AS archive_no FROM documents GROUP BY ALL)
    SELECT archive_no, CASE archive_no % 3 WHEN 0 THEN 'agent-0' ELSE 'agent-1/daily' END AS folder
    FROM a WHERE archive_no % 6 <> 3 AND archive_no % 5 <> 0""")
def scan_backups_walk(v: Views):
    """Archives written into folders of agents, some of them unfinished, as the walk finds them."""
    folder = scratch_path(v.spark, "backups").removeprefix("file://")
    docs = v.table("documents").select(F.floor(F.col("doc_id") / DOCS_PER_ARCHIVE).alias("archive_no"), "doc_id", "text")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["archive_no"].iloc[0])
        agent = "agent-0" if number % 3 == 0 else "agent-1/daily"
        return _build_archive(pdf, f"{folder}/{agent}" + ("/chunks_x" if number % 5 == 0 else ""))

    docs.groupBy("archive_no").applyInPandas(build, "path string, archive_no long").write.parquet(scratch_path(v.spark, "built"))
    found = listings.scan_backups(v.spark, folder)
    return found.select(
        F.regexp_extract("rel_path", "archive-([0-9]+)", 1).cast("long").alias("archive_no"),
        F.regexp_replace("rel_path", "/[^/]*$", "").alias("folder"))


@query("s5_scan_remote_listing", "SELECT storage, bucket, key, size FROM v_remote WHERE key LIKE 'nation_1%' ORDER BY key")
def scan_remote_listing(v: Views):
    return listings.scan_remote_listing(v.remote(), "nation_1").select("storage", "bucket", "key", "size")


@query("a1_prescan", """
    WITH p AS (SELECT DISTINCT string_split(rel_path, '/')[1] AS d FROM v_files UNION ALL
               SELECT DISTINCT string_split(rel_path, '/')[1] || '/' || string_split(rel_path, '/')[2] FROM v_files)
    SELECT count(*) + (SELECT count(*) FROM p) AS total_objects, CAST(sum(size) AS BIGINT) AS total_bytes FROM v_files""")
def prescan(v: Views):
    return inventory.prescan(inventory.with_directories(v.files()))


@query("u2_multi_root_union", """
    SELECT 0 AS root_no, count(*) AS entries, count(DISTINCT rel_path) AS paths FROM v_files UNION ALL
    SELECT 1, count(*), count(DISTINCT rel_path) FROM v_files WHERE rel_path LIKE 'src1/%'""")
def multi_root_union(v: Views):
    """The whole tree, and one folder in it as a root of its own: its files are listed twice."""
    roots = [v.files(), v.files().filter(F.startswith("rel_path", F.lit("src1/")))]
    return inventory.multi_root_union(roots).groupBy("root_no").agg(F.count("*").alias("entries"), F.countDistinct("rel_path").alias("paths"))


def _event_rows(v: Views):
    kind = F.col("event_type")
    return v.ticks().select(
        F.col("ts").alias("timestamp"),
        F.when(kind == "error", "error").when(kind == "view", "warn").otherwise("info").alias("level"),
        kind.alias("type"), F.col("agent").cast("string").alias("agent"), F.col("slot").cast("int").alias("stream"),
        F.concat(F.lit('event "'), F.col("event_id").cast("string"), F.lit('", bytes '), F.col("bytes").cast("string"))
        .alias("message"),
    )


EVENT_SQL = """e AS (SELECT ts, event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warn' ELSE 'info'
    END AS level, event_type AS type, CAST(agent AS VARCHAR) AS agent, CAST(slot AS INTEGER) AS stream,
    'event "' || event_id || '", bytes ' || bytes AS message FROM v_ticks)"""


@query("s2_read_jsonl_tolerant", f"""WITH {EVENT_SQL}
    SELECT epoch_us(ts) AS us, level, type, agent, stream, message FROM e WHERE event_id % 9 > 2""")
def read_jsonl_tolerant(v: Views):
    """A store with broken, blank and array lines among the good ones."""
    path = scratch_path(v.spark, "events-jsonl")
    number = F.regexp_extract("message", '"([0-9]+)"', 1).cast("long")
    line = F.to_json(
        F.struct("timestamp", "level", "type", "agent", "stream", "message"), {"timestampFormat": stores.JSON_TIME}
    )
    text = (
        F.when(number % 9 == 0, "this is not json").when(number % 9 == 1, F.concat(F.lit("["), line, F.lit("]")))
        .when(number % 9 == 2, "").otherwise(line)
    )
    _event_rows(v).select(text.alias("value")).write.text(path)
    return stores.read_jsonl_tolerant(v.spark, path, EVENTS).select(
        F.unix_micros("timestamp").alias("us"), "level", "type", "agent", "stream", "message"
    )


@query("s6_read_store_tail", f"""WITH {EVENT_SQL}
    SELECT epoch_us(ts) AS us, message FROM e ORDER BY ts DESC, message DESC LIMIT 1000""")
def read_store_tail(v: Views):
    path = scratch_path(v.spark, "events-store")
    stores.append_store(_event_rows(v), path)
    tail = stores.read_store_tail(v.spark, path, EVENTS, "events", ["timestamp", "message"])
    return tail.select(F.unix_micros("timestamp").alias("us"), "message")


@query("k8_append_store", f"""WITH {EVENT_SQL}
    SELECT level, 2 * count(*) AS events, count(*) AS timed_at_append FROM e GROUP BY level""")
def append_store(v: Views):
    """Two appends, the second without times."""
    path = scratch_path(v.spark, "append-store")
    stores.append_store(_event_rows(v), path)
    stores.append_store(_event_rows(v).withColumn("timestamp", F.lit(None).cast("timestamp")), path)
    read = stores.read_jsonl_tolerant(v.spark, path, EVENTS)
    return read.groupBy("level").agg(
        F.count("*").alias("events"), F.count_if(F.col("timestamp") > "2024-06-01").alias("timed_at_append")
    )


@query("k9_export_events_csv", f"WITH {EVENT_SQL} SELECT level, type, agent, message FROM e")
def export_events_csv(v: Views):
    path = scratch_path(v.spark, "events-csv")
    stores.export_events(_event_rows(v), path, "csv")
    read = v.spark.read.csv(path, header=True, escape='"')
    return read.select("level", "type", "agent", "message")


@query("k9_export_events_json", f"WITH {EVENT_SQL} SELECT epoch_us(ts) AS us, level, type, agent, message FROM e")
def export_events_json(v: Views):
    path = scratch_path(v.spark, "events-json")
    stores.export_events(_event_rows(v), path, "json")
    read = v.spark.read.schema(EVENTS).json(path)
    return read.select(F.unix_micros("timestamp").alias("us"), "level", "type", "agent", "message")


@query("k1_snapshot_dataset", """
    SELECT 'gzip' AS codec, count(*) AS total_rows, true AS has_digests FROM orders UNION ALL
    SELECT 'zst', count(*), true FROM orders""")
def snapshot_dataset(v: Views):
    """Snapshots in both codecs; size and digest of every file are those of its bytes read again."""
    parts = []
    for codec in ("gzip", "zst"):
        path = scratch_path(v.spark, f"snapshot-{codec}")
        manifest = archives.snapshot_dataset(v.table("orders"), path, codec)
        files = v.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(
            F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.sha2("content", 256).alias("digest"), "length")
        named = manifest.withColumn("name", F.regexp_extract("path", "[^/]+$", 0)).join(files, "name", "full")
        same = (F.col("sha256") == F.col("digest")) & (F.col("bytes") == F.col("length"))
        parts.append(named.agg(
            F.lit(codec).alias("codec"), F.sum("rows").alias("total_rows"),
            F.bool_and(F.coalesce(same, F.lit(False))).alias("has_digests"),
        ))
    return parts[0].unionByName(parts[1])


def _build_archive(docs: pd.DataFrame, folder: str) -> pd.DataFrame:
    """Write up to fifty documents as one archive, damaged in a way its number decides; returns its path."""
    number = int(docs["archive_no"].iloc[0])
    kind = number % 6
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as tar:
        for doc_id, text in zip(docs["doc_id"], docs["text"]):
            body = text.encode("utf-8")
            entry = tarfile.TarInfo(f"doc-{doc_id}.txt")
            entry.size = len(body)
            tar.addfile(entry, io.BytesIO(body))
    plain = buffer.getvalue()
    packed = pa.compress(plain, codec="zstd", asbytes=True) if kind == 1 else gzip.compress(plain, mtime=0)
    if kind == 2:
        packed = b""
    elif kind == 4:
        packed = packed[: len(packed) // 2]
    elif kind == 5:
        packed = b"XX" + packed[2:]
    name = f"archive-{number}" + {1: ".tar.zst", 3: ".zip"}.get(kind, ".tar.gz")
    target = f"{folder}/{name}"
    system, path = (pafs.LocalFileSystem(), target) if target.startswith("/") else pafs.FileSystem.from_uri(target)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        out.write(packed)
    return pd.DataFrame({"path": [target], "archive_no": [number]})


@query("k4_audit_archives", f"""
    WITH a AS (SELECT doc_id // {DOCS_PER_ARCHIVE} AS archive_no, count(*) AS n FROM documents GROUP BY ALL)
    SELECT CAST(archive_no AS BIGINT) AS archive_no, CASE archive_no % 6 WHEN 2 THEN 'empty'
           WHEN 3 THEN 'unsupported extension' WHEN 4 THEN 'bad entry' WHEN 5 THEN 'unreadable header' ELSE 'ok' END
           AS verdict, CASE WHEN archive_no % 6 < 2 THEN n ELSE 0 END AS entries FROM a""")
def audit_archives(v: Views):
    """Documents packed into archives, some damaged; the verdict on each file."""
    folder = scratch_path(v.spark, "archives").removeprefix("file://")
    docs = v.table("documents").select(
        F.floor(F.col("doc_id") / DOCS_PER_ARCHIVE).alias("archive_no"), "doc_id", "text"
    )
    built = docs.groupBy("archive_no").applyInPandas(
        lambda pdf: _build_archive(pdf, folder), "path string, archive_no long"
    )
    verdicts = archives.audit_archives(built)
    whole = F.when(F.col("verdict") == "ok", F.col("entries")).otherwise(0)
    return verdicts.select(
        F.regexp_extract("path", "archive-([0-9]+)", 1).cast("long").alias("archive_no"),
        F.regexp_replace("verdict", " #[0-9]+$", "").alias("verdict"), whole.alias("entries"),
    )
