"""Values the operators must give, on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from haulmark.functions import network, paths, progress, sizes, status
from haulmark.operators import inventory, mirroring, reassembly, retention, rollups, sequences, tails, timeline
from haulmark.operators.lookups import ip_range_semi
from haulmark.plans import audit, forensics, mirror
from haulmark.schemas import EVENTS
from haulmark.sources import listings, logs, stores


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def many(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_sizes(spark):
    assert many(spark, ["256mb", " 1GB ", "17", "5b", "1.5gb", "", "x", "12 mb", "99999999999999gb"], "string",
                sizes.parse_byte_size) == [268435456, 1073741824, 17, 5, None, None, None, None, None]
    assert many(spark, [0, 1023, 1024, 1536, 1280, 5 << 20, 7 << 30, 3 << 40], "long", sizes.format_bytes_short) == [
        "0 B", "1023 B", "1.0 KB", "1.5 KB", "1.2 KB", "5.0 MB", "7.0 GB", "3072.0 GB"]
    assert many(spark, [1280, 3 << 40, 1 << 60], "long", sizes.format_bytes_si) == ["1.2 KB", "3.0 TB", "1.0 EB"]
    assert many(spark, [1000, 1536, 3 << 40], "long", sizes.human_size) == ["1000 B", "1.50 KB", "3.00 TB"]
    assert many(spark, [None, 0, 10, 1280, 3 << 50], "long", sizes.format_bytes_ui) == [
        "0 B", "0 B", "10 B", "1.3 KB", "3072.0 TB"]


def test_durations(spark):
    assert many(spark, [0.4, 59.5, 61.0, 3661.0], "double", sizes.format_duration) == ["0:00", "1:00", "1:01", "1:01:01"]
    assert many(spark, [5, 65, 3600, 90061], "long", sizes.format_elapsed) == ["5s", "1m 5s", "1h 0s", "25h 1m 1s"]
    assert many(spark, [5, 65, 3605], "long", sizes.go_duration) == ["5s", "1m5s", "1h0m5s"]
    assert many(spark, ["1h1h", ".5s", "1.s", "-1m", "+0", "."], "string", sizes.parse_go_duration) == [7200.0, 0.5, 1.0, -60.0, 0.0, None]
    assert many(spark, ["1h23m45.678s", "300ms", "45s", "2m", "x", None], "string", sizes.parse_go_duration) == [
        pytest.approx(5025.678), pytest.approx(0.3), 45.0, 120.0, None, None]
    assert many(spark, ["1h23m45.678s", "0.2s", "", None, "2h0m0s"], "string", sizes.format_uptime) == [
        "1h 23m 46s", "0s", "—", "—", "2h"]
    assert one(spark, sizes.fmt_objects(F.lit(6867432), F.lit(11966809))) == "6,867,432/11,966,809"
    assert many(spark, ["a" * 41, "a" * 40, None], "string", lambda c: sizes.truncate_text(c, 40)) == [
        "a" * 40 + "…", "a" * 40, ""]


def test_eta(spark):
    rows = [
        (100, 100, 10.0, 11966809, 6867432, 145.0, (11966809 - 6867432) / 145),
        (1000, 500, 100.0, 2000, 100, 10.0, 190.0), (1000, 1000, 100.0, 500, 500, 50.0, 0.0),
        (1000, 100, 0.0, 500, 50, 0.0, None), (0, 1048576, 13.5e6, 0, 30, 0.5, None),
    ]
    df = spark.createDataFrame(rows, "tb long, db long, bs double, t long, d long, os double, want double")
    eta = progress.eta_pessimistic("tb", "db", "bs", "t", "d", "os")
    for r in df.select("want", eta.alias("got")).collect():
        assert r["got"] == (None if r["want"] is None else pytest.approx(r["want"]))
    assert one(spark, progress.session_eta(F.lit(10), F.lit(100), F.lit(20), F.lit(True))) == "3m0s"
    assert one(spark, progress.session_eta(F.lit(10), F.lit(100), F.lit(20), F.lit(False))) == "∞"
    assert one(spark, progress.session_eta(F.lit(100), F.lit(100), F.lit(20), F.lit(True))) == "0s"


def test_names_and_paths(spark):
    names = ["", "a" * 256, "é" * 128, "a/b", "a\\b", "a\x00b", "..", "..x", ".", ".git", "ok-1"]
    assert many(spark, names, "string", paths.invalid_component_reason) == [
        "empty", "too long", "too long", "separator", "separator", "null byte", "traversal", "traversal", "traversal",
        "starts with dot", None]
    cases = [("/d/a", True), ("/d/../e", False), ("/d/a/../../d/x", True), ("/d/..x", False), ("/d", True), ("/dd/a", False)]
    assert many(spark, [c for c, _ in cases], "string", lambda c: paths.path_within(F.lit("/d"), c)) == [w for _, w in cases]
    assert one(spark, paths.archive_name(F.lit("2026-03-01 02:03:04.567").cast("timestamp"), F.lit(".tar.gz"))) == (
        "2026-03-01T02-03-04-567.tar.gz")
    assert paths.glob_to_regex("a[") is None and paths.glob_to_regex("a\\") is None


def test_exclusion(spark):
    files = [("file1.txt", "file"), ("file2.txt", "file"), ("access.log", "file"), ("sub", "dir"),
             ("sub/file3.txt", "file"), (".git", "dir"), (".git/config", "file")]
    df = spark.createDataFrame(files, "rel_path string, entry_type string")

    def left(fn, *patterns):
        return {r["rel_path"] for r in fn(df, list(patterns)).collect()}

    everything = {f for f, _ in files}
    assert left(inventory.glob_exclude, "*.log") == everything - {"access.log"}
    assert left(inventory.glob_exclude, ".git/**") == everything - {".git", ".git/config"}
    assert left(inventory.glob_exclude, "sub/") == everything - {"sub"}
    assert left(inventory.prune_excluded_dirs, "*/sub/") == everything - {"sub", "sub/file3.txt"}
    assert left(inventory.prune_excluded_dirs, "s?b") == everything - {"sub", "sub/file3.txt"}
    for nested in ("sub/file3.txt/**", "sub/file3.txt/", "*/sub/deep/", ".git/config/**"):
        assert left(inventory.glob_exclude, nested) == left(inventory.prune_excluded_dirs, nested) == everything
    assert left(inventory.glob_exclude, "sub/deep/**", "file[^1].txt") == everything - {"file2.txt", "sub/file3.txt"}


def test_addresses(spark):
    addresses = ["10.1.2.3:80", "10.1.2.3", "11.0.0.1:1", "10.1.2.300", "host", "[2001:db8::1]:22", "::1", "fe80::1%eth0"]
    assert many(spark, addresses, "string", lambda c: network.ip_allowed(c, ["10.0.0.0/8", "2001:db8::/32"])) == [
        True, True, False, False, False, True, False, False]
    assert many(spark, addresses[:3], "string", lambda c: network.ip_allowed(c, [])) == [False] * 3
    df = spark.createDataFrame([(a,) for a in addresses[:5]], "addr string")
    ranges = spark.createDataFrame([("10.1.0.0/16",), ("11.0.0.1",), ("bad",)], "cidr string")
    assert {r["addr"] for r in ip_range_semi(df, ranges).collect()} == {"10.1.2.3:80", "10.1.2.3", "11.0.0.1:1"}


def chunk_table(spark, payloads, arrivals=None):
    rows = [("s", seq, bytes(p, "ascii"), n) for n, (seq, p) in enumerate(payloads)]
    return spark.createDataFrame(rows, "session_id string, global_seq long, payload binary, arrival long").withColumn(
        "length", F.octet_length("payload").cast("long"))


def whole(spark, df, mode, per_part=32):
    parts = reassembly.reassemble(df, mode, per_part).orderBy("part_no").collect()
    return b"".join(bytes(p["payload"]) for p in parts)


def test_reassembly(spark):
    shuffled = chunk_table(spark, [(2, "CCCC"), (0, "AAAA"), (1, "BBBB")])
    assert whole(spark, shuffled, "lazy") == b"AAAABBBBCCCC" == whole(spark, shuffled, "eager", per_part=2)
    six = chunk_table(spark, [(i, ch * 2) for i, ch in enumerate("ABCDEF")])
    assert whole(spark, six, "eager", per_part=4) == b"AABBCCDDEEFF"
    gap = chunk_table(spark, [(0, "AA"), (1, "BB"), (3, "DD")])
    assert whole(spark, gap, "eager") == b"AABB" and whole(spark, gap, "lazy") == b""
    status_row = reassembly.assembly_status(gap, "lazy").first()
    assert (status_row["can_assemble"], status_row["first_missing_seq"]) == (False, 2)
    copies = chunk_table(spark, [(0, "AA"), (1, "BB"), (0, "XX")])
    first = {r["global_seq"]: bytes(r["payload"]) for r in sequences.dedupe_chunks(copies).collect()}
    last = {r["global_seq"]: bytes(r["payload"]) for r in sequences.dedupe_chunks(copies, "last_pending").collect()}
    assert first == {0: b"AA", 1: b"BB"} and last == {0: b"XX", 1: b"BB"}
    late = sequences.late_and_duplicate_chunks(copies).collect()
    assert [(r["global_seq"], bytes(r["payload"])) for r in late] == [(0, b"XX")]


def test_digests_stream_long_sessions(spark):
    import hashlib

    chunks = chunk_table(spark, [(i, f"{i:03d}") for i in reversed(range(100))])
    want = hashlib.sha256(b"".join(b"%03d" % i for i in range(100))).hexdigest()
    row = reassembly.session_digests(chunks).first()
    assert (row["sha256"], row["total_bytes"]) == (want, 300)
    prefix = spark.createDataFrame([("s", 4)], "session_id string, frontier long")
    copied = chunks.unionByName(chunks.withColumns({"arrival": F.col("arrival") + 1000, "payload": F.lit(b"late")}))
    row = reassembly.session_digests(copied, prefix, ["arrival"]).first()
    assert (row["sha256"], row["total_bytes"]) == (hashlib.sha256(b"000001002003").hexdigest(), 12)


def test_no_sort_aggregate_over_payloads(spark):
    chunks = chunk_table(spark, [(i, f"{i:03d}") for i in range(9)]).withColumn("length", F.lit(3).cast("long"))
    trailers = spark.createDataFrame([("s", "x", 27)], "session_id string, sha256 string, size long")
    for result in (audit.audit_payloads(chunks, trailers), reassembly.reassemble(chunks)):
        assert "SortAggregate" not in result._jdf.queryExecution().sparkPlan().toString()


def test_rejected_and_headless_sessions(spark):
    rows = [("all bad", 0, 0), ("all bad", 1, 40_000_000), ("headless", 1, 10), ("fine", 0, 5), ("fine", 0, 5)]
    chunks = spark.createDataFrame([(*r, 1) for r in rows], "session_id string, global_seq long, length long, arrival long")
    eager = {r.session_id: (r.verdict, r.total_bytes, r.rejected_chunks) for r in audit.audit_transfer(chunks, "eager").collect()}
    assert eager == {"all bad": ("write_error", 0, 2), "headless": ("write_error", 10, 0), "fine": ("ok", 5, 0)}
    lazy = {r.session_id: r.verdict for r in audit.audit_transfer(chunks).collect()}
    assert lazy == {"all bad": "write_error", "headless": "missing_chunks", "fine": "ok"}


def test_late_arrivals_with_ties(spark):
    rows = [("s", 0, 5, "a"), ("s", 0, 5, "b"), ("s", 0, 5, "b"), ("s", 1, 1, "c"), ("s", 2, 1, "d"), ("s", 2, 1, "d")]
    late = sequences.late_and_duplicate_chunks(spark.createDataFrame(rows, "session_id string, global_seq long, arrival long, v string"))
    assert sorted((r.global_seq, r.v) for r in late.collect()) == [(0, "b"), (0, "b"), (2, "d")]


def test_verdicts(spark):
    trailers = spark.createDataFrame(
        [("a", "x", 3), ("b", "y", 3), ("c", "x", 4), ("d", "x", 3)], "session_id string, sha256 string, size long")
    digests = spark.createDataFrame(
        [("a", "x", 3), ("b", "x", 3), ("c", "x", 3), ("d", "x", 0)], "session_id string, sha256 string, total_bytes long")
    want = {"a": "ok", "b": "checksum_mismatch", "c": "write_error", "d": "write_error"}
    assert {r[0]: r["result"] for r in reassembly.verify_session(digests, trailers).collect()} == want
    single = reassembly.verify_session(digests, trailers, "single")
    assert {r[0]: r["result"] for r in single.collect()} == want | {"c": "ok"}


def test_audit_is_arrival_order_free(spark):
    import random

    payloads = [(i, chr(65 + i % 26) * 5) for i in range(60) if i != 40]
    rows = payloads + payloads[:10]
    results = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        r = audit.audit_transfer(chunk_table(spark, rows), width=7).first()
        results.add((r["received_chunks"], r["duplicates"], r["next_expected_seq"], r["gap_chunks"], r["verdict"]))
    assert results == {(59, 10, 40, 1, "missing_chunks")}


def test_chunking(spark):
    df = spark.createDataFrame([(1, bytearray(b"abcdefg")), (2, bytearray(b""))], "id long, body binary")
    rows = reassembly.chunk_payloads(df, "id", "body", 3, [0, 2]).orderBy("global_seq").collect()
    assert [(r["global_seq"], r["slot_id"], r["length"], bytes(r["payload"])) for r in rows] == [
        (0, 0, 3, b"abc"), (1, 2, 3, b"def"), (2, 0, 1, b"g")]
    assert [r["crc32"] for r in rows][0] == 0x352441C2
    with pytest.raises(ValueError):
        reassembly.chunk_payloads(df, "id", "body", 3, [])


def bucket(name, mode, asynchronous, strategy=None, retain=0):
    return ("s", name, f"{name}/", mode, retain, strategy, asynchronous)


BUCKETS = "storage string, name string, prefix string, bmode string, retain long, sync_strategy string, async_upload boolean"


@pytest.mark.parametrize("buckets,want", [
    ([bucket("a", "archive", True)], False), ([bucket("a", "sync", True)], True), ([bucket("a", "sync", False)], False),
    ([bucket("a", "sync", True), bucket("b", "sync", False)], False),
    ([bucket("a", "sync", True), bucket("b", "archive", False)], True),
])
def test_should_async(spark, buckets, want):
    assert mirroring.should_async(spark.createDataFrame(buckets, BUCKETS)).first()["should_async"] is want


def test_retro_sync(spark):
    local = [("s", "agent1", f"2026-03-0{d}T00-00-00-000.tar.gz", f"agent1/daily/2026-03-0{d}T00-00-00-000.tar.gz", 5)
             for d in (1, 2, 3)]
    backups = spark.createDataFrame(local, "storage string, agent string, file_name string, rel_path string, size long")
    buckets = spark.createDataFrame([bucket("backups", "sync", False)], BUCKETS)
    remote = spark.createDataFrame([("s", "backups", "backups/agent1/daily/2026-03-01T00-00-00-000.tar.gz")],
                                   "storage string, bucket string, key string")
    plan = mirror.plan_retro_sync(backups, buckets, remote)
    total = mirror.retro_sync_totals(plan).filter("storage is null").first()
    assert (total["uploaded"], total["skipped"], total["errors"]) == (2, 1, 0)


def test_retention_counts(spark):
    rows = [("s", "a", f"2026-02-0{d}T02-00-00.tar.gz", 3) for d in range(1, 6)]
    df = spark.createDataFrame(rows, "storage string, agent string, file_name string, max_backups long")
    assert {r["file_name"][:10] for r in retention.retention_candidates(df).collect()} == {"2026-02-01", "2026-02-02"}
    objects = spark.createDataFrame(
        [("s", "b", f"p/{n}", "p/", 3) for n in range(5)] + [("s", "b", "q/0", "p/", 3)],
        "storage string, bucket string, key string, prefix string, retain long")
    assert {r["key"] for r in retention.bucket_retention(objects).collect()} == {"p/0", "p/1"}


def test_post_commit_order(spark):
    buckets = spark.createDataFrame([
        bucket("eff", "sync", False, "space_efficient"), bucket("safe", "sync", False, "safe"),
        bucket("off", "offload", False, None, 3), bucket("arc", "archive", False, None, 3)], BUCKETS)
    commits = spark.createDataFrame([("s", "a", "new.tar.gz")], "storage string, agent string, file_name string")
    rotated = spark.createDataFrame(
        [("s", "a", "old.tar.gz", True)], "storage string, agent string, file_name string, newest_removed boolean")
    plan = mirror.plan_post_commit(commits, rotated, buckets).orderBy("bucket", "step").collect()
    actions = {}
    for r in plan:
        actions.setdefault(r["bucket"], []).append((r["action"], r["key"]))
    assert actions == {
        "eff": [("delete_remote", "eff/old.tar.gz"), ("upload", "eff/new.tar.gz")],
        "safe": [("upload", "safe/new.tar.gz"), ("delete_remote", "safe/old.tar.gz")],
        "off": [("upload", "off/new.tar.gz"), ("delete_local", "new.tar.gz"), ("rotate_bucket", "off/")],
        "arc": [("upload_rotated", "arc/old.tar.gz"), ("rotate_bucket", "arc/")],
    }


def test_log_lines(spark):
    lines = ['{"msg":"chunk_received","globalSeq":3}', '{"msg":"chunk_received","globalSeq":"4"}', "", "  ", "not json",
             "[1,2]", '{"msg":"chunk_received","globalSeq":4.5}', '{"msg":"missing_chunk_in_assembly","missingSeq":"7"}', '{"msg":']
    parsed = logs.parse_session_log(spark.createDataFrame([(s,) for s in lines], "value string")).collect()
    assert [r["line_tag"] for r in parsed] == ["valid", "valid", "blank", "blank", "invalid", "invalid", "valid", "valid", "invalid"]
    assert [r["seq"] for r in parsed if r["line_tag"] == "valid"] == [3, 4, None, None]
    assert parsed[7]["missing_seq"] == 7


def test_forensic_report(spark):
    names = {"s": "chunk_receive_started", "r": "chunk_received", "k": "ChunkSACK sent", "f": "chunk_receive_failed",
             "m": "missing_chunk_in_assembly"}

    def log(session, **sets):
        return [(session, names[kind], seq) for kind, seqs in sets.items() for seq in seqs]

    rows = log("clean", s=[0, 1, 2], r=[0, 1, 2], k=[0, 1, 2]) + log("nosack", r=[5, 6]) + log(
        "bad", s=[0, 1, 2, 9], r=[0, 1, 4], k=[0], f=[7], m=[8]) + log("many", r=[2 * i for i in range(20)])
    rows.append(("void", None, None))
    report = {r["session_id"]: r for r in forensics.forensic_report(
        spark.createDataFrame(rows, "session_id string, msg string, seq long")).collect()}
    assert {k: r["exit_code"] for k, r in report.items()} == {"clean": 0, "nosack": 0, "bad": 1, "many": 1, "void": 2}
    bad = report["bad"]
    assert (bad["received_gaps_text"], bad["started_minus_received_text"], bad["failed_minus_received_text"],
            bad["explicit_missing_text"], bad["received_minus_sacked_text"]) == ("2-3", "2, 9", "7", "8", "1, 4")
    assert report["nosack"]["received_minus_sacked_text"] == "nenhum" and report["nosack"]["first_seq"] == 5
    assert report["many"]["received_gaps_text"].endswith("23, ... (+7 intervalos)")


def test_stores(spark, tmp_path):
    path = str(tmp_path / "events.jsonl")
    (tmp_path / "events.jsonl").write_text(
        '{"timestamp":"2025-01-01T00:00:00Z","level":"info","type":"test","message":"ok"}\nthis is not json\n'
        '{"timestamp":"2025-01-01T00:01:00Z","level":"warn","type":"test","message":"also ok"}\n\n[{"level":"x"}]\n')
    read = stores.read_jsonl_tolerant(spark, path, EVENTS)
    assert [r["message"] for r in read.orderBy("timestamp").collect()] == ["ok", "also ok"]
    assert stores.read_jsonl_tolerant(spark, str(tmp_path / "none"), EVENTS).count() == 0
    fifty = spark.range(50).select("id")
    assert [r["id"] for r in tails.recent(fifty, 10, ["id"]).collect()] == list(range(40, 50))
    assert tails.recent(fifty, 0, ["id"]).count() == 50
    appended = str(tmp_path / "store")
    stores.append_store(read, appended)
    stores.append_store(read, appended)
    stores.compact_store(spark, appended, str(tmp_path / "trimmed"), EVENTS, 3, ["timestamp"])
    assert [r["message"] for r in stores.read_jsonl_tolerant(spark, str(tmp_path / "trimmed"), EVENTS).collect()] == ["also ok"]
    assert tails.trim_store(fifty, 20, ["id"]).count() == 10 and tails.trim_store(fifty, 50, ["id"]).count() == 50


def test_snapshots_of_session(spark):
    rows = [("s1", 10, 0), ("s2", 20, 0), ("s1", 30, 60)]
    df = spark.createDataFrame(rows, "session_id string, bytes_received long, ts long")
    assert tails.filter_session(df, "", 0, ["ts"]).count() == 3
    assert [r["bytes_received"] for r in tails.filter_session(df, "s1", 10, ["ts"]).collect()] == [10, 30]
    assert tails.filter_session(df, "s1", 1, ["ts"]).first()["bytes_received"] == 30


def test_csv_export(spark, tmp_path):
    rows = [("2025-01-01", "info", "t", None, 'say "hi", all')]
    df = spark.createDataFrame(rows, "timestamp string, level string, type string, agent string, message string")
    stores.export_events(df, str(tmp_path / "out"), "csv")
    lines = {line for part in (tmp_path / "out").glob("part-*.csv") for line in part.read_text().splitlines()}
    assert '"2025-01-01","info","t","","say ""hi"", all"' in lines


def test_listings(spark, tmp_path):
    for name in ("2026-03-01.tar.gz", "2026-03-02.tar.zst", "notes.txt", "agent2/weekly/backup.tar.gz",
                 "chunks_abc/00/00/chunk.tar.gz", ".tmp/x"):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"12345")
    found = listings.scan_backups(spark, str(tmp_path)).collect()
    assert [r["rel_path"] for r in found] == ["2026-03-01.tar.gz", "2026-03-02.tar.zst", "agent2/weekly/backup.tar.gz"]
    (tmp_path / "void").mkdir()
    (tmp_path / "none.txt").write_bytes(b"")
    (tmp_path / "link").symlink_to("notes.txt")
    entries = listings.scan_inventory(spark, [str(tmp_path)], ["chunks_*/", "*.zst"])
    root = str(tmp_path).lstrip("/")
    names = {r["rel_path"][len(root):].lstrip("/"): r["entry_type"] for r in entries.collect()}
    assert names == {
        "": "dir", "2026-03-01.tar.gz": "file", "notes.txt": "file", "none.txt": "file", "link": "symlink",
        "void": "dir", "agent2": "dir", "agent2/weekly": "dir", "agent2/weekly/backup.tar.gz": "file", ".tmp": "dir",
        ".tmp/x": "file",
    }
    total = inventory.prescan(entries).first()
    assert (total["total_objects"], total["total_bytes"]) == (11, 20)
    both = listings.scan_inventory(spark, [str(tmp_path), str(tmp_path / "agent2"), str(tmp_path / "absent")])
    assert both.filter(F.col("rel_path").endswith("backup.tar.gz")).count() == 2


def test_status_words(spark):
    now = dt.datetime(2026, 1, 1, 12)
    moments = [now - dt.timedelta(seconds=s) for s in (1, 10, 59, 60)]
    assert many(spark, moments, "timestamp", lambda c: status.session_status(c, F.lit(now))) == [
        "running", "idle", "idle", "degraded"]
    assert many(spark, [49, 50, 80, None], "int", lambda c: status.usage_band(c, "agents")) == ["low", "med", "high", "low"]
    assert many(spark, ["WARNING", "x", None, "Debug"], "string", status.normalize_level) == ["warn", "info", "info", "debug"]
    assert one(spark, status.flow_hint(F.lit(5.0), F.lit(10.0), F.lit(3))) == "Producer-Limited"
    assert one(spark, status.bottleneck(F.lit(101), F.lit(100))) == "network"


def test_metrics_without_input(spark):
    sessions = spark.createDataFrame([], "mode string, active_streams long")
    agents = spark.createDataFrame([], "agent string")
    row = rollups.metrics_snapshot(sessions, agents, F.count("*")).first()
    assert (row["sessions"], row["active_streams"], row["connected_agents"]) == (0, 0, 0)
    assert mirroring.upload_summary(spark.createDataFrame([], "success boolean")).first()["success_pct"] == 0


def test_storage_usage(spark):
    gib = 1 << 30
    storages = spark.createDataFrame([("s", "main", 5, 100 * gib), ("t", "none", 5, 0)],
                                     "storage string, name string, max_backups long, total_bytes long")
    backups = spark.createDataFrame([("s", 20 * gib)] * 3, "storage string, size long")
    rows = {r["storage"]: r for r in mirroring.storage_usage(backups, storages).collect()}
    assert (rows["s"]["backups_count"], rows["s"]["free_bytes"], rows["s"]["usage_percent"]) == (3, 40 * gib, 60.0)
    assert rows["t"]["usage_percent"] == 0.0


def test_stall_reasons(spark):
    rows = [("a", t, b) for t, b in [(0, 1), (10, 5), (45, 5), (50, 6), (2000, 7)]]
    df = spark.createDataFrame(rows, "k string, s long, b long").withColumn("ts", F.timestamp_seconds("s"))
    found = timeline.stall_detect(df, ["k"], ["ts"], F.floor(F.col("s") / 20), "ts", F.col("b"), 30, 1800)
    assert {(r["s"], r["reason"]) for r in found.collect()} == {(45, "stalled"), (2000, "timeout")}


def test_summary_of_sessions_without_streams(spark):
    """Every session is a row: without streams it counts nothing; a single one keeps its own bytes and has no stream list."""
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    fields = "session_id long, mode string, objects_sent long, total_objects long, walk_complete boolean, elapsed_s long, closing boolean, phase string, bytes_received long"
    sessions = spark.createDataFrame([(1, "single", 0, 0, False, 1, False, "receiving", 5), (2, "parallel", 0, 0, False, 1, False, "receiving", 7),
                                      (3, "parallel", 0, 0, False, 1, False, "receiving", 9)], fields)
    streams = spark.createDataFrame([(2, 0, 40, "receiving", 1.5), (2, 1, 2, "idle", 0.5), (1, 0, 99, "receiving", 1.0)],
                                    "session_id long, slot long, offset long, slot_status string, mbps double")
    streams = streams.withColumn("last_activity", F.lit("2024-01-01 00:09:58").cast("timestamp"))
    rows = {r.session_id: r for r in rollups.session_detail(sessions, streams, now).collect()}
    assert {k: (r.bytes_received, r.active_streams) for k, r in rows.items()} == {1: (5, 1), 2: (42, 1), 3: (0, 0)}
    assert len(rows[2].streams) == 2 and rows[3].streams is None and rows[3].last_activity is None


def _log_sets(rows):
    """Sets of numbers per session, and the ranges of each category, number by number."""
    from haulmark.operators.forensics import MESSAGES

    sets = {}
    for session, msg, seq in rows:
        if msg in MESSAGES and seq is not None:
            sets.setdefault(session, {name: set() for name in MESSAGES.values()})[MESSAGES[msg]].add(seq)
    found = {}
    for session, s in sets.items():
        r = s["received"]
        categories = {"explicit_missing": s["explicit_missing"], "started_minus_received": s["started"] - r, "failed_minus_received": s["failed"] - r,
                      "received_minus_sacked": r - s["sacked"] if s["sacked"] else set()}
        for category, numbers in categories.items():
            for n in sorted(numbers):
                runs = found.setdefault((session, category), [])
                if runs and runs[-1][1] == n - 1:
                    runs[-1][1] = n
                else:
                    runs.append([n, n])
        gaps = [[a + 1, b - 1] for a, b in zip(sorted(r), sorted(r)[1:]) if b > a + 1]
        if gaps:
            found[session, "received_gaps"] = gaps
    return sets, found


@pytest.mark.parametrize("seed", range(3))
def test_log_sets_against_number_by_number(spark, seed):
    """Runs over many words, at the edges of words, negative numbers, unknown and missing messages."""
    import random

    from haulmark.operators import forensics as sets_of
    from haulmark.operators.forensics import MESSAGES

    dice = random.Random(seed)
    rows = []
    for session in range(12):
        for _ in range(dice.randrange(1, 30)):
            start, msg = dice.choice([-130, -64, -1, 0, 1, 62, 63, 64, 127, 128, 1000, 10**12, dice.randrange(600)]), dice.choice(list(MESSAGES))
            rows += [(session, msg, start + i) for i in range(dice.choice([1, 1, 2, 3, 64, 65, 200]))]
    rows += dice.sample(rows, 50) + [(1, None, None), (1, "other", 5), (2, "chunk_received", None), (50, None, None), (51, "other", 3)]
    log = spark.createDataFrame(rows, "session_id long, msg string, seq long")
    sets, ranges = _log_sets(rows)
    got = {}
    for r in forensics.finding_ranges(log).orderBy("range_start").collect():
        got.setdefault((r.session_id, r.category), []).append([r.range_start, r.range_end])
    assert got == ranges
    counted = {r.session_id: {k: r[k] for k in MESSAGES.values()} for r in sets_of.distinct_seq_sets(log).collect()}
    assert counted == {s: {k: len(x) for k, x in v.items()} for s, v in sets.items()}
    listed = {(r.session_id, r.category, r.seq) for r in sets_of.set_differences(log).collect()}
    assert listed == {(s, c, n) for (s, c), runs in ranges.items() if "minus" in c for a, b in runs for n in range(a, b + 1)}
    for limit in (2, 12):
        report = {r.session_id: r for r in forensics.forensic_report(log, limit).collect()}
        assert set(report) == {r[0] for r in rows}
        for s, row in report.items():
            for c in forensics.CATEGORIES:
                runs = ranges.get((s, c), [])
                text = ", ".join([str(a) if a == b else f"{a}-{b}" for a, b in runs[:limit]] + ([f"... (+{len(runs) - limit} intervalos)"] if len(runs) > limit else []))
                assert (row[f"{c}_count"], row[f"{c}_text"]) == (sum(b - a + 1 for a, b in runs), text or "nenhum")
            own = sets.get(s, {}).get("received", set())
            assert (row.received_chunks, row.first_seq, row.last_seq) == (len(own), min(own, default=None), max(own, default=None))
            assert row.valid_lines == sum(x[0] == s and x[1] is not None for x in rows)
    verdicts = {r.session_id: (r.problem, r.exit_code) for r in forensics.log_verdict(log).collect()}
    assert verdicts == {s: (bool(code == 1), code) for s, code in ((s, row.exit_code) for s, row in report.items())}
    assert verdicts[50] == (False, 2) and verdicts[51] == (False, 0)


def _contains(address, network):
    """Is the address inside, by the standard library; an IPv4 address as IPv6 counts as IPv4 on both sides, one with a zone lies nowhere."""
    import ipaddress

    def plain(text):
        if text.startswith("["):
            text = text[1:text.index("]")]
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return None
        if "%" in text:
            return None
        return getattr(ip, "ipv4_mapped", None) or ip

    try:
        base, _, size = network.partition("/")
        ip, host = plain(address), plain(base)
        length = int(size) - (96 if ":" in base and host.version == 4 else 0) if size else host.max_prefixlen
        inside = ipaddress.ip_network(f"{host}/{length}", strict=False)
    except (ValueError, AttributeError):
        return False
    return ip is not None and ip.version == inside.version and ip in inside


def test_ranges_of_both_families(spark):
    import random

    dice = random.Random(4)
    v4 = lambda: ".".join(str(dice.choice([0, 1, 10, 127, 128, 255, dice.randrange(256)])) for _ in range(4))
    v6 = lambda: ":".join(f"{dice.choice([0, 1, 0x8000, 0xFFFF, dice.randrange(65536)]):x}" for _ in range(8))
    networks = [f"{v4()}/{dice.randrange(2, 33)}" for _ in range(25)] + [f"{v6()}/{dice.randrange(3, 129)}" for _ in range(40)]
    networks += ["192.168.1.5", "fe80::1", "2001:db8::/32", "2001:db8:5::/48", "2001:db8::/127", "::ffff:9.8.0.0/112", "1.2.3.4/33", "1.2.3.4/x", "::1/129", "x", "", None, "1.2.3.4/", "/8"]
    addresses = [v4() for _ in range(60)] + [v6() for _ in range(60)]
    for n in [n for n in networks if n and "/" in n]:  # the network itself, and the same bits one before and after its end
        addresses.append(n.split("/")[0])
    addresses += ["192.168.1.5", "192.168.1.5:80", "[fe80::1]:99", "[fe80::1]", "fe80::2", "2001:DB8:5::9", "2001:db9::", "::ffff:9.8.7.6", "9.8.7.6", "::9.8.7.6", "::", "1::2::3", "1:2:3:4:5:6:7", ":::",
                  "fe80::1%eth0", "12345::", "g::", "", None, "1:2:3:4:5:6:7::8", "1:2:3:4:5:6:1.2.3.4", "1.2.3", "2001:db8::1", "2001:db8::2"]
    table = spark.createDataFrame([(a, i) for i, a in enumerate(addresses)] + [("192.168.1.5", -1)], "addr string, n long")
    ranges = spark.createDataFrame([(n,) for n in networks], "cidr string")
    got = {r.n for r in ip_range_semi(table, ranges).collect()}
    strip = lambda a: a.rsplit(":", 1)[0] if a.count(":") == 1 else a
    assert got == {i for i, a in enumerate(addresses) if a and any(n and _contains(strip(a), n) for n in networks)} | {-1}
    for every, family in (("0.0.0.0/0", 4), ("::/0", 6)):
        hit = ip_range_semi(spark.createDataFrame([("1.2.3.4", 4), ("255.255.255.255", 4), ("::", 6), ("ffff::", 6), ("::ffff:1.1.1.1", 4)], "addr string, n int"),
                            spark.createDataFrame([(every,)], "cidr string")).collect()
        assert {r.n for r in hit} == {family}
    assert ip_range_semi(table, ranges.limit(0)).count() == 0 and ip_range_semi(table.limit(0), ranges).count() == 0


def test_search_paths():
    from haulmark.operators.lookups import probe_path

    for width in (32, 128):
        for length in range(width + 1):
            at, step, probes = width // 2, width // 4, 1
            while at != length:
                assert (at in probe_path(length, width)) == (at < length)
                at += (1 if at < length else -1) * max(step, 1)
                step, probes = step // 2, probes + 1
            assert probes <= width.bit_length()
