"""Queries on chunk ledgers: dedupe, order, gaps, reassembly, verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from haulmark.catalog.base import Views, query
from haulmark.operators import reassembly, sequences
from haulmark.plans import audit
from haulmark.session import scratch_path

STATS_SQL = """
    WITH p AS (SELECT session_id, global_seq, length,
                      row_number() OVER (PARTITION BY session_id ORDER BY global_seq) AS rk,
                      lag(global_seq) OVER (PARTITION BY session_id ORDER BY global_seq) AS prev
               FROM v_first),
         s AS (SELECT session_id, count(*) AS received_chunks, CAST(sum(length) AS BIGINT) AS total_bytes,
                      min(global_seq) AS first_seq, max(global_seq) AS last_seq,
                      count(*) FILTER (global_seq = rk - 1) AS next_expected_seq,
                      CAST(coalesce(sum(length) FILTER (global_seq = rk - 1), 0) AS BIGINT) AS assembled_bytes,
                      count(*) FILTER (global_seq > prev + 1) AS gap_ranges,
                      CAST(coalesce(sum(global_seq - prev - 1) FILTER (global_seq > prev + 1), 0) AS BIGINT)
                          AS gap_chunks
               FROM p GROUP BY session_id)"""


@query("k12_audit_transfer", STATS_SQL + """,
         n AS (SELECT session_id, count(*) AS arrivals FROM v_chunks GROUP BY session_id)
    SELECT session_id, received_chunks, arrivals - received_chunks AS duplicates, total_bytes, first_seq, last_seq,
           next_expected_seq, received_chunks - next_expected_seq AS pending_chunks,
           total_bytes - assembled_bytes AS pending_bytes, gap_ranges, gap_chunks,
           received_chunks = next_expected_seq AS assembled,
           CASE WHEN received_chunks <> next_expected_seq THEN next_expected_seq END AS first_missing_seq,
           CAST(0 AS BIGINT) AS rejected_chunks,
           CASE WHEN total_bytes = 0 THEN 'write_error' WHEN received_chunks <> next_expected_seq
                THEN 'missing_chunks' ELSE 'ok' END AS verdict
    FROM s JOIN n USING (session_id)""")
def audit_transfer(v: Views):
    return audit.audit_transfer(v.chunks())


@query("k12_audit_transfer_eager", """
    WITH c AS (SELECT session_id, global_seq, length * CASE WHEN session_id % 7 = 3 THEN 34000000 ELSE 800000 END AS length, l_shipdate,
                      l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax FROM v_chunks),
         f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, global_seq ORDER BY l_shipdate, l_partkey,
               l_suppkey, l_extendedprice, l_discount, l_tax, length) AS rn FROM c WHERE length BETWEEN 1 AND 33554432) WHERE rn = 1),
         p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY global_seq) AS rk FROM f),
         s AS (SELECT session_id, CAST(sum(length) AS BIGINT) AS total_bytes,
               CAST(sum(CASE WHEN global_seq = rk - 1 THEN length ELSE 0 END) AS BIGINT) AS written,
               count(*) FILTER (global_seq = rk - 1) AS next_expected_seq FROM p GROUP BY session_id),
         r AS (SELECT session_id, count(*) FILTER (length NOT BETWEEN 1 AND 33554432) AS rejected_chunks FROM c GROUP BY session_id)
    SELECT r.session_id, coalesce(total_bytes, 0) AS total_bytes, coalesce(next_expected_seq, 0) AS next_expected_seq, rejected_chunks,
           CASE WHEN coalesce(written, 0) = 0 THEN 'write_error' ELSE 'ok' END AS verdict
    FROM r LEFT JOIN s ON r.session_id = s.session_id""")
def audit_transfer_eager(v: Views):
    """Some sessions have only chunks that are too long; many lack their first chunk."""
    factor = F.when(F.col("session_id") % 7 == 3, 34_000_000).otherwise(800_000)
    audited = audit.audit_transfer(v.chunks().withColumn("length", F.col("length") * factor), "eager")
    return audited.select("session_id", "total_bytes", "next_expected_seq", "rejected_chunks", "verdict")


@query("k12_audit_payloads", """
    SELECT session_id, CAST(sum(octet_length(encode(payload))) AS BIGINT) AS total_bytes,
           CASE session_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'checksum_mismatch' ELSE 'write_error' END AS result
    FROM v_conv GROUP BY session_id""")
def audit_payloads(v: Views):
    chunks = v.conv().withColumns(
        {"length": F.octet_length("payload").cast("long"), "arrival": F.col("global_seq")}
    )
    return audit.audit_payloads(chunks, _trailers(v))


@query("k12_audit_payloads_damaged", """
    WITH k AS (SELECT session_id, global_seq, payload FROM v_conv
               WHERE NOT (session_id % 5 = 1 AND global_seq = 1) AND NOT (session_id % 5 = 2 AND global_seq = 2)),
         p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY global_seq) AS rk FROM k),
         d AS (SELECT session_id, CAST(sum(octet_length(encode(payload))) AS BIGINT) AS total_bytes,
                      sha256(string_agg(payload, '' ORDER BY global_seq)) AS digest FROM p WHERE global_seq = rk - 1 GROUP BY session_id),
         t AS (SELECT session_id, CAST(sum(octet_length(encode(payload))) AS BIGINT) AS size,
                      sha256(string_agg(payload, '' ORDER BY global_seq)) AS sha256 FROM v_conv GROUP BY session_id)
    SELECT t.session_id, coalesce(total_bytes, 0) AS total_bytes, CASE WHEN coalesce(total_bytes, 0) = 0 THEN 'write_error'
           WHEN digest <> sha256 THEN 'checksum_mismatch' WHEN total_bytes <> size THEN 'write_error' ELSE 'ok' END AS result
    FROM t LEFT JOIN d ON t.session_id = d.session_id""")
def audit_payloads_damaged(v: Views):
    """Lost chunks, chunks damaged on the way, and later copies with other payloads."""
    sent = v.conv().withColumns({"crc32": F.crc32("payload"), "length": F.octet_length("payload").cast("long"), "arrival": F.col("global_seq")})
    copies = sent.withColumns({"payload": F.encode(F.lit("a later copy"), "UTF-8"), "arrival": F.col("arrival") + 1000}).withColumns(
        {"crc32": F.crc32("payload"), "length": F.octet_length("payload").cast("long")})
    lost = (F.col("session_id") % 5 == 1) & (F.col("global_seq") == 1)
    hit = (F.col("session_id") % 5 == 2) & (F.col("global_seq") == 2)
    arrived = sent.filter(~lost).withColumn("payload", F.when(hit, F.encode(F.lit("damaged"), "UTF-8")).otherwise(F.col("payload")))
    trailers = reassembly.session_digests(v.conv()).withColumnRenamed("total_bytes", "size")
    return audit.audit_payloads(arrived.unionByName(copies.filter(~lost & ~hit)), trailers)


def _trailers(v: Views):
    """Trailers for conversations: a third right, a third with a wrong digest, a third with a wrong size."""
    whole = reassembly.session_digests(v.conv())
    kind = F.col("session_id") % 3
    return whole.select(
        "session_id",
        F.when(kind == 1, F.sha2(F.encode("sha256", "UTF-8"), 256)).otherwise(F.col("sha256")).alias("sha256"),
        F.when(kind == 2, F.col("total_bytes") + 1).otherwise(F.col("total_bytes")).alias("size"),
    )


@query("f14_valid_chunk", """
    SELECT length > 10 AND length <= 40 AS in_range, count(*) AS chunks, CAST(sum(length) AS BIGINT) AS bytes
    FROM v_chunks WHERE length * 800000 BETWEEN 1 AND 33554432 GROUP BY ALL""")
def valid_chunk(v: Views):
    scaled = v.chunks().withColumns({"units": F.col("length"), "length": F.col("length") * 800000})
    return (
        sequences.valid_chunks(scaled)
        .groupBy(((F.col("units") > 10) & (F.col("units") <= 40)).alias("in_range"))
        .agg(F.count("*").alias("chunks"), F.sum("units").alias("bytes"))
    )


@query("f14_rejected_chunks", """
    SELECT session_id, global_seq, length * 800000 AS length FROM v_chunks WHERE length * 800000 > 33554432""")
def rejected_chunks(v: Views):
    scaled = v.chunks().withColumn("length", F.col("length") * 800000)
    return sequences.rejected_chunks(scaled).select("session_id", "global_seq", "length")


@query("w1_dedupe_chunks", "SELECT session_id, global_seq, slot_id, length FROM v_first")
def dedupe_chunks(v: Views):
    return sequences.dedupe_chunks(v.chunks()).select("session_id", "global_seq", "slot_id", "length")


@query("w1_dedupe_chunks_last_pending", """
    SELECT session_id, global_seq, slot_id, length FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id, global_seq ORDER BY l_shipdate DESC, l_partkey DESC,
            l_suppkey DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, length DESC) AS rn FROM v_chunks)
    WHERE rn = 1""")
def dedupe_chunks_last(v: Views):
    return sequences.dedupe_chunks(v.chunks(), keep="last_pending").select(
        "session_id", "global_seq", "slot_id", "length"
    )


@query("w2_contiguous_prefix", """
    SELECT session_id, global_seq, length,
           global_seq = row_number() OVER (PARTITION BY session_id ORDER BY global_seq) - 1 AS assembled
    FROM v_first""")
def contiguous_prefix(v: Views):
    firsts = sequences.dedupe_chunks(v.chunks())
    return sequences.contiguous_prefix(firsts).select("session_id", "global_seq", "length", "assembled")


@query("a2_chunk_session_stats", STATS_SQL + """
    SELECT session_id, next_expected_seq, assembled_bytes, received_chunks, total_bytes, first_seq, last_seq,
           gap_ranges, gap_chunks, received_chunks - next_expected_seq AS pending_chunks,
           total_bytes - assembled_bytes AS pending_bytes, last_seq + 1 AS total_chunks_lazy,
           next_expected_seq AS total_chunks_eager, received_chunks = next_expected_seq AS assembled,
           CASE WHEN received_chunks = next_expected_seq THEN 'done' ELSE 'receiving' END AS phase
    FROM s""")
def chunk_session_stats(v: Views):
    return sequences.chunk_session_stats(sequences.dedupe_chunks(v.chunks())).drop("duplicates")


@query("w3_missing_ranges", """
    SELECT session_id, prev + 1 AS range_start, global_seq - 1 AS range_end FROM (
        SELECT session_id, global_seq, lag(global_seq) OVER (PARTITION BY session_id ORDER BY global_seq) AS prev
        FROM v_first) WHERE global_seq > prev + 1""")
def missing_ranges(v: Views):
    return sequences.missing_ranges(v.chunks(), ["session_id"], "global_seq")


@query("w4_values_to_ranges", """
    SELECT session_id, min(global_seq) AS range_start, max(global_seq) AS range_end FROM (
        SELECT session_id, global_seq,
               global_seq - row_number() OVER (PARTITION BY session_id ORDER BY global_seq) AS island FROM v_first)
    GROUP BY session_id, island""")
def values_to_ranges(v: Views):
    return sequences.values_to_ranges(v.chunks(), ["session_id"], "global_seq")


@query("t5_late_and_duplicate_chunks", """
    SELECT session_id, global_seq, length, slot_id FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id, global_seq ORDER BY l_shipdate, l_partkey, l_suppkey,
            l_extendedprice, l_discount, l_tax, length) AS rn FROM v_chunks) WHERE rn > 1""")
def late_and_duplicate_chunks(v: Views):
    return sequences.late_and_duplicate_chunks(v.chunks()).select("session_id", "global_seq", "length", "slot_id")


@query("t5_late_ties", """
    WITH c AS (SELECT session_id, global_seq, CAST(l_shipdate AS DATE) AS day, length % 3 AS length FROM v_chunks),
         d AS (SELECT * FROM c UNION ALL SELECT * FROM c WHERE session_id % 2 = 0)
    SELECT session_id, global_seq, length FROM (SELECT *, row_number() OVER (PARTITION BY session_id, global_seq ORDER BY day, length) AS rn
        FROM d) WHERE rn > 1""")
def late_ties(v: Views):
    """Arrivals known to the day only, and rows that repeat as a whole."""
    coarse = v.chunks().select("session_id", "global_seq", F.col("arrival.ts").cast("date").alias("arrival"), (F.col("length") % 3).alias("length"))
    both = coarse.unionByName(coarse.filter("session_id % 2 = 0"))
    return sequences.late_and_duplicate_chunks(both).select("session_id", "global_seq", "length")


@query("a3_reassemble", """
    SELECT session_id, CAST(global_seq // 4 AS BIGINT) AS part_no, count(*) AS chunks,
           CAST(sum(octet_length(encode(payload))) AS BIGINT) AS bytes,
           sha256(string_agg(payload, '' ORDER BY global_seq)) AS sha256
    FROM v_conv GROUP BY ALL""")
def reassemble(v: Views):
    return reassembly.reassemble(v.conv()).select(
        "session_id", "part_no", "chunks",
        F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("sha256"),
    )


@query("a3_reassemble_lazy", """
    WITH kept AS (SELECT * FROM v_conv WHERE NOT (session_id % 4 = 0 AND global_seq = 1)),
         good AS (SELECT session_id FROM kept GROUP BY session_id HAVING count(*) = max(global_seq) + 1)
    SELECT session_id, CAST(global_seq // 4 AS BIGINT) AS part_no,
           sha256(string_agg(payload, '' ORDER BY global_seq)) AS sha256
    FROM kept JOIN good USING (session_id) GROUP BY ALL""")
def reassemble_lazy(v: Views):
    kept = v.conv().filter(~((F.col("session_id") % 4 == 0) & (F.col("global_seq") == 1)))
    return reassembly.reassemble(kept, "lazy").select("session_id", "part_no", F.sha2("payload", 256).alias("sha256"))


@query("a3_assembly_status", """
    WITH kept AS (SELECT * FROM v_conv WHERE NOT (session_id % 4 = 0 AND global_seq = 1)),
         p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY global_seq) AS rk FROM kept)
    SELECT session_id, count(*) = max(global_seq) + 1 AS can_assemble,
           CASE WHEN count(*) <> max(global_seq) + 1 THEN count(*) FILTER (global_seq = rk - 1) END
               AS first_missing_seq
    FROM p GROUP BY session_id""")
def assembly_status(v: Views):
    kept = v.conv().filter(~((F.col("session_id") % 4 == 0) & (F.col("global_seq") == 1)))
    return reassembly.assembly_status(kept, "lazy")


@query("a4_verify_session", """
    SELECT session_id, CAST(sum(octet_length(encode(payload))) AS BIGINT) AS total_bytes,
           CASE session_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'checksum_mismatch' ELSE 'write_error' END AS result
    FROM v_conv GROUP BY session_id""")
def verify_session(v: Views):
    return reassembly.verify_session(reassembly.session_digests(v.conv()), _trailers(v))


@query("a15_file_checksum", """
    SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes
    FROM documents""")
def file_checksum(v: Views):
    content = v.table("documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return reassembly.file_checksum(content).drop("content")


@query("a16_partial_hash_checkpoints", """
    SELECT doc_id AS session_id, k AS "offset", sha256(unhex(substr(hex(encode(text)), 1, 2 * k))) AS partial_sha256
    FROM (SELECT doc_id, text, CAST(unnest([100, 1000, 10000]) AS BIGINT) AS k FROM documents WHERE doc_id % 3 = 1)
    WHERE octet_length(encode(text)) >= k""")
def partial_hash_checkpoints(v: Views):
    sessions = v.table("documents").select(
        F.col("doc_id").alias("session_id"),
        F.encode("text", "UTF-8").alias("content"),
        F.when(F.col("doc_id") % 3 == 1, "checksum_mismatch").otherwise("ok").alias("result"),
    )
    return reassembly.partial_hash_checkpoints(sessions, checkpoints=(100, 1000, 10000))


@query("k2_chunk_payloads", """
    WITH d AS (SELECT doc_id, hex(encode(text)) AS hx, octet_length(encode(text)) AS n FROM documents),
         c AS (SELECT doc_id, hx, n, unnest(range(0, CAST(ceil(n / 4096.0) AS BIGINT))) AS k FROM d WHERE n > 0)
    SELECT doc_id AS session_id, CAST(k AS BIGINT) AS global_seq, CAST(least(4096, n - k * 4096) AS BIGINT) AS length,
           CAST(CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END AS INTEGER) AS slot_id,
           md5(substr(hx, k * 8192 + 1, 8192)) AS payload_md5
    FROM c""")
def chunk_payloads(v: Views):
    content = v.table("documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return reassembly.chunk_payloads(content, "doc_id", "content", 4096, [0, 2, 3]).select(
        "session_id", "global_seq", "length", F.col("slot_id").cast("int").alias("slot_id"),
        F.md5(F.encode(F.hex("payload"), "UTF-8")).alias("payload_md5"),
    )


@query("x16_crc32_ok", """
    SELECT doc_id % 7 AS remainder, doc_id % 7 <> 0 AS crc_ok,
           CAST(sum(ceil(octet_length(encode(text)) / 4096.0)) AS BIGINT) AS chunks FROM documents GROUP BY ALL""")
def crc32_ok(v: Views):
    """Chunks of documents, one in seven with a damaged payload: how many pass the checksum."""
    content = v.table("documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    chunks = reassembly.chunk_payloads(content, "doc_id", "content", 4096, [0, 1])
    damaged = F.when(F.col("session_id") % 7 == 0, F.concat("payload", F.lit("x").cast("binary"))).otherwise(
        F.col("payload")
    )
    return (
        chunks.withColumn("payload", damaged)
        .groupBy((F.col("session_id") % 7).alias("remainder"), reassembly.crc32_ok().alias("crc_ok"))
        .agg(F.count("*").alias("chunks"))
    )


@query("a24_last_offset", """
    SELECT session_id, slot_id, CAST(sum(length + 13) AS BIGINT) AS last_offset FROM v_first GROUP BY ALL""")
def last_offset(v: Views):
    return reassembly.last_offset(sequences.dedupe_chunks(v.chunks()), ["session_id", "slot_id"])


@query("k3_reassemble_to_files", """
    SELECT session_id, count(*) AS chunks, sha256(string_agg(payload, '' ORDER BY global_seq)) AS sha256, true AS in_order
    FROM v_conv GROUP BY session_id""")
def reassemble_to_files(v: Views):
    """``in_order``: within a file no chunk stands before a smaller one, and files hold ranges that do not overlap."""
    path = scratch_path(v.spark, "ordered-chunks")
    reassembly.write_ordered_chunks(v.conv(), path)
    written = v.spark.read.parquet(path)
    place = F.struct("session_id", "global_seq")
    placed = written.select(place.alias("place"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    before = F.lag("place").over(Window.partitionBy("file").orderBy("row"))
    files = placed.withColumn("ok", F.coalesce(before < F.col("place"), F.lit(True))).groupBy("file").agg(
        F.min("place").alias("low"), F.max("place").alias("high"), F.bool_and("ok").alias("ok"))
    highest = F.max("high").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    ordered = files.withColumn("ok", F.col("ok") & F.coalesce(highest < F.col("low"), F.lit(True))).agg(F.bool_and("ok").alias("in_order"))
    counts = written.groupBy("session_id").agg(F.count("*").alias("chunks")).withColumn("in_order", ordered.scalar())
    return reassembly.session_digests(written).join(counts, "session_id").drop("total_bytes")
