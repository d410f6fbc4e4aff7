"""Queries on session logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from haulmark.catalog.base import Views, query
from haulmark.operators import forensics, sequences
from haulmark.plans import forensics as report
from haulmark.session import scratch_path
from haulmark.sources import logs

MEMBERS = """m AS (SELECT session_id, seq, bool_or(msg = 'chunk_receive_started') AS started,
    bool_or(msg = 'chunk_received') AS received, bool_or(msg = 'ChunkSACK sent') AS sacked,
    bool_or(msg = 'chunk_receive_failed') AS failed, bool_or(msg = 'missing_chunk_in_assembly') AS explicit_missing
    FROM v_log GROUP BY session_id, seq)"""
DIFFS = """d AS (SELECT session_id, 'started_minus_received' AS category, seq FROM m WHERE started AND NOT received
    UNION ALL SELECT session_id, 'failed_minus_received', seq FROM m WHERE failed AND NOT received
    UNION ALL SELECT session_id, 'received_minus_sacked', seq FROM m WHERE received AND NOT sacked
              AND session_id IN (SELECT session_id FROM m WHERE sacked))"""
RANGES = """v AS (SELECT * FROM d UNION ALL SELECT session_id, 'explicit_missing', seq FROM m WHERE explicit_missing),
    i AS (SELECT session_id, category, seq, seq - row_number() OVER (PARTITION BY session_id, category ORDER BY seq)
          AS island FROM v),
    g AS (SELECT session_id, seq, lag(seq) OVER (PARTITION BY session_id ORDER BY seq) AS prev FROM m WHERE received),
    r AS (SELECT session_id, category, min(seq) AS a, max(seq) AS b FROM i GROUP BY session_id, category, island
          UNION ALL SELECT session_id, 'received_gaps', prev + 1, seq - 1 FROM g WHERE seq > prev + 1)"""
TEXTS = """n AS (SELECT *, row_number() OVER (PARTITION BY session_id, category ORDER BY a) AS k FROM r),
    t AS (SELECT session_id, category, count(*) AS range_count, CAST(sum(b - a + 1) AS BIGINT) AS value_count,
          string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a)
              FILTER (k <= 12) || CASE WHEN count(*) > 12 THEN ', ... (+' || (count(*) - 12) || ' intervalos)' ELSE ''
              END AS ranges_text FROM n GROUP BY session_id, category)"""
NAMES = report.CATEGORIES


def _lines(v: Views):
    """The event feed as session log lines, some blank, broken, no object, or with the number as text."""
    log = v.log()
    kind = F.col("event_id") % 50
    number = F.when(F.col("msg") != "missing_chunk_in_assembly", F.col("seq"))
    missing = F.when(F.col("msg") == "missing_chunk_in_assembly", F.col("seq"))
    entry = F.to_json(F.struct("msg", number.alias("globalSeq"), missing.alias("missingSeq"), "session_id"))
    quoted = F.to_json(F.struct("msg", F.col("seq").cast("string").alias("globalSeq"), "session_id"))
    text = (
        F.when(kind == 0, "   ").when(kind == 1, F.concat(F.lit("broken "), entry))
        .when(kind == 2, F.concat(F.lit("["), entry, F.lit("]"))).when(kind == 3, quoted)
        .when(kind == 4, F.substring(entry, 1, 12)).otherwise(entry)
    )
    return log.select(text.alias("value"))


LINES_SQL = """x AS (SELECT *, CASE event_id % 50 WHEN 0 THEN 'blank' WHEN 1 THEN 'invalid' WHEN 2 THEN 'invalid'
    WHEN 4 THEN 'invalid' ELSE 'valid' END AS line_tag FROM v_log)"""


@query("s3_read_session_log", f"""WITH {LINES_SQL},
    y AS (SELECT line_tag, CASE WHEN line_tag = 'valid' THEN msg END AS msg,
          CASE WHEN line_tag = 'valid' AND (msg <> 'missing_chunk_in_assembly' OR event_id % 50 = 3) THEN seq END AS seq,
          CASE WHEN line_tag = 'valid' AND msg = 'missing_chunk_in_assembly' AND event_id % 50 <> 3 THEN seq END
          AS missing_seq FROM x)
    SELECT line_tag, msg, seq, missing_seq, count(*) AS n FROM y GROUP BY ALL""")
def read_session_log(v: Views):
    path = scratch_path(v.spark, "session-log")
    _lines(v).write.text(path)
    log = logs.read_session_log(v.spark, path)
    return log.groupBy("line_tag", "msg", "seq", "missing_seq").agg(F.count("*").alias("n"))


@query("a13_log_line_counts", f"WITH {LINES_SQL} SELECT line_tag, count(*) AS lines FROM x GROUP BY line_tag")
def log_line_counts(v: Views):
    return logs.log_line_counts(logs.parse_session_log(_lines(v)))


@query("a12_distinct_seq_sets", f"""WITH {MEMBERS}
    SELECT session_id, count(*) FILTER (started) AS started, count(*) FILTER (received) AS received,
           count(*) FILTER (sacked) AS sacked, count(*) FILTER (failed) AS failed,
           count(*) FILTER (explicit_missing) AS explicit_missing FROM m GROUP BY session_id""")
def distinct_seq_sets(v: Views):
    return forensics.distinct_seq_sets(v.log())


@query("u1_set_differences", f"WITH {MEMBERS}, {DIFFS} SELECT * FROM d")
def set_differences(v: Views):
    return forensics.set_differences(v.log())


@query("o7_format_ranges", f"""WITH {MEMBERS}, {DIFFS}, {RANGES}, {TEXTS}
    SELECT session_id, category, range_count, value_count, ranges_text FROM t""")
def format_ranges(v: Views):
    return sequences.format_ranges(report.finding_ranges(v.log()), ["session_id", "category"])


@query("a14_log_verdict", f"""WITH {MEMBERS}, {DIFFS}, {RANGES},
    f AS (SELECT session_id, bool_or(category <> 'received_minus_sacked') AS problem,
          bool_or(category = 'received_minus_sacked') AS note FROM r GROUP BY session_id)
    SELECT s.session_id, coalesce(problem, false) AS problem, coalesce(note, false) AS unsacked_note,
           CAST(CASE WHEN coalesce(problem, false) THEN 1 ELSE 0 END AS INTEGER) AS exit_code
    FROM (SELECT DISTINCT session_id FROM v_log) s LEFT JOIN f ON s.session_id = f.session_id""")
def log_verdict(v: Views):
    return report.log_verdict(v.log())


@query("k13_forensic_report", f"""WITH {MEMBERS}, {DIFFS}, {RANGES}, {TEXTS},
    w AS (SELECT session_id, {', '.join(
        f"max(ranges_text) FILTER (category = '{c}') AS {c}_t, max(value_count) FILTER (category = '{c}') AS {c}_n"
        for c in NAMES)} FROM t GROUP BY session_id),
    c AS (SELECT session_id, count(*) AS received_chunks, min(seq) AS first_seq, max(seq) AS last_seq FROM m
          WHERE received GROUP BY session_id),
    l AS (SELECT session_id, count(*) AS valid_lines FROM v_log GROUP BY session_id)
    SELECT l.session_id, valid_lines, coalesce(received_chunks, 0) AS received_chunks, first_seq, last_seq,
           {', '.join(f"coalesce({c}_n, 0) AS {c}_count, coalesce({c}_t, 'nenhum') AS {c}_text" for c in NAMES)},
           CAST(CASE WHEN {' OR '.join(f"{c}_n > 0" for c in NAMES[:4])} THEN 1 ELSE 0 END AS INTEGER) AS exit_code
    FROM l LEFT JOIN c ON l.session_id = c.session_id LEFT JOIN w ON l.session_id = w.session_id""")
def forensic_report(v: Views):
    return report.forensic_report(v.log())
