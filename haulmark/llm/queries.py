"""The registered queries: each operator over its whole table, with the SQL of its result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.llm.centroids import cluster
from haulmark.llm.chat import Field, link_tool_calls
from haulmark.llm.common import materialize
from haulmark.llm.filter_audit import filter_audit
from haulmark.llm.hamming import sign_code, top_k
from haulmark.llm.mixing import mix, word_count
from haulmark.llm.ngram_join import ngram_join
from haulmark.llm.packing import pack
from haulmark.llm.pii import digest_columns, personal_data
from haulmark.llm.quality_classifier import quality_classifier
from haulmark.llm.quality_rules import RULES, quality_rules
from haulmark.llm.toxicity import toxicity
from haulmark.llm.url_filter import host_of, url_filter
from haulmark.llm.warc import archive_round_trip
from haulmark.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare(spark), sf_dir)

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file, the same on every machine that has the vocabulary package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUALITY_RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS win FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS times FROM windows),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) WHERE times > 1 GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
             length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
             length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS n_lower,
             coalesce(list_max(map_values(list_aggregate(ws, 'histogram'))), 0) AS top_word
      FROM w LEFT JOIN again ON w.doc_id = again.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (""" + " OR ".join(f"({rule.sql})" for rule in RULES) + """) AS kept
FROM b"""


@query("op1_quality_rules", QUALITY_RULES_SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the rule cascade for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).drop("text")


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; without SQL, as SQL cannot grow the trees."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier(docs, table(spark, sf_dir, "labels")).drop("text")


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; without SQL, as SQL cannot learn the lexicon."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).drop("text")


@query("op10_mixing")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix by weights 1, 2, 3 takes of every document; without SQL, as the draw is a sequence of moves."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("words"))
    mixed = mix(materialize(docs, "mix-words"), F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


# Fixed values of the URL contract: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
             ("block", "com", "/de/")]
#: Host labels whose pages make up the list of unwanted URLs.
UNWANTED = r"(^|\.)(ads-track|spam-farm|casino-win|adult-x|cheap-pills|free-bets)\."

URL_FILTER_SQL = r"""
WITH h AS (SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
        lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]*|ref|fbclid|gclid)(=|$)'))) AS query FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') ||
        regexp_replace(path, '/+$', '') || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS key FROM h),
listed AS (SELECT DISTINCT key FROM c WHERE key IS NOT NULL AND regexp_matches(host, '""" + UNWANTED + r"""')),
rules AS (SELECT * FROM (VALUES """ + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES) + r""") AS r(kind, rule_host, rule_path)),
fit AS (SELECT page_id, rule_host || rule_path AS rule, kind, row_number() OVER (PARTITION BY page_id
        ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path) AS place
    FROM c JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT c.page_id, host, path, fit.rule, CASE WHEN fit.rule IS NOT NULL THEN fit.kind WHEN listed.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM c LEFT JOIN fit ON c.page_id = fit.page_id AND fit.place = 1 LEFT JOIN listed ON c.key = listed.key"""


@query("op9_url_filter", URL_FILTER_SQL)
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page URL: the contract's rules, then the list of URLs seen on unwanted hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, URL_RULES, pages.filter(host_of(F.col("url")).rlike(UNWANTED))).drop("url")


NGRAM_JOIN_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS gram
      FROM w, unnest(range(1, greatest(len(ws) - 1, least(len(ws), 1) + 1))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 90 * (nx.n + ny.n - common)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON m.x = documents.doc_id"""

WARC_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT *, list_transform(range(32), lambda k: (CAST('0x' || substr(hex, k * 5 // 4 + 1, 1) AS INTEGER) * 16
    + CAST('0x' || coalesce(nullif(substr(hex, k * 5 // 4 + 2, 1), ''), '0') AS INTEGER))) AS pair FROM p),
d AS (SELECT page_id, payload_bytes, list_reduce(list_transform(range(32),
    lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((pair[k + 1] >> CAST(3 - (k * 5) % 4 AS INTEGER)) & 31) + 1, 1)),
    lambda a, b: a || b) AS payload_digest FROM bits),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM m"""


@query("op3_warc", WARC_SQL)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back from them."""
    return archive_round_trip(table(spark, sf_dir, "pages"))


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens; without SQL, as SQL cannot tokenise."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op5_ngram_join", NGRAM_JOIN_SQL)
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by word 3-grams with a similarity of 0.9 or more."""
    return ngram_join(table(spark, sf_dir, "documents"), 3, 90, 100)


HAMMING_SQL = """
WITH c AS (SELECT vec_id, list_transform(range(64), lambda k: coalesce(embedding[k + 1] > 0, false)) AS code
           FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, c.vec_id, len(list_filter(range(64), lambda k: q.code[k + 1] <> c.code[k + 1])) AS distance FROM c q JOIN c ON q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(distance AS INTEGER) AS distance FROM r WHERE rank <= 10"""


@query("op8_hamming_search", HAMMING_SQL)
def op8_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes to that of every 50th vector, among those of all vectors."""
    codes = materialize(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code")), "hamming-signs")
    found = top_k(codes, codes.filter("id % 50 = 0").withColumnRenamed("id", "qid"))
    return found.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"), "distance")


#: Tools of the conversations: a user turn asks one of them, the next assistant turn answers.
TOOLS = {
    "answer": [Field("chars", "integer"), Field("text", "string"), Field("turn", "integer")],
    "note": [Field("chars", "integer", False), Field("text", "string"), Field("turn", "integer", False)],
}

CHAT_SQL = """
WITH RECURSIVE a AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), 'null') || '-' AS conv FROM conversations),
t AS (SELECT DISTINCT conv_id, conv, turn, role, text FROM a WHERE turn IS NOT NULL),
c AS (SELECT conv_id, conv || turn AS call_id, CASE WHEN turn % 4 = 1 THEN 'note' ELSE 'answer' END AS name, text, turn,
             CASE WHEN turn >= 2 THEN conv || (turn - 2) END AS parent_id FROM t WHERE role = 'user'),
r AS (SELECT conv_id, conv || (turn - 1) AS call_id, min(text) AS content FROM t WHERE role = 'assistant' GROUP BY ALL),
p AS (SELECT c.*, q.call_id AS known FROM c LEFT JOIN c q ON c.parent_id = q.call_id),
chain AS (SELECT call_id, CAST(0 AS BIGINT) AS depth FROM p WHERE known IS NULL
    UNION ALL SELECT p.call_id, chain.depth + 1 FROM chain JOIN p ON p.known = chain.call_id),
j AS (SELECT p.*, chain.depth, r.content, r.call_id IS NOT NULL AS has_result,
    CASE WHEN length(text) % 7 = 3 THEN 'null' WHEN turn % 8 = 6 THEN to_json(CAST(turn AS VARCHAR)) ELSE to_json(turn) END AS turn_json
    FROM p JOIN chain ON p.call_id = chain.call_id LEFT JOIN r ON p.call_id = r.call_id)
SELECT conv_id, call_id, depth, has_result,
    array_to_string(list_filter([
        CASE WHEN length(text) % 7 = 3 THEN CASE WHEN name = 'answer' THEN 'missing turn' END WHEN turn % 8 = 6 THEN 'turn is no integer' END,
        CASE WHEN parent_id IS NOT NULL AND known IS NULL THEN 'unknown parent' END,
        CASE WHEN NOT has_result THEN 'no result' END], lambda e: e IS NOT NULL), '; ') AS errors,
    '{"arguments":{"chars":' || length(text) || ',"text":' || to_json(text) || CASE WHEN turn_json = 'null' THEN '' ELSE ',"turn":' || turn_json END
    || '},"id":' || to_json(call_id) || ',"name":' || to_json(name) || CASE WHEN parent_id IS NULL THEN '' ELSE ',"parent":' || to_json(parent_id) END
    || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || to_json(content) END || '}' AS json
FROM j
UNION ALL
SELECT conv_id, call_id, NULL, true, 'no call', '{"id":' || to_json(call_id) || ',"result":' || to_json(content) || '}'
FROM r WHERE call_id NOT IN (SELECT call_id FROM c)
UNION ALL
SELECT conv_id, conv || turn, NULL, false, CASE WHEN role IS NULL THEN 'no role' ELSE '' END, '{' || array_to_string(list_filter([
    '"role":' || to_json(role), '"text":' || to_json(text), '"turn":' || turn], lambda x: x IS NOT NULL), ',') || '}'
FROM a WHERE role IS NULL OR role NOT IN ('user', 'assistant')
UNION ALL
SELECT conv_id, NULL, NULL, role = 'assistant', 'no identifier', CASE role
    WHEN 'user' THEN '{"arguments":{' || array_to_string(list_filter(['"chars":' || length(text), '"text":' || to_json(text)], lambda x: x IS NOT NULL), ',') || '},"name":"answer"}'
    ELSE '{' || coalesce('"result":' || to_json(text), '') || '}' END
FROM a WHERE turn IS NULL AND role IN ('user', 'assistant')"""


@query("op6_chat_formatting", CHAT_SQL)
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as tool calls (each builds on the one before), assistant turns as their results, linked and serialised.

    Every turn is in the result: a call and its result share a row, a turn of another role (system, or none, which is an error) is a
    message and a row of its own with its identifier, and calls and results without a turn number have no identifier and are
    rows with that error. A null conversation is one conversation. Calls and results alike in everything count once, messages as often as they occur.
    """
    turns = table(spark, sf_dir, "conversations")
    name = lambda back: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit("-"), (F.col("turn") - back).cast("string"))
    text, turn = F.col("text"), F.col("turn")
    # Some arguments lack the turn and some give it as a string, so that the schemas have something to find.
    number = F.when(F.length(text) % 7 == 3, None).otherwise(turn)
    plain = F.to_json(F.struct(number.alias("turn"), text.alias("text"), F.length(text).alias("chars")))
    quoted = F.to_json(F.struct(number.cast("string").alias("turn"), text.alias("text"), F.length(text).alias("chars")))
    calls = turns.filter("role = 'user'").select(
        "conv_id", name(0).alias("call_id"), F.when(turn % 4 == 1, "note").otherwise("answer").alias("name"),
        F.when(turn % 8 == 6, quoted).otherwise(plain).alias("arguments"), F.when(turn >= 2, name(2)).alias("parent_id"))
    results = turns.filter("role = 'assistant'").select("conv_id", name(1).alias("call_id"), text.alias("content"))
    asks = F.col("role") == "user"
    unnamed = turns.filter("turn IS NULL AND role IN ('user', 'assistant')").select(
        "conv_id", F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("long").alias("depth"), (~asks).alias("has_result"), F.lit("no identifier").alias("errors"),
        F.to_json(F.struct(F.when(asks, F.try_parse_json(plain)).alias("arguments"), F.when(asks, "answer").alias("name"), F.when(~asks, text).alias("result"))).alias("json"))
    role = F.col("role")
    messages = turns.filter("role IS NULL OR role NOT IN ('user', 'assistant')").select(
        "conv_id", name(0).alias("call_id"), F.lit(None).cast("long").alias("depth"), F.lit(False).alias("has_result"),
        F.when(role.isNull(), "no role").otherwise("").alias("errors"), F.to_json(F.struct(role.alias("role"), text.alias("text"), turn.alias("turn"))).alias("json"))
    return link_tool_calls(calls, results, TOOLS).unionByName(unnamed).unionByName(messages)


FILTER_AUDIT_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
e AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, len(ws) < 100 AS A, 100 * len(list_distinct(ws)) < 80 * len(ws) AS B,
        100 * (length(w.t) - length(regexp_replace(w.t, '[A-Z]', '', 'g'))) > 10 * length(w.t) AS C,
        regexp_matches(w.t, '[#$%&*|]') AS D, coalesce(w.doc_id > e.least, false) AS E, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
      FROM w JOIN e ON w.t = e.t LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda f, i: [A, B, C, D, E][i]) AS fails, count(*) AS n, count(*) FILTER (good) AS good,
        count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
o AS (SELECT '' AS p UNION ALL SELECT p || f FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS u(f) WHERE length(p) < 5 AND NOT contains(p, f)),
s AS (SELECT p AS filter_order, k AS step, substr(p, k, 1) AS f, string_split(substr(p, 1, k - 1), '') AS earlier FROM o, range(1, 6) AS r(k) WHERE length(p) = 5),
x AS (SELECT part, filter_order, step, f,
        CAST(coalesce(sum(n) FILTER (NOT list_has_any(fails, earlier) AND NOT list_contains(fails, f)), 0) AS BIGINT) AS kept,
        CAST(coalesce(sum(n) FILTER (NOT list_has_any(fails, earlier) AND list_contains(fails, f)), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (list_has_any(fails, earlier) AND list_contains(fails, f)), 0) AS BIGINT) AS redundant,
        CAST(coalesce(sum(n) FILTER (fails = [f]), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(good) FILTER (NOT list_has_any(fails, earlier) AND list_contains(fails, f)), 0) AS BIGINT) AS good_lost,
        CAST(coalesce(sum(toxic) FILTER (NOT list_has_any(fails, earlier) AND list_contains(fails, f)), 0) AS BIGINT) AS toxic_lost
      FROM g, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM x"""


@query("op13_filter_audit", FILTER_AUDIT_SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders over every document, by language."""
    return filter_audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def _rounds_sql(rounds: int) -> str:
    """The rounds of the clustering: assignment a<n> and centroids c<n> of each."""
    whole = "SELECT vec_id, n, k, d FROM (SELECT v.vec_id, v.n, c.k, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.w[i] - c.w[i]) * (v.w[i] - c.w[i]))) AS BIGINT) AS d, v.w FROM v, c{0} c)"
    assign = "a{0} AS MATERIALIZED (SELECT n, arg_min(k, (d, k)) AS k, min(d) AS d FROM (" + whole + ") GROUP BY n)"
    move = """c{1} AS MATERIALIZED (SELECT c.k, coalesce(m.w, c.w) AS w FROM c{0} c LEFT JOIN (SELECT k, list(x ORDER BY i) AS w FROM
        (SELECT k, i, CAST((sum(v.w[i]) - ((sum(v.w[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
         FROM v JOIN a{0} a ON v.n = a.n, range(1, 65) AS r(i) GROUP BY k, i) GROUP BY k) m ON c.k = m.k)"""
    return ",\n".join(part.format(i, i + 1) for i in range(rounds) for part in (assign, move)) + ",\n" + assign.format(rounds)


CENTROIDS_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
      FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, w) - 1 AS INTEGER) AS k, w FROM (SELECT sha256('3:' || vec_id) AS h, w FROM v WHERE vec_id IS NOT NULL ORDER BY h, w LIMIT 8)),
""" + _rounds_sql(10) + """,
f AS (SELECT v.vec_id, a.k, a.d, sum(a.d) OVER (PARTITION BY a.k) AS own, sum(a.d) OVER () AS whole FROM v JOIN a10 a ON v.n = a.n)
SELECT f.vec_id, f.k AS cluster, f.d AS distance, CAST(own AS BIGINT) AS cluster_inertia, CAST(whole AS BIGINT) AS inertia,
       sha256(array_to_string(c.w, ',')) AS centroid_sha256
FROM f JOIN c10 c ON f.k = c.k"""


@query("op11_centroids", CENTROIDS_SQL)
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors after ten rounds."""
    return cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 64)


@query("op12_pii")
def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; without SQL, as SQL has neither positions of matches nor the added kinds."""
    return digest_columns(personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text", "found")
