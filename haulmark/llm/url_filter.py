"""URL filters: host and path rules, then a listed-URL check by a blocked Bloom filter and an exact join.

Everything is DataFrame functions. The Bloom filter is an array of blocks of 256 bits; a URL owns one block and one bit in
each of its four words. Its size is fixed by a parameter, whatever the list: a longer list lets more URLs pass on to the
join, which decides exactly, so the result never depends on the filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Blocks of the filter: 32 bytes each, so 1 MiB.
BLOCKS = 1 << 15

# Query parameters that only tell where a visitor came from.
TRACKING = r"^(utm_[a-z]*|ref|fbclid|gclid)(=|$)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form of a URL: no scheme, fragment, ``www.``, default port, tracking parameter or final slash; parameters sorted.

    Null where there is no host.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    given = F.split(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), query))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, host, path) that fits, as its text and its verdict; null where none does.

    Rules are a short list given by the caller. A rule fits its host and the subdomains of it, where the path starts with
    the rule's path. Of equally long rules the first by text wins.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def _places(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key, and its bit in each of the four words as a mask."""
    mixed = F.xxhash64(key, F.lit("bits"))
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(mixed, 6 * j).bitwiseAND(63).cast("int"))
             for j in range(4)]
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), masks


def bloom_filter(listed: DataFrame, column: str, blocks: int = BLOCKS) -> DataFrame:
    """One row with ``filter``, an array of ``blocks`` structs of four words; keys are or-ed before and after the shuffle."""
    block, masks = _places(F.col(column), blocks)
    words = [f"w{j}" for j in range(4)]
    keyed = listed.select(block.cast("long").alias("block"), *[m.alias(w) for m, w in zip(masks, words)])
    used = keyed.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in words])
    full = listed.sparkSession.range(blocks).withColumnRenamed("id", "block").join(used, "block", "left")
    row = F.struct("block", *[F.coalesce(w, F.lit(0).cast("long")).alias(w) for w in words])
    return full.agg(F.array_sort(F.collect_list(row)).alias("filter"))


def might_be_listed(key: Column, bloom: DataFrame, blocks: int = BLOCKS) -> Column:
    """False only for keys that are surely not in the filter; null keys are not."""
    block, masks = _places(key, blocks)
    own = F.get(bloom.scalar(), block)
    hits = [own[f"w{j}"].bitwiseAND(mask) != 0 for j, mask in enumerate(masks)]
    return key.isNotNull() & reduce(lambda a, b: a & b, hits)


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Each row of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (``allow`` or ``block``).

    The longest fitting rule decides; where none fits, a URL is blocked if its canonical form is among those of column
    ``url`` of ``listed``. Null URLs and URLs without ``://`` have an empty host and path, fit no rule, are not listed and
    so allowed. Rows are judged one by one, repeated rows alike; the list may repeat URLs or be empty. Columns that carry
    the name of a result are replaced, all others stay.
    """
    pages = pages.drop(*[c for c in pages.columns if c.lower() in {"host", "path", "rule", "verdict"}])
    known = listed.select(canonical(F.col("url")).alias("__listed")).filter("__listed IS NOT NULL").distinct()
    judged = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "__key": canonical(F.col("url"))})
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "verdict": verdict})
    judged = judged.withColumn("__maybe", F.col("rule").isNull() & might_be_listed(F.col("__key"), bloom_filter(known, "__listed", blocks), blocks))
    sure = judged.filter(~F.col("__maybe")).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    asked = judged.filter(F.col("__maybe")).join(known, F.col("__key") == F.col("__listed"), "left").withColumn(
        "verdict", F.when(F.col("__listed").isNotNull(), "block").otherwise("allow")).drop("__listed")
    return sure.unionByName(asked).drop("__key", "__maybe")
