"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of ``b`` bits is cut into ``m`` segments; for each segment there is an index from its value to codes. A query probes all
values within a radius ``r`` of its own segments. A code at distance ``d`` is within ``d // m`` of the query in one of its
segments, so after radius ``r`` every code at a distance of at most ``m * (r + 1) - 1`` has been verified. The radius grows
until the k-th verified distance lies in that range; queries that are covered stop, the others go on.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.llm.common import materialize

SEGMENTS, BITS = 4, 64


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """One bit for each of the first ``bits`` components: set where it is positive. Null vectors have no code; null and
    missing components count as not positive."""
    places = F.slice(vector, 1, bits)
    powers = F.sequence(F.lit(0), F.greatest(F.size(places) - 1, F.lit(0)))
    set_bits = F.zip_with(places, powers, lambda x, k: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    return F.when(vector.isNotNull(), F.aggregate(set_bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.coalesce(x, F.lit(0).cast("long")))))


def _segment(code: Column, j: int, width: int) -> Column:
    return F.shiftrightunsigned(code, j * width).bitwiseAND((1 << width) - 1)


def _segments(segments: int, width: int, code: Column) -> Column:
    return F.array(*[F.struct(F.lit(j).alias("seg"), _segment(code, j, width).alias("value")) for j in range(segments)])


def _masks(width: int, radius: int) -> Column:
    """All masks with ``radius`` of ``width`` bits, as one literal."""
    masks = (sum(1 << b for b in bits) for bits in combinations(range(width), radius))
    return F.split(F.lit(",".join(map(str, masks))), ",").cast("array<long>")


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, segments: int = SEGMENTS, bits: int = BITS) -> DataFrame:
    """The ``k`` rows of ``codes`` (``id``, ``code``) nearest to each of ``queries`` (``qid``, ``code``): ``qid``, ``rank``,
    ``id``, ``distance``.

    Ranks follow distance, then id. Rows with a null id or code take no part. With fewer than ``k`` rows all are returned.
    Rows equal in id and code count once; a query that is itself among the rows finds itself first. Equal codes are one
    entry of the index with their ``k`` smallest ids, so a code that a third of all rows share costs what any other does.
    """
    if bits % segments:
        raise ValueError("segments must cut the code into equal parts")
    width = bits // segments
    by_code = Window.partitionBy("code").orderBy("id")
    by_part = Window.partitionBy("code", "part").orderBy("id")
    known = codes.select("id", "code").filter("id IS NOT NULL AND code IS NOT NULL").distinct()
    # Ranked within parts of a code first, so that no task meets all rows of a frequent one.
    known = known.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("place", F.row_number().over(by_part)).filter(F.col("place") <= k)
    known = known.withColumn("place", F.row_number().over(by_code)).filter(F.col("place") <= k)
    entries = materialize(known.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "hamming-codes")
    index = materialize(
        entries.select("code", F.get("ids", F.lit(0)).alias("first"), F.explode(_segments(segments, width, F.col("code"))).alias("s"))
        .select("s.seg", "s.value", "code", "first"), "hamming-index")
    asked = queries.select("qid", F.col("code").alias("asked")).filter("qid IS NOT NULL AND asked IS NOT NULL").distinct()
    open_ = materialize(asked, "hamming-queries")
    nearest = Window.partitionBy("qid", "asked").orderBy("distance", "first")
    found = done = None
    for radius in range(width + 1):
        probes = open_.select("qid", "asked", F.explode(_segments(segments, width, F.col("asked"))).alias("s")).select(
            "qid", "asked", "s.seg", F.explode(F.transform(_masks(width, radius), lambda mask: F.col("s.value").bitwiseXOR(mask))).alias("value"))
        # Merged, not broadcast: probes are far more than the size of the table they are made from tells.
        met = probes.join(index.hint("merge"), ["seg", "value"]).select("qid", "asked", "code", "first").distinct()
        met = met.withColumn("distance", F.bit_count(F.col("asked").bitwiseXOR(F.col("code"))))
        if found is not None:
            met = met.unionByName(found).distinct()
        # Each of the k codes that come first by distance and smallest id holds an id at least: no other code can matter.
        best = materialize(met.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= k).drop("place"), "hamming-found")
        covered = segments * (radius + 1) - 1
        reached = (
            best.join(entries.select("code", F.size("ids").alias("n")), "code").filter(F.col("distance") <= covered)
            .groupBy("qid", "asked").agg(F.sum("n").alias("n")).filter(F.col("n") >= k).select("qid", "asked")
        )
        ended = best.join(reached, ["qid", "asked"], "left_semi") if radius < width else best
        done = ended if done is None else done.unionByName(ended)
        if radius == width:
            break
        open_ = materialize(open_.join(reached, ["qid", "asked"], "left_anti"), "hamming-queries")
        if open_.isEmpty():
            break
        found = best.join(reached, ["qid", "asked"], "left_anti")
    ranked = done.drop("first").join(entries, "code").select("qid", "asked", "distance", F.explode("ids").alias("id"))
    order = Window.partitionBy("qid", "asked").orderBy("distance", "id")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "id", "distance")
