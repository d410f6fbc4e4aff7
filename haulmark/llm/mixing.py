"""Mixing sources to target weights by balanced sampling with the cube method.

Each source gets a target in words. A document of a source is taken ``target / size of the source`` times: the whole part
of that number for certain, the rest as an inclusion probability. The flight phase moves the probabilities of three
documents at a time along the null-space of the constraints (words and documents keep their expected totals) until one of
the three is decided. Blocks of documents fly in parallel; the two or fewer undecided documents that each block leaves
meet in new blocks, until one block per source is left and lands, with a few exchanges towards the words expected.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulmark.llm.common import WORD, materialize
from haulmark.operators.slices import running_by_slice

EPS = 1e-9
#: Units that fly together; a block leaves at most two undecided.
BLOCK = 4096
#: Rows alike in everything that one task writes out again.
RUN = 65_536


def word_count(column: str = "text") -> Column:
    """Words of a whole text; null counts as none."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``source``, ``source_size`` -> also ``target``: shares of the total size by weight, none above ``most`` times its size.

    Sources by code point, null last, take the weights in turn. What a limited source leaves is shared again by weight
    among the others until none is above its limit. Each round is one sum over the sources.
    """
    spark = sizes.sparkSession
    order = sizes.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda r: (r[0].source, r[0].source_size, r[1]))
    kinds = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("place", T.LongType())])
    turns = F.array(*[F.lit(float(w)) for w in weights])
    ranked = materialize(
        spark.createDataFrame(order, kinds).withColumn("weight", F.get(turns, (F.col("place") % len(weights)).cast("int")))
        .withColumn("limit", F.col("source_size") * most), "mix-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, held = 0.0, None
    above = F.lit(False)  # sources that stop at their limit; the set only grows
    while True:
        seen = ranked.agg(F.sum(F.when(above, F.col("limit"))), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))).first()
        if seen[2] == held or not seen[1]:
            break
        held, level = seen[2], (total - (seen[0] or 0.0)) / seen[1]
        above = F.col("limit") < F.lit(level) * F.col("weight")
    return ranked.select("source", "source_size", F.least("limit", F.lit(level) * F.col("weight")).alias("target"))


def fly(sizes: list[float], counts: list[float], chances: list[float], order: list[int]) -> list[float]:
    """Flight: move chances until at most two are undecided, keeping their sums weighted by size and by count.

    Three undecided units always have a direction that changes neither sum; its two ends are drawn so that the
    expectation of each chance stays. The draw depends on the arguments only.
    """
    chance = list(chances)
    hand: list[int] = []
    state = 0
    for k in order:
        if not EPS < chance[k] < 1 - EPS:
            chance[k] = float(round(chance[k]))
            continue
        hand.append(k)
        while len(hand) == 3:
            (s1, r1), (s2, r2), (s3, r3) = ((sizes[i], counts[i]) for i in hand)
            u = (s2 * r3 - s3 * r2, s3 * r1 - s1 * r3, s1 * r2 - s2 * r1)
            if not any(u):  # equal in both, so that two of them suffice
                u = (r2, -r1, 0.0)
            up = min((1 - chance[i]) / d if d > 0 else chance[i] / -d for i, d in zip(hand, u) if d)
            down = min(chance[i] / d if d > 0 else (1 - chance[i]) / -d for i, d in zip(hand, u) if d)
            state = (state * 6364136223846793005 + 1442695040888963407 + k) & (2**64 - 1)
            step = up if (state >> 11) / 2**53 < down / (up + down) else -down
            for i, d in zip(hand, u):
                chance[i] += step * d
                if not EPS < chance[i] < 1 - EPS:
                    chance[i] = 1.0 if chance[i] > 0.5 else 0.0
            hand = [i for i in hand if 0 < chance[i] < 1]
    return chance


def land(sizes: list[float], counts: list[float], chances: list[float], expected: float) -> list[float]:
    """Landing: the two or fewer undecided units take the combination nearest to the expected words, then documents; what
    still misses is made up by turning over decided units of the block, each the one that helps most, until none helps by
    half a word."""
    left = [k for k, p in enumerate(chances) if 0 < p < 1]
    docs = sum(counts[k] * chances[k] for k in left)
    fixed = sum(s * p for s, p in zip(sizes, chances) if p in (0, 1))
    ways = ([(m >> i) & 1 for i in range(len(left))] for m in range(2 ** len(left)))
    best = min(ways, key=lambda w: (abs(expected - fixed - sum(sizes[k] * x for k, x in zip(left, w))), abs(docs - sum(counts[k] * x for k, x in zip(left, w))), w))
    out = list(chances)
    for k, x in zip(left, best):
        out[k] = float(x)
    taken, change = np.array(out), np.array(sizes, float)
    miss = expected - float(taken @ change)
    while len(out):
        after = np.abs(miss - np.where(taken == 0, change, -change))
        k = int(after.argmin())
        if after[k] >= abs(miss) - 0.5:
            break
        miss -= change[k] if taken[k] == 0 else -change[k]
        taken[k] = 1 - taken[k]
    return taken.tolist()


def _draw(unit: str) -> bytes:
    return hashlib.blake2b(unit.encode(), digest_size=8).digest()


UNIT = "unit string, source string, size double, count double, chance double"


def balanced(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """``unit`` (unique in its source), ``source``, ``size``, ``count``, ``chance`` -> ``unit``, ``source``, ``chosen`` (0 or 1).

    Blocks hold units of one source only, dealt by hash, so that a hot source is many blocks. Every round keeps what is
    decided and passes on the undecided, at most two of a block; the largest source sets the number of rounds.
    """
    state = units.select("unit", "source", *[F.col(c).cast("double").alias(c) for c in ("size", "count", "chance")])
    done = None
    while True:
        counts = state.groupBy(F.col("source").alias("s")).agg(F.ceil(F.count("*") / block).cast("long").alias("parts"))
        rounds = counts.agg(F.max("parts")).first()[0] or 1
        dealt = state.join(counts, F.col("source").eqNullSafe(F.col("s"))).withColumn(
            "block", F.pmod(F.xxhash64("unit", F.lit(rounds)), F.col("parts")))

        def flight(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("unit", ignore_index=True)
            draws = [_draw(k) for k in group["unit"]]
            sizes, numbers = group["size"].tolist(), group["count"].tolist()
            before = group["chance"].tolist()
            chance = fly(sizes, numbers, before, sorted(range(len(group)), key=draws.__getitem__))
            if group["parts"].iloc[0] == 1:  # nothing of this source flies elsewhere
                chance = land(sizes, numbers, chance, sum(s * p for s, p in zip(sizes, before)))
            return group[["unit", "source", "size", "count"]].assign(chance=chance)

        flown = materialize(dealt.groupBy("source", "block").applyInPandas(flight, UNIT), "mix-flight")
        decided = flown.filter("chance = 0 or chance = 1").select("unit", "source", F.col("chance").cast("long").alias("chosen"))
        done = decided if done is None else done.unionByName(decided)
        if rounds == 1:
            return done
        state = flown.filter("chance > 0 and chance < 1")


GROUP = ["doc_id", "source", "size"]


def _same(left: list[str], right: list[str]) -> Column:
    """Equal columns on both sides of a join, null as a value like any other."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])


def plan_mix(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, block: int = BLOCK) -> DataFrame:
    """``rows`` (doc_id, source, size and ``row``, a hash of all that makes rows alike) folded, with what the mix takes of them.

    One row for each doc_id, source, size and ``row``: ``alike`` rows, each taken ``whole`` times, and ``extra`` of them once
    more; source_size and target are those of the source. All rows of a doc_id, source and size have one
    inclusion probability p. Of n of them the whole part of n * p is certain, so only one open unit for the rest is drawn,
    however many they are; they go by ``row``, in slices, so that neither key nor size nor copies make a large unit or task.
    """
    contents = materialize(rows.groupBy(*GROUP, "row").agg(F.count("*").alias("alike")), "mix-contents")
    named = F.concat_ws(":", F.when(F.col("doc_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), F.col("doc_id").cast("string"))), F.col("size").cast("string"))
    units = contents.groupBy(*GROUP).agg(F.sum("alike").alias("count")).withColumn("unit", named)
    sources = targets(contents.groupBy("source").agg(F.sum(F.col("size") * F.col("alike")).alias("source_size")), weights, most)
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    share = F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)) * F.col("count")
    planned = materialize(
        units.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + EPS).cast("long"))
        .withColumn("sure", F.floor(share + EPS).cast("long")).withColumn("chance", F.greatest(share - F.col("sure"), F.lit(0.0))), "mix-plan")
    chosen = balanced(planned.filter(F.col("chance") > EPS).select("unit", "source", "size", F.lit(1).alias("count"), "chance"), block)
    taken = planned.join(
        chosen.select(F.col("unit").alias("u"), F.col("source").alias("s"), "chosen"), _same(["unit", "source"], ["u", "s"]), "left",
    ).select(
        *[F.col(c).alias(f"__{c}") for c in GROUP], "source_size", "target", "whole", "count", (F.col("sure") + F.coalesce("chosen", F.lit(0))).alias("__extra"),
        F.concat_ws("|", "unit", F.concat(F.lit("s"), F.col("source"))).alias("__unit"))
    both = contents.join(materialize(taken, "mix-taken"), _same(GROUP, [f"__{c}" for c in GROUP]))
    some = (F.col("__extra") > 0) & (F.col("__extra") < F.col("count"))
    result = lambda df, extra: df.select(*GROUP, "row", "alike", "source_size", "target", "whole", extra.cast("long").alias("extra"))
    alike = result(both.filter(~some), F.when(F.col("__extra") > 0, F.col("alike")).otherwise(0))
    # Of groups that are taken in part, rows take their extra copy in the order of their hashes.
    placed = running_by_slice(both.filter(some), ["__unit"], ["row"], F.shiftright("row", 48), sums={"__upto": F.col("alike")})
    left = F.col("__extra") - (F.col("__upto") - F.col("alike"))
    return alike.unionByName(result(placed, F.least(F.greatest(left, F.lit(0)), F.col("alike"))))


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, block: int = BLOCK) -> DataFrame:
    """Each row of ``docs`` with ``size`` (by default the words of ``text``), ``source_size``, ``target`` and ``copies``.

    ``copies`` is how often the mix takes the row, at most ``most`` times. Null sources are one source, the last; null and
    empty texts have size 0 and are never taken. Keys may be null and repeat, also for a large part of the rows: rows of one
    ``doc_id``, ``source`` and size have the same chance, and are drawn apart (see :func:`plan_mix`). An empty table gives
    no rows. Draws follow keys, sizes and the content of rows, so runs agree. Columns that carry the name of a result are
    replaced, all others stay. Texts are not shuffled for the draw; they are joined to its result.
    """
    size = word_count() if size is None else size
    rest = docs.withColumn("__size", size).drop(*[c for c in docs.columns if c.lower() in {"size", "source_size", "target", "copies"}])
    names = [c for c in rest.columns if c != "__size"]
    sized = rest.withColumnRenamed("__size", "size").withColumn("__row", F.xxhash64(*names))
    plan = materialize(plan_mix(sized.select(*GROUP, F.col("__row").alias("row")), weights, most, block), "mix-planned")
    part = (F.col("extra") > 0) & (F.col("extra") < F.col("alike"))
    keys = [f"__{c}" for c in GROUP] + ["__hash"]
    renamed = plan.withColumnsRenamed({**{c: f"__{c}" for c in GROUP}, "row": "__hash"})
    results = ["size", "source_size", "target", "copies"]
    each = sized.join(renamed.filter(~part), _same([*GROUP, "__row"], keys)).withColumn(
        "copies", F.col("whole") + (F.col("extra") > 0).cast("long")).select(*names, *results)
    # Rows alike in everything of which only some are taken once more: folded, and written out again with the right counts.
    # At most one of a doc_id, source and size, and none in most tables: their own table tells Spark how few they are.
    few = materialize(renamed.filter(part), "mix-part")
    folded = sized.join(few, _same([*GROUP, "__row"], keys)).groupBy(*names, "size", "source_size", "target", "whole", "extra").agg(F.count("*").alias("__n"))
    runs = folded.withColumn("__at", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / RUN).cast("int"))))
    first = F.col("__at").cast("long") * RUN
    numbered = runs.repartition(F.xxhash64(*names), "__at").withColumn("__k", F.explode(F.sequence(first, F.least(first + RUN, F.col("__n")) - 1)))
    apart = numbered.withColumn("copies", F.col("whole") + (F.col("__k") < F.col("extra")).cast("long")).select(*names, *results)
    return each.unionByName(apart)
