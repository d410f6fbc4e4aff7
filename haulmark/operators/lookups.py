"""Addresses against a table of network ranges, by binary search on the prefix length.

An address lies in a network if its first bits are those of the network. Instead of trying every length that occurs, each
address goes down a tree of lengths (64, then 32 or 96, ... for IPv6; 16, then 8 or 24, ... for IPv4): where its prefix of that length is an
entry it goes on with longer ones, else with shorter ones. Entries are the networks, and markers that lead to longer
networks. Networks inside other networks are dropped first, so the first network met decides and no marker leads astray.
Every step is an equality join on the prefix; no address meets a network it does not match, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.functions.network import WIDTHS, address_bits, network_bits, prefix
from haulmark.operators.slices import running_by_slice
from haulmark.session import written

_SIGN = -(2**63)


def probe_path(length: int, width: int) -> list[int]:
    """Lengths at which the search for a network of ``length`` bits has to be led on to longer ones."""
    at, step, markers = width // 2, width // 4, []
    while at != length:
        if at < length:
            markers.append(at)
        at += max(step, 1) if at < length else -max(step, 1)
        step //= 2
    return markers


def outermost(networks: DataFrame) -> DataFrame:
    """Distinct networks (family, length, high, low) that lie in no other one.

    Networks nest or are apart, so one is inside another if its end is not beyond the ends before it, in order of beginning
    and length. Slices are the first 16 bits.
    """
    distinct = networks.distinct()
    unsigned = lambda c: F.col(c).bitwiseXOR(F.lit(_SIGN))
    ones = lambda c, bits: F.when(bits <= 0, F.lit(-1).cast("long")).when(bits >= 64, F.col(c)).otherwise(
        F.col(c).bitwiseOR(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), bits.cast("int"))))
    last = F.struct(ones("high", F.col("length")).bitwiseXOR(F.lit(_SIGN)).alias("h"), ones("low", F.col("length") - 64).bitwiseXOR(F.lit(_SIGN)).alias("l"))
    ordered = distinct.withColumns({"_h": unsigned("high"), "_l": unsigned("low"), "_end": last})
    placed = running_by_slice(ordered, ["family"], ["_h", "_l", "length"], F.shiftright("_h", 48), maxes_before={"_covered": F.col("_end")})
    return placed.filter(F.col("_covered").isNull() | (F.col("_covered") < F.col("_end"))).select("family", "length", "high", "low")


def search_entries(networks: DataFrame) -> DataFrame:
    """Networks and the markers on the way to them: family, length, high, low and ``network`` (false for a marker)."""
    def lengths(width: int) -> Column:
        paths = F.array(*[F.array(*[F.lit(p) for p in probe_path(n, width)]).cast("array<int>") for n in range(width + 1)])
        return F.get(paths, F.col("length"))

    path = F.lit(None).cast("array<int>")
    for family, width in WIDTHS.items():
        path = F.when(F.col("family") == family, lengths(width)).otherwise(path)
    markers = networks.select("family", F.explode(path).alias("length"), "high", "low").select(
        "family", "length", *[p.alias(c) for c, p in zip(("high", "low"), prefix("high", "low", "length"))], F.lit(False).alias("network"))
    return networks.withColumn("network", F.lit(True)).unionByName(markers).groupBy("family", "length", "high", "low").agg(F.bool_or("network").alias("network"))


def ip_range_semi(addresses: DataFrame, ranges: DataFrame, addr: str = "addr", cidr: str = "cidr") -> DataFrame:
    """Rows whose IPv4 or IPv6 address lies in one of the networks; a bare address counts as a network of one.

    Addresses may have a port; an IPv4 address written as IPv6 counts as that IPv4 address, and an IPv4 address lies in no
    IPv6 network. What is null or no address matches nothing, what is null or no network is ignored. Each distinct address is
    looked up once, in eight joins that adaptive execution can split where many share a prefix. The entries are written to the shared folder.
    """
    parsed = ranges.select(network_bits(F.col(cidr)).alias("n")).filter("n IS NOT NULL").select("n.*")
    entries = written(search_entries(outermost(parsed)), "range-entries")
    found = addresses.select(addr).distinct().withColumn("_a", address_bits(addr)).filter("_a IS NOT NULL").select(
        addr, F.col("_a.family").alias("family"), F.col("_a.high").alias("high"), F.col("_a.low").alias("low"))
    width = F.when(F.col("family") == 4, WIDTHS[4]).otherwise(WIDTHS[6])
    state = found.withColumns({"at": (width / 2).cast("int"), "step": (width / 4).cast("int"), "hit": F.lit(False)})
    names = {"family": "_family", "length": "_length", "high": "_high", "low": "_low", "network": "_network"}
    for _ in range(max(WIDTHS.values()).bit_length()):
        high, low = prefix("high", "low", "at")
        keyed = state.withColumns({"_ph": high, "_pl": low})
        other = entries.withColumnsRenamed(names)
        same = ((F.col("family") == F.col("_family")) & (F.col("at") == F.col("_length")) & (F.col("_ph") == F.col("_high")) & (F.col("_pl") == F.col("_low"))
                & ~F.col("hit"))
        joined = keyed.join(other, same, "left")
        longer = F.col("_length").isNotNull()
        state = joined.select(
            addr, "family", "high", "low", (F.col("hit") | F.coalesce("_network", F.lit(False))).alias("hit"),
            # The last step looks at whole addresses where all markers led there, and at networks of no length where none did.
            F.when(F.col("step") >= 1, F.col("at") + F.when(longer, F.col("step")).otherwise(-F.col("step")))
            .otherwise(F.col("at") + F.when(longer, 1).otherwise(-1)).alias("at"),
            F.floor(F.col("step") / 2).cast("int").alias("step"))
    matched = state.filter("hit").select(addr)
    return addresses.join(matched, addr, "left_semi")
