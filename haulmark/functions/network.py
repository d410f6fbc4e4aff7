"""Access lists: is an address inside one of the allowed ranges?"""

from __future__ import annotations

import ipaddress
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from haulmark.functions.sizes import _col

# An IPv4 address written as IPv6 (``::ffff:10.0.0.1``, also in brackets with a port) counts as that IPv4 address.
_MAPPED = r"(?i)^\[?::ffff:((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?:\](?::[^:]*)?)?$"
_IPV4 = r"^((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?::[^:]*)?$"


def ipv4_number(addr) -> Column:
    """Number of an IPv4 address with or without port, or of one mapped into IPv6; null for anything else."""
    plain = F.regexp_replace(_col(addr), _MAPPED, "$1")
    octets = F.split(F.regexp_extract(plain, _IPV4, 1), r"\.")
    valid = (F.size(octets) == 4) & F.forall(
        octets, lambda o: o.rlike("^(0|[1-9][0-9]{0,2})$") & (o.try_cast("int") <= 255)
    )
    numbers = F.transform(octets, lambda o: o.try_cast("long"))
    return F.when(valid, F.aggregate(numbers, F.lit(0).cast("long"), lambda acc, n: acc * 256 + n))


#: Bits of an address by family.
WIDTHS = {4: 32, 6: 128}

_BRACKETS = r"^\[([^\]]*)\](?::[0-9]*)?$"
_TAIL = r"^(.*:)((?:[0-9]{1,3}\.){3}[0-9]{1,3})$"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _split_groups(half: Column) -> Column:
    return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))


def _filled(left: Column, right: Column, halves: Column) -> Column:
    """Eight numbers from the groups before and after ``::``; null if they are not those of an address."""
    given = F.size(left) + F.size(right)
    whole = ((halves == 1) & (given == 8)) | ((halves == 2) & (given <= 7))
    valid = whole & F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - given, F.lit(0))), right)
    return F.when(valid, F.transform(filled, lambda g: F.conv(g, 16, 10).cast("long")))


def _ipv6_groups(addr: Column) -> Column:
    """The eight numbers of an IPv6 address, with or without brackets and port; null for anything else."""
    # An IPv4 address at the end stands for two groups.
    pair = lambda n: F.lower(F.concat_ws(":", F.hex(F.floor(n / 65536)), F.hex(n % 65536)))
    spelled = lambda bare: F.when(bare.contains("."), F.concat(F.regexp_extract(bare, _TAIL, 1), _let(ipv4_number(F.regexp_extract(bare, _TAIL, 2)), lambda n: F.when(n.isNotNull(), pair(n))))).otherwise(bare)
    plain = _let(F.lower(F.when(F.startswith(addr, F.lit("[")), F.regexp_extract(addr, _BRACKETS, 1)).otherwise(addr)), spelled)
    return _let(F.split(plain, "::", -1), lambda halves: _let(
        F.struct(_split_groups(F.get(halves, F.lit(0))).alias("l"), F.coalesce(_split_groups(F.get(halves, F.lit(1))), F.array().cast("array<string>")).alias("r")),
        lambda both: _filled(both["l"], both["r"], F.size(halves))))


def _joined(groups: Column, at: int) -> Column:
    return F.aggregate(F.slice(groups, at, 4), F.lit(0).cast("long"), lambda acc, g: F.shiftleft(acc, 16).bitwiseOR(g))


def _bits(family: int, high: Column, low: Column) -> Column:
    return F.struct(F.lit(family).alias("family"), high.cast("long").alias("high"), low.cast("long").alias("low"))


def address_bits(addr) -> Column:
    """Family and bits of an address, with or without port, as a struct (family, high, low); null for anything else.

    The bits of an IPv4 address are the first of ``high``; one written as IPv6 (``::ffff:10.0.0.1``) is an IPv4 address.
    """
    zero = F.lit(0)

    def of_halves(x: Column) -> Column:
        mapped = (x["h"] == 0) & (F.shiftrightunsigned(x["l"], 32) == 0xFFFF)
        return F.when(x["h"].isNotNull(), F.when(mapped, _bits(4, F.shiftleft(x["l"], 32), zero)).otherwise(_bits(6, x["h"], x["l"])))

    wide = lambda text: _let(_ipv6_groups(text), lambda g: _let(F.struct(_joined(g, 1).alias("h"), _joined(g, 5).alias("l")), of_halves))
    return _let(_col(addr), lambda text: _let(ipv4_number(text), lambda v4: F.when(v4.isNotNull(), _bits(4, F.shiftleft(v4, 32), zero)).otherwise(wide(text))))


def prefix(high, low, length) -> tuple[Column, Column]:
    """The first ``length`` bits of an address, the others zero."""
    def kept(bits: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(-1).cast("long"), (F.lit(64) - bits).cast("int"))
        return F.when(bits <= 0, F.lit(0).cast("long")).when(bits >= 64, F.lit(-1).cast("long")).otherwise(mask)

    size = _col(length)
    return _col(high).bitwiseAND(kept(size)), _col(low).bitwiseAND(kept(size - 64))


def network_bits(cidr) -> Column:
    """Family, length and bits of a network as a struct (family, length, high, low); null for anything else.

    A bare address is a network of one. Bits beyond the length are dropped.
    """
    def cut(bits: Column, size: Column) -> Column:
        high, low = prefix(bits["high"], bits["low"], size)
        valid = bits.isNotNull() & size.between(0, F.when(bits["family"] == 4, WIDTHS[4]).otherwise(WIDTHS[6]))
        return F.when(valid, F.struct(bits["family"].alias("family"), size.alias("length"), high.alias("high"), low.alias("low")))

    def sized(parts: Column, bits: Column) -> Column:
        given = F.when(F.get(parts, F.lit(1)).rlike("^[0-9]{1,3}$"), F.get(parts, F.lit(1)).try_cast("int"))
        # The length of an IPv4 network that is written as IPv6 counts from the first bit of the IPv6 address.
        as_v6 = (bits["family"] == 4) & F.get(parts, F.lit(0)).contains(":") & ~F.get(parts, F.lit(0)).rlike(_IPV4)
        return F.when(F.size(parts) == 1, F.when(bits["family"] == 4, WIDTHS[4]).otherwise(WIDTHS[6])).when(
            F.size(parts) == 2, F.when(as_v6, given - 96).otherwise(given))

    return _let(F.split(_col(cidr), "/", -1), lambda parts: _let(address_bits(F.get(parts, F.lit(0))), lambda bits: _let(
        sized(parts, bits), lambda size: cut(bits, size))))


def _network(text: str) -> ipaddress.IPv4Network | ipaddress.IPv6Network:
    return ipaddress.ip_network(text, strict=False)


def ip_allowed(addr, cidrs: list[str]) -> Column:
    """Deny by default: true only for an address inside one of the networks; a bare address is itself one.

    IPv4 is decided by built-in expressions. Python sees rows only if the list holds an IPv6 network.
    """
    networks = [_network(c) for c in cidrs]
    v4 = [n for n in networks if n.version == 4]
    v6 = [n for n in networks if n.version == 6]
    number = ipv4_number(addr)
    tests = [number.between(int(n.network_address), int(n.broadcast_address)) for n in v4]
    allowed = F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))
    if not v6:
        return allowed

    @F.pandas_udf("boolean")
    def in_v6(values: pd.Series) -> pd.Series:
        def test(value):
            host = value or ""
            if "%" in host:
                return False
            if host.startswith("[") and "]" in host:
                host = host[1 : host.index("]")]
            try:
                ip = ipaddress.ip_address(host)
            except ValueError:
                return False
            return ip.version == 6 and any(ip in n for n in v6)

        return values.map(test).astype(bool)

    return allowed | F.when(number.isNull(), in_v6(_col(addr))).otherwise(F.lit(False))
