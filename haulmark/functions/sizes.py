"""Byte sizes, numbers and durations as text, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB = 1024

# The unit names of each formatter, smallest first.
SHORT_UNITS = ("KB", "MB", "GB")
SI_UNITS = ("KB", "MB", "GB", "TB", "PB", "EB")
HUMAN_UNITS = ("KB", "MB", "GB", "TB")
UI_UNITS = ("KB", "MB", "GB", "TB")
SIZE_SUFFIXES = {"gb": KIB**3, "mb": KIB**2, "kb": KIB, "b": 1}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fixed(value: Column, digits: int, half_even: bool) -> Column:
    """Text with a fixed number of digits, rounded on the exact value of the double."""
    exact = value.cast("decimal(38,18)")
    rounded = F.bround(exact, digits) if half_even else F.round(exact, digits)
    return rounded.cast(f"decimal(38,{digits})").cast("string")


def _with_unit(b: Column, units: tuple[str, ...], digits: int, half_even: bool) -> Column:
    text = F.concat(b.cast("long").cast("string"), F.lit(" B"))
    for power, unit in enumerate(units, start=1):
        scaled = F.concat(_fixed(b / F.lit(float(KIB**power)), digits, half_even), F.lit(f" {unit}"))
        text = F.when(b >= F.lit(KIB**power), scaled).otherwise(text)
    return text


def parse_byte_size(s) -> Column:
    """Bytes of ``256mb``, ``1gb``, ``17``; null where the text is no size or the result does not fit."""
    text = F.trim(F.lower(_col(s)))
    pattern = r"^([+-]?[0-9]+)(gb|mb|kb|b)?$"
    suffix = F.regexp_extract(text, pattern, 2)
    factor = F.lit(1).cast("long")
    for name, size in SIZE_SUFFIXES.items():
        factor = F.when(suffix == name, F.lit(size).cast("long")).otherwise(factor)
    digits = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    number = digits.try_cast("long")
    return F.try_multiply(number, factor)


def format_bytes_short(b) -> Column:
    """One decimal, rounded half to even, B to GB."""
    return _with_unit(_col(b), SHORT_UNITS, 1, True)


def format_bytes_si(b) -> Column:
    """One decimal, rounded half to even, B to EB."""
    return _with_unit(_col(b), SI_UNITS, 1, True)


def human_size(b) -> Column:
    """Two decimals, rounded half to even, B to TB."""
    return _with_unit(_col(b), HUMAN_UNITS, 2, True)


def format_bytes_ui(b) -> Column:
    """Display form: null and zero are ``0 B``, one decimal rounded half up, never beyond TB."""
    value = _col(b)
    return F.when(F.coalesce(value, F.lit(0)) == 0, "0 B").otherwise(_with_unit(value, UI_UNITS, 1, False))


def format_number(n) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(_col(n), 0)


def fmt_objects(done, total) -> Column:
    """``done/total``, or ``done`` alone while the total is unknown."""
    return F.when(_col(total) > 0, F.concat_ws("/", format_number(done), format_number(total))).otherwise(
        format_number(done)
    )


def format_duration(seconds) -> Column:
    """Rounded seconds as M:SS or H:MM:SS."""
    total = F.round(_col(seconds).cast("double"), 0).cast("long")
    hours, minutes, rest = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(
        F.format_string("%d:%02d", minutes, rest)
    )


def _unit(value: Column, unit: str) -> Column:
    return F.concat(value.cast("string"), F.lit(unit))


def format_elapsed(seconds) -> Column:
    """Whole seconds as ``1h 2m 3s``; seconds always shown."""
    total = F.floor(_col(seconds)).cast("long")
    hours, minutes, rest = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    return F.concat_ws(
        " ", F.when(hours > 0, _unit(hours, "h")), F.when(minutes > 0, _unit(minutes, "m")), _unit(rest, "s")
    )


def go_duration(seconds) -> Column:
    """Whole seconds in the form ``1h2m3s``: larger units appear once they are reached."""
    total = F.floor(_col(seconds)).cast("long")
    hours, minutes, rest = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    return F.concat(
        F.when(hours > 0, _unit(hours, "h")).otherwise(""),
        F.when(total >= 60, _unit(minutes, "m")).otherwise(""),
        _unit(rest, "s"),
    )


# Seconds of the units of a duration.
_DURATION_UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ns": 1e-9}
_DURATION_PART = r"([0-9]+\.?[0-9]*|\.[0-9]+)(ms|us|µs|μs|ns|h|m|s)"


def parse_go_duration(text) -> Column:
    """Seconds of ``1h23m45.6s``, ``300ms`` or ``.5s``; units may repeat. Null where a part of the text is no duration."""
    value = _col(text)
    numbers, units = (F.regexp_extract_all(value, F.lit(_DURATION_PART), F.lit(k)) for k in (1, 2))
    factor = F.create_map(*[F.lit(x) for pair in _DURATION_UNITS.items() for x in pair])
    parts = F.zip_with(numbers, units, lambda number, unit: number.try_cast("double") * factor[unit])
    total = F.aggregate(parts, F.lit(0.0), lambda sum_, part: sum_ + part)
    whole = value.rlike(f"^[-+]?({_DURATION_PART})+$")
    return F.when(whole, F.when(value.startswith("-"), -total).otherwise(total)).when(value.rlike("^[-+]?0$"), F.lit(0.0))


def format_uptime(text) -> Column:
    """Duration text for display: parts above zero, seconds rounded; a dash where there is none."""
    value = _col(text)
    pattern = r"^(?:(\d+)h)?(?:(\d+)m)?(?:(\d+(?:\.\d+)?)s)?"

    def part(group: int, kind: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(value, pattern, group), F.lit("")).cast(kind), F.lit(0).cast(kind))

    hours, minutes = part(1, "long"), part(2, "long")
    seconds = F.floor(part(3, "double") + 0.5).cast("long")
    shown = F.concat_ws(
        " ",
        F.when(hours > 0, _unit(hours, "h")),
        F.when(minutes > 0, _unit(minutes, "m")),
        F.when((seconds > 0) | ((hours == 0) & (minutes == 0)), _unit(seconds, "s")),
    )
    return F.when(F.coalesce(value, F.lit("")) == "", "—").otherwise(shown)


def truncate_text(s, length: int) -> Column:
    """Text cut to ``length`` characters with an ellipsis; null gives an empty text."""
    value = F.coalesce(_col(s), F.lit(""))
    return F.when(F.length(value) > length, F.concat(F.substring(value, 1, length), F.lit("…"))).otherwise(value)
