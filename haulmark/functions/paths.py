"""Paths, archive names, remote keys and exclusion patterns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulmark.functions.sizes import _col

# Archive suffixes, the longest path component in bytes.
ARCHIVE_SUFFIXES = (".tar.gz", ".tar.zst")
MAX_COMPONENT_BYTES = 255


def basename(path) -> Column:
    """Last component of a path."""
    return F.element_at(F.split(_col(path), "/"), -1)


def rel_path(path) -> Column:
    """Path without its leading slash."""
    return F.regexp_replace(_col(path), "^/", "")


def is_backup_file(name) -> Column:
    """Is this the name of a finished archive?"""
    return reduce(lambda a, b: a | b, [_col(name).endswith(s) for s in ARCHIVE_SUFFIXES])


def archive_extension(compression) -> Column:
    """Archive suffix of a compression mode."""
    return F.when(_col(compression) == "zst", ".tar.zst").otherwise(".tar.gz")


def archive_name(ts, extension) -> Column:
    """Archive name of a moment in UTC, with milliseconds."""
    return F.concat(F.date_format(_col(ts), "yyyy-MM-dd'T'HH-mm-ss-SSS"), _col(extension))


def remote_key(prefix, path, layout: str = "rel_path") -> Column:
    """Object key: prefix and whole path, or prefix and base name (layout ``basename``)."""
    tail = _col(path) if layout == "rel_path" else basename(path)
    return F.concat(_col(prefix), tail)


def invalid_component_reason(name) -> Column:
    """Why a name may not be used as a path component; null if it may. The first reason wins."""
    value = _col(name)
    return (
        F.when(value == "", "empty")
        .when(F.octet_length(value) > MAX_COMPONENT_BYTES, "too long")
        .when(value.contains("/") | value.contains("\\"), "separator")
        .when(value.contains("\x00"), "null byte")
        .when(value.startswith("..") | (value == "."), "traversal")
        .when(value.startswith("."), "starts with dot")
    )


def clean_path(path) -> Column:
    """Components of an absolute path with ``.`` and ``..`` folded."""
    parts = F.filter(F.split(_col(path), "/"), lambda p: (p != "") & (p != "."))
    return F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(
            p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        ).otherwise(F.concat(done, F.array(p))),
    )


def path_within(base, path) -> Column:
    """Does the cleaned path stay inside the base? A first component below it starting with ``..`` does not."""
    root, full = clean_path(base), clean_path(path)
    inside = F.slice(full, F.lit(1), F.size(root)) == root
    below = F.try_element_at(full, F.size(root) + 1)
    return inside & ~F.coalesce(below.startswith(".."), F.lit(False))


def glob_to_regex(pattern: str) -> str | None:
    """Regular expression of a shell pattern whose ``*`` and ``?`` stay inside a component.

    None for a malformed pattern, which matches nothing.
    """
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "[":
            found = re.match(r"\[(\^?)((?:\\.|[^\]\\])+)\]", pattern[i:])
            if not found:
                return None
            negate, body = found.groups()
            out.append(f"[{negate}{body.replace('[', chr(92) + '[').replace('&', chr(92) + '&')}]")
            i += found.end()
            continue
        elif ch == "\\":
            if i + 1 == len(pattern):
                return None
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(ch))
        i += 1
    return "".join(out)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _rule(pattern: str) -> tuple[str, str | None]:
    """Kind of an exclusion pattern and the regular expression of its glob.

    ``x/`` and ``x/**`` are compared with single components, so an ``x`` that holds a slash matches nothing.
    """
    if pattern.endswith(("/", "/**")):
        directory = pattern.endswith("/")
        name = pattern[:-1].removeprefix("*/") if directory else pattern[:-3]
        return ("dir_name" if directory else "component"), (None if "/" in name else glob_to_regex(name))
    return "path", glob_to_regex(pattern)


def is_excluded(path, is_dir, patterns: list[str]) -> Column:
    """Does a pattern match this entry itself?

    ``x/`` matches directories with a component x, ``x/**`` any entry with a component x, anything else the
    whole path or the last component.
    """
    p = _col(path)
    tests = []
    for kind, glob in map(_rule, patterns):
        if glob is None:
            continue
        if kind == "dir_name":
            tests.append(_col(is_dir) & p.rlike(f"(^|/)(?:{glob})(/|$)"))
        elif kind == "component":
            tests.append(p.rlike(f"(^|/)(?:{glob})(/|$)"))
        else:
            tests.append(p.rlike(f"^(?:{glob})$") | basename(path).rlike(f"^(?:{glob})$"))
    return _any(tests)


def is_pruned(path, is_dir, patterns: list[str]) -> Column:
    """Does a pattern match this entry or a directory above it? The walk skips such whole subtrees."""
    p = _col(path)
    tests = []
    for kind, glob in map(_rule, patterns):
        if glob is None:
            continue
        if kind == "dir_name":
            tests.append(p.rlike(f"(^|/)(?:{glob})/") | (_col(is_dir) & p.rlike(f"(^|/)(?:{glob})$")))
        elif kind == "component":
            tests.append(p.rlike(f"(^|/)(?:{glob})(/|$)"))
        else:
            tests.append(p.rlike(f"^(?:{glob})(/|$)") | F.exists(F.split(p, "/"), lambda c: c.rlike(f"^(?:{glob})$")))
    return _any(tests)
