"""Column helpers for paths, globs, dotted names and small texts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SKIPPED_PARTS = tuple("build dist node_modules venv .venv .tox .svn .hg .git __pycache__".split())


def glob_regex(pattern: str) -> str:
    """An anchored regex of a glob whose * crosses slashes; **/ may also match nothing."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            while i < len(pattern) and pattern[i] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            body = pattern[i:end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out.append("[" + ("^" + body[1:] if body[:1] == "!" else body) + "]")
            i = end + 1
        else:
            out.append(re.sub(r"([^\w])", r"\\\1", c, flags=re.ASCII) if ord(c) < 128 else c)
    whole = "".join(out)
    return f"(?s)^(?:{whole}|{glob_regex(pattern[3:])[5:-1]})$" if pattern.startswith("**/") else f"(?s)^{whole}$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [path.rlike(glob_regex(p)) for p in patterns], F.lit(False))


def has_suffix(path: Column, *suffixes: str) -> Column:
    """The last part ends with one of the suffixes and has a stem; a leading dot alone makes no suffix."""
    return path.rlike("(?s)[^/]+(?:" + "|".join(re.escape(s) for s in suffixes) + ")$")


def has_skipped_part(path: Column, parts: tuple[str, ...] = SKIPPED_PARTS) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in parts]))


def is_safe_path(path: Column) -> Column:
    """Relative, with forward slashes, without drive letters or steps upwards."""
    return (path != "") & ~path.contains("\\") & ~path.contains(":") & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..") & (F.locate("\x00", path) == 0)


def module_name(path: Column) -> Column:
    return F.regexp_replace(F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit(".")), r"\.__init__$", "")


def dotted_suffixes(name: Column) -> Column:
    """All suffixes of a dotted name that begin at a part: a.b.c gives a.b.c, b.c and c."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))


def dotted_prefixes(name: Column) -> Column:
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def short_hash(h: Column) -> Column:
    return F.concat(F.left(h, F.lit(10)), F.lit("…"), F.right(h, F.lit(6)))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def indent(text: Column) -> Column:
    return F.concat(F.lit("    "), F.replace(text, F.lit("\n"), F.lit("\n    ")))


def redact(text: Column, secret: str) -> Column:
    return F.replace(text, F.lit(secret), F.lit("[redacted]")) if secret else text


def line_coordinate(text: Column) -> Column:
    """Struct (first, last) of N or N-M with 1 <= N <= M; null otherwise."""
    first = F.regexp_extract(text, r"^([1-9]\d{0,8})(?:-([1-9]\d{0,8}))?$", 1).try_cast("int")
    last = F.coalesce(F.regexp_extract(text, r"^([1-9]\d{0,8})-([1-9]\d{0,8})$", 2).try_cast("int"), first)
    return F.when(first.isNotNull() & (first <= last), F.struct(first.alias("first"), last.alias("last")))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null over zero."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))
