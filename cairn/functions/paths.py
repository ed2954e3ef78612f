"""Path, locator and name functions as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def normalise(path: Column) -> Column:
    """Backslashes to slashes, no double or trailing slash, no `.` segment. `..` is resolved by `resolve_dots`."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    p = F.regexp_replace(p, r"/(?:\./)+", "/")
    p = F.regexp_replace(p, r"/{2,}", "/")
    p = F.regexp_replace(p, r"/\.$", "")
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)


def resolve_dots(path: Column) -> Column:
    """Resolve `..` segments by folding the segments; JVM-side."""
    parts = F.filter(F.split(normalise(path), "/"), lambda x: x != "")
    stack = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(stack, "/"))


def from_uri(uri: Column) -> Column:
    """Path of a file: URI; null if it is none. Drive letters keep their form (`C:/x`)."""
    raw = F.regexp_extract(uri, r"^file:/{0,2}(/.*)$", 1)
    return F.when(raw == "", F.lit(None)).otherwise(F.regexp_replace(raw, r"^/([A-Za-z]:)", "$1"))


def to_uri(path: Column) -> Column:
    return F.when(path.startswith("/"), F.concat(F.lit("file://"), path)).otherwise(F.concat(F.lit("file:///"), path))


def directory_uri(path: Column) -> Column:
    """URI with a slash at its end."""
    return F.concat(F.regexp_replace(to_uri(path), "/$", ""), F.lit("/"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Null at the root."""
    p = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(p == "", F.lit(None)).otherwise(p)


def resolve(path: Column, child: Column) -> Column:
    return F.concat(path, F.lit("/"), child)


def join(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def is_under(path: Column, prefix: Column) -> Column:
    """Strictly below: a path is no prefix of itself."""
    return path.startswith(F.concat(F.regexp_replace(prefix, "/$", ""), F.lit("/")))


def is_at_or_under(path: Column, prefix: Column) -> Column:
    """Equal or below (C4)."""
    return (path == prefix) | is_under(path, prefix)


def to_restore_path(path: Column, backup_root: Column, restore_root: Column) -> Column:
    """The part below the backup root, put below the restore root."""
    return F.concat(F.regexp_replace(restore_root, "/$", ""), F.substr(path, F.length(F.regexp_replace(backup_root, "/$", "")) + 1))


def ancestors(path: Column) -> Column:
    """All proper ancestors but the root, shortest first."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 2, F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))


def glob_to_regex(pattern: str) -> str:
    """A glob where ** crosses slashes, * and ? do not, with [..], [!..], {a,b} and backslash escapes."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            if pattern[i : i + 2] == "**":
                out.append(".*")
                i += 1
            else:
                out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError(f"missing ] in {pattern!r}")
            body = pattern[i + 1 : end]
            body = "^" + body[1:] if body[0] == "!" else re.sub(r"^\^", r"\\^", body)
            out.append("(?!/)[" + body.replace("\\", "\\\\") + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"missing }} in {pattern!r}")
    return "^" + "".join(out) + "$"


def matches_any(path: Column, source: str, patterns: list[str]) -> Column:
    """Whether a path matches one of the globs below a source."""
    if not patterns:
        return F.lit(False)
    return path.rlike("|".join(f"(?:{glob_to_regex(source.rstrip('/') + '/' + p.replace(chr(92), '/'))})" for p in patterns))


def format_locator(increment: Column, entry: Column) -> Column:
    return F.concat(F.lit("/"), increment.cast("string"), F.lit("/"), entry)


def parse_locator(text: Column) -> Column:
    """struct<backup_increment, entry_name>, or null."""
    pattern = rf"^/(\d+)/({UUID})$"
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).cast("int").alias("backup_increment"), F.regexp_extract(text, pattern, 2).alias("entry_name")))


def chunk_name(prefix: Column, number: Column) -> Column:
    return F.format_string("%s.%05d.cargo", prefix, number)


def index_name(prefix: Column) -> Column:
    return F.concat(prefix, F.lit(".index.cargo"))


def entry_prefix(number: Column) -> Column:
    return F.format_string("%08d", number)


def operating_system(name: Column) -> Column:
    """WINDOWS, MAC, LINUX or UNKNOWN by the first part that the lower-cased name holds, in this order."""
    n = F.lower(F.coalesce(name, F.lit("")))
    return F.when(n.contains("win"), "WINDOWS").when(n.contains("mac"), "MAC").when(n.contains("linux"), "LINUX").otherwise("UNKNOWN")


def app_version(text: Column) -> Column:
    """struct<major, minor, patch>, which orders as versions do; null if malformed."""
    p = F.split(text, r"\.")
    return F.when(text.rlike(r"^\d+\.\d+\.\d+$"), F.struct(p[0].cast("int").alias("major"), p[1].cast("int").alias("minor"), p[2].cast("int").alias("patch")))
