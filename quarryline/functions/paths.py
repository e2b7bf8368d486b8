"""Path expressions. All are Column functions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of each language; any other is 'other'.
LANGUAGES = {
    "js": [".js", ".mjs", ".cjs", ".jsx"],
    "ts": [".ts", ".tsx"],
    "py": [".py"],
}


def extension(path: Column) -> Column:
    """The extension with its dot in lower case; '' where the last segment has none. Null for null."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def language(path: Column) -> Column:
    """js, ts, py or other by the extension. A null path is 'other'."""
    ext = extension(path)
    out = F.lit("other")
    for name, exts in LANGUAGES.items():
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


def normalized(path: Column) -> Column:
    """One spelling of a path: slashes for backslashes, no '.' segments or empty segments, '..' resolved.

    A '..' that leaves the root is kept, so that such a path equals no file's. Case is kept. Null stays null.
    """
    plain = F.translate(path, "\\", "/")
    parts = F.filter(F.split(plain, "/"), lambda s: (s != "") & (s != "."))
    empty = F.expr("cast(array() as array<string>)")

    def step(acc: Column, s: Column) -> Column:
        up = (s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
        return F.when(up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))

    messy = plain.rlike(r"(^|/)\.{0,2}(/|$)")
    return F.when(messy, F.array_join(F.aggregate(parts, empty, step), "/")).otherwise(plain)


def directory(path: Column) -> Column:
    """All of a path before its last slash, '' where there is none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
