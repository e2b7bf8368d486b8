"""Text expressions. All are Column functions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Five ordered redaction patterns; the first group is the name of the setting.
REDACTIONS = [
    r"(?i)(api[_-]?key|secret|token|password|passwd|pwd)\s*[:=]\s*[\"']?[^\s\"']+[\"']?",
    r"(?i)(auth[_-]?token|bearer[_-]?token|access[_-]?token)\s*[:=]\s*[\"']?[^\s\"']+[\"']?",
    r"(?i)(private[_-]?key|public[_-]?key)\s*[:=]\s*[\"']?[^\s\"']+[\"']?",
    r"(?i)(database[_-]?url|db[_-]?url|connection[_-]?string)\s*[:=]\s*[\"']?[^\s\"']+[\"']?",
    r"(?i)(redis[_-]?url|mongodb[_-]?url)\s*[:=]\s*[\"']?[^\s\"']+[\"']?",
]


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and the signs of paths; null counts as empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-zA-Z0-9_./-]+"), F.lit(0))


def line_count(text: Column) -> Column:
    """Lines separated by line feeds; 1 for an empty text, null for null."""
    return F.size(F.split(text, "\n", -1))


def redact(text: Column) -> Column:
    """Settings named like credentials lose their value."""
    for pattern in REDACTIONS:
        text = F.regexp_replace(text, pattern, "$1=***REDACTED***")
    return text


def title(text: Column) -> Column:
    """Every run of letters begins with a capital and goes on in lower case (digits and signs end a run)."""
    cased = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z]+|[^A-Za-z]+"), F.lit(0)), F.initcap)
    return F.array_join(cased, "")


def ratio(a: Column, b: Column) -> Column:
    """a over b; 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def join_urls(base: Column, path: Column) -> Column:
    """A prefix and a path with one slash between them; an empty side leaves the other."""
    joined = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(path, F.lit("/")))
    return F.when(F.coalesce(base, F.lit("")) == "", path).when(F.coalesce(path, F.lit("")) == "", base).otherwise(joined)


def first_match(value: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern found in the value."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(value.rlike(pattern), label).otherwise(out)
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays; 0 where one has no length."""
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, zero, lambda s, x: s + x.cast("double") * x.cast("double")))
    return ratio(dot, norm(a) * norm(b))
