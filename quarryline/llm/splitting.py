"""Splitting oversized texts at natural boundaries (problem 1).

The byte offsets of all tokens are the prefix sums of their lengths; three sorted arrays hold the offsets that end a
block (before a blank line or a definition), a line, and a token. From the start of a piece the last boundary under the
limit is found by binary search, first among blocks, then lines, then tokens; where none lies in reach, the text is cut
hard between two characters. The next piece begins the overlap before that end.

Defined results: a text not over its limit, an empty or a null text yields no pieces; a language without a limit is not
split; redelivered rows count once (the last delivery), by which it is decided whether a file is over its limit; an overlap
that is not under the limit is refused; further columns are ignored. A cut never lies inside a character, so an overlap
may be up to three bytes longer than asked, and where that would leave no progress as much shorter. A limit under four
bytes is taken as four.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.paths import language

_TOKEN = re.compile(r"\w+|[^\S\n]+|\n|[^\w\s]")
#: The end of a line that a blank line or a line of code in the first column follows.
_BLOCK = re.compile(r"\n(?=[^\S\n]*\r?\n|[^\s)\]}])")

PIECE = "file_id bigint, piece int, start bigint, end bigint, boundary string, text string"


def offsets(text: str, pattern: re.Pattern) -> list[int]:
    """Byte offsets at which matches of the pattern end, from prefix sums of byte lengths; ends strictly increase."""
    ends = [m.end() for m in pattern.finditer(text)]
    if text.isascii():
        return ends
    return list(accumulate(len(text[a:b].encode("utf-8", "surrogatepass")) for a, b in zip([0, *ends], ends)))


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, boundary) in bytes. Pieces cover the text, none is over the limit, each starts the overlap before the last end."""
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    limit = max(limit, 4)
    if size <= limit:
        return [(0, size, "end")] if size else []
    overlap = max(0, overlap)
    if overlap >= limit:
        raise ValueError(f"an overlap of {overlap} bytes leaves nothing of a limit of {limit}")
    tiers = [("block", offsets(text, _BLOCK)), ("line", offsets(text, re.compile("\n"))), ("token", offsets(text, _TOKEN))]

    def whole(at: int) -> int:  # back to the first byte of a character
        while 0 < at < size and raw[at] & 0xC0 == 0x80:
            at -= 1
        return at

    out, start = [], 0
    while size - start > limit:
        # a block is worth a piece of at least half the limit; lines and tokens only have to make progress
        for (name, ends), least in zip(tiers, (max(limit // 2, overlap + 4), overlap + 4, overlap + 4)):
            k = bisect_right(ends, start + limit)
            if k and ends[k - 1] >= start + least:
                end = ends[k - 1]
                break
        else:
            name, end = "hard", whole(start + limit)
        out.append((start, end, name))
        back = whole(end - overlap)
        while back <= start or whole(back + limit) <= end:  # the next piece must reach further
            back += 1
            while raw[back] & 0xC0 == 0x80:
                back += 1
        start = back
    return [*out, (start, size, "end")]


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for file_id, text, limit, overlap in zip(pdf.file_id, pdf.text, pdf.max_bytes, pdf.overlap_bytes):
            raw = text.encode("utf-8", "surrogatepass")
            for k, (a, b, why) in enumerate(pieces(text, int(limit), int(overlap))):
                rows.append((file_id, k, a, b, why, raw[a:b].decode("utf-8", "surrogatepass")))
        yield pd.DataFrame(rows, columns=["file_id", "piece", "start", "end", "boundary", "text"])


def split_oversized(files: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every file over its language's limit: (file_id, piece, start, end, boundary, text).

    Sizes are compared in the JVM. The last delivery of a file is found on narrow rows, and only texts that are oversized
    go on. ``limits`` has one row per language.
    """
    one = limits.groupBy("language").agg(F.min_by(F.struct("max_bytes", "overlap_bytes"), "max_bytes").alias("_l")).select("language", "_l.*")
    rows = files.where("text is not null and file_id is not null").select("file_id", language(F.col("path")).alias("language"), "text", "arrived_at").join(one, "language", "left")
    over = F.coalesce(F.octet_length("text") > F.col("max_bytes"), F.lit(False))
    # the text goes along only where it is oversized
    slim = rows.select("file_id", "arrived_at", over.alias("over"), F.when(over, F.col("text")).alias("text"), "max_bytes", "overlap_bytes")
    last = slim.groupBy("file_id").agg(F.max_by(F.struct("over", "text", "max_bytes", "overlap_bytes"), F.struct("arrived_at", "over", "text")).alias("_r"))
    return last.where("_r.over").select("file_id", "_r.text", "_r.max_bytes", "_r.overlap_bytes").mapInPandas(_split, PIECE)
