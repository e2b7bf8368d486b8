"""Encoding a corpus with a public byte-level BPE vocabulary (problem 7).

A text is cut into words by the vocabulary's pattern. Within a word a segment tree over its byte positions holds, in
its root, the leftmost pair of live neighbours with the least rank; a merge kills the right position and updates the
two pairs that touch the merged token, in logarithmic time each, so a word of n bytes costs n log n.

Defined results: empty and null texts give an empty list; text that looks like a special token is ordinary text; a
byte without an id in the vocabulary is an error at load time. Lone surrogates are encoded as three bytes.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files are on the driver; a parameter of every operator here. Executors get the file they need.
FOLDER = "/opt/tokenizers"
#: Fixed value: the pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a worker remembers; a full memory is emptied, which changes speed only.
MEMORY = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of all tokens from a rank file: one base64 token and its id per line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"{path} lacks single bytes: {missing[:5]}")
    return ranks


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word. Of equal ranks the leftmost pair is merged first."""
    n = len(word)
    if n == 1:
        return [ranks[word]]
    none = 1 << 62
    size = 1 << (n - 1).bit_length()
    bits = size.bit_length()
    tree = [none] * (2 * size)
    token = [word[i : i + 1] for i in range(n)]
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    for i in range(n - 1):
        if (r := get(word[i : i + 2])) is not None:
            tree[size + i] = r << bits | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += size
        if tree[i] == value:
            return
        tree[i] = value
        while i > 1:
            a, b = tree[i], tree[i ^ 1]
            i >>= 1
            least = a if a < b else b
            if tree[i] == least:
                return
            tree[i] = least

    mask = (1 << bits) - 1
    while (top := tree[1]) != none:
        i = top & mask
        j = right[i]
        token[i] += token[j]
        k = right[i] = right[j]
        token[j] = b""
        put(j, none)
        if k < n:
            left[k] = i
            r = get(token[i] + token[k])
            put(i, none if r is None else r << bits | i)
        else:
            put(i, none)
        if (h := left[i]) >= 0:
            r = get(token[h] + token[i])
            put(h, none if r is None else r << bits | h)
    return [ranks[t] for t in token if t]


class Encoder:
    """Encodes texts; remembers the ids of words it has seen."""

    def __init__(self, path: str):
        self.ranks, self.cut, self.seen = load_ranks(path), regex.compile(PATTERN), {}

    def words(self, text: str) -> Iterator[list[int]]:
        seen = self.seen
        for word in self.cut.findall(text):
            ids = seen.get(word)
            if ids is None:
                ids = merge_word(word.encode("utf-8", "surrogatepass"), self.ranks)
                if len(word) <= 64:
                    if len(seen) >= MEMORY:
                        seen.clear()
                    seen[word] = ids
            yield ids

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.words(text) for i in ids] if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self.words(text))) if text else 0


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary; the file is the one sent along where there is none at the path."""
    return Encoder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


def share_vocabulary(spark: SparkSession, vocabulary: str, folder: str) -> None:
    """Send the vocabulary's file to every executor, once per session."""
    path = os.path.join(folder, f"{vocabulary}.tiktoken")
    if os.path.basename(path) not in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(path)


def token_ids(text: Column, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> Column:
    """The ids of a text as array<int>."""
    path = os.path.join(folder, f"{vocabulary}.tiktoken")

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for texts in batches:
            yield pd.Series([e.encode(t) for t in texts])

    return encode(text)


def token_count(text: Column, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> Column:
    """The number of ids of a text; 0 for empty and null."""
    path = os.path.join(folder, f"{vocabulary}.tiktoken")

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for texts in batches:
            yield pd.Series([e.count(t) for t in texts], dtype="int64")

    return count(text)


def encode_corpus(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, ids) for each row of documents; no shuffle."""
    share_vocabulary(documents.sparkSession, vocabulary, folder)
    return documents.select("doc_id", token_ids(F.col("text"), vocabulary, folder).alias("ids"))
