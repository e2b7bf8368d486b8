"""Visually identical text with different characters (problem 9).

Every text gets a skeleton: it is decomposed, characters that show nothing are dropped, each other character is
replaced by its prototype, and the result is decomposed again. Texts with equal skeletons look the same. The consistent
form of a text keeps its script: it is the same without the step that maps letters of one script to another's.

The prototypes are the public table of confusables, read from the Unicode library that Spark brings along, less the
pairs that a reader tells apart, by this rule: a character is replaced only by one of its own class (capital, small
letter, letter without case, digit, sign), plain characters and combining marks stand for themselves, and nothing is
replaced by several characters. So 0/O, 1/l, I/l, rn/m, accents and case stay apart.

Kept apart besides: superscripts and circled forms, line breaks
against spaces, and the number of spaces. Defined results: a null text has a null skeleton; a text without any visible
character takes no part in pairs; exact copies are no pair of each other; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarryline.session import checkpointed, spread_left_join

#: Decompositions that keep the look of a character.
KEPT_KINDS = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")
#: Characters that show nothing: default ignorables, and controls other than white space.
_HIDDEN = re.compile(
    r"[\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e"
    r"\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufffb\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]+"
)
#: All ways to end a line.
_LINE = re.compile(r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_PLAIN = re.compile(r"[\n\x20-\x7e]*")


def _class(ch: str) -> str:
    """Capital, small letter, other letter, digit, mark or sign."""
    kind = unicodedata.category(ch)
    return {"Lu": "U", "Lt": "U", "Ll": "L", "Lo": "O"}.get(kind) or {"N": "N", "M": "M"}.get(kind[0], "S")


def _same_class(a: str, b: str) -> bool:
    x, y = _class(a), _class(b)
    return x == y and x != "M" or x == "O" and y in "UL"


def chosen(public: dict[str, str]) -> dict[str, str]:
    """The prototypes that the rule leaves of a public table (character to skeleton)."""
    plain: dict[str, list[str]] = {}
    for c in map(chr, range(0x21, 0x7F)):
        plain.setdefault(public.get(c, c), []).append(c)
    out = {}
    for ch, to in public.items():
        if ch < "\x7f":
            continue
        # capitals before small letters, for letters that have no case
        options = sorted((c for c in plain.get(to, []) if _same_class(ch, c)), key=lambda c: (_class(c) != "U", c))
        if options:
            out[ch] = options[0]
        elif to not in plain and len(to) == 1 and to != ch and _same_class(ch, to):
            out[ch] = to
    return out


#: Fixed value: the palochka is a bar, as in earlier versions of the table, not an i without its dot.
_BARS = {"\u04cf": "l"}
_TABLES: dict[str, dict[str, str]] = {}


def confusables(spark: SparkSession) -> dict[str, str]:
    """The chosen prototypes of all assigned characters; some thousand entries, made once per session with one call."""
    if "" not in _TABLES:
        chars = [c for c in map(chr, range(0x21, 0x20000)) if unicodedata.category(c)[0] not in "CZ"]
        checker = getattr(spark._jvm.com.ibm.icu.text.SpoofChecker, "Builder")().build()
        found = checker.getSkeleton("\n".join(chars)).split("\n")  # a line break is no part of any skeleton
        _TABLES[""] = chosen({a: b for a, b in zip(chars, found) if a != b and unicodedata.normalize("NFD", a) == a}) | _BARS
    return _TABLES[""]


class Prototypes(dict):
    """Prototype by code point, worked out when first asked; without look-alikes scripts stay apart."""

    def __init__(self, across: dict[str, str] | None = None):
        self.across = across or {}

    def of(self, ch: str) -> str:
        if ch.isspace():
            return "\n" if ch == "\n" else " "
        if unicodedata.category(ch) == "Zs":
            return " "
        kind, _, rest = unicodedata.decomposition(ch).partition(" ")
        if kind in KEPT_KINDS:
            return "".join(self.of(chr(int(c, 16))) for c in rest.split())
        if kind and not kind.startswith("<"):
            return "".join(self.of(c) for c in unicodedata.normalize("NFD", ch))
        return self.across.get(ch, ch)

    def __missing__(self, code: int) -> str:
        self[code] = out = self.of(chr(code))
        return out


_WITHIN = Prototypes()


def skeleton(text: str | None, across: Prototypes) -> str | None:
    """The form in which texts that look the same are equal."""
    if text is None or _PLAIN.fullmatch(text):
        return text
    text = _HIDDEN.sub("", _LINE.sub("\n", text))
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(across))


def consistent(text: str | None) -> str | None:
    """One form for all ways to encode the same letters, composed, in their own script."""
    if text is None or _PLAIN.fullmatch(text):
        return text
    text = _HIDDEN.sub("", _LINE.sub("\n", text))
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_WITHIN))


def _udf(f):
    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([f(t) for t in texts], dtype="object")

    return run


def skeleton_column(spark: SparkSession, text: Column) -> Column:
    told = spark.sparkContext.broadcast(confusables(spark))  # the table, whatever the input

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        across = Prototypes(told.value)
        for texts in batches:
            yield pd.Series([skeleton(t, across) for t in texts], dtype="object")

    return run(text)


def consistent_column(text: Column) -> Column:
    return _udf(consistent)(text)


def keyed(documents: DataFrame) -> DataFrame:
    """(doc_id, look, exact): digests of the skeleton and of the text, of documents with visible characters."""
    looks = documents.where("text is not null").select("doc_id", "text", skeleton_column(documents.sparkSession, F.col("text")).alias("_s"))
    return looks.where(F.col("_s").rlike(r"\S")).select("doc_id", F.md5("_s").alias("look"), F.md5("text").alias("exact"))


def spellings(docs: DataFrame) -> DataFrame:
    """(look, exact, documents) of the looks with several spellings; docs as from keyed()."""
    each = docs.groupBy("look", "exact").agg(F.count(F.lit(1)).alias("documents"))
    several = each.groupBy("look").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("look")
    return each.join(several, "look")


def lookalike_pairs(documents: DataFrame) -> DataFrame:
    """Pairs of documents that look the same but differ as strings: (doc_id_a, doc_id_b).

    Pairs are formed between the different spellings of one look first, and only these are joined to the documents, so
    the work follows the size of the result; any number of exact copies without another spelling costs nothing. Only
    documents of looks with several spellings are shuffled by their spelling.
    """
    docs = checkpointed(keyed(documents))
    some = checkpointed(spellings(docs).select("look", "exact"))
    held = docs.join(some, ["look", "exact"], "left_semi")
    two = some.withColumnRenamed("exact", "one").join(some.withColumnRenamed("exact", "other"), "look").where("one < other")
    a = held.select(F.col("doc_id").alias("_a"), "look", F.col("exact").alias("one"))
    b = held.select(F.col("doc_id").alias("_b"), "look", F.col("exact").alias("other"))
    pairs = two.join(a, ["look", "one"]).join(b, ["look", "other"])
    return pairs.select(F.least("_a", "_b").alias("doc_id_a"), F.greatest("_a", "_b").alias("doc_id_b"))


def lookalike_classes(documents: DataFrame) -> DataFrame:
    """One row per document: (doc_id, text in its consistent form, class_id, spellings, links).

    class_id is the least doc_id of those that look the same, spellings the number of different texts among them and
    links the number of documents that look the same as this one in another spelling. A null text, and one without any
    visible character, is in no class: its class_id and spellings are null and it has no links. Classes are found on
    digests; they come back to the texts by a join that splits hot looks.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", consistent_column(F.col("text")).alias("text"), skeleton_column(spark, F.col("text")).alias("_s"), F.md5("text").alias("exact"))
    rows = rows.select("doc_id", "text", "exact", F.when(F.col("_s").rlike(r"\S"), F.md5("_s")).alias("look"))
    keys = checkpointed(keyed(documents))
    each = keys.groupBy("look", "exact").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("same"))
    classes = each.groupBy("look").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("spellings"), F.sum("same").alias("_all"))
    told = each.join(classes, "look").select("look", "exact", "class_id", "spellings", (F.col("_all") - F.col("same")).alias("links"))
    counts = each.select("look", "exact", F.col("same").alias("_n"))
    # texts without a class have a key of their own each, so that they do not meet
    rows = rows.withColumn("look", F.coalesce("look", F.concat(F.lit("-"), F.col("doc_id").cast("string")))).withColumn("exact", F.coalesce("exact", F.lit("")))
    out = spread_left_join(rows, told, ["look", "exact"], "doc_id", counts=counts)
    return out.select("doc_id", "text", "class_id", "spellings", F.coalesce("links", F.lit(0)).alias("links"))
