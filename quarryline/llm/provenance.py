"""Generated, minified, vendored files and data kept as code (problem 3).

Each code file becomes two sets of token shingles (five tokens, remarks left out): its form, with names, numbers and
strings masked, and its masked text, with the names alone masked. From these come

* generated: the form repeats one block (few distinct shingles for many tokens), or the file belongs to a family within
  its repository (MinHash bands of the form, verified to be 0.8 similar, three different texts) and either
  repeats a block in part or has a form that no other repository has anything like. A form that several repositories
  share is the habit of a trade as often as that of a tool (of 60 such files in sf0.1, 14 were read and all 14 look
  written by hand), so there the family is evidence, not proof;
* vendored: the masked texts are, by MinHash banding and verification, at least 0.8 similar to a file of another
  repository, and so are the names and strings in them: in a cluster of masked texts alone stand copies and code that
  was written after one pattern (1,233 such files in sf0.1). A renamed identifier breaks neither;
* data: nearly all characters of the code lie in one run of literals;
* minified: names of one or two letters and no white space;
* a tool's or third party's notice at the beginning of a remark, or a folder for packages, stands in where a file is the
  only one of its kind in the corpus. Without any of them 0.999 of the files flagged in sf0.1 remain.

Defined results: null and empty texts and files other than js, ts and py take no part; of redelivered rows the last counts;
texts under MIN_SHARED shingles are too short to count as copies; further columns are ignored.
"""

from __future__ import annotations

import keyword
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.paths import language
from quarryline.session import checkpointed, has

SHINGLE, PERMUTATIONS, BANDS, ROWS, SIMILAR = 5, 128, 12, 5, 0.8
#: Minima of a band of copies that are those of names and strings, and similarity of these that a copy has: whoever
#: takes a file over may rename something in it, whoever writes after the same pattern has names of their own.
WORD_ROWS, SAME_WORDS = 2, 0.8
#: Distinct shingles that a file must have to count as a copy of another.
MIN_SHARED = 24
#: A block repeats when distinct masked shingles are at most this share of all, and this many.
REPEATS, BLOCK = 0.14, 150
FAMILY_REPEATS, FAMILY = 0.25, 3
#: Distinct masked shingles under which a form says nothing.
MIN_FORM = 8
#: Similarity from which another repository's form speaks against a family of one repository.
FOREIGN = 0.5
#: Members of a bucket that are compared at a time, and bands that are tried before the others; they change speed only.
SLICE, FIRST_BANDS = 512, 3
#: Different values that texts of one form are counted by: two texts fall together once in so many.
COUNTED = 4096
#: Share of the code's characters in one run of literals, and characters of that run, that make a file data.
LITERAL, LITERAL_CHARS = 0.88, 400
#: Mean length of names and share of white space under which code of some size is minified.
SHORT_NAMES, DENSE, MIN_CODE = 3.2, 0.08, 150

_TOKEN = re.compile(
    r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|//[^\n]*|/\*[\s\S]*?\*/|#[^\n]*|`(?:[^`\\]|\\[\s\S])*`|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*|\S')
_KEYWORDS = set(keyword.kwlist) | set(
    "function const let var export default new switch case catch throw typeof interface type enum extends implements private public static null true false void this".split())
#: Kinds of tokens: a remark, a name, a number, a string, a mark that may stand within data; others follow.
REMARK, NAME, NUMBER, STRING, PLAIN = range(5)
_PLAIN = {c: PLAIN + k for k, c in enumerate(",[]()-+{}")}
_FIRST_OTHER = PLAIN + len(_PLAIN)

#: How tools mark what they wrote. Matched at the beginning of a remark.
_TOOL = re.compile(
    r"(?i)(?:code generated by \S+|@generated(?: by \S+|\s*$)|auto-?generated(?: file\b|:)|<auto-generated>|generated (?:with|by) \S+ on \d|"
    r"this file (?:was|is) (?:automatically|auto-?) ?(?:created|generated)|diese datei wurde automatisch erzeugt|ce fichier a été généré automatiquement|este archivo (?:fue|ha sido) generado automáticamente)")
#: How third parties sign. The name of the project is the group. Matched at the beginning of a remark.
_NOTICE = re.compile(
    r"(?i)(?:@license\s+(\S+)\s+v?\d|copyright(?: \(c\))? the (\S+) (?:authors|contributors|project)|\(c\) (\S+) (?:contributors|authors|project)|:copyright: \(c\) (\S+) project|"
    r"vendored: (\S+)@\d|copied from (\S+) v?\d[\w.]*, upstream|originally part of the (\S+) package)")
#: A word of each form of _TOOL and _NOTICE.
_SAID = ("generated", "created", "erzeugt", "généré", "generado", "@license", "copyright", "(c)", "vendored:", "copied from", "originally part")
#: Folders for other people's packages; the package's own folder follows.
_PACKAGES = r"(?:^|/)(?:node_modules|third_party|third-party|site-packages|_vendor|vendor|vendored|external|bower_components)/[^/]+/"

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: What stands for every name.
_NAMED = np.uint64(0x5851F42D4C957F2D)


class _Tokens(dict):
    """Index of a token's text; the arrays hold its kind, length and hash."""

    def __init__(self):
        super().__init__()
        self.kind, self.size, self.hash, self.held = [], [], [], 0
        self.kinds, self.sizes, self.hashes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def __missing__(self, tok: str) -> int:
        c = tok[0]
        if tok in _KEYWORDS or not (c.isalnum() or c in "_$\"'`"):
            k = REMARK if tok[:2] in ("//", "/*") or c == "#" and len(tok) > 1 else _PLAIN.get(tok)
            if k is None:
                k = _FIRST_OTHER + xxhash.xxh32_intdigest(tok.encode()) % 100_003
        elif c.isdigit():
            k = NUMBER
        elif c in "\"'`":
            k = REMARK if tok[:3] in ('"""', "'''") else STRING  # a docstring
        else:
            k = NAME
        self[tok] = n = len(self.kind)
        self.kind.append(k), self.size.append(len(tok)), self.hash.append(xxhash.xxh64_intdigest(tok.encode("utf-8", "surrogatepass")))
        return n

    def read(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kinds, lengths and hashes of a list of tokens."""
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        seen, held = len(self.kind), self.held
        if seen > len(self.kinds):
            grow = 2 * seen + 4096 - len(self.kinds)
            self.kinds, self.sizes, self.hashes = (np.concatenate([x, np.zeros(grow, x.dtype)]) for x in (self.kinds, self.sizes, self.hashes))
        if seen > held:
            self.kinds[held:seen], self.sizes[held:seen], self.hashes[held:seen] = self.kind[held:], self.size[held:], np.array(self.hash[held:], np.uint64)
            self.held = seen
        return self.kinds[at], self.sizes[at], self.hashes[at]


def shingles(ids: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five; of the whole where it is shorter."""
    n = len(ids)
    if not n:
        return ids
    width = min(SHINGLE, n)
    out = np.zeros(n - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out ^ ids[i : n - width + 1 + i]) * _STEP
            out ^= out >> np.uint64(29)
    return out


def signature(distinct: np.ndarray) -> np.ndarray:
    """The least value under each permutation, of distinct hashes; large sets go in slices."""
    best = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(distinct), 4096):
            best = np.minimum(best, (distinct[at : at + 4096, None] * _MULTIPLY + _ADD).min(0))
    return best


def sketch(best: np.ndarray) -> bytes:
    """One byte of each minimum: two sets agree on a byte with their similarity, and else by chance in one of 256."""
    with np.errstate(over="ignore"):
        return ((best * _STEP) >> np.uint64(56)).astype(np.uint8).tobytes()  # the first bits of a minimum are nearly always 0


def bands(best: np.ndarray, salt: int, words: np.ndarray | None = None) -> list[int]:
    """One key for each band of a signature. With the minima of its words a band has WORD_ROWS of these and fewer of the shingles."""
    rows = ROWS if words is None else ROWS - WORD_ROWS
    held = best[: BANDS * rows].reshape(BANDS, rows)
    if words is not None:
        held = np.hstack([held, words[: BANDS * WORD_ROWS].reshape(BANDS, WORD_ROWS)])
    return [xxhash.xxh64_intdigest(held[b].tobytes(), seed=salt * 100 + b) - (1 << 63) for b in range(BANDS)]


def _code(text: str) -> str:
    """The text with the inside of strings that span lines left out, unless they stand alone as a docstring does."""
    if "`" not in text and '"""' not in text and "'''" not in text:
        return text
    out, last = [], 0
    for m in _TOKEN.finditer(text):
        a = m.start()
        if text[a] in "`\"'" and "\n" in m[0] and (text[a] == "`" or text[text.rfind("\n", 0, a) + 1 : a].strip()):
            out.append(text[last:a])
            last = m.end()
    return "".join([*out, text[last:]])


def _remarks(text: str) -> list[str]:
    """All remarks and docstrings by lines, stripped of their signs. Only texts with the words of a notice are read."""
    low = text.lower()
    if not any(w in low for w in _SAID):
        return []
    out, inside = [], ""
    for x in map(str.strip, _code(text).split("\n")):
        if inside:
            out.append(x.lstrip("* ").rstrip("*/ "))
            if inside in x:
                inside = ""
        elif x.startswith(("//", "#")):
            out.append(x.lstrip("/# !"))
        elif x.startswith(("/*", "<!--")):
            out.append(x.lstrip("/*!<- ").rstrip("*/-> "))
            inside = "" if "*/" in x[2:] or "-->" in x else "*/"
        elif x.startswith(('"""', "'''")):
            out.append(x[3:])
            inside = "" if x[:3] in x[3:] else x[:3]
    return out


def describe(text: str, tokens: _Tokens, python: bool) -> dict:
    """All that is known of a file by itself."""
    words = _TOKEN.findall(text)
    if python:  # '//' divides there
        words = [w for x in words for w in (("//", *_TOKEN.findall(x[2:])) if x[:2] == "//" else (x,))] if "//" in text else words
    elif "#" in text:
        words = [w for x in words for w in (("#", *_TOKEN.findall(x[1:])) if x[0] == "#" and len(x) > 1 else (x,))]
    kind, size, mark = tokens.read(words)
    code = kind != REMARK
    remarks = int(size[~code].sum())
    kind, size, mark = kind[code], size[code], mark[code]
    total = int(size.sum())
    if not total:
        return {"total": 0}
    literal = (kind == NUMBER) | (kind == STRING) | ((kind >= PLAIN) & (kind < _FIRST_OTHER))
    sums = np.cumsum(np.where(literal, size, 0))
    run = int((sums - np.maximum.accumulate(np.where(literal, 0, sums))).max())
    names = kind == NAME
    masked = shingles(kind.astype(np.uint64))
    form = np.unique(masked)
    own = np.unique(shingles(np.where(names, _NAMED, mark)))
    words = np.unique(mark[names | (kind == STRING)])
    return {
        "text": xxhash.xxh64_intdigest(mark.tobytes()) - (1 << 63), "total": total, "run": run, "names": float(size[names].mean()) if names.any() else 0.0,
        "dense": 1 - total / max(1, len(text) - remarks), "all": len(masked), "form": form, "own": own, "words": words,
    }


DESCRIBED = (
    "file_id bigint, repo_id string, path string, total bigint, run bigint, names double, dense double, shingles bigint, forms bigint, own bigint, tool boolean, "
    "notice string, arrived_at timestamp_ntz, text bigint, signature binary, text_bands array<bigint>, form_signature binary, form_bands array<bigint>")


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tokens = _Tokens()
    for pdf in batches:
        if len(tokens) > 400_000:
            tokens = _Tokens()
        rows = []
        for file_id, repo_id, path, lang, at, text in zip(pdf.file_id, pdf.repo_id, pdf.path, pdf.language, pdf.arrived_at, pdf.text):
            d = describe(text, tokens, lang == "py")
            said = _remarks(text)
            notice = next((next(g for g in m.groups() if g) for r in said if (m := _NOTICE.match(r))), None)
            tool = any(_TOOL.match(r) for r in said)
            if not d["total"]:
                rows.append((file_id, repo_id, path, 0, 0, 0.0, 0.0, 0, 0, 0, tool, notice, at, 0, b"", [], b"", []))
                continue
            sig, form, words = signature(d["own"]), signature(d["form"]), signature(d["words"])
            rows.append((
                file_id, repo_id, path, d["total"], d["run"], d["names"], d["dense"], d["all"], len(d["form"]), len(d["own"]), tool, notice, at, d["text"], sketch(sig) + sketch(words),
                bands(sig, 1, words) if len(d["own"]) >= MIN_SHARED and len(d["words"]) else [], sketch(form), bands(form, 2) if len(d["form"]) >= MIN_FORM else []))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in DESCRIBED.split(", ")])


def described(files: DataFrame) -> DataFrame:
    """One row per delivered code file with its measures, notices, signatures and band keys. No shuffle."""
    rows = files.select("file_id", "repo_id", "path", language(F.col("path")).alias("language"), has(files, "arrived_at", "timestamp_ntz").cast("timestamp_ntz").alias("arrived_at"), "text")
    rows = rows.where(F.col("text").isNotNull() & (F.col("text") != "") & (F.col("language") != "other") & F.col("file_id").isNotNull())
    return rows.mapInPandas(_describe, DESCRIBED)


# ---------------------------------------------------------------- clusters
#
# A cluster's node is one signature of one repository, whatever the number of files behind it, so groups of copies and
# files from one template shrink to one row before anything is compared.


def _compare(keys: np.ndarray, ask: np.ndarray, repos: np.ndarray, weight: np.ndarray, signatures: list, own: bool, least: float) -> Iterator[int]:
    """The asking rows with enough similar rows in their bucket: FAMILY texts of their own repository, or one of another.

    Each asks a slice of the bucket at a time and stops when it knows, so that a bucket with many alike costs one slice
    for each; only strangers ask the whole bucket.
    """
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    for a, b in zip(starts[:-1], starts[1:]):
        asking = a + np.flatnonzero(ask[a:b])
        if b - a < 2 or not len(asking):
            continue
        held = np.frombuffer(b"".join(signatures[a:b]), np.uint8).reshape(b - a, -1, PERMUTATIONS)
        bounds = np.array([least, SAME_WORDS])[: held.shape[1]]
        for i in asking:
            n = 0
            for at in range(a, b, SLICE):
                to = min(b, at + SLICE)
                like = ((held[at - a : to - a] == held[i - a]).mean(2) >= bounds).all(1)
                n += int(weight[at:to][like & (repos[at:to] == repos[i])].sum()) if own else int((like & (repos[at:to] != repos[i])).sum())
                if n >= (FAMILY if own else 1):
                    yield i
                    break


def _near(batches: Iterator[pd.DataFrame], own: bool, least: float) -> Iterator[pd.DataFrame]:
    """Rows come sorted by bucket; the last bucket of a batch waits for the next."""
    kept = None
    for pdf in _with_end(batches):
        whole = kept if pdf is None else pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
        if whole is None or not len(whole):
            continue
        keys = whole.band.to_numpy()
        cut = len(keys) if pdf is None else int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        kept = whole.iloc[cut:].reset_index(drop=True)
        if cut:
            part = whole.iloc[:cut]
            told = list(_compare(keys[:cut], part.ask.to_numpy(), part.repo.to_numpy(), part.n.to_numpy(), part.signature.tolist(), own, least))
            yield pd.DataFrame({"node": part.node.to_numpy()[told]}, columns=["node"])


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def near(members: DataFrame, own: bool, least: float) -> DataFrame:
    """(node) of those members that ask and are told: members(band, node, repo, n, ask, signature)."""
    rows = members.repartition("band").sortWithinPartitions("band")
    return rows.mapInPandas(lambda batches: _near(batches, own, least), "node bigint").distinct()


def nodes(rows: DataFrame, signature: str, keys: str, ask: Column) -> DataFrame:
    """(node, repo, look, n, ask, signature, bands): one row for each signature of a repository with its number of texts.

    ``look`` is the same for equal signatures of all repositories. A null repository is one of its own. Texts are
    counted in a set of at most COUNTED values, whatever their number.
    """
    each = rows.where(F.size(keys) > 0).select(F.xxhash64(F.coalesce("repo_id", F.lit(""))).alias("repo"), F.xxhash64(signature).alias("look"), "text", ask.alias("ask"), F.col(signature).alias("signature"), F.col(keys).alias("bands"))
    one = each.groupBy("repo", "look").agg(
        F.size(F.collect_set(F.pmod("text", F.lit(COUNTED)).cast("int"))).alias("n"), F.max("ask").alias("ask"), F.min("signature").alias("signature"), F.first("bands").alias("bands"))
    return one.withColumn("node", F.xxhash64("repo", "look"))


def copies(rows: DataFrame) -> DataFrame:
    """(node) of the signatures that are at least 0.8 similar to one of another repository.

    Equal signatures are told by a count. The others go by their bands: only buckets of two repositories are read, and a
    node that does not know yet asks all members of its buckets, so no link depends on a representative.
    """
    own = checkpointed(nodes(rows, "signature", "text_bands", F.lit(True)))
    shared = own.groupBy("look").agg(F.min("repo").alias("_a"), F.max("repo").alias("_b")).where("_a <> _b").select("look")
    same = own.join(shared, "look", "left_semi").select("node")
    keyed = own.select("node", "repo", F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band").agg(F.min("repo").alias("_a"), F.max("repo").alias("_b")).where("_a <> _b").select("band")
    members = checkpointed(keyed.join(buckets, "band", "left_semi").join(same.withColumn("_same", F.lit(True)), "node", "left"))
    open_ = members.groupBy("band").agg(F.max(F.col("_same").isNull()).alias("_any")).where("_any").select("band")
    members = members.join(open_, "band", "left_semi").select("band", "node", F.col("_same").isNull().alias("ask"))
    found = near(members.join(own.select("node", "repo", "n", "signature"), "node"), False, SIMILAR)
    return same.unionByName(found)


def families(rows: DataFrame, ask: Column) -> DataFrame:
    """(node, elsewhere) of the forms that ask and have FAMILY different texts at least 0.8 similar in their repository.

    ``elsewhere`` tells that other repositories have a form at least FOREIGN similar.
    """
    form = checkpointed(nodes(rows, "form_signature", "form_bands", ask))
    alone = form.where(F.col("ask") & (F.col("n") >= FAMILY)).select("node")
    keyed = form.select("node", "repo", "n", (F.col("ask") & (F.col("n") < FAMILY)).alias("ask"), F.explode("bands").alias("_b"))
    keyed = keyed.select("node", "repo", "n", "ask", F.xxhash64("repo", "_b").alias("band"))
    # a bucket has a family only where its texts are as many
    shared = keyed.groupBy("band").agg(F.sum("n").alias("_n"), F.max("ask").alias("_ask")).where((F.col("_n") >= 2) & F.col("_ask")).select("band")
    sketches = form.select("node", "signature")
    family = checkpointed(alone.unionByName(near(keyed.join(shared, "band", "left_semi").join(sketches, "node"), True, SIMILAR)))
    # whoever has company elsewhere mostly meets it in the first bands; the rest of the bands are for the others
    far = None
    for some in (F.slice("bands", 1, FIRST_BANDS), F.slice("bands", FIRST_BANDS + 1, BANDS)):
        asking = family if far is None else family.join(far, "node", "left_anti")
        everywhere = form.select("node", "repo", "n", F.explode(some).alias("band")).join(asking.withColumn("_in", F.lit(True)), "node", "left")
        wanted = everywhere.where("_in").select("band").distinct()
        asked = everywhere.join(wanted, "band", "left_semi").select("band", "node", "repo", "n", F.coalesce("_in", F.lit(False)).alias("ask"))
        told = near(asked.join(sketches, "node"), False, FOREIGN)
        far = checkpointed(told) if far is None else far.unionByName(told)
    far = far.withColumn("elsewhere", F.lit(True))
    return family.join(far, "node", "left").select("node", F.coalesce("elsewhere", F.lit(False)).alias("elsewhere"))


def not_handwritten(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, generated, vendored, data, minified) of the files that are any of these."""
    rows = checkpointed(described(files))
    share = F.col("run") / F.col("total")
    data = F.coalesce((share >= LITERAL) & (F.col("run") >= LITERAL_CHARS), F.lit(False))
    repeats = F.try_divide(F.col("forms"), F.col("shingles"))
    form = F.col("forms") >= MIN_FORM
    small = (F.col("forms") <= BLOCK) & form
    block, part = small & (repeats <= REPEATS), small & (repeats <= FAMILY_REPEATS)
    minified = (F.col("names") > 0) & (F.col("names") < SHORT_NAMES) & (F.col("dense") < DENSE) & (F.col("total") > MIN_CODE)
    # a family changes nothing for the others
    ask = F.coalesce(form & ~data & ~F.col("tool") & ~block & (~minified | part), F.lit(False))
    # the last delivery of a file, of equally late ones by its text
    cols = ["repo_id", "path", "total", "run", "names", "dense", "shingles", "forms", "own", "tool", "notice"]
    looks = [F.xxhash64("signature").alias("_s"), F.xxhash64("form_signature").alias("_f")]
    slim = rows.groupBy("file_id").agg(F.max_by(F.struct(*cols, *looks), F.struct("arrived_at", "text", "path")).alias("_r")).select("file_id", "_r.*")
    repo = F.xxhash64(F.coalesce("repo_id", F.lit("")))
    slim = slim.withColumns({"_own": F.xxhash64(repo, "_s"), "_form": F.xxhash64(repo, "_f")}).drop("_s", "_f")
    copied = copies(rows).distinct().select(F.col("node").alias("_own"), F.lit(True).alias("_copied"))
    out = slim.join(copied, "_own", "left").join(families(rows, ask).withColumnRenamed("node", "_form"), "_form", "left")
    family = F.col("elsewhere").isNotNull() & (part | ~F.col("elsewhere")) & ask
    vendored = F.col("_copied").isNotNull() | F.col("notice").isNotNull() | F.col("path").rlike(_PACKAGES)
    flags = out.select(
        "file_id", "repo_id", ((block | family) & ~data | F.col("tool")).alias("generated"), (vendored & ~data).alias("vendored"),
        data.alias("data"), (minified & ~data).alias("minified"))
    flags = flags.na.fill(False)
    return flags.where("generated or vendored or data or minified")
