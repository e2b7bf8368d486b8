"""Source files that do not parse (problem 4).

The tokens of a file are taken one by one from the language of its extension by memoised derivatives. An empty
derivative gives the exact token that fails; a last derivative that is not nullable gives a truncated file. What they
refuse is invalid. A Python file that they accept is then put to the standard parser, which knows what the grammar lets
be (the fields of f-strings, targets, the order of arguments) and may refuse it. Scripts are first
read with a fast lexer, and where that fails again with one that follows templates and JSX.

Defined results: null texts take no part, empty texts are valid; no depth and no number of readings makes a text pass:
nodes that the state no longer holds are dropped on the way; extensions other than py, js, mjs, cjs, jsx, ts, tsx
and json are not judged; redelivered rows count once, by their last delivery; further columns are ignored.
"""

from __future__ import annotations

import ast
import sys
import warnings
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.paths import extension, language
from quarryline.llm import grammars as G
from quarryline.llm.derivatives import END, Grammar
from quarryline.session import has

CHECKED = [".py", ".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".json"]


class Verdict(NamedTuple):
    """Why a text is invalid: 'token' with the place of the failing token, or 'truncated'."""

    reason: str
    line: int
    token: str


def _at(text: str, offset: int, reason: str) -> Verdict:
    return Verdict(reason, text.count("\n", 0, offset) + 1, text[offset : offset + 20].split("\n")[0])


# ---------------------------------------------------------------- Python

_OPEN, _CLOSE = ({G.PY.kind(c) for c in s} for s in ("([{", ")]}"))
_NEWLINE, _INDENT, _DEDENT = (G.PY.kind(k) for k in ("NEWLINE", "INDENT", "DEDENT"))
_PY_BRACKETS = {**{k: 1 for k in _OPEN}, **{k: -1 for k in _CLOSE}}


def _f_string(text: str, at: int) -> int:
    """The end of the f-string whose quotes begin at ``at``; -1 if it doesn't end. Fields are balanced, not parsed."""
    quote = text[at] * 3 if text.startswith(text[at] * 3, at) else text[at]
    i, depth, size = at + len(quote), 0, len(text)
    while i < size:
        c = text[i]
        if depth == 0:
            if text.startswith(quote, i):
                return i + len(quote)
            if c == "\\":
                i += 2
                continue
            if c == "\n" and len(quote) == 1:
                return -1
            if c == "{":
                if text.startswith("{{", i):
                    i += 2
                    continue
                depth = 1
            elif c == "}" and not text.startswith("}}", i):
                return -1
            elif c == "}":
                i += 1
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c in "'\"":
            if text.startswith(quote, i) and quote[0] == c and len(quote) == 1 and not _closes(text, i, c):
                return -1
            j = text.find(c, i + 1)
            if j < 0:
                return -1
            i = j
        i += 1
    return -1


def _closes(text: str, i: int, c: str) -> bool:
    j = text.find(c, i + 1)
    return 0 <= j and "\n" not in text[i:j]


def parse_python(text: str) -> Verdict | None:
    if "\0" in text:
        return _at(text, text.index("\0"), "token")
    text = text.removeprefix("\ufeff")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    state = _read_python(text)
    if state is None:
        return None
    # an f-string with nested quotes or braces needs a scan of its own; it then stands as a plain string
    plain = _without_f_strings(text)
    if plain is not None and _read_python(plain) is None:
        return None
    return _place_python(text if plain is None else plain)


def _read_python(text: str):
    """None if the text is valid, else the last state."""
    g, derive = G.PY, G.PY.derive
    state, depth, indents, first = g.fresh(), 0, [0], True
    kinds, brackets = G.PY_KINDS, _PY_BRACKETS
    for tok in G.PY_TOKEN.findall("\n" + text):
        if tok[:1] == "\n":
            if depth:
                continue
            if not first:
                state = state.d.get(_NEWLINE) or derive(state, _NEWLINE)
            first = False
            column = len(tok) - 1 - tok.rfind("\n")
            if "\t" in tok:
                column = len(tok[tok.rfind("\n") + 1 :].expandtabs(8))
            if column == indents[-1]:
                continue
            while column < indents[-1]:
                indents.pop()
                state = state.d.get(_DEDENT) or derive(state, _DEDENT)
            if column > indents[-1]:
                # a remark that ends the text is no line
                indents.append(column)
                state = state.d.get(_INDENT) or derive(state, _INDENT)
            continue
        k = kinds[tok]
        if k in brackets:
            depth += brackets[k]
        elif k == -1:
            continue
        try:
            state = state.d[k]
        except KeyError:
            state = derive(state, k)
            if len(g.made) > g.limit:
                state = g.lean(state)
    if depth:
        return state
    # the end of the text also ends the last line, and every block
    for k in [_NEWLINE, *[_DEDENT] * (len(indents) - 1)]:
        nxt = derive(state, k)
        if nxt is g.empty and k == _NEWLINE:
            continue
        state = nxt
    return None if g.nullable(state, END) else state


def _place_python(text: str) -> Verdict:
    """The failing token of an invalid text with its place."""
    g, derive = G.PY, G.PY.derive
    state, depth, indents, first = g.start, 0, [0], True
    for m in G.PY_TOKEN.finditer("\n" + text):
        tok, steps, bad = m[1], [], False
        if tok[:1] == "\n":
            if depth:
                continue
            steps = [] if first else [_NEWLINE]
            first = False
            column = len(tok[tok.rindex("\n") + 1 :].expandtabs(8))
            while column < indents[-1]:
                indents.pop()
                steps.append(_DEDENT)
            if column > indents[-1]:
                bad = steps[-1:] == [_DEDENT]
                indents.append(column)
                steps.append(_INDENT)
        elif (k := G.PY_KINDS[tok]) != -1:
            depth += _PY_BRACKETS.get(k, 0)
            steps = [k]
        for k in steps:
            state = derive(state, k)
        if len(g.made) > g.limit:
            state = g.lean(state)
        if bad or state is g.empty:
            at = m.end(1) if tok[:1] == "\n" else m.start(1)
            return _at(text, max(0, at - 1), "token")
    return Verdict("truncated", text.count("\n") + 1, "")


def _without_f_strings(text: str) -> str | None:
    """The text with every f-string as a plain string over as many lines; None if there is none."""
    out, last, found = [], 0, False
    for m in G.PY_TOKEN.finditer(text):
        if m.start(1) < last or m[1] not in ("f", "F", "fr", "fR", "Fr", "FR", "rf", "rF", "Rf", "RF") or text[m.end(1) : m.end(1) + 1] not in ("'", '"'):
            continue
        end = _f_string(text, m.end(1))
        if end < 0:
            continue
        found = True
        out += [text[last : m.start(1)], '""' + "\\\n" * 0]
        lines = text.count("\n", m.start(1), end)
        out[-1] = '"""' + "\n" * lines + '"""' if lines else '""'
        last = end
    return "".join([*out, text[last:]]) if found else None


# ---------------------------------------------------------------- JSON and scripts


def parse_json(text: str) -> Verdict | None:
    g, kinds = G.JS_ON, G.JSON_KINDS
    state, derive = g.fresh(), g.derive
    empty = g.empty
    for m in G.JSON_TOKEN.finditer(text):
        k = kinds[m[1]]
        if k >= 0:
            state = state.d.get(k) or derive(state, k)
            if state is empty:
                return _at(text, m.start(1), "token")
            if len(g.made) > g.limit:
                state = g.lean(state)
    return None if g.nullable(state, END) else Verdict("truncated", text.count("\n") + 1, "")


def _hole(g: Grammar):
    """Whether the field of a template is an expression."""
    kinds = G.ScriptKinds(g, lambda _: False)

    def check(code: str) -> bool:
        state = g.rules["expr"]
        for tok in G.FAST[id(g)].findall(code):
            k = kinds[tok]
            for one in k if isinstance(k, tuple) else (k,):
                if one > 1:
                    state = g.derive(state, one)
        return g.nullable(state, END)

    return check


_KINDS = {id(g): G.ScriptKinds(g, _hole(g)) for g in (G.JS, G.TS)}
_LINE = 1


def _fast_script(text: str, g: Grammar) -> bool:
    """Whether the fast lexer finds a valid text."""
    state = g.fresh()
    derive, after = g.derive, g.after_line
    for k in map(_KINDS[id(g)].__getitem__, G.FAST[id(g)].findall(text)):
        try:
            state = state.d[k]
        except KeyError:
            if k == -1:
                nxt = state
            elif k == _LINE:
                nxt = after(state)
            elif isinstance(k, tuple):
                nxt = state
                for one in k:
                    nxt = derive(nxt, one)
            else:
                nxt = derive(state, k)
            state.d[k] = nxt
            state = nxt
            if len(g.made) > g.limit:
                state = g.lean(state)
    return g.nullable(state, END)


def parse_script(text: str, typed: bool, jsx: bool) -> Verdict | None:
    g = G.TS if typed else G.JS
    if not (jsx and ("</" in text or "/>" in text)) and _fast_script(text, g):
        return None
    state, derive = g.fresh(), g.derive
    empty = g.empty
    for k, at, line in G.careful(text, g, jsx):
        state = derive(state, k | 1 if line else k)
        if state is empty:
            return _at(text, at, "token")
        if len(g.made) > g.limit:
            state = g.lean(state)
    return None if g.nullable(state, END) else Verdict("truncated", text.count("\n") + 1, "")


def _ast(text: str) -> Verdict | None:
    """What the standard parser has against a text that the grammar accepts; nothing where it is too deep for it."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except SyntaxError as e:
        if str(e.msg).startswith("too many nested"):
            return None
        line = max(1, e.lineno or 1)
        rows = text.split("\n")
        return Verdict("token", line, rows[line - 1][max(0, (e.offset or 1) - 1) :][:20] if line <= len(rows) else "")
    except ValueError:
        return Verdict("token", 1, "")
    except (RecursionError, MemoryError):
        return None
    return None


#: Calls that may stand within each other; they are Python's own and use no stack of the machine.
DEPTH = 50_000_000


def judge(text: str | None, ext: str) -> Verdict | None:
    """What is wrong with a text in the language of the extension; None for valid."""
    if not text:
        return None
    if sys.getrecursionlimit() < DEPTH:
        sys.setrecursionlimit(DEPTH)
    if ext == ".py":
        return parse_python(text) or _ast(text.removeprefix("\ufeff"))
    if ext == ".json":
        return parse_json(text)
    return parse_script(text, ext in (".ts", ".tsx"), ext in (".jsx", ".tsx"))


_JUDGED = "file_id bigint, repo_id string, language string, valid boolean, reason string, line int, token string, arrived_at timestamp_ntz"


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [judge(t, e) for t, e in zip(pdf.text, pdf.ext)]
        yield pd.DataFrame({
            "file_id": pdf.file_id, "repo_id": pdf.repo_id, "language": pdf.language, "valid": [v is None for v in found],
            "reason": [v and v.reason for v in found], "line": pd.array([v.line if v else None for v in found], dtype="Int32"),
            "token": [v and v.token for v in found], "arrived_at": pdf.arrived_at})


def judged_files(files: DataFrame) -> DataFrame:
    """Verdict of each delivered row: (file_id, repo_id, language, valid, reason, line, token, arrived_at). No shuffle."""
    rows = files.select("file_id", "repo_id", extension(F.col("path")).alias("ext"), language(F.col("path")).alias("language"), "text", has(files, "arrived_at", "timestamp_ntz").cast("timestamp_ntz"))
    rows = rows.where(F.col("text").isNotNull() & F.col("ext").isin(*CHECKED))
    return rows.mapInPandas(_judge, _JUDGED)


def _last(files: DataFrame) -> DataFrame:
    """The verdict of each file's last delivery; of equally late ones the invalid one. Only verdicts are shuffled."""
    cols = ["repo_id", "language", "valid", "reason", "line", "token"]
    rank = F.struct("arrived_at", (~F.col("valid")).alias("_bad"), *cols)
    return judged_files(files).groupBy("file_id").agg(F.max_by(F.struct(*cols), rank).alias("_v")).select("file_id", "_v.*")


def broken_files(files: DataFrame) -> DataFrame:
    """Files that do not parse, one row each."""
    return _last(files).where("not valid").drop("valid")


def broken_rates(files: DataFrame) -> DataFrame:
    """(repo_id, language, files, broken, rate); a file counts once."""
    out = _last(files).groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("valid")).alias("broken"))
    return out.withColumn("rate", F.col("broken") / F.col("files"))
