"""Credentials embedded in source code (problem 6).

Lines are read by the model where they hold what a credential needs: a name that speaks of one by its letters
(``credential_names``) before a sign of assignment, a literal whose characters are mixed as in no word, an address with
a user, a header, the prefix of a known key format, or a key block. Their lexical tokens are labelled by a linear-chain
conditional random field with features of shape and context; the spans of the best labelling (Viterbi) are the literal
characters that are redacted. A span that is a placeholder by the fixed list is dropped afterwards. Of a key block the
first line is reported and the body is redacted up to its end line.

The model is trained here, on ``SAMPLE`` labelled lines that are generated with a seed: names, values and line forms
are combined at random, with decoys (placeholders, digests, ids, references, settings about credentials). Training
takes a few seconds on the driver, once per process; the weights are some ten thousand numbers whatever the input.

Defined results: null and empty texts have no findings; a file counts once however often it was delivered; further
columns are ignored; lines end at '\\n' and are counted from 1. Masked characters become 'x', so lengths, lines and
quotes stay as they were.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import credential_names as N
from quarryline.session import has

#: Number of generated lines that the model is fitted on.
SAMPLE = 4500
SEED = 11

#: Words that make a name a credential's when they end it.
SECRET_WORDS = {"password", "passwd", "passphrase", "pwd", "pass", "secret", "token", "apikey", "auth", "credential", "credentials", "authorization"}
#: Words before a final 'key' that make it a credential's.
KEY_WORDS = {"api", "encryption", "signing", "private", "access", "secret", "client", "auth", "master", "account", "license", "service"}
#: Words that end the name of a setting about a credential, or of a value that is public.
SAFE_WORDS = {
    "length", "type", "header", "url", "uri", "name", "path", "ttl", "kind", "expiry", "expires", "limit", "count", "field", "policy", "hint", "min",
    "max", "digest", "sha256", "sha1", "sha512", "md5", "checksum", "etag", "commit", "revision", "integrity", "id", "uuid", "hash", "fingerprint", "public", "required", "enabled", "endpoint", "prefix", "label", "rotation", "age", "days", "size",
}
#: What stands where a credential is to be filled in.
PLACEHOLDERS = {
    "example-key", "example", "changeme", "change-me", "change_me", "todo", "tbd", "fixme", "your-api-key-here", "your_password", "your-password", "your_token", "your-token",
    "your_api_key", "your-secret", "your_secret", "redacted", "not-set", "not_set", "notset", "unset", "dummy", "replace_me", "replace-me", "replaceme", "placeholder", "none", "null", "undefined", "true", "false",
    "secret", "password", "token", "test", "sample", "insert", "fill-me", "empty", "default", "bearer", "basic", "masked", "hidden",
}
_MASKED = re.compile(r"(?i)[x*.#•_-]{3,}|<[^<>]*>|\$\{[^{}]*\}|\{\{[^{}]*\}\}|%\w+%|your[-_ ].*|(?:example|change|insert|replace)[-_ ].*")
#: How keys of known formats begin.
KNOWN = re.compile(r"AKIA[A-Z0-9]{12}|ASIA[A-Z0-9]{12}|AIza[\w-]{20}|gh[pousr]_\w{20}|github_pat_\w{20}|glpat-[\w-]{16}|[sprk]k_(?:live|test)_\w{16}|xox[abeoprs]-[\w-]{12}|eyJ[\w-]{10,}\.[\w-]{8,}|npm_\w{20}|SG\.[\w-]{16}|whsec_\w{16}|[a-z]{2,6}_(?=[A-Za-z]*\d[A-Za-z]*\d)[A-Za-z0-9]{24}|dop_v1_\w{20}|hf_\w{20}")

_CHUNK = r"[\w+\-.!#$%^&*~|]+"
_TOKEN = re.compile(rf"[A-Za-z][A-Za-z0-9+.\-]*://|\$\{{|\{{\{{|\}}\}}|{_CHUNK}|\S")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_HEX = re.compile(r"[0-9a-fA-F]{16,}")
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
_PHRASE = re.compile(r"[a-z]+(?:-[a-z]+){1,5}-\d+")
_IDENT = re.compile(r"[A-Za-z_$][\w$]*(?:[.\-]+[A-Za-z_$][\w$]*)*")
_ODD_CASE = re.compile(r"[a-z][A-Z](?![A-Za-z])|[A-Z]{2}[a-z]{1,2}(?![A-Za-z])|[a-z][A-Z]{2,}[a-z]")
_CAMEL_NAME = re.compile(r"[\w$]*(?:ID|URL|API|JSON|HTML|IDs|URLs|APIs)[\w$]*")
#: Calls that take a name and a password.
_LOGIN = re.compile(r"(?i)connect|login|log_?in|auth|sign_?in|credential|session")
#: Encoded data that goes on to the left or right of a place.
_MEMBER = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+")
_BLOB_BEFORE, _BLOB_AFTER = re.compile(r"[A-Za-z0-9+/]{24,}[/+]$"), re.compile(r"[/+][A-Za-z0-9+/]{24,}")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")


@lru_cache(maxsize=200_000)
def name_kind(chunk: str) -> str:
    """cred, safe or other: what the words of an identifier say."""
    words = [w.lower() for w in _CAMEL.findall(chunk)]
    while words and words[-1].isdigit():
        words.pop()
    if not words:
        return "other"
    last, before = words[-1], words[-2] if len(words) > 1 else ""
    if last in SECRET_WORDS or last == "key" and before in KEY_WORDS or before + last in SECRET_WORDS:
        return "cred"
    if last in SAFE_WORDS or before in SECRET_WORDS or any(w.rstrip("0123456789") + "256" in SAFE_WORDS for w in words[-1:]) or last == "sha":
        return "safe"
    return "other"


@lru_cache(maxsize=200_000)
def shape(tok: str) -> str:
    """The class of a token."""
    if tok.endswith("://"):
        return "scheme"
    if len(tok) == 1 and not tok.isalnum():
        return tok
    if tok in ("${", "{{", "}}"):
        return tok
    low = tok.lower()
    if low in ("bearer", "basic", "token"):
        return low
    if tok in ("-u", "--user", "-p", "--password", "--token"):
        return "flag"
    if low in PLACEHOLDERS or _MASKED.fullmatch(tok):
        return "blank"
    if tok.startswith(("process.env", "os.environ", "os.getenv", "import.meta.env", "ENV")):
        return "env"
    if KNOWN.match(tok):
        return "known"
    if _UUID.fullmatch(tok):
        return "uuid"
    if _HEX.fullmatch(tok) and re.search(r"\d", tok):
        return "hex"
    if _PHRASE.fullmatch(tok):
        return "phrase"
    if tok.isdigit() or re.fullmatch(r"\d+(?:\.\d+)*", tok):
        return "num"
    digit, upper, lower = (bool(re.search(p, tok)) for p in (r"\d", "[A-Z]", "[a-z]"))
    if re.fullmatch(r"[\w$.\-]+", tok) and _IDENT.fullmatch(tok) and name_kind(tok) == "cred":
        return "name"
    if len(tok) >= 6 and digit and (upper or lower):
        return "mixed"
    if len(tok) >= 12 and upper and lower and sum(a.islower() != b.islower() for a, b in zip(tok, tok[1:])) > 4:
        return "letters"
    if re.search(r"[^\w.$-]", tok) and len(tok) >= 6 and tok[0].isalnum():
        return "symbols"
    if len(tok) >= 8 and _ODD_CASE.search(tok) and not _CAMEL_NAME.fullmatch(tok):
        return "odd"
    if len(tok) >= 8 and tok.isalpha() and (re.search(r"(?i)[bcdfghjklmnpqrstvwxz]{5}", tok) or not re.search("[aeiouy].*[aeiouy]", tok.lower())):
        return "odd"
    return "word"


@lru_cache(maxsize=200_000)
def mixture(tok: str) -> tuple[str, int]:
    """The classes of a token's characters, and how its letters, digits and signs take turns for its length (0 to 3)."""
    kinds = ["u" if c.isupper() else "l" if c.isalpha() else "d" if c.isdigit() else "s" for c in tok]
    turns = sum(a != b and (a, b) != ("u", "l") for a, b in zip(kinds, kinds[1:]))
    return "".join(sorted(set(kinds))), min(3, 6 * turns // max(6, len(tok)))


def contexts(line: str, names: N.Names) -> list[tuple[int, int, tuple]]:
    """(start, end, emission key) of each token of a line. The key holds all that the features are made of."""
    toks = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(line)]
    shapes = [shape(t) for _, _, t in toks]
    n = len(toks)
    out = []
    key, level, rhs, ref, ctx, called = "none", 0, False, 0, "", False
    pem = bool(_PEM.search(line))
    for i, (a, b, t) in enumerate(toks):
        s = shapes[i]
        prev, nxt = shapes[i - 1] if i else "^", shapes[i + 1] if i + 1 < n else "$"
        glued = bool(i) and toks[i - 1][1] == a
        # what follows an address, a flag or a scheme of a header
        if s == "scheme":
            j, colon = i + 1, 0
            while j < n and toks[j][0] == toks[j - 1][1] and toks[j][2] not in "\"'`,;<>()" and shapes[j] not in ("@", "/"):
                colon = colon or j * (shapes[j] == ":")
                j += 1
            if j < n and shapes[j] == "@" and colon:
                ctx = ("user", colon, j)
            elif i + 1 < n and (toks[i + 1][2].startswith("hooks.") or ".hooks." in toks[i + 1][2] or toks[i + 1][2].startswith("hooks")):
                ctx = ("hook", i + 2, n)
            else:
                ctx = ("url", i + 1, n)
        elif s == "flag":
            ctx = ("flag", i + 1, n)
        elif s in ("bearer", "basic", "token") and nxt not in ("=", ":", "'", '"', "`", "$", ".", "_", ")", ",", ";") and i + 1 < n and toks[i + 1][0] > b:
            ctx = ("header", i + 1, n)
        elif ctx and t in "\"'`" or ctx and ctx[0] in ("url", "hook", "user") and not glued and i >= ctx[1]:
            ctx = ""
        where = ""
        if ctx:
            what, lo, hi = ctx
            if what == "user":
                where = "userpass" if lo < i < hi else "address"
            elif what == "flag":
                where = "flagpass" if prev == ":" and glued or i and out and out[-1][2][3] == "flagpass" and glued else "flag"
            elif what == "hook":
                where = "hookpath" if i >= lo else "address"
            elif what == "header":
                where = "headval"
                if i > lo and not glued:
                    where, ctx = "", ""
            else:
                where = "address"
        ref += (s in ("${", "{{", "<")) - (s in ("}", "}}", ">") and ref > 0)
        out.append((a, b, (s, min(len(t) // 4, 8), key, where, rhs, ref > 0 or s in ("}", "}}", ">") and prev != "=", prev, nxt, pem, glued, level, *(mixture(t) if len(t) > 3 else ("", 0)), called)))
        # the name that the next value belongs to
        if _IDENT.fullmatch(t) and where in ("", "flag"):
            k = i + 1
            while k < n and toks[k][2] in "\"')]?":
                k += 1
            if k < n and (toks[k][2] in "=:" or shapes[k] == "symbols" and toks[k][2] == "||" or toks[k][2] == "||" or toks[k][2] == ","):
                kind = name_kind(t)
                if toks[k][2] != "," or kind == "cred" and any(toks[j][2].endswith(("env", "get", "environ")) for j in range(max(0, i - 3), i)):
                    key, level, rhs = kind, names.level(t), False
            elif k < n and toks[k][2] == "(" and _LOGIN.search(t):
                called = True
        if t in "=:" or t in ("||", ","):
            rhs = key != "none"
    return out


def features(e: tuple) -> list[str]:
    s, size, key, where, rhs, ref, prev, nxt, pem, glued, level, mix, turns, called = e
    return [
        "1", f"s={s}", f"s={s},k={key}", f"s={s},w={where}", f"w={where}", f"k={key},r={rhs}", f"s={s},k={key},r={rhs}", f"s={s},n={size}", f"ref={ref}", f"ref={ref},s={s}",
        f"p={prev}", f"p={prev},s={s}", f"x={nxt}", f"x={nxt},s={s}", f"pem={pem}", f"pem={pem},s={s}", f"g={glued},s={s}", f"w={where},p={prev}", f"k={key},p={prev},s={s}",
        f"l={level},r={rhs}", f"l={level},r={rhs},k={key}", f"l={level},r={rhs},p={prev}", f"l={level},s={s}", f"m={mix},t={turns}", f"t={turns},l={level},r={rhs}", f"c={called},m={mix},t={turns},p={prev}", f"c={called},s={s},x={nxt}",
    ]


# ---------------------------------------------------------------- training lines


def _value(r: random.Random, words: list[str]) -> str:
    low, alnum = "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    cap = lambda: r.choice(words).title()
    while True:
        if r.random() < 0.2:  # without any digit
            return r.choice([pick(low[:26], r.choice([10, 12, 14, 16])), pick(alnum[:52], 6) + r.choice("!#%*+-~") + pick(alnum[:52], 6), pick(alnum[:52], 20)])
        v = r.choice([
            lambda: "AKIA" + pick(alnum[:26] + "0123456789", 16), lambda: "AIza" + pick(alnum + "-_", 35), lambda: "gh" + r.choice("pos") + "_" + pick(alnum, 36),
            lambda: "sk_live_" + pick(alnum, 24), lambda: "xoxb-" + pick("0123456789", 11) + "-" + pick(alnum, 24), lambda: "eyJhbGciOiJIUzI1NiJ9.eyJ" + pick(alnum + "-_", 40) + "." + pick(alnum + "-_", 43),
            lambda: r.choice(["abc_", "key_", "tok_", "prv_"]) + pick(low, 32), lambda: pick("0123456789abcdef", r.choice([32, 40])), lambda: pick(low, r.choice([10, 14, 16, 20])), lambda: pick(alnum, r.choice([10, 12, 16, 24])),
            lambda: pick(alnum + "+/", 40), lambda: pick(alnum + "+//", 40), lambda: pick(alnum, 28) + r.choice(["=", "==", ""]), lambda: pick(alnum, 6) + r.choice("!#%*+-_~") + pick(alnum, 7),
            lambda: cap() + r.choice("!#%*_-") + cap() + pick("0123456789", 2), lambda: cap() + cap() + pick("0123456789", 2), lambda: "-".join(r.choice(words) for _ in range(3)) + "-" + pick("0123456789", r.choice([2, 4])),
        ])()
        if re.search(r"\d", v) or len(v) > 20:
            return v


def _name(r: random.Random, words: list[str], kind: str, style: str) -> str:
    if kind == "cred":
        parts = r.choice([["password"], ["passwd"], ["pwd"], ["smtp", "pass"], ["db", "password"], ["secret"], ["client", "secret"], ["webhook", "secret"], ["token"], ["auth", "token"], ["access", "token"],
                          ["private", "token"], ["api", "key"], ["apikey"], ["encryption", "key"], ["signing", "key"], ["redis", "auth"], ["pass"], [r.choice(words), "password"], [r.choice(words), "token"],
                          [r.choice(N.SECRET)], [r.choice(words), r.choice(N.SECRET)], [r.choice(N.KEYED), "key"], ["session", "key"]])
    elif kind == "safe":
        parts = r.choice([["password", "min", "length"], ["token", "type"], ["api", "key", "header"], [r.choice(words), "commit"], [r.choice(words), "sha256"], [r.choice(words), "etag"], [r.choice(words), "digest"],
                          [r.choice(words), "revision"], ["integrity"], [r.choice(words), "id"], ["token", "ttl"], ["secret", "name"], ["password", "policy"], ["auth", "url"]])
    else:
        parts = r.choice([[r.choice(words)], [r.choice(words), r.choice(words)], [r.choice(N.OTHER)], [r.choice(words), r.choice(["key", "id", "code", "hash", "ref"])]])
    if style == "camel":
        out = parts[0] + "".join(p.title() for p in parts[1:])
    elif style == "dot":
        out = ".".join([r.choice(words), *parts])
    elif style == "upper":
        out = "_".join(parts).upper()
    else:
        out = "_".join(parts)
    return out + (f"_{r.randrange(999)}" if r.random() < 0.3 and style in ("upper", "snake") else "")


def training_lines(count: int = SAMPLE, seed: int = SEED) -> list[tuple[str, list[tuple[int, int]]]]:
    """Generated lines with the spans of their credentials."""
    r = random.Random(seed)
    words = "harbor lantern meadow copper violet summit gravel orchard pepper saddle timber walnut beacon cactus dragon ember falcon glacier hazel island jungle kettle linen marble nectar oyster pebble quartz ribbon silver".split()
    blanks = ["example-key", "changeme", "todo", "your-api-key-here", "your_password", "<token>", "<insert secret>", "${SECRET}", "{{ vault_token }}", "REDACTED", "not-set", "dummy", "xxxxxxxxxxxxxxxx", "********", "REPLACE_ME", "${DB_PASSWORD}", "<password>"]
    out = []
    for _ in range(count):
        q = r.choice("\"'")
        v, w = _value(r, words), lambda: r.choice(words)
        host = f"{w()}-{w()}.{r.choice(['test', 'example', 'invalid', 'com'])}"
        style = r.choice(["camel", "snake", "upper", "dot"])
        form = r.random()
        spans: list[str] = [v]
        kind = "cred"
        if r.random() < 0.12:  # short values of names that say it all, logins by position, and values that only look random
            odd = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(8))
            word = r.choice([w() + str(r.randrange(10, 99)) + r.choice(["", "x", "z"]), r.choice("abcx") + str(r.randrange(9)), w() + str(r.randrange(9999)), r.choice("XZQ") + odd[:5] + r.choice("!#%*") + odd[5:].upper() + "k"])
            name, other = _name(r, words, "cred", style), _name(r, words, "other", style)
            call = r.choice(["db.connect", "client.login", "connect", "session.auth", "ftp.login", "conn.signIn"])
            line, spans = r.choice([
                (f"{name}: {word}", [word]), (f"{name}={word}", [word]), (f"export {name}={word}", [word]), (f"{name} = {q}{word}{q}", [word]),
                (f"{call}({q}{w()}{q}, {q}{word}{q})", [word]), (f"{call}({q}{w()}{q}, {q}{v}{q});", [v]), (f"await {call}({q}{w()}@{host}{q}, {q}{v}{q});", [v]),
                (f"{call}({q}{w()}{q}, {w()})", []), (f"{call}({q}{w()}{q}, {q}{w()}{q})", []), (f"{w()}({q}{w()}{q}, {q}{odd}{q})", []), (f"  {q}{odd}{q}, {q}{odd[::-1]}{q},", []), (f"{other} = {q}{odd}{q}", []),
                (f"assert {w()}({q}{odd}{q}) == {q}{odd[::-1]}{q}", []), (f"{w()}Key: {q}{w()}_{w()}{q},", []), (f"sort_key = {q}{w()}_at{q}", []), (f"{w()}_key={w()}", []), (f"_{r.randrange(99)} = Descriptor(name={q}{w()}_{odd[:4]}{q}, id={r.randrange(99)})", []),
                (f"import {{ {w()} as {w()}{r.randrange(9)} }} from '@/{w()}/{w()}_{odd[:3]}';", []), (f"const {other} = {q}{host}:{odd[:4]}{q};", []), (f"{name}: string;", []), (f"{name}: str = None", []), (f"  {name} = {w()}({w()})", []), (f"if ({name} == {w()}) {{", []),
            ])
        elif form < 0.34:  # a named value
            kind = r.choice(["cred", "cred", "cred", "cred", "safe", "other"])
            if kind == "cred":
                if r.random() < 0.38:
                    v, spans = r.choice(blanks), []
            elif kind == "safe":
                v = r.choice([str(r.randrange(5, 40)), "bearer", f"X-{w().title()}-Api-Key", v if not KNOWN.match(v) and re.fullmatch("[0-9a-f]+", v) else "%064x" % r.getrandbits(256), r.choice(["sha512-", "sha256-", "sha384-", ""]) + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(r.choice([43, 64, 86]))) + r.choice(["", "=="]), "%08x-%04x-%04x-%04x-%012x" % (r.getrandbits(32), r.getrandbits(16), r.getrandbits(16), r.getrandbits(16), r.getrandbits(48))])
                spans = []
            elif KNOWN.match(v):
                pass
            else:
                v, spans = r.choice([w(), str(r.randrange(999)), f"{w()}/{w()}:{r.randrange(9)}.{r.randrange(9)}", f"https://{host}/{w()}", f"{w()} {w()}", f"{w()}.v1.Message{r.randrange(99)}"]), []
            name = _name(r, words, kind, style)
            line = r.choice([f"const {name} = {q}{v}{q};", f"{name} = {q}{v}{q}", f"{name} = {v}", f"{name}: {v}", f"{name}: {q}{v}{q}", f"{name}={v}", f"- {name}={v}", f"export {name}={q}{v}{q}", f'  "{name}": "{v}",',
                             f"  {name}: {q}{v}{q},", f"    {name}={q}{v}{q},", f"// {name} = {q}{v}{q}", f"# {name} = {q}{v}{q}", f"  '{name}': {q}{v}{q},"])
        elif form < 0.42:  # a default of an environment variable, or none
            name, env = _name(r, words, "cred", style), _name(r, words, "cred", "upper")
            if r.random() < 0.5:
                spans = []
                line = r.choice([f"const {name} = process.env.{env};", f'{name} = os.environ["{env}"]', f'{name} = os.getenv("{env}")', f"{name}: ${{{env}}}", f"{name} = config.get({q}{env.lower()}{q})", f"{name} = vault.read({q}{w()}/{w()}{q})"])
            else:
                line = r.choice([f"const {name} = process.env.{env} || {q}{v}{q};", f'{name} = os.getenv("{env}", {q}{v}{q})', f'{name} = os.environ.get("{env}", {q}{v}{q})', f"const {name} = process.env.{env} ?? {q}{v}{q};"])
        elif form < 0.48:  # in two parts
            cut = len(v) // 2
            spans = [v[:cut], v[cut:]]
            name = _name(r, words, "cred", style)
            line = r.choice([f"const {name} = {q}{v[:cut]}{q} + {q}{v[cut:]}{q};", f"{name} = {q}{v[:cut]}{q} + {q}{v[cut:]}{q}"])
        elif form < 0.62:  # an address
            scheme = r.choice(["redis", "mongodb", "postgresql", "mysql", "amqp", "https"])
            name = _name(r, words, "other", style) + r.choice(["_url", "_dsn", "Url", ".url"])
            if r.random() < 0.4:
                spans = []
                url = r.choice([f"https://{w()}@{host}/{w()}?token_kind={w()}", f"https://{host}/{w()}", f"redis://{host}:{r.randrange(9999)}/0", f"https://{host}:8080/{w()}/{w()}", f"{scheme}://{w()}:${{DB_PASSWORD}}@{host}/{w()}", f"{scheme}://{w()}:<password>@{host}/{w()}"])
            else:
                v = v.replace("/", "A")
                spans = [v]
                url = f"{scheme}://{w()}:{v}@{host}:{r.randrange(1000, 9999)}/{w()}"
            line = r.choice([f"const {name} = {q}{url}{q};", f"{name} = {q}{url}{q}", f"{name}={url}", f"{name}: {url}", f"- {name}={url}", f'  "{name}": "{url}",', f"{name} = {url}", f"# {name} = {q}{url}{q}"])
        elif form < 0.69:  # a command
            name = _name(r, words, "other", "snake") + "_cmd"
            if r.random() < 0.2:
                spans, arg = [], r.choice([f"-u {w()}:$PASSWORD", f"-u {w()}:${{TOKEN}}", f"-s {w()}"])
            else:
                v = v.replace("/", "A")
                spans, arg = [v], f"{r.choice(['-u', '--user'])} {w()}:{v}"
            line = r.choice([f"const {name} = {q}curl {arg} https://{host}/{w()}{q};", f"{name} = {q}curl {arg} https://{host}/{w()}{q}", f"curl {arg} https://{host}/{w()}"])
        elif form < 0.79:  # a header
            scheme = r.choice(["Bearer", "Token", "Basic"])
            if r.random() < 0.3:
                spans, v = [], r.choice(["${token}", "<token>", "{token}", "$TOKEN", "xxxxxxxxxxxx", "{{ token }}"])
            line = r.choice([f"  'Authorization': '{scheme} {v}',", f'  "Authorization": "{scheme} {v}",', f"{w()}_auth = {q}{scheme} {v}{q}", f"const {w()}_auth_{r.randrange(99)} = {q}{scheme} {v}{q};", f"headers = {{'Authorization': '{scheme} {v}'}}", f"Authorization: {scheme} {v}"])
        elif form < 0.86:  # a webhook
            name = r.choice([f"hook_{r.randrange(999)}", f"{w()}_url"])
            tail = f"/services/T{_value(r, ['A'])[:8].upper()}/B{_value(r, ['B'])[:8].upper()}/{_value(r, words)}"
            tail = re.sub(r"[^\w/]", "A", tail)
            spans = [tail]
            line = r.choice([f"const {name} = {q}https://hooks.{host}{tail}{q};", f"{name} = {q}https://hooks.{host}{tail}{q}", f"{name}: https://hooks.{host}{tail}"])
            if r.random() < 0.3:
                spans, line = [], r.choice([f"from app.hooks.{w()} import {w()}", f"import {{ {w()} }} from '../hooks/{w()}';", f"const docs = {q}https://{host}/docs/{w()}{q};"])
        elif form < 0.9:  # a login with several values
            line = r.choice([f"return session.post({q}https://{host}/login{q}, data={{{q}user{q}: {q}{w()}{q}, {q}pass{q}: {q}{v}{q}}})", f"client.login({{ user: {q}{w()}{q}, password: {q}{v}{q} }});", f"connect(user={q}{w()}{q}, password={q}{v}{q}, host={q}{host}{q})"])
        elif form < 0.93:  # key blocks, private and public, and data that only looks random
            what, b64 = r.choice(["RSA ", "EC ", "OPENSSH ", "", ""]), "".join(r.choice("ABCDEFGHIJKLMabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(r.choice([64, 100, 300])))
            head, name = f"-----BEGIN {what}PRIVATE KEY-----", _name(r, words, "other", style) + r.choice(["_key", "_pem", "Key", ""])
            spans = [head]
            line = r.choice([f"const {name} = `{head}", f'{name} = """{head}', head, f"{name}: |  {head}"])
            if r.random() < 0.4:
                spans = [f"{head}\\n{b64}\\n-----END {what}PRIVATE KEY-----"]
                line = r.choice([f'  "{name}": "{spans[0]}",', f"{name}={spans[0]}", f"{name} = {spans[0]}", f'{name}: "{spans[0]}"', f"- {name}={spans[0]}"])
            elif r.random() < 0.4:
                spans, line = [], r.choice([f"const {name} = `-----BEGIN PUBLIC KEY-----", f'{name} = """-----BEGIN CERTIFICATE-----', f'{w()}_{w()} = "{b64 * 3}"', f'{w()}_{w()} = "{b64}"', f"const {w()} = '{b64 * 2}';", f'  "{b64}",', b64])
        else:  # code that only mentions such things
            spans = []
            line = r.choice([f"  const token = await {w()}.next({w()}, {r.randrange(99)});", f"if (password.length < {r.randrange(20)}) return false;", f"def check_token(token, secret):", f"# rotate the secret every {r.randrange(90)} days", f"function auth(req, res, next) {{", f"  return tokens.map((token) => token.{w()});",
                             f"const PUB_{r.randrange(99)} = `-----BEGIN PUBLIC KEY-----", f" * Copyright the {w()} authors, Apache-2.0", f"  author: {q}{w()} {w()}{q},", f"{w()}_tokens = {w()}({r.randrange(9)}, {r.randrange(9)})", f'  "description": "{w()} the access token of {w()}",', f"password = getpass({q}password: {q})", f"secret: !vault {w()}/{w()}"])
        places, at = [], 0
        for s in spans:
            k = line.index(s, at)
            places.append((k, k + len(s)))
            at = k + len(s)
        out.append((line, places))
    return out


# ---------------------------------------------------------------- the model


class Field:
    """A linear-chain CRF over two labels: outside (0) and literal (1)."""

    def __init__(self, weights: dict[str, float], transitions: np.ndarray, words: dict[str, float]):
        self.weights, self.step, self.words, self.names = weights, transitions.tolist(), words, N.Names(words)
        self.known: dict[tuple, float] = {}

    def score(self, e: tuple) -> float:
        s = self.known.get(e)
        if s is None:
            if len(self.known) > 300_000:
                self.known.clear()
            s = self.known[e] = sum(self.weights.get(f, 0.0) for f in features(e))
        return s

    def spans(self, line: str) -> list[tuple[int, int]]:
        """Spans of the best labelling; neighbouring tokens without a gap are one span."""
        toks = contexts(line, self.names)
        if not toks:
            return []
        (oo, os_), (so, ss) = self.step
        out, lit, back = 0.0, self.score(toks[0][2]), []
        for _, _, e in toks[1:]:
            x = self.score(e)
            a, b, c, d = out + oo, lit + so, out + os_, lit + ss
            back.append((b > a, d > c))
            out, lit = (b if b > a else a), (d if d > c else c) + x
        label = lit > out
        labels = [label]
        for from_out, from_lit in reversed(back):
            label = from_lit if label else from_out
            labels.append(label)
        labels.reverse()
        spans: list[list[int]] = []
        for (a, b, _), on in zip(toks, labels):
            if on:
                if spans and spans[-1][1] == a:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
        return [(a, b) for a, b in spans]


def fit(lines: list[tuple[str, list[tuple[int, int]]]], rounds: int = 90, penalty: float = 2e-4) -> Field:
    """Maximum likelihood by full-batch gradient steps (Adam)."""
    names: dict[str, int] = {}
    seqs, golds = [], []
    words = N.fit()
    naming = N.Names(words)
    for line, spans in lines:
        toks = contexts(line, naming)
        seqs.append([[names.setdefault(f, len(names)) for f in features(e)] for _, _, e in toks])
        golds.append([any(a >= x and b <= y for x, y in spans) or any(a < y and b > x for x, y in spans if "PRIVATE KEY" in line[x:y]) for a, b, _ in toks])
    # longest first, so that each step goes over those lines only that are as long
    order = [i for i in sorted(range(len(seqs)), key=lambda i: -len(seqs[i])) if seqs[i]]
    seqs, golds = [seqs[i] for i in order], [golds[i] for i in order]
    ends = np.array([len(s) - 1 for s in seqs])
    n, t, k = len(seqs), max(map(len, seqs)), len(features(("",) * 14))
    ids, mask, gold = np.zeros((n, t, k), np.int32), np.zeros((n, t), bool), np.zeros((n, t), bool)
    for i, (s, g) in enumerate(zip(seqs, golds)):
        if s:
            ids[i, : len(s)], mask[i, : len(s)], gold[i, : len(g)] = s, True, g
    flat = ids[mask]
    theta, trans = np.zeros(len(names)), np.zeros((2, 2))
    m1, m2 = np.zeros(len(names) + 4), np.zeros(len(names) + 4)
    both = mask[:, 1:]
    held = mask.sum(0)  # lines with a token at each place
    want_t = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            want_t[a, b] = ((gold[:, :-1] == a) & (gold[:, 1:] == b) & both).sum()

    for it in range(1, rounds + 1):
        x = np.zeros((n, t))
        x[mask] = theta[flat].sum(1)
        emit = np.stack([np.zeros_like(x), x], 2)
        fwd = np.zeros((n, t, 2))
        fwd[:, 0] = emit[:, 0]
        for j in range(1, t):
            c = held[j]
            fwd[:c, j] = np.logaddexp(fwd[:c, j - 1, 0, None] + trans[0], fwd[:c, j - 1, 1, None] + trans[1]) + emit[:c, j]
        last = fwd[np.arange(n), ends]
        z = np.logaddexp(last[:, 0], last[:, 1])
        bwd = np.zeros((n, t, 2))
        grad_t = want_t.copy()
        for j in range(t - 2, -1, -1):
            c = held[j + 1]
            nxt = emit[:c, j + 1] + bwd[:c, j + 1]
            bwd[:c, j] = np.logaddexp(trans[:, 0] + nxt[:, 0, None], trans[:, 1] + nxt[:, 1, None])
            grad_t -= np.exp(fwd[:c, j, :, None] + trans + nxt[:, None, :] - z[:c, None, None]).sum(0)
        p = np.exp(fwd[..., 1] + bwd[..., 1] - z[:, None])
        diff = (gold - p)[mask]
        grad = np.bincount(flat.ravel(), np.repeat(diff, k), len(names))
        g = np.concatenate([grad, grad_t.ravel()]) / n - penalty * np.concatenate([theta, trans.ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.98 * m2 + 0.02 * g * g
        move = 0.25 * (m1 / (1 - 0.9**it)) / (np.sqrt(m2 / (1 - 0.98**it)) + 1e-6) * min(1.0, 2.0 * (1 - it / (rounds + 1)))
        theta, trans = theta + move[:-4], trans + move[-4:].reshape(2, 2)

    return Field({f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 1e-4}, trans, words)


@lru_cache(maxsize=2)
def model(sample: int = SAMPLE, seed: int = SEED) -> Field:
    return fit(training_lines(sample, seed))


# ---------------------------------------------------------------- files

#: What else makes a line read by the model, in lower case: headers, commands, addresses and key formats.
TRIGGERS = [
    "bearer ", "basic ", "curl ", " -u ", "--user ", "hooks.", "://hooks", "akia", "asia", "aiza", "eyj", "xox", "ghp_", "gho_", "ghs_", "ghu_", "ghr_",
    "github_pat_", "glpat-", "sk_live_", "pk_live_", "rk_live_", "sk_test_", "pk_test_", "rk_test_", "npm_", "sg.", "whsec_", "dop_v1_", "hf_", "-----begin", "pass", "pwd", "secret", "token", "auth", "credential",
]
#: A name before a sign of assignment, where a literal follows on the line, a bare value ends it or nothing is left of it.
_NAMED = re.compile(r"(?<![\w$.\-])([A-Za-z_$][\w$.\-]*+)[\"'`\])]{0,2}+[ \t]*+(?::=|\?\?|\|\||[=:])(?!=)")
_LITERAL = re.compile(r"[^\n\"'`]*+[\"'`]|[ \t]*+[(\\]?[^\s(){}\[\],;<>]*+[,; \t\r]*+(?:\n|\Z)")
#: A key with the prefix of any vendor.
_PREFIXED = re.compile(r"_(?=[A-Za-z]*\d[A-Za-z]*\d)[A-Za-z0-9]{24}")
#: Characters from which a line is read by statements.
LONG = 400
#: A literal whose letters, digits and signs are mixed.
_MIXED = re.compile(r"[\"'`](?=[^\"'`\s\\]{0,200}?(?:[A-Za-z]\d+[A-Za-z]|\d[A-Za-z]{1,2}\d|[A-Za-z0-9][!#%^&*~+][A-Za-z0-9]))[^\"'`\s\\]{6,200}[\"'`]")
#: How a line ends whose value begins on the next line, and how one begins that only looks so.
_VALUE_BELOW = re.compile(r"[\w\"'`\]]\s*(?::=|[=:]|\|\||\?\?)\s*[(\\]?$")
_NO_NAME = re.compile(r"\s*(?:\}\s*)?(?:if|elif|else|while|for|with|def|class|try|except|case|default|switch|lambda|async)\b")
#: Triggers that count only where a word begins, in either case style.
_WORDS = {"pass", "pwd", "secret", "token", "auth", "asia", "sg.", "hf_", "eyj", "xox", "credential", "akia", "aiza"}
_USERINFO = re.compile(r"://[^\s/\"'`@:]+:[^\s/\"'`@]+@")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for t in TRIGGERS:
        a.add_word(t, (len(t), t in _WORDS))
    a.make_automaton()
    return a


def _below(lines: str) -> bool:
    """Whether the value of the last name of these lines is on the next line; blank lines between them count."""
    last = lines.rstrip()
    last = last[last.rfind("\n") + 1 :]
    return bool(_VALUE_BELOW.search(last[-200:])) and not _NO_NAME.match(last)


def candidate_lines(text: str, names: N.Names) -> list[tuple[int, int]]:
    """(start, end) of the lines to read, in order, each with the lines below it that hold the value of its name."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length; such texts are read in their own case and in capitals
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    hits = []
    for end, (size, word) in _automaton().iter(low):
        at = end - size + 1
        if word and at and text[at].islower() and text[at - 1].islower():
            continue
        hits.append(at)
    if "://" in low:
        hits += [m.start() for m in _USERINFO.finditer(text)]
    level, known = names.level, names.names
    hits += [m.start() for m in _NAMED.finditer(text) if (known.get(m[1]) or level(m[1])) > 1 and _LITERAL.match(text, m.end())]
    hits += [m.start() for m in _MIXED.finditer(text)]
    hits += [m.start() for m in _PREFIXED.finditer(text)]
    hits.sort()
    out, done = [], -1
    for at in hits:
        if at < done:
            continue
        start = text.rfind("\n", 0, at) + 1
        done = text.find("\n", at)
        done = len(text) if done < 0 else done
        while done < len(text) and _below(text[start:done]):
            done = text.find("\n", done + 1)
            done = len(text) if done < 0 else done
        if done - start > LONG:
            start, done = _statement(text, start, at, done)
        out.append((start, done))
        done += 1
    return out


def _statement(text: str, start: int, at: int, end: int) -> tuple[int, int]:
    """The part of a long line between semicolons around a place; quotes are kept whole."""
    a = max(start, text.rfind(";", start, at) + 1)
    b = text.find(";", at, end)
    while b >= 0 and (text.count('"', a, b) % 2 or text.count("'", a, b) % 2 or text.count("`", a, b) % 2):
        b = text.find(";", b + 1, end)
    return a, end if b < 0 else b


def credential_spans(text: str, field: Field) -> list[tuple[int, int, bool]]:
    """(start, end, begins a finding) of all literal characters of credentials; a key block has one finding."""
    out: list[tuple[int, int, bool]] = []
    skip = 0
    for start, end in candidate_lines(text, field.names):
        if end <= skip:
            continue
        line = text[start:end]
        spans = field.spans(line)
        pem = _PEM.search(line)
        if pem and spans:
            stop = _PEM_END.search(text, start + pem.end())
            body = stop.start() if stop else len(text)
            out.append((start + pem.end(), max(body, start + pem.end()), True))
            skip = body
            continue
        for a, b in spans:
            bare = line[a:b].strip("\"'` ,;")
            if len(bare) < 2 or bare.lower() in PLACEHOLDERS or _MASKED.fullmatch(bare):
                continue
            if "://" not in line and (_BLOB_BEFORE.search(line, max(0, a - 80), a) or _BLOB_AFTER.match(line, b)):
                continue  # a part of a longer run of encoded data
            if _MEMBER.fullmatch(bare) and line[a - 1 : a] not in ("'", '"', "`") and text[start + b : start + b + 1] in tuple(";,)]}"):
                continue  # the member of a variable, in code
            out.append((start + a, start + b, True))
    return out


def found_lines(text: str, field: Field) -> list[int]:
    """Numbers of the lines with a credential."""
    spans = credential_spans(text, field)
    if not spans:
        return []
    out, at, line = [], 0, 1
    for a, _, _ in spans:
        line += text.count("\n", at, a)
        at = a
        if not out or out[-1] != line:
            out.append(line)
    return out


def redacted(text: str, field: Field) -> str:
    """The text with every literal character of a credential as 'x'; line breaks, also written ones, stay."""
    parts, last = [], 0
    for a, b, _ in sorted(credential_spans(text, field)):
        a = max(a, last)
        parts += [text[last:a], re.sub(r"\\n|\\r|\s|[^\n]", lambda m: m[0] if m[0] in ("\\n", "\\r") or m[0].isspace() else "x", text[a:b])]
        last = max(b, last)
    return "".join([*parts, text[last:]])


def _weights(spark: SparkSession):
    field = model()
    return spark.sparkContext.broadcast((field.weights, field.step, field.words))  # some ten thousand numbers


def credential_lines(files: DataFrame) -> DataFrame:
    """(file_id, line_no) of every line with a literal credential in the last delivery of each file."""
    told = _weights(files.sparkSession)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = Field(told.value[0], np.array(told.value[1]), told.value[2])
        for pdf in batches:
            rows = [(i, at, n) for i, at, t in zip(pdf.file_id, pdf.arrived_at, pdf.text) for n in found_lines(t, field)]
            yield pd.DataFrame(rows, columns=["file_id", "arrived_at", "line_no"])

    at = F.coalesce(has(files, "arrived_at", "timestamp").cast("timestamp_ntz"), F.lit("1970-01-01").cast("timestamp_ntz")).alias("arrived_at")
    rows = files.where("file_id is not null").select("file_id", at, "text")
    found = rows.where("text is not null and text <> ''").mapInPandas(find, "file_id bigint, arrived_at timestamp_ntz, line_no int")
    # only findings and times of arrival are shuffled
    last = rows.groupBy("file_id").agg(F.max("arrived_at").alias("arrived_at"))
    return found.join(last, ["file_id", "arrived_at"], "left_semi").select("file_id", "line_no").distinct()


def redacted_files(files: DataFrame) -> DataFrame:
    """(file_id, text) with all credentials masked, one row per file (its last delivery); a null text stays null."""
    told = _weights(files.sparkSession)

    def mask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = Field(told.value[0], np.array(told.value[1]), told.value[2])
        for pdf in batches:
            yield pd.DataFrame({"file_id": pdf.file_id, "text": [t if t is None else redacted(t, field) for t in pdf.text]})

    last = files.where("file_id is not null").groupBy("file_id").agg(F.max_by("text", F.struct("arrived_at", "text")).alias("text"))
    return last.mapInPandas(mask, "file_id bigint, text string")
