import numpy as np
import pytest

from quarryline.llm import provenance as P

HAND = "import os\n\ndef load(path):\n    with open(path) as f:\n        return f.read()\n\nclass Cache:\n    def __init__(self, size=10):\n        self.size = size\n        self.items = {}\n\n    def get(self, key, default=None):\n        if key not in self.items:\n            return default\n        return self.items[key]\n"
GENERATED = "".join(f"export function call{i}(client, params) {{\n  return client.send({{ method: \"POST\", url: \"/call/{i}\", seq: {i}, params }});\n}}\n\n" for i in range(30))
MINIFIED = "".join(f"var a{i}=function(b){{for(var c=0;c<b.length;c++)b[c]=b[c]*{i}+1;return b}};" for i in range(20))
DATA = "TABLE = [\n" + "".join(f"    {i}, {i * 7 % 100}, {i * 13 % 997},\n" for i in range(200)) + "]\n"
BLOB = 'var x = "' + "QUJD0Zk/" * 200 + '";\n'
LIBRARY = "".join(f"export function {n}(value, options) {{\n  if (value.{n}Flag > {i}) return options.{n} - value.size;\n  while (value.next{i}) value = value.{n}Next(options);\n  return [value, options.{n}s, '{n}'];\n}}\n" for i, n in enumerate(["trim", "pad", "wrap", "fold", "split", "join", "zip"]))
OWN = "// Copyright (c) our timeline team. Internal use only.\n// ids are generated per receipt; do not edit without a review\n" + HAND.replace("#", "//")

FILE = "file_id bigint, repo_id string, path string, text string, total bigint, class_id bigint"


def run(spark, *rows):
    f = spark.createDataFrame([(i, r, p, t, 1, 2) for i, (r, p, t) in enumerate(rows)], FILE)
    return {r.file_id: {k for k in ("generated", "vendored", "data", "minified") if r[k]} for r in P.not_handwritten(f).collect()}


def test_all_kinds(spark):
    changed = LIBRARY.replace("trimFlag", "cutFlag").replace("// x", "")
    got = run(
        spark, ("a", "x.py", HAND), ("a", "y.ts", GENERATED), ("a", "z.js", MINIFIED), ("b", "t.py", DATA), ("b", "t.js", BLOB), ("a", "l.js", LIBRARY), ("b", "m.js", "// local\n" + changed), ("a", "o.ts", OWN), ("c", "e.py", ""), ("c", "n.py", None), ("c", "s.css", DATA),
        ("c", "h.py", "# Code generated by stub. DO NOT EDIT.\nx = 1\n"), ("c", "v.js", "/**\n * @license somejs 1.2.3\n * Copyright the somejs authors\n */\nf();\n"), ("c", "lib/node_modules/p/i.js", "f(1);"), ("c", "vendor/i.js", "f(1);"), (None, None, HAND))
    assert got == {1: {"generated"}, 2: got[2] | {"minified"}, 3: {"data"}, 4: {"data"}, 5: {"vendored"}, 6: {"vendored"}, 11: {"generated"}, 12: {"vendored"}, 13: {"vendored"}}


def test_copies_within_a_repository_are_not_vendored(spark):
    assert run(spark, ("a", "l.js", LIBRARY), ("a", "m.js", LIBRARY), ("a", "m.js", LIBRARY)) == {}
    assert run(spark) == {}


def test_a_file_that_speaks_of_tools_is_handwritten(spark):
    talk = '"""Writes files."""\nHEADER = "# Code generated by upperstub. DO NOT EDIT."\n' + HAND
    assert run(spark, ("a", "x.py", talk), ("a", "y.py", "# we check for the words: code generated by tools\n" + HAND)) == {}


@pytest.mark.parametrize("keep", [0.95, 0.8, 0.5, 0.1])
def test_signatures_estimate_the_similarity(keep):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 62, 2000, dtype=np.uint64)
    b = np.concatenate([a[: int(2000 * keep)], rng.integers(0, 1 << 62, 2000 - int(2000 * keep), dtype=np.uint64)])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((P.signature(np.unique(a)) == P.signature(np.unique(b))).mean() - true) < 0.15


def test_bands_find_similar_sets():
    rng = np.random.default_rng(5)
    found = 0
    for _ in range(60):
        a = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
        b = np.concatenate([a[:360], rng.integers(0, 1 << 62, 40, dtype=np.uint64)])  # similarity 0.82
        found += bool(set(P.bands(P.signature(a), 1)) & set(P.bands(P.signature(b), 1)))
    assert found >= 58


def stub(i, k):
    """A text whose form differs for each k and whose names differ for each i; no block repeats."""
    ops = ["+", "-", "*", "%", "<", ">", "&", "|"]
    return "".join(f"def n{i}_{j}(a{i}, b{i}):\n" + "".join(f"    c{i} = a{i} {ops[(j * 5 + k * 3 + x * x) % 8]} b{i}.v{i}{'[1]' * ((j + k + x) % 3)}\n" for x in range(3 + (j + k) % 4)) + f"    return c{i}{ops[(j + k) % 8]}{i}\n" for j in range(8))


def test_a_family_of_one_repository_is_generated(spark):
    d = P.describe(stub(1, 0), P._Tokens(), True)
    assert d["all"] < 4 * len(d["form"])  # no block
    local = [("a", f"f{i}.py", stub(i, 0)) for i in range(3)]
    assert run(spark, *local) == {i: {"generated"} for i in range(3)}
    assert run(spark, *local[:2]) == {}
    # a form that another repository has as well
    assert run(spark, *local, ("b", "g.py", stub(9, 0))) == {}


def sketches(*sets):
    return [P.sketch(P.signature(np.unique(x))) for x in sets]


def test_a_shared_band_alone_makes_no_family():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 62, 900, dtype=np.uint64)
    near, far = (np.concatenate([a[:k], rng.integers(0, 1 << 62, 900 - k, dtype=np.uint64)]) for k in (860, 300))
    rows = sketches(a, near, far)
    ask, repos = np.array([True, True, True]), np.array([1, 1, 1])
    told = lambda weight, repos=repos, own=True: list(P._compare(np.array([5, 5, 5]), ask, repos, np.array(weight), rows, own, P.SIMILAR))
    assert told([1, 1, 1]) == [] and told([2, 1, 1]) == [0, 1]  # three texts make a family
    assert told([1, 1, 1], np.array([1, 2, 2]), False) == [0, 1]  # the stranger has no copy


def test_copies_are_found_beside_a_stranger_in_their_bucket(spark):
    rng = np.random.default_rng(9)
    a = rng.integers(0, 1 << 62, 900, dtype=np.uint64)
    b, stranger = (np.concatenate([a[:k], rng.integers(0, 1 << 62, 900 - k, dtype=np.uint64)]) for k in (860, 300))
    keys = P.bands(P.signature(a), 1)
    rows = [(i, "ab"[i % 2], i, x + x, keys[:6]) for i, x in enumerate(sketches(stranger, a, b))]
    f = spark.createDataFrame(rows, "file_id bigint, repo_id string, text bigint, signature binary, text_bands array<bigint>").checkpoint()
    own = {r.node for r in P.nodes(f.where("file_id > 0"), "signature", "text_bands", P.F.lit(True)).collect()}
    assert {r.node for r in P.copies(f).collect()} == own and len(own) == 2


def test_a_copy_with_a_name_of_its_own_is_found(spark):
    renamed = LIBRARY.replace("value", "thing")
    mine = "".join(f"export function {n}(item, settings) {{\n  if (item.{n}Mark > {i}) return settings.{n} - item.size;\n  while (item.after{i}) item = item.{n}After(settings);\n  return [item, settings.{n}s, '{n}'];\n}}\n" for i, n in enumerate(["shout", "lend", "carry", "rinse", "plant", "greet", "mend"]))
    assert run(spark, ("a", "l.js", LIBRARY), ("b", "m.js", renamed), ("c", "o.js", mine)) == {0: {"vendored"}, 1: {"vendored"}}


def test_banding_recall_against_brute_force(spark):
    """Every file whose id is divisible by 5 against all rows: at least 0.9 of the true links of two repositories."""
    rng = np.random.default_rng(11)
    names = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(60):
        base = [f"{names[rng.integers(400)]}({names[rng.integers(400)]}, {rng.integers(99)})" for _ in range(60)]
        copy = list(base)
        for k in rng.integers(0, 60, int(rng.integers(0, 4))):
            copy[k] = f"{names[rng.integers(400)]} = {rng.integers(99)}"
        texts += [("a", f"x{i}.js", ";\n".join(base)), ("b", f"y{i}.js", ";\n".join(copy))]
    tokens = P._Tokens()
    d = [P.describe(t, tokens, False) for _, _, t in texts]
    like = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    true = {i for i in range(0, len(texts), 5) for j in range(len(texts)) if texts[i][0] != texts[j][0] and like(d[i]["own"], d[j]["own"]) >= 0.8 and like(d[i]["words"], d[j]["words"]) >= 0.8}
    found = {i for i, kinds in run(spark, *texts).items() if "vendored" in kinds}
    assert len(true) > 10 and len(true & found) >= 0.9 * len(true)


def test_notices_count_wherever_they_stand(spark):
    head = "".join(f"import m{i}\n" for i in range(40))
    tool, notice = "# Code generated by stub. DO NOT EDIT.\n", "# Copyright the somelib authors\n"
    speaks = 'HEADER = """\n' + tool + notice + '"""\n# we write: code generated by tools\n'
    assert run(spark, ("a", "x.py", head + tool + HAND), ("a", "y.py", HAND + notice + HAND + HAND)) == {0: {"generated"}, 1: {"vendored"}}
    assert run(spark, ("a", "z.py", head + speaks + HAND)) == {}
