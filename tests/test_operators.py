from datetime import datetime as T

import pytest
from pyspark.sql import functions as F

from quarryline.functions import paths as P
from quarryline.functions import text as X
from quarryline.operators import capability as C
from quarryline.operators import files as FI
from quarryline.operators import graph as G
from quarryline.operators import jobs as J
from quarryline.operators import quality as Q
from quarryline.operators import resolve as R
from quarryline.operators import search as S
from quarryline.sources import archives, sinks

EDGE = "graph_id string, src string, dst string, kind string, confidence double, hypothesis boolean, layer string, ord bigint, resolved boolean"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("path, want", [("a//b/./c", "a/b/c"), ("a/../b", "b"), ("a\\b", "a/b"), ("../x", "../x"), ("a/b/../../c", "c"), ("./a", "a"), ("a.b/c", "a.b/c"), ("", ""), (None, None), ("/a/b", "a/b")])
def test_normalized(spark, path, want):
    assert one(spark, P.normalized(F.lit(path)))[0] == want


def test_language_and_extension(spark):
    rows = spark.createDataFrame([("A/B.PY",), ("x.d.ts",), ("noext",), (".env",), (None,), ("a.b/c",)], "p string")
    assert [tuple(r) for r in rows.select(P.extension(F.col("p")), P.language(F.col("p"))).collect()] == [(".py", "py"), (".ts", "ts"), ("", "other"), (".env", "other"), (None, "other"), ("", "other")]


def test_text_functions(spark):
    r = one(spark, X.redact(F.lit("api_key=abc token: x9 db_url='z' ok")), X.title(F.lit("foo-bar baz_qux")), X.ratio(F.lit(1), F.lit(0)), X.join_urls(F.lit("/api/"), F.lit("/x")), X.line_count(F.lit("a\nb\n")), X.tokens(F.lit(None).cast("string")))
    assert r[0] == "api_key=***REDACTED*** token=***REDACTED*** db_url=***REDACTED*** ok" and r[1] == "Foo-Bar Baz_Qux" and r[2] == 0.0 and r[3] == "/api/x" and r[4] == 3 and r[5] == []
    assert one(spark, X.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0))), X.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == (1.0, 0.0)


FILES = "file_id bigint, snapshot_id string, repo_id string, path string, text string, hash string, mtime double"


def files(spark, *rows):
    return spark.createDataFrame([(i, "s", "r", p, t, h, float(m)) for i, (p, t, h, m) in enumerate(rows)], FILES)


def test_resolution_of_a_small_repository(spark):
    f = files(spark, *[(p, "", "", 0) for p in ("src/components/Hero.tsx", "src/components/Button.tsx", "src/app/page.tsx", "acme/utils/math.py", "acme/utils/__init__.py", "lib/index.js", "src/app/globals.css")])
    imports = spark.createDataFrame([
        (1, "s", "src/app/page.tsx", "@/components/Hero", "esm"), (2, "s", "src/app/page.tsx", "../components/Button", "esm"), (3, "s", "src/app/page.tsx", "next/image", "esm"), (4, "s", "acme/app/main.py", "acme.utils.math", "py"),
        (5, "s", "acme/app/main.py", "..utils", "py"), (6, "s", "src/app/page.tsx", "../../lib", "cjs"), (7, "s", "src/app/layout.tsx", "./globals.css", "esm"), (8, "s", None, None, None), (1, "s", "src/app/page.tsx", "@/components/Hero", "esm")],
        "import_id bigint, snapshot_id string, from_path string, raw string, kind string")
    got = {r.import_id: r.resolved for r in R.resolve(imports, f).collect()}
    assert got == {1: "src/components/Hero.tsx", 2: "src/components/Button.tsx", 3: None, 4: "acme/utils/math.py", 5: "acme/utils/__init__.py", 6: "lib/index.js", 7: "src/app/globals.css", 8: None}
    assert R.resolve(imports.limit(0), f).count() == 0


def test_nearest_config(spark):
    f = files(spark, ("a/b/c.ts", "", "", 0), ("x.ts", "", "", 0))
    conf = files(spark, ("tsconfig.json", "", "", 0), ("a/tsconfig.json", "", "", 0))
    assert {(r.path, r.config) for r in R.nearest_config(f, conf).collect()} == {("a/b/c.ts", "a/tsconfig.json"), ("x.ts", "tsconfig.json")}


def test_incremental_plan(spark):
    before = files(spark, ("a", "", "1", 0), ("b", "", "1", 0), ("c", "", "1", 0), ("old", "", "1", 0))
    now = files(spark, ("a", "", "1", 10), ("b", "", "2", 0), ("c", "", "1", 9000), ("new", "", None, 0))
    assert {(r.path, r.action) for r in FI.stale(now, before).collect()} == {("a", "reuse"), ("b", "reparse"), ("c", "reparse"), ("new", "new"), ("old", "deleted")}


def test_scan_of_a_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/b.js").write_text("1")
    (tmp_path / "big.ts").write_text("x" * 5000)
    got = {r.path: (r.language, r.lines, r.skipped) for r in FI.scan_folder(spark, str(tmp_path), 1000).collect()}
    assert got == {"src/a.py": ("py", 2, False), "big.ts": ("ts", None, True)}


def test_tree_has_every_folder_once(spark):
    rows = {(r.id, r.parent_id, r.is_leaf) for r in FI.tree(files(spark, ("a/b/c.py", "", "", 0), ("a/d.py", "", "", 0), (None, "", "", 0))).collect()}
    assert rows == {("a", "", False), ("a/b", "a", False), ("a/b/c.py", "a/b", True), ("a/d.py", "a", True)}


def graph(spark, *rows):
    return spark.createDataFrame([("g", s, d, "import", c, h, layer, i, True) for i, (s, d, c, h, layer) in enumerate(rows)], EDGE)


def test_merge_prefers_strictly_greater_confidence(spark):
    e = graph(spark, ("a", "b", 0.5, False, "static"), ("a", "b", 0.5, True, "model"), ("a", "c", None, False, "static"), ("a", "c", 0.1, True, "model"))
    got = {r.dst: (r.layer, r.confidence) for r in G.merge_layers(e).collect()}
    assert got == {"b": ("static", 0.5), "c": ("model", 0.1)}
    assert {r.dst: r.ord for r in G.last_writer(e).collect()} == {"b": 1, "c": 3}


def test_split_covers_all_edges(spark):
    e = graph(spark, ("a", "b", 0.2, True, "m"), ("a", "c", 0.4, False, "m"), ("a", "d", 0.9, True, "m"), ("a", "e", 0.9, False, "m"), ("a", "f", None, None, "m"))
    assert {r.dst: r.status for r in G.split(e).collect()} == {"b": "quarantined", "c": "suggested", "d": "suggested", "e": "main", "f": "suggested"}


def test_degrees_keep_lonely_nodes_and_repeats(spark):
    e = graph(spark, ("a", "b", 1.0, False, "m"), ("a", "b", 1.0, False, "m"))
    n = spark.createDataFrame([("g", x) for x in "abc"], "graph_id string, id string")
    d = G.degrees(n, e)
    assert {r.id: (r.in_degree, r.out_degree) for r in d.collect()} == {"a": (0, 2), "b": (2, 0), "c": (0, 0)}
    assert [r.id for r in G.hubs(d, 2).collect()] == ["a", "b"]


def test_paths_and_islands(spark):
    e = graph(spark, *[(a, b, 1.0, False, "m") for a, b in ("ab", "ac", "bd", "db", "de", "xy")])
    starts = spark.createDataFrame([("g", "a"), ("g", "x")], "graph_id string, id string")
    paths = G.longest_path(G.greedy_paths(e, starts))
    assert [r.id for r in paths.orderBy("step").collect()] == ["a", "b", "d", "e"]
    lanes = paths.withColumn("lane", F.when(F.col("id").isin("a", "b"), "web").otherwise("api"))
    assert [(r.lane, r.ids) for r in G.lane_islands(lanes).orderBy("island").collect()] == [("web", ["a", "b"]), ("api", ["d", "e"])]


def test_nested_routes_stop_at_cycles(spark):
    inc = spark.createDataFrame([("root", "/api", "a"), ("a", "/x", "b"), ("b", "/loop", "a")], "file string, prefix string, target string")
    routes = spark.createDataFrame([("b", "/list"), ("root", "/")], "file string, path string")
    roots = spark.createDataFrame([("root",)], "file string")
    assert {(r.file, r.path) for r in G.prefix_routes(inc, routes, roots).collect()} == {("b", "/api/x/list"), ("root", "/")}


def test_ratios_of_nothing(spark):
    e = spark.createDataFrame([], EDGE)
    assert G.unresolved_ratio(e).count() == 0 and G.stats(e).count() == 0 and G.centrality(e).count() == 0


def test_neighbours_touching_and_induced(spark):
    e = graph(spark, ("a", "b", 1.0, False, "m"), ("b", "c", 1.0, False, "m"), ("c", "d", 1.0, False, "m"))
    w = spark.createDataFrame([("g", "b"), ("g", "c"), ("g", "b")], "graph_id string, id string")
    assert {(r.src, r.dst) for r in G.induced(e, w).collect()} == {("b", "c")}
    assert G.touching(e, w).count() == 3
    assert {r.neighbour for r in G.neighbours(e, w).where("id = 'b'").collect()} == {"a", "b", "c"}


LOG = "event_id bigint, ts timestamp, job_id bigint, phase string, value double"


def log(spark, *rows):
    return spark.createDataFrame([(i, T(2024, 1, 1, 0, m), j, p, float(v)) for i, (m, j, p, v) in enumerate(rows)], LOG)


def test_job_folds(spark):
    e = log(spark, (0, 1, "view", 0), (1, 1, "click", 3), (2, 1, "error", 9), (3, 1, "view", 10), (0, 2, "view", 1))
    e = e.unionByName(e.where("event_id = 0")).unionByName(spark.createDataFrame([(77, None, None, None, None)], LOG))
    got = {r.job_id: (r.status, r.completed_at, r.events) for r in J.fold_state(e).collect()}
    assert got == {1: ("view", T(2024, 1, 1, 0, 2), 4), 2: ("view", None, 1)}
    assert [r.event_id for r in J.debounced(log(spark, (0, 1, "v", 0), (1, 1, "v", 3), (2, 1, "v", 9))).collect()] == [0, 2]
    assert [r.event_id for r in J.within_budget(log(spark, (0, 1, "v", 5), (1, 1, "v", 5), (2, 1, "v", 5)), 9).orderBy("ts").collect()] == [0, 1]
    assert [r.allowed for r in J.token_bucket(log(spark, (0, 1, "v", 0), (0, 1, "v", 0), (1, 1, "v", 0)), 1.0, 1 / 60).orderBy("event_id").collect()] == [True, False, True]
    assert {r.phase: r.n for r in J.status_summary(e).collect()}["signup"] == 0


def test_versions_and_tasks(spark):
    old = spark.createDataFrame([("k", 3), ("k", 1)], "key string, version int")
    new = spark.createDataFrame([("k", "b"), ("k", "a"), ("n", "c")], "key string, v string")
    assert {(r.key, r.v, r.version) for r in J.next_versions(old, new, ["key"], "version").collect()} == {("k", "a", 4), ("k", "b", 5), ("n", "c", 1)}
    t = lambda rows, s: spark.createDataFrame(rows, s)
    ready = J.ready_tasks(t([("a",), ("b",), ("c",)], "task string"), t([("a", "x"), ("b", "x"), ("b", "y")], "task string, need string"), t([("x",)], "task string"))
    assert {r.task for r in ready.collect()} == {"a", "c"}


def test_retrieval_falls_back_to_the_first_files(spark):
    corpus = spark.createDataFrame([(i, t, False) for i, t in enumerate(["queue worker", "queue", None, "other"])], "id bigint, text string, entry boolean")
    got = S.retrieve(corpus, [(1, "queue worker queue"), (2, "zzz"), (3, "")], top=2, rest=3)
    rows = {}
    for r in got.orderBy("question_id", "rank").collect():
        rows.setdefault(r.question_id, []).append((r.id, r.score))
    assert rows[1] == [(0, 3.0), (1, 2.0)] and [i for i, _ in rows[2]] == [0, 1, 2] and [i for i, _ in rows[3]] == [0, 1, 2]


def test_precision_and_recall(spark):
    k = "by string, k string"
    got = Q.precision_recall(spark.createDataFrame([("x", "1"), ("x", "1"), ("x", "2")], k), spark.createDataFrame([("x", "1"), ("y", "9")], k), ["k"], "by")
    assert {r.by: (r.precision, r.recall) for r in got.collect()} == {"x": (0.5, 1.0), "y": (0.0, 0.0)}


def test_contract_gaps(spark):
    need = spark.createDataFrame([("g", "x/user_item.ts"), ("g", "y.ts"), ("h", "y.ts")], "graph_id string, path string")
    have = spark.createDataFrame([("g", "y.ts", "Y", "k")], "graph_id string, path string, name string, kind string")
    assert {(r.graph_id, r.path, r.name, r.stub) for r in C.contract_gaps(need, have).collect()} == {("g", "y.ts", "Y", False), ("g", "x/user_item.ts", "user_item", True), ("h", "y.ts", "y", True)}


def test_archive_guards(spark):
    rows = [("src/a.ts", 10, 5), ("../evil.txt", 1, 1), ("C:/x", 1, 1), ("node_modules/l.js", 1, 1), ("assets/logo.png", 1, 1), ("big.bin", 200, 100), ("bomb", 90, 0), ("z", 90, 1), ("con.txt", 1, 1), (None, 1, 1)]
    e = spark.createDataFrame([("z", i, n, s, p, False, 10) for i, (n, s, p) in enumerate(rows)], archives.ENTRY)
    got = [r.verdict for r in archives.guarded(e, max_file=100).orderBy("ord").collect()]
    assert got == ["ok", "unsafe path", "unsafe path", "ignored", "ignored", "file too large", "ok", "ok", "unsafe path", "unsafe path"]
    assert {r.verdict for r in archives.guarded(e, max_entries=3).collect()} == {"too many entries"} and {r.verdict for r in archives.guarded(e, max_archive=3).collect()} == {"archive too large"}


def test_archives_are_read_and_unpacked(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("src/a.py", "x = 1")
        z.writestr("../evil.txt", "no")
        z.writestr("node_modules/b.js", "no")
    (tmp_path / "b.zip").write_bytes(b"no zip")
    folder = f"file://{tmp_path}"
    verdicts = archives.guarded(archives.entries(spark, folder))
    assert {(r.name, r.verdict) for r in verdicts.collect()} == {("src/a.py", "ok"), ("../evil.txt", "unsafe path"), ("node_modules/b.js", "ignored"), (None, "unsafe path")}
    assert [(r.path, bytes(r.content)) for r in archives.extracted(spark, folder, verdicts).collect()] == [("src/a.py", b"x = 1")]


def test_versioned_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    root = f"file://{tmp_path}"
    assert [sinks.store_artifact(df, root, "r", "files"), sinks.store_artifact(df.limit(0), root, "r", "files")] == [1, 2]
    assert sinks.read_artifact(spark, root, "r", "files", 1).collect() == df.collect() and sinks.read_artifact(spark, root, "r", "files").count() == 0
    sinks.write_partitioned(df, f"{root}/p", "v")
    assert spark.read.parquet(f"{root}/p").count() == 1


def test_greedy_paths_are_not_cut(spark):
    chain = [("g", f"n{i:03}", f"n{i + 1:03}") for i in range(70)]
    e = spark.createDataFrame(chain, "graph_id string, src string, dst string").coalesce(1)
    starts = spark.createDataFrame([("g", "n000"), ("g", "n003")], "graph_id string, id string").coalesce(1)
    paths = G.longest_path(G.greedy_paths(e, starts)).orderBy("step").collect()
    assert [r.id for r in paths] == [f"n{i:03}" for i in range(71)]  # beyond any short guard
    assert G.greedy_paths(e, starts, guard=3).count() == 6


def test_caches_keys_and_fallbacks(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    assert {r.key for r in J.evicted(t([("c", "a", 1), ("c", "b", 3), ("c", "d", 2), ("e", "x", 1)], "cache string, key string, used_at int"), 2).collect()} == {"a"}
    new = J.new_only(t([("a", 1), ("b", 2), ("b", 1)], "id string, ord int"), t([("a",)], "id string"), ["id"], ["ord"])
    assert [tuple(r) for r in new.collect()] == [("b", 1)]
    need, have = t([("g", "x"), ("g", "y"), ("h", "x")], "g string, k string"), t([("g", "x"), ("h", "x")], "g string, k string")
    assert {(r.g, r.complete, r.missing) for r in J.lacking(need, have, "g", "k").collect()} == {("g", False, 1), ("h", True, 0)}
    made = t([(k, f"s{k}") for k in range(9)], "ord int, v string")
    assert S.sparse_fallback(t([("a",), ("b",)], "v string"), made).count() == 6 and S.sparse_fallback(t([("a",), ("b",), ("c",)], "v string"), made).count() == 3 and S.sparse_fallback(t([], "v string"), made).count() == 6
    assert one(spark, J.batch_percent(F.lit(5), F.lit(10)), J.batch_percent(F.lit(0), F.lit(0)))[:] == (42, 35)
    assert J.aliased(t([(None, 1)], "repo_id string, n int"), {"repo_id": "repoId"}, {"repo_id": "-"}).first().asDict() == {"repoId": "-", "n": 1}


def test_best_summaries_need_no_pairs_of_all(spark):
    f = spark.createDataFrame([("src/utils/api.ts",), ("src/x/Hero.tsx",), ("a/q.py",), (None,)], "path string")
    s = spark.createDataFrame([(1, "The api.ts helper", "calls a tool", ""), (2, "superhero", "shows", ""), (3, "q", "", ""), (4, "about it", "see api.ts", "")], "id int, title string, purpose string, detail string")
    assert {(r.path, r.id, r.score) for r in S.best_summaries(f, s).collect()} == {("src/utils/api.ts", 1, 220), ("src/x/Hero.tsx", 2, 80)}


def test_hot_keys_are_split_by_their_rows(spark):
    from quarryline.session import spread_left_join

    left = spark.range(1000).select(F.lit("hot").alias("k"), "id").unionByName(spark.createDataFrame([(None, 1), ("cold", 2)], "k string, id bigint"))
    right = spark.createDataFrame([("hot", 1), ("cold", 2), ("other", 3)], "k string, v int")
    got = spread_left_join(left, right, ["k"], "id", rows=10)
    assert got.count() == 1002 and got.where("v = 1").count() == 1000 and got.where("v is null").count() == 1
