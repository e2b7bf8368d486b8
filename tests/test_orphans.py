from datetime import datetime as T

from quarryline.operators import orphans as O
from quarryline.session import spread_left_join

IMP = "import_id bigint, snapshot_id string, from_path string, raw string, resolved string, external boolean, reason_code string, observed_at timestamp_ntz, status string, path string"
WARN = "warning_id bigint, snapshot_id string, file string, created_at timestamp_ntz"
ART = "artifact_id string, snapshot_id string, created_at timestamp_ntz"
SNAP = "snapshot_id string, repo_id string, created_at timestamp_ntz"
FILE = "file_id bigint, snapshot_id string, path string, arrived_at timestamp_ntz, deleted_at timestamp_ntz"
DAY = lambda n: T(2025, 1, n)


def run(spark, imports=(), warns=(), arts=(), snaps=(), files=(), repos=()):
    mk = spark.createDataFrame
    imp = mk([(*r, "clash", "clash") for r in imports], IMP)
    out = O.orphans(imp, mk(list(warns), WARN), mk(list(arts), ART), mk(list(snaps), SNAP), mk(list(files), FILE), mk([(r,) for r in repos], "repo_id string"))
    return {(r.ref_table, r.ref_id, r.status) for r in out.collect()}


FILES = [(1, "s", "src/a.ts", DAY(1), None), (2, "s", "src/late.ts", DAY(9), None), (2, "s", "src/late.ts", DAY(8), None), (3, "s", "src/old.ts", DAY(1), DAY(3)), (4, "s", "src/pkg/index.js", DAY(1), None), (5, "s", "src/both.ts", DAY(9), DAY(3)), (6, "s", "m/__init__.py", DAY(1), None)]


def imp(i, raw, resolved=None, reason=None, at=DAY(5), frm="src/x/from.ts", ext=None):
    return (i, "s", frm, raw, resolved, ext, reason, at)


def test_statuses_of_imports(spark):
    got = run(spark, files=FILES, imports=[
        imp(1, "x", "src/a.ts"), imp(2, "x", "./src//y/../a.ts"), imp(3, "x", "src\\a.ts"), imp(4, "x", "src/A.ts"), imp(5, "x", "src/late.ts"), imp(6, "x", "src/old.ts"), imp(7, "x", "src/both.ts"),
        imp(8, "../a"), imp(9, "../pkg"), imp(10, "../none"), imp(11, "./${x}", reason="dynamic-import"), imp(12, "lodash"), imp(13, "../a", ext=True), imp(14, "../../m"), imp(15, "../late"), imp(16, None), imp(17, "../a.ts"),
        imp(18, "x", "src/old.ts", at=DAY(2)), imp(19, "../../../up/a"), imp(5, "x", "src/late.ts"),
    ])
    assert got == {("imports", "4", "missing"), ("imports", "5", "late"), ("imports", "6", "deleted"), ("imports", "7", "late"), ("imports", "10", "missing"), ("imports", "15", "late"), ("imports", "19", "missing")}


def test_other_tables(spark):
    got = run(
        spark, files=FILES, repos=["r"], snaps=[("s", "r", DAY(4)), ("s", "r", DAY(4)), ("q", "gone", DAY(4)), ("n", None, DAY(1))],
        warns=[(1, "s", "src/a.ts", DAY(5)), (2, "s", None, DAY(5)), (3, "t", "src/a.ts", DAY(5)), (4, "s", "./src/old.ts", DAY(5))],
        arts=[("a", "s", DAY(5)), ("b", "s", DAY(2)), ("c", "zzz", DAY(5)), ("d", None, DAY(5))])
    assert got == {("snapshots", "q", "missing"), ("parse_warnings", "3", "missing"), ("parse_warnings", "4", "deleted"), ("artifacts", "b", "late"), ("artifacts", "c", "missing")}


def test_empty_tables(spark):
    assert run(spark) == set()


def test_counts_by_month(spark):
    rows = spark.createDataFrame([("imports", "1", DAY(3), "late"), ("imports", "2", DAY(4), "late")], "ref_table string, ref_id string, at timestamp_ntz, status string")
    assert [tuple(r) for r in O.orphan_counts(rows).collect()] == [("imports", "2025-01", "late", 2)]


def test_hot_keys_are_split_and_nothing_is_lost(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)] + [(9999, None)], "id bigint, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("unused", 3)], "k string, v int")
    got = {r.id: r.v for r in spread_left_join(left, right, ["k"], "id").collect()}
    assert len(got) == 3001 and all(got[i] == (1 if i % 3 else 2 if i == 3 else None) for i in range(3000)) and got[9999] is None
