import json

from quarryline.operators import schema_drift as D

ART = "artifact_id string, snapshot_id string, kind string, version int, status string, field string"
REC = "record_id bigint, artifact_id string, line_no int, payload string, old_field string"


def tables(spark, arts, recs):
    a = spark.createDataFrame([(i, s, k, v, "x", "y") for i, s, k, v in arts], ART)
    r = spark.createDataFrame([(n, i, n, p if p is None or isinstance(p, str) else json.dumps(p), "z") for n, (i, p) in enumerate(recs)], REC)
    return a, r


def steps(spark, arts, recs):
    a, r = tables(spark, arts, recs)
    return {tuple(x) for x in D.migration_steps(a, r).select("artifact_id", "change", "old_field", "new_field").collect()}


def test_all_kinds_of_change(spark):
    arts = [("a1", "s", "files", 1), ("a2", "s", "files", 4), ("a2", "s", "files", 4), ("b1", "s", "graph", 1)]
    recs = [
        ("a1", {"path": "p", "size": 1, "gone": True, "old": "v"}), ("a1", {"path": "q", "size": 2, "old": "w", "opt": None}),
        ("a2", {"path": "p", "size": "1", "new": "v", "fresh": [1]}), ("a2", {"new": "w", "path": "q", "size": "2"}), ("a2", {"new": "w", "path": "q", "size": "2"}),
        ("b1", {"path": "p"}),
    ]
    assert steps(spark, arts, recs) == {
        ("a2", "renamed", "old", "new"), ("a2", "removed", "gone", ""), ("a2", "removed", "opt", ""), ("a2", "added", "", "fresh"), ("a2", "retyped", "size", "size")}


def test_unreadable_null_and_unordered_payloads(spark):
    arts = [("a1", "s", "k", 1), ("a2", "s", "k", 2)]
    recs = [("a1", '{"path":"p","a":1}'), ("a1", '{"path":"p","a"'), ("a1", None), ("a1", "[1,2]"), ("a1", ""), ("a2", '{"a": 1, "path": "p"}')]
    assert steps(spark, arts, recs) == set()


def test_same_values_of_other_type_are_no_rename(spark):
    arts = [("a1", "s", "k", 1), ("a2", "s", "k", 2)]
    recs = [("a1", {"path": "p", "a": 1}), ("a2", {"path": "p", "b": "1"})]
    assert steps(spark, arts, recs) == {("a2", "removed", "a", ""), ("a2", "added", "", "b")}


def test_empty_tables_and_nulls(spark):
    assert steps(spark, [], []) == set()
    assert steps(spark, [(None, None, None, None), ("a1", None, None, 1), ("a2", None, None, 2)], [("a1", {"path": None, "x": 1}), ("a2", {"path": None})]) == {("a2", "removed", "x", "")}


def test_previous_version_across_blocks(spark):
    arts = [(f"a{v}", "s", "k", v) for v in (1, D.BLOCK - 1, D.BLOCK, 5 * D.BLOCK + 3)]
    a, _ = tables(spark, arts, [])
    got = {r.artifact_id: r.prev_id for r in D.ordered_artifacts(a).collect()}
    assert got == {"a1": None, f"a{D.BLOCK - 1}": "a1", f"a{D.BLOCK}": f"a{D.BLOCK - 1}", f"a{5 * D.BLOCK + 3}": f"a{D.BLOCK}"}


def test_consistent_table_follows_renames_and_casts(spark):
    arts = [("a1", "s", "k", 1), ("a2", "s", "k", 2), ("a3", "s", "k", 3)]
    recs = [("a1", {"path": "p", "n": 7}), ("a2", {"path": "p", "m": 7}), ("a3", {"path": "p", "m": "7"})]
    a, r = tables(spark, arts, recs)
    out = {(x.artifact_id, x.field): (x.type, x.value, x.source_field) for x in D.consistent_table(a, r, D.migration_steps(a, r)).collect()}
    assert out[("a1", "m")] == ("string", '"7"', "n") and out[("a2", "m")] == ("string", '"7"', "m") and out[("a3", "m")][1] == '"7"'


def test_consistent_table_has_defaults_and_all_records(spark):
    arts = [("a1", "s", None, 1), ("a2", "s", None, 2), ("b1", "s", "k", None)]
    recs = [("a1", {"path": "p", "n": 7}), ("a2", {"path": "p", "n": 7, "late": True, "opt": "x"}), ("a2", {"path": "q", "n": 8, "late": False}), ("a1", {}), ("b1", {"v": 1}), ("gone", {"w": 2}), ("gone", {}), (None, {"z": 3})]
    a, r = tables(spark, arts, recs)
    rows = D.consistent_table(a, r, D.migration_steps(a, r)).collect()
    out = {(x.record_id, x.field): (x.type, x.value, x.source_field) for x in rows}
    assert len(out) == len(rows)
    assert out[(0, "late")] == ("boolean", None, None) and out[(0, "opt")] == ("string", None, None) and out[(0, "n")] == ("number", "7", "n")
    assert out[(2, "opt")] == ("string", None, None) and out[(2, "late")] == ("boolean", "false", "late")
    assert {f for n, f in out if n == 3} == {"path", "n", "late", "opt"} and all(v[1:] == (None, None) for (n, _), v in out.items() if n == 3)
    assert out[(4, "v")] == ("number", "1", "v") and out[(5, "w")] == ("number", "2", "w") and out[(6, None)] == (None, None, None) and out[(7, "z")] == ("number", "3", "z")
    assert {(x.snapshot_id, x.kind, x.version) for x in rows if x.record_id < 4} == {("s", None, 1), ("s", None, 2)}
