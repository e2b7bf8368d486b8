import pandas as pd

from quarryline.llm import mixing as M

DOC = "doc_id bigint, lang string, source string, tokens bigint"
TARGET = "mix_id int, source string, target_share double, max_repeats int, mix_size_ratio double"


def run(spark, docs, targets):
    d, t = spark.createDataFrame(docs, DOC), spark.createDataFrame(targets, TARGET)
    m = M.mix(d, t).cache()
    return m.collect(), {(r.mix_id, r.source): r for r in M.actual_shares(m, t).collect()}


def test_shares_repeats_and_determinism(spark):
    docs = [(i, "en", "readme", 10) for i in range(300)] + [(1000 + i, "de", "runbook", 10) for i in range(10)] + [(2000, "en", None, 10), (2001, "en", "readme", 0)]
    targets = [(1, "readme", 0.5, 2, 0.5), (1, "runbook", 0.5, 3, 0.5), (2, "readme", 1.0, 1, 0.2), (2, "nothing", 0.0, 1, 0.2)]
    rows, shares = run(spark, docs, targets)
    total = sum(d[3] for d in docs)
    assert all(1 <= r.repeats <= {("readme", 1): 2, ("runbook", 1): 3, ("readme", 2): 1}[(r.source, r.mix_id)] for r in rows)
    assert shares[(1, "runbook")].tokens == 300  # ten documents, three times: all it has
    assert abs(shares[(1, "readme")].tokens - (0.5 * total - 300)) <= 10  # the shortage went to the other source
    assert abs(shares[(2, "readme")].tokens - 0.2 * total) <= 10 and shares[(2, "nothing")].actual_share == 0
    again, _ = run(spark, docs, targets)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_prefix_is_exact_within_a_document(spark):
    rows, shares = run(spark, [(i, "en", "readme", 1 + i % 7) for i in range(2000)], [(1, "readme", 1.0, 3, 1.4)])
    total = sum(1 + i % 7 for i in range(2000))
    assert 0 <= 1.4 * total - shares[(1, "readme")].tokens <= 7 and {r.repeats for r in rows} == {1, 2}


def test_dirty_names_and_empty_tables(spark):
    d = spark.createDataFrame([(1, " README ", "EN-us"), (2, "release-note", None), (3, None, "xx")], "doc_id bigint, source string, lang string")
    got = d.select(M.source_name(d.source).alias("s"), M.lang_name(d.lang).alias("l")).collect()
    assert [tuple(r) for r in got] == [("readme", "en"), ("release_note", "und"), (None, "und")]
    rows, shares = run(spark, [], [(1, "readme", 1.0, 2, 0.5)])
    assert rows == [] and shares[(1, "readme")].actual_share == 0
    assert run(spark, [(1, "en", "readme", 5)], []) == ([], {})


def test_shortages_go_to_siblings_before_ancestors():
    leaves = pd.DataFrame({"domain": ["a", "a", "a", "b"], "lang": ["x", "x", "y", "x"], "weight": [0.25] * 4, "capacity": [10, 40, 100, 100]})
    got = M.spread(leaves, 100.0)
    assert got.tolist() == [10, 40, 25, 25]
    leaves["capacity"] = [10, 30, 100, 100]
    assert M.spread(leaves, 100.0).round(6).tolist() == [10, 30, 35, 25]
    leaves["capacity"] = [10, 30, 30, 100]
    assert M.spread(leaves, 100.0).round(6).tolist() == [10, 30, 30, 30]
    leaves["capacity"] = [1, 1, 1, 1]
    assert M.spread(leaves, 100.0).tolist() == [1, 1, 1, 1]
