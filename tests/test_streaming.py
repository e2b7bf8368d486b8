from datetime import datetime as T

from quarryline.operators import jobs as J
from quarryline.streaming import events as E

ROWS = [(i, T(2024, 1, 1, 0, i), i % 2, "view" if i < 6 else "error", float(v)) for i, v in enumerate([0, 0, 3, 9, 20, 21, 22, 40])]


def run(spark, tmp_path, transform, mode):
    for k in range(2):
        spark.createDataFrame(ROWS[k * 4 : k * 4 + 4], E.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = transform(E.read_events(spark, f"{tmp_path}/in")).writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    out = spark.table("out").collect()
    q.stop()
    return out


def test_state_equals_the_batch_fold(spark, tmp_path):
    got = {}
    for r in run(spark, tmp_path, E.fold_stream, "update"):
        if r.events >= got.get(r.job_id, (0,))[0]:
            got[r.job_id] = (r.events, r.phase, r.started_at, r.completed_at, r.progress)
    want = {r.job_id: (r.events, r.status, r.started_at, r.completed_at, r.progress) for r in J.fold_state(spark.createDataFrame(ROWS, E.EVENT)).collect()}
    assert got == want


def test_debounce_carries_over_batches(spark, tmp_path):
    got = {r.event_id for r in run(spark, tmp_path, E.debounced_stream, "append")}
    assert got == {r.event_id for r in J.debounced(spark.createDataFrame(ROWS, E.EVENT)).collect()}


def test_token_bucket_carries_over_batches(spark, tmp_path):
    got = {r.event_id for r in run(spark, tmp_path, lambda s: E.limited_stream(s, 1.0, 1 / 300), "append")}
    assert got == {r.event_id for r in J.token_bucket(spark.createDataFrame(ROWS, E.EVENT), 1.0, 1 / 300).collect() if r.allowed}


def test_messages_and_percent(spark, tmp_path):
    e = spark.createDataFrame(ROWS, E.EVENT)
    assert {r.type for r in E.typed(e).collect()} == {"progress", "error"} and E.of_job(e, 1).count() == 4
    got = {}
    for r in run(spark, tmp_path, lambda s: E.percent_stream(s, 8), "update"):
        got[r.job_id] = max(got.get(r.job_id, 0), r.percent)
    assert got == {0: 42, 1: 42}
