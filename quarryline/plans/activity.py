"""Queries over event logs, retrieval, vectors and quality measures, each with the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import graph as G
from quarryline.operators import jobs as J
from quarryline.operators import quality as Q
from quarryline.operators import search as S
from quarryline.plans.code import EDGES, IN, edges
from quarryline.sources.tables import latest_files, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LOG = "log AS (SELECT event_id, ts, user_id AS job_id, event_type AS phase, value FROM events)"


def log(spark, d):
    return table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("job_id"), F.col("event_type").alias("phase"), "value")


@query(f"WITH {LOG} SELECT job_id, arg_max(phase, (ts, event_id)) AS status, min(ts) AS started_at, min(ts) FILTER (WHERE phase IN {IN(J.TERMINAL)}) AS completed_at, arg_max(value, (ts, event_id)) AS progress, count(*) AS events FROM log WHERE job_id IS NOT NULL GROUP BY 1")
def job_t05_fold_state(spark, d):
    return J.fold_state(log(spark, d))


@query(f"WITH {LOG}, x AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY job_id ORDER BY ts, event_id)) AS moved FROM log) SELECT event_id, job_id, value FROM x WHERE moved >= 5 OR moved IS NULL")
def win_w05_debounced(spark, d):
    return J.debounced(log(spark, d)).select("event_id", "job_id", "value")


@query(f"WITH {LOG} SELECT event_id, job_id, ts FROM log QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) <= 5")
def win_w06_last_events(spark, d):
    return J.last_events(log(spark, d)).select("event_id", "job_id", "ts")


@query(f"WITH {LOG}, x AS (SELECT *, coalesce(round(sum(value) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4), 0.0) AS used_before FROM log) SELECT event_id, job_id, used_before FROM x WHERE used_before < 500")
def win_w07_within_budget(spark, d):
    return J.within_budget(log(spark, d), 500.0).select("event_id", "job_id", "used_before")


@query(f"WITH {LOG} SELECT event_id, job_id FROM log QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) <= 3")
def win_w08_first_calls(spark, d):
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    return log(spark, d).withColumn("_n", F.row_number().over(w)).where("_n <= 3").select("event_id", "job_id")


@query(f"WITH {LOG}, s AS (SELECT unnest({['click', 'view', 'purchase', 'error', 'signup']}) AS phase) SELECT s.phase, count(l.event_id) AS n, min(l.ts) AS first_ts, max(l.ts) AS last_ts FROM s LEFT JOIN log l ON l.phase = s.phase GROUP BY 1")
def agg_a08_status_summary(spark, d):
    return J.status_summary(log(spark, d))


@query(f"WITH {LOG} SELECT phase, count(*) AS calls, round(sum(value), 2) AS total, round(avg(value), 6) AS mean, round(avg(CAST(value > 50 AS DOUBLE)), 6) AS hit_rate FROM log GROUP BY 1")
def agg_a28_usage(spark, d):
    return J.usage(log(spark, d))


@query()
def job_t07_token_bucket(spark, d):
    return J.token_bucket(log(spark, d), capacity=2.0, rate=0.0005)


@query("SELECT o_orderkey, o_orderpriority, CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INT) <= 2 THEN 'high' WHEN CAST(substr(o_orderpriority, 1, 1) AS INT) = 3 THEN 'normal' ELSE 'low' END AS queue FROM orders")
def job_t09_queue_names(spark, d):
    p = 4 - F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", J.queue_name(p).alias("queue"))


@query(f"WITH {LOG}, j AS (SELECT job_id, min(ts) FILTER (WHERE phase IN {IN(J.TERMINAL)}) AS completed_at FROM log GROUP BY 1) SELECT job_id, completed_at FROM j WHERE date_diff('second', completed_at, TIMESTAMP '2024-02-01 00:00:00') > 1209600")
def top_o11_expired_jobs(spark, d):
    jobs = J.fold_state(log(spark, d))
    return J.expired(jobs, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), 14 * 24 * 3600).select("job_id", "completed_at")


@query(f"WITH {LOG} SELECT event_id, job_id, phase FROM log WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def job_t03_backfill_page(spark, d):
    from quarryline.streaming.events import backfill_then_follow

    return backfill_then_follow(log(spark, d), 500).select("event_id", "job_id", "phase")


# ---------------------------------------------------------------- retrieval

QUESTIONS = [(1, "Where is the queue worker for jobs"), (2, "which api routes use the store"), (3, "zzz qqq"), (4, "how does the import graph resolve index files")]


@query("""WITH q AS (SELECT * FROM (VALUES (1, 'Where is the queue worker for jobs'), (2, 'which api routes use the store'), (3, 'zzz qqq'), (4, 'how does the import graph resolve index files')) AS t(question_id, question)),
t AS (SELECT question_id, unnest(regexp_extract_all(lower(question), '[a-zA-Z0-9_./-]+')) AS w FROM q),
h AS (SELECT t.question_id, d.doc_id AS id, count(*) FILTER (WHERE contains(lower(coalesce(d.text, '')), t.w)) AS hits, any_value(coalesce(d.path LIKE '%index%', false)) AS entry FROM t, documents d GROUP BY 1, 2),
s AS (SELECT question_id, id, round(hits + CASE WHEN entry AND hits > 0 THEN 0.3 ELSE 0.0 END, 6) AS score FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank, max(score) OVER (PARTITION BY question_id) AS best FROM s)
SELECT question_id, id, CAST(score AS DOUBLE) AS score, rank FROM r WHERE (best > 0 AND score > 0 AND rank <= 20) OR (best = 0 AND rank <= 10)""")
def top_o03_retrieval(spark, d):
    corpus = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.coalesce(F.col("path").like("%index%"), F.lit(False)).alias("entry"))
    return S.retrieve(corpus, QUESTIONS)


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
e AS (SELECT vec_id AS id, embedding, label / 10.0 AS confidence FROM embeddings),
s AS (SELECT id, confidence, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(q[i] AS DOUBLE))) AS dot, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS a, sqrt(list_sum(list_transform(q, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS b FROM e, q)
SELECT id, round(dot / (a * b) * 0.3 + confidence * 0.7, 6) AS score FROM s""")
def top_o04_rerank(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("_q"))
    rows = e.select(F.col("vec_id").alias("id"), "embedding", (F.col("label") / 10.0).alias("confidence")).join(F.broadcast(q))  # one row
    return rows.select("id", F.round(X.cosine(F.col("embedding"), F.col("_q")) * 0.3 + F.col("confidence") * 0.7, 6).alias("score"))


@query("""WITH l AS (SELECT doc_id AS id, text AS line FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '(?i)\\b(various|several|appropriate|etc|some files)\\b')),
m AS (SELECT DISTINCT id, unnest(regexp_extract_all(line, '[\\w./-]+/[\\w./-]*\\w')) AS path FROM l), a AS (SELECT DISTINCT path FROM documents WHERE path IS NOT NULL)
SELECT DISTINCT m.id FROM m JOIN a ON a.path = m.path""")
def proj_p19_allowed_mentions(spark, d):
    docs = table(spark, d, "documents")
    lines = docs.where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("line"))
    return S.generic_lines(lines, docs.where("path is not null").select("path")).select("id")


@query("WITH d AS (SELECT doc_id, repo_id FROM documents WHERE repo_id IS NOT NULL) SELECT r.repo_id, count(d.doc_id) AS documents FROM repos r JOIN d ON d.repo_id = r.repo_id WHERE r.owner_id IS NOT NULL GROUP BY 1")
def join_j14_semi_files(spark, d):
    owned = table(spark, d, "repos").where("owner_id is not null").select("repo_id").distinct()
    docs = table(spark, d, "documents").select("doc_id", "repo_id")
    return docs.join(owned, "repo_id", "left_semi").groupBy("repo_id").agg(F.count(F.lit(1)).alias("documents"))


# ---------------------------------------------------------------- quality


@query("""WITH f AS (SELECT DISTINCT snapshot_id, from_path, resolved FROM imports WHERE resolved IS NOT NULL AND confidence >= 0.8), g AS (SELECT DISTINCT i.snapshot_id, i.from_path, i.resolved FROM imports i JOIN (SELECT DISTINCT snapshot_id, path FROM source_files) s ON s.snapshot_id = i.snapshot_id AND s.path = i.resolved),
n AS (SELECT coalesce(f.snapshot_id, g.snapshot_id) AS snapshot_id, count(f.resolved) AS f, count(g.resolved) AS g, count(*) FILTER (WHERE f.resolved IS NOT NULL AND g.resolved IS NOT NULL) AS b FROM f FULL JOIN g ON f.snapshot_id = g.snapshot_id AND f.from_path = g.from_path AND f.resolved = g.resolved GROUP BY 1),
r AS (SELECT snapshot_id, CASE WHEN f = 0 THEN 0.0 ELSE round(CAST(b AS DOUBLE) / f, 6) END AS precision, CASE WHEN g = 0 THEN 0.0 ELSE round(CAST(b AS DOUBLE) / g, 6) END AS recall FROM n) SELECT *, precision >= 0.9 AND recall >= 0.8 AS passed FROM r""")
def agg_a09_precision_recall(spark, d):
    i = table(spark, d, "imports").where("resolved is not null").select("snapshot_id", "from_path", "resolved", "confidence")
    files = table(spark, d, "source_files").select("snapshot_id", F.col("path").alias("resolved")).distinct()
    return Q.precision_recall(i.where("confidence >= 0.8"), i.join(files, ["snapshot_id", "resolved"], "left_semi"), ["from_path", "resolved"], "snapshot_id")


@query(f"""WITH {EDGES}, k AS (SELECT graph_id, src, dst, bool_or(coalesce(confidence, 0) = 0 AND hypothesis) AS u, bool_or(hypothesis) AS h FROM edges GROUP BY 1, 2, 3), r AS (SELECT graph_id, round(CAST(count(*) FILTER (WHERE u) AS DOUBLE) / count(*), 6) AS u, round(CAST(count(*) FILTER (WHERE h) AS DOUBLE) / count(*), 6) AS h FROM k GROUP BY 1)
SELECT graph_id, round(greatest(0.0, 1.0 - least(u, 0.2) / 0.2), 6) AS unresolved_score, round(greatest(0.0, 1.0 - least(h, 0.3) / 0.3), 6) AS hypothesis_score FROM r""")
def agg_a10_threshold_scores(spark, d):
    r = G.unresolved_ratio(edges(spark, d))
    return r.select("graph_id", F.round(Q.inverted(F.col("unresolved_ratio"), Q.THRESHOLDS["unresolved_import_ratio"]), 6).alias("unresolved_score"), F.round(Q.inverted(F.col("hypothesis_ratio"), Q.THRESHOLDS["hypothesis_ratio"]), 6).alias("hypothesis_score"))


@query("WITH p AS (" + SQL["agg_a09_precision_recall"] + ") SELECT count(*) AS snapshots, round(avg(CAST(passed AS DOUBLE)), 6) AS score FROM p")
def agg_a11_suite_score(spark, d):
    p = agg_a09_precision_recall(spark, d)
    return p.agg(F.count(F.lit(1)).alias("snapshots"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("score"))


@query("""WITH i AS (SELECT DISTINCT import_id, resolved, external, evidence FROM imports) SELECT import_id, round((CASE WHEN len(evidence) > 0 THEN 0.9 ELSE 0.3 END + CASE WHEN resolved IS NOT NULL THEN 0.8 ELSE 0.5 END + CASE WHEN NOT coalesce(external, false) THEN 0.8 ELSE 0.2 END) / 3, 6) AS confidence FROM i""")
def agg_a12_provenance_confidence(spark, d):
    i = table(spark, d, "imports").dropDuplicates(["import_id"])
    return i.select("import_id", Q.provenance_confidence(F.size("evidence") > 0, F.col("resolved").isNotNull(), ~F.coalesce("external", F.lit(False))).alias("confidence"))


@query("SELECT path, count(*) AS n FROM (SELECT DISTINCT file_id, path FROM source_files) GROUP BY path HAVING count(*) > 1")
def fn_repeated_paths(spark, d):
    return latest_files(table(spark, d, "source_files"), "path").groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT DISTINCT path, array_to_string(list_transform(regexp_extract_all(regexp_replace(string_split(path, '/')[-1], '\\.\\w+$', ''), '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS title FROM source_files")
def fn_titles(spark, d):
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.\w+$", "")
    return table(spark, d, "source_files").select("path").distinct().select("path", X.title(stem).alias("title"))


# ---------------------------------------------------------------- caches, keys and responses


@query(f"WITH {LOG} SELECT phase AS cache, event_id AS key FROM log QUALIFY row_number() OVER (PARTITION BY phase ORDER BY ts DESC, event_id DESC) > 150")
def top_o07_evicted(spark, d):
    return J.evicted(log(spark, d).select(F.col("phase").alias("cache"), F.col("event_id").alias("key"), F.col("ts").alias("used_at")), 150)


@query("WITH a AS (SELECT DISTINCT artifact_id, snapshot_id, kind, version FROM artifacts), h AS (SELECT DISTINCT snapshot_id, kind FROM a WHERE version <= 2) SELECT snapshot_id, kind, version, artifact_id FROM a WHERE version > 2 AND NOT EXISTS (SELECT 1 FROM h WHERE h.snapshot_id = a.snapshot_id AND h.kind = a.kind) QUALIFY row_number() OVER (PARTITION BY snapshot_id, kind ORDER BY version, artifact_id) = 1")
def set_u05_new_only(spark, d):
    a = table(spark, d, "artifacts").select("artifact_id", "snapshot_id", "kind", "version").distinct()
    return J.new_only(a.where("version > 2"), a.where("version <= 2"), ["snapshot_id", "kind"], ["version", "artifact_id"])


@query("WITH r AS (SELECT DISTINCT snapshot_id, kind FROM artifacts), p AS (SELECT DISTINCT snapshot_id, kind FROM artifacts WHERE version >= 3) SELECT r.snapshot_id, count(*) FILTER (WHERE p.kind IS NULL) = 0 AS complete, count(*) FILTER (WHERE p.kind IS NULL) AS missing FROM r LEFT JOIN p ON p.snapshot_id = r.snapshot_id AND p.kind = r.kind WHERE r.snapshot_id IS NOT NULL GROUP BY 1")
def set_u07_complete(spark, d):
    a = table(spark, d, "artifacts").where("snapshot_id is not null").select("snapshot_id", "kind", "version")
    return J.lacking(a, a.where("version >= 3"), "snapshot_id", "kind")


@query("SELECT title FROM (SELECT name AS title, repo_id FROM repos WHERE name IS NOT NULL ORDER BY repo_id LIMIT 6)")
def proj_p20_sparse_fallback(spark, d):
    r = table(spark, d, "repos")
    few = r.where("name = 'no such repository'").select(F.col("name").alias("title"))
    return S.sparse_fallback(few, r.where("name is not null").select(F.col("repo_id").alias("ord"), F.col("name").alias("title")))


@query("SELECT repo_id AS \"repoId\", coalesce(name, 'unnamed') AS name, coalesce(owner_id, 'unknown') AS \"ownerId\" FROM repos")
def proj_p23_response_names(spark, d):
    return J.aliased(table(spark, d, "repos").select("repo_id", "name", "owner_id"), {"repo_id": "repoId", "owner_id": "ownerId"}, {"name": "unnamed", "owner_id": "unknown"})


@query(f"WITH {LOG}, n AS (SELECT job_id, count(*) AS n FROM log GROUP BY 1) SELECT job_id, CAST(35 + floor(n / 20.0 * 15) AS INT) AS percent FROM n")
def job_t11_percent(spark, d):
    n = log(spark, d).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("job_id", J.batch_percent(F.col("n"), F.lit(20)).alias("percent"))


@query(f"WITH {LOG}, r AS (SELECT job_id, CAST(date_diff('second', min(ts), max(ts)) AS DOUBLE) AS s FROM log GROUP BY 1) SELECT job_id, round(CASE WHEN s <= 300 THEN 1.0 ELSE greatest(0.0, 1.0 - (s - 300) / 300) END, 6) AS score FROM r")
def agg_a10_runtime_scores(spark, d):
    r = log(spark, d).groupBy("job_id").agg(F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).cast("double").alias("s"))
    return r.select("job_id", F.round(Q.runtime_score(F.col("s")), 6).alias("score"))


@query(f"WITH {LOG} SELECT event_id, job_id, CASE WHEN phase IN ('done', 'error', 'phase', 'progress', 'artifact', 'warning') THEN phase WHEN value IS NOT NULL THEN 'progress' ELSE 'phase' END AS type FROM log")
def job_t02_typed_events(spark, d):
    from quarryline.streaming.events import typed

    return typed(log(spark, d)).select("event_id", "job_id", "type")
