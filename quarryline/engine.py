"""The operators under one roof: what a caller asks of an analysed repository, each answer a DataFrame.

An engine reads the tables of one folder (source files, imports, warnings, snapshots, artifacts, events) and composes
operators lazily; a snapshot narrows every answer to one repository at one time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import capability as C
from quarryline.operators import detect as D
from quarryline.operators import files as FI
from quarryline.operators import graph as G
from quarryline.operators import jobs as J
from quarryline.operators import manifest as M
from quarryline.operators import scripts as S
from quarryline.operators import search as SE
from quarryline.session import checkpointed
from quarryline.sources import archives
from quarryline.sources.tables import latest_files, table
from quarryline.streaming.events import backfill_then_follow


class Engine:
    def __init__(self, spark: SparkSession, folder: str, snapshot: str | None = None):
        self.spark, self.folder, self.snapshot = spark, folder, snapshot

    def _table(self, name: str) -> DataFrame:
        t = table(self.spark, self.folder, name)
        return t.where(F.col("snapshot_id") == self.snapshot) if self.snapshot and "snapshot_id" in t.columns else t

    def ingest(self, uploads: str) -> DataFrame:
        """Files of all archives of a folder that may be unpacked: (archive, path, content)."""
        return archives.extracted(self.spark, uploads, archives.guarded(archives.entries(self.spark, uploads)))

    def job_status(self) -> DataFrame:
        e = table(self.spark, self.folder, "events")
        return J.fold_state(e.select("event_id", "ts", F.col("user_id").alias("job_id"), F.col("event_type").alias("phase"), "value"))

    def events(self, job_id: int, after: int = 0, count: int = 100) -> DataFrame:
        e = table(self.spark, self.folder, "events").where(F.col("user_id") == job_id)
        return backfill_then_follow(e, after, count)

    def nodes(self) -> DataFrame:
        return self._table("source_files").select(F.col("snapshot_id").alias("graph_id"), F.col("path").alias("id")).distinct()

    def edges(self) -> DataFrame:
        return G.import_edges(self._table("imports"))

    def graph(self) -> DataFrame:
        """Nodes with neighbours, lane and role."""
        return G.index(self.nodes(), self.edges(), FI.lane(F.col("id")), FI.entry_name(F.col("id")))

    def overview(self) -> DataFrame:
        """Files, languages, imports and warnings of each snapshot."""
        f = latest_files(self._table("source_files"), "snapshot_id", FI.language(F.col("path")).alias("language"))
        files = f.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("language").alias("languages"))
        imports = self._table("imports").groupBy("snapshot_id").agg(F.countDistinct("import_id").alias("imports"))
        warnings = self._table("parse_warnings").groupBy("snapshot_id").agg(F.countDistinct("warning_id").alias("warnings"))
        return files.join(imports, "snapshot_id", "left").join(warnings, "snapshot_id", "left").na.fill(0)

    def preflight(self) -> DataFrame:
        f = self._table("source_files")
        return M.preflight(f, FI.repo_hash(f))

    def build_capabilities(self) -> DataFrame:
        """One row per entrypoint, from imports and detections read anew."""
        f = self._table("source_files")
        found = checkpointed(D.detect(f, D.ROUTES + D.STORES + D.EXTERNALS).withColumnsRenamed({"snapshot_id": "graph_id", "line": "ord"}))
        of = lambda rules: found.where(F.col("detector").isin(*{r.detector for r in rules}))
        none = found.where("false").select("*", F.lit("").alias("producer"), F.lit("").alias("consumer"))
        routes = of(D.ROUTES).select("*", F.col("item").alias("method"), F.col("name").alias("route"), F.expr("cast(array() as array<string>)").alias("middlewares"))
        i = self._table("imports").dropDuplicates(["import_id"]).select(F.col("snapshot_id").alias("graph_id"), F.col("from_path").alias("path"), "raw", "resolved", "external", "confidence", "hypothesis", "reason_code", F.col("import_id").alias("ord"))
        edges = checkpointed(G.edges_by_kind(i, routes, none, of(D.STORES), of(D.EXTERNALS), none, none))
        return C.capabilities(self.nodes().where(FI.entry_name(F.col("id"))), edges, self.nodes().withColumnRenamed("id", "path"))

    def capability(self, capability_id: str) -> DataFrame:
        return self.build_capabilities().where(F.col("capability_id") == capability_id)

    def file_detail(self, path: str) -> DataFrame:
        return S.profiles(self._table("source_files").where(F.col("path") == path))

    def files(self, lane: str | None = None) -> DataFrame:
        rows = self._table("source_files").select("snapshot_id", "path", FI.lane(F.col("path")).alias("lane")).distinct()
        return rows.where(F.col("lane") == lane) if lane else rows

    def tree(self) -> DataFrame:
        return FI.tree(self._table("source_files").select("snapshot_id", "path").distinct())

    def metrics(self) -> DataFrame:
        return G.stats(self.edges())

    def glossary(self, top: int = 50) -> DataFrame:
        words = F.explode(F.regexp_extract_all(F.lower("path"), F.lit("[a-z]{4,}"), F.lit(0)))
        return SE.glossary(self._table("source_files").select("snapshot_id", words.alias("term")), top)

    def suggestions(self, top: int = 20) -> DataFrame:
        p = S.profiles(self._table("source_files"))
        sure, why = SE.suggestion_class(F.col("path"), F.size("functions"), F.size("classes"), F.col("is_route"), F.col("is_api"), F.col("is_component"), F.lit(0))
        return SE.suggestions(p.select("file_id", "path", sure.alias("confidence"), why.alias("rationale")), ["file_id"], top)

    def retrieve(self, *questions: str, top: int = 20) -> DataFrame:
        corpus = latest_files(self._table("source_files"), "path", F.coalesce("text", F.lit("")).alias("text")).select(F.col("file_id").alias("id"), F.concat_ws(" ", "path", "text").alias("text"), FI.entry_name(F.col("path")).alias("entry"))
        return SE.retrieve(corpus, list(enumerate(questions)), top)

    def scenario_filter(self, lines: DataFrame) -> DataFrame:
        """Of lines(id, line) those that are not generic and name a file of the repository."""
        return SE.generic_lines(lines, self._table("source_files").select("path"))

    def artifacts(self) -> DataFrame:
        """The last version of every kind."""
        return J.latest_versions(self._table("artifacts").select("snapshot_id", "kind", "version", "artifact_id", "uri").distinct(), ["snapshot_id", "kind"], "version")

    def queue_stats(self) -> DataFrame:
        s = self._table("snapshots").select("snapshot_id", "source", "status").distinct()
        return s.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))
