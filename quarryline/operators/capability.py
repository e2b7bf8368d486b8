"""What a repository can do: evidence, lanes, areas, contracts and one row per entrypoint, composed of graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators import graph as G
from quarryline.operators.files import capability_lane, config_file, core_file, entry_name, lane, stem
from quarryline.operators.quality import provenance_confidence


def evidence(imports: DataFrame) -> DataFrame:
    """Distinct evidence spans in the order they were first seen: (snapshot_id, file, start, end, ord)."""
    one = imports.dropDuplicates(["import_id"]).select("snapshot_id", "ord", "import_id", F.explode("evidence").alias("e"))
    spans = one.select("snapshot_id", F.col("e.file").alias("file"), F.col("e.start").alias("start"), F.col("e.end").alias("end"), "ord")
    return spans.groupBy("snapshot_id", "file", "start", "end").agg(F.min("ord").alias("ord"))


def swimlanes(files: DataFrame) -> DataFrame:
    """The paths of each lane in order: (snapshot_id, lane, paths). A list has the distinct files of one snapshot and lane."""
    rows = files.select("snapshot_id", lane(F.col("path")).alias("lane"), "path").distinct()
    return rows.groupBy("snapshot_id", "lane").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def areas(files: DataFrame, key_files: int = 10) -> DataFrame:
    """Files by the first folder: (snapshot_id, area, entry, key_files) with at most ``key_files`` paths (a report)."""
    rows = files.where("path like '%/%'").select("snapshot_id", F.substring_index("path", "/", 1).alias("area"), "path").distinct()
    w = Window.partitionBy("snapshot_id", "area").orderBy("path")
    few = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= key_files)
    return few.groupBy("snapshot_id", "area").agg(F.min("path").alias("entry"), F.array_sort(F.collect_list("path")).alias("key_files"))


def context_files(files: DataFrame) -> DataFrame:
    """Core and configuration files and entrypoints, each once with the first role that applies."""
    p = F.col("path")
    role = F.when(entry_name(p), "entrypoint").when(core_file(p), "core").when(config_file(p), "config")
    return files.select("snapshot_id", "path", role.alias("role")).where("role is not null").distinct()


def entrypoints(files: DataFrame, routes: DataFrame, jobs: DataFrame, functions: DataFrame) -> DataFrame:
    """The union of what begins by its name, a route, a job or a function called main: (graph_id, id).

    files(graph_id, path); routes, jobs(graph_id, path); functions(graph_id, path, name).
    """
    named = files.where(entry_name(F.col("path"))).select("graph_id", F.col("path").alias("id"))
    main = functions.where("name = 'main'").select("graph_id", F.col("path").alias("id"))
    return named.unionByName(routes.select("graph_id", F.col("path").alias("id"))).unionByName(jobs.select("graph_id", F.col("path").alias("id"))).unionByName(main).distinct()


def contract_gaps(needed: DataFrame, contracts: DataFrame) -> DataFrame:
    """Contracts completed by a stub for every needed path that lacks one: needed(graph_id, path), contracts(graph_id, path, name, kind) -> (graph_id, path, name, kind, stub)."""
    missing = needed.where("path <> ''").select("graph_id", "path").distinct().join(contracts, ["graph_id", "path"], "left_anti")
    name = F.coalesce(F.nullif(stem(F.col("path")), F.lit("")), F.lit("contract"))
    held = contracts.select("graph_id", "path", "name", "kind", F.lit(False).alias("stub"))
    return held.unionByName(missing.select("graph_id", "path", name.alias("name"), F.lit("api.Module").alias("kind"), F.lit(True).alias("stub")))


# What each lane is for, and the steps of a capability of no known kind.
PURPOSES = {"web": "Web interface and user interaction", "api": "API service and data access", "worker": "Background processing and job execution", "scheduler": "Scheduled task execution", "cli": "Command-line interface and scripting"}
STEPS = [
    ("Initialize Component", "Set up the {name} functionality", True), ("Process Input", "Handle and validate incoming data or requests", False), ("Execute Logic", "Perform the core processing logic for this capability", False),
    ("Generate Output", "Produce the expected output or response", False), ("Complete Operation", "Finalize the operation and return results", True)]
# Policies that every service is taken to have.
POLICIES = [("cors", "methods=GET,POST;origins=*;headers=Content-Type"), ("rateLimit", "requests=100;window=1m")]


def orchestrators(starts: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Files that serve a start: neighbours by imports and calls, and the core and configuration files of its graph: (graph_id, id, path).

    starts(graph_id, id), files(graph_id, path). Core and configuration files are joined by graph; of these a graph has few.
    """
    near = G.neighbours(edges.where("kind in ('import', 'call')"), starts).select("graph_id", "id", F.col("neighbour").alias("path"))
    shared = files.where(core_file(F.col("path")) | config_file(F.col("path"))).select("graph_id", "path").distinct()
    return near.unionByName(starts.join(shared, "graph_id").select("graph_id", "id", "path")).distinct()


def control_flow(routes: DataFrame) -> DataFrame:
    """Edges from the file of a route to its handler: routes(graph_id, path, handler) -> (graph_id, src, dst, kind)."""
    return routes.where("handler is not null").select("graph_id", F.col("path").alias("src"), F.col("handler").alias("dst"), F.lit("route").alias("kind")).distinct()


def data_flow(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """What goes in and out of each start: (graph_id, id, section, type, name, confidence, hypothesis).

    Routes of a file give a request and a response each, stores and services are at the other end of its edges, services
    that are settings of the environment are inputs. edges as from graph.edges_by_kind().
    """
    w = starts.select("graph_id", "id").distinct()
    routes = edges.where("kind = 'route'").select("graph_id", F.col("dst").alias("id"), F.col("src").alias("name"), "confidence", "hypothesis").join(w, ["graph_id", "id"], "left_semi").distinct()

    def section(rows: DataFrame, name: str, kind: str, label: Column, sure: Column, guess: Column) -> DataFrame:
        return rows.select("graph_id", "id", F.lit(name).alias("section"), F.lit(kind).alias("type"), label.alias("name"), sure.alias("confidence"), guess.alias("hypothesis"))

    far = lambda kind: G.other_ends(edges, w, kind)
    env = F.col("other").rlike("^[A-Z][A-Z0-9_]*$")
    sure, guess = F.col("confidence"), F.col("hypothesis")
    parts = [
        section(routes, "inputs", "request", F.col("name"), sure, guess), section(routes, "outputs", "response", F.concat("name", F.lit(" Response")), sure, guess),
        section(far("store"), "stores", "database", F.col("other"), F.lit(0.8), F.lit(False)), section(far("external").where(~env), "externals", "service", F.col("other"), F.lit(0.7), F.lit(True)),
        section(far("external").where(env), "inputs", "environment", F.col("other"), F.lit(0.7), F.lit(True))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.distinct()


def capabilities(starts: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """One row per start with what it is made of.

    (graph_id, path, capability_id, lane, name, purpose, orchestrators, control_flow, inputs, outputs, stores, externals,
    suggested, confidence). Numbers count distinct things; confidence is the mean of three factors of provenance.
    """
    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("graph_id", "id").agg(F.count(F.lit(1)).alias(name))

    flow = data_flow(starts, edges).groupBy("graph_id", "id").agg(*[F.count_if(F.col("section") == s).alias(s) for s in ("inputs", "outputs", "stores", "externals")])
    around = G.incident(edges, starts).groupBy("graph_id", "id").agg(F.count(F.lit(1)).alias("control_flow"), F.count_if(F.col("status") == "suggested").alias("suggested"))
    rows = starts.select("graph_id", "id").distinct().join(counted(orchestrators(starts, edges, files), "orchestrators"), ["graph_id", "id"], "left").join(flow, ["graph_id", "id"], "left").join(around, ["graph_id", "id"], "left")
    rows = rows.na.fill(0, ["orchestrators", "control_flow", "inputs", "outputs", "stores", "externals", "suggested"]).withColumn("lane", capability_lane(F.col("id")))
    words = F.create_map(*[F.lit(x) for kv in PURPOSES.items() for x in kv])
    part = lambda n, say: F.when(F.col(n) > 0, F.format_string(say, F.col(n)))
    purpose = F.concat(words[F.col("lane")], F.concat_ws("", part("inputs", " with %d input sources"), part("stores", " using %d data stores"), part("externals", " integrating %d external services")))
    return rows.select(
        "graph_id", F.col("id").alias("path"), F.substring(F.sha2(F.concat_ws(":", "id", "lane"), 256), 1, 16).alias("capability_id"), "lane", F.concat(F.initcap("lane"), F.lit(" - "), stem(F.col("id"))).alias("name"), purpose.alias("purpose"),
        "orchestrators", "control_flow", "inputs", "outputs", "stores", "externals", "suggested", provenance_confidence(F.col("control_flow") > 0, F.col("outputs") > 0, F.col("orchestrators") > 0).alias("confidence"))


def policies(capabilities: DataFrame) -> DataFrame:
    """The assumed policies of each capability of the api lane: (capability_id, type, detail)."""
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(d).alias("detail")) for t, d in POLICIES])).alias("p")
    return capabilities.where("lane = 'api'").select("capability_id", each).select("capability_id", "p.*").distinct()


def contracts(models: DataFrame) -> DataFrame:
    """A contract for each model: models(graph_id, path, name, kind) -> the same, once."""
    return models.select("graph_id", "path", "name", "kind").distinct()


def steps(capabilities: DataFrame) -> DataFrame:
    """The narrative of a capability of no known kind: (capability_id, ord, title, description, file_id)."""
    each = F.posexplode(F.array(*[F.struct(F.lit(t).alias("title"), F.lit(d).alias("d"), F.lit(at).alias("at")) for t, d, at in STEPS])).alias("_k", "s")
    rows = capabilities.select("capability_id", "name", "path", each)
    return rows.select("capability_id", (F.col("_k") + 1).alias("ord"), "s.title", F.replace("s.d", F.lit("{name}"), "name").alias("description"), F.when(F.col("s.at"), F.col("path")).alias("file_id"))
