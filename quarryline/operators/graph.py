"""Edges with evidence and confidence: building, merging, splitting, measuring and walking them.

An edge table has (graph_id, src, dst, kind, confidence, hypothesis, ord) and optionally layer ('static' or 'model').
Its natural key is (graph_id, src, dst, kind). A multigraph keeps repeated rows; the merge operators do not.

Defined results: edges with a null end are no edges; a null confidence counts as 0 and a null hypothesis as false; ties
are broken by a total order, so repeated runs agree; empty tables give empty tables or ratios of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import join_urls, ratio
from quarryline.session import checkpointed

#: The bounds of quarantine and of suggestion.
QUARANTINE, SUGGEST = 0.3, 0.5
EDGE = ["graph_id", "src", "dst", "kind"]


def import_edges(imports: DataFrame) -> DataFrame:
    """Edges of imports, one per import: resolved ones lead to files, others to what they name."""
    one = imports.dropDuplicates(["import_id"])
    return one.select(
        F.col("snapshot_id").alias("graph_id"), F.col("from_path").alias("src"), F.coalesce("resolved", "raw").alias("dst"), F.lit("import").alias("kind"), "confidence",
        F.coalesce("hypothesis", F.lit(False)).alias("hypothesis"), F.col("resolved").isNotNull().alias("resolved"), F.coalesce("external", F.col("resolved").isNull()).alias("external"), F.col("import_id").alias("ord"),
    ).where("src is not null and dst is not null")


# How sure an edge to a middleware, a producer or a consumer is, of what its route or job is; and a store's or service's without a word on it.
INDIRECT, DEFAULT_CONFIDENCE = 0.8, 0.5


def edges_by_kind(imports: DataFrame, routes: DataFrame, jobs: DataFrame, stores: DataFrame, externals: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """One table of edges of eight kinds: (graph_id, src, dst, kind, confidence, hypothesis, reason_code, ord).

    imports(graph_id, path, raw, resolved, external, confidence, hypothesis, reason_code, ord); routes(graph_id, path,
    method, route, middlewares, confidence, hypothesis, ord); jobs(graph_id, path, name, producer, consumer, confidence,
    hypothesis, ord); stores, externals, functions, classes(graph_id, path, name, confidence, hypothesis, ord). An import
    without a file stays with confidence 0 as 'unresolved', which only the ratio reads. Edges without an end are none.
    """
    none = F.lit(None).cast("string")

    def edge(rows: DataFrame, src: Column, dst: Column, kind: str, factor: float = 1.0, reason: Column = none) -> DataFrame:
        sure = F.coalesce(F.col("confidence"), F.lit(DEFAULT_CONFIDENCE)) * factor
        return rows.select("graph_id", src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.round(sure, 6).alias("confidence"), F.coalesce("hypothesis", F.lit(False)).alias("hypothesis"), reason.alias("reason_code"), "ord")

    path, name = F.col("path"), F.col("name")
    inner = imports.where("not coalesce(external, true)")
    found, lost = inner.where("resolved is not null"), inner.where("resolved is null").withColumns({"confidence": F.lit(0.0), "hypothesis": F.lit(True)})
    at = F.concat_ws(":", "method", "route")
    between = routes.select("*", F.explode("middlewares").alias("_via"))
    static = F.lit("static_detection")
    parts = [
        edge(found, path, F.col("resolved"), "import", reason=F.col("reason_code")), edge(lost, path, F.col("raw"), "import", reason=F.lit("unresolved")),
        edge(routes, at, path, "route"), edge(between, at, F.col("_via"), "middleware", INDIRECT, F.lit("middleware")),
        edge(jobs, name, path, "job"), edge(jobs.where("producer <> 'unknown'"), name, F.col("producer"), "job", INDIRECT, F.lit("producer")), edge(jobs.where("consumer <> 'unknown'"), name, F.col("consumer"), "job", INDIRECT, F.lit("consumer")),
        edge(stores, path, name, "store"), edge(externals, path, name, "external"), edge(functions, path, name, "call", reason=static), edge(classes, path, name, "class", reason=static)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.where("src is not null and dst is not null and dst <> ''")


def other_ends(edges: DataFrame, starts: DataFrame, kind: str) -> DataFrame:
    """What is at the other end of a start's edges of a kind, in either direction: (graph_id, id, other)."""
    e = edges.where(F.col("kind") == kind)
    both = e.select("graph_id", F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(e.select("graph_id", F.col("dst").alias("id"), F.col("src").alias("other")))
    return both.join(starts.select("graph_id", "id").distinct(), ["graph_id", "id"], "left_semi").distinct()


def incident(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Main and suggested edges at each start: (graph_id, id, src, dst, kind, status); two equality joins, not an OR."""
    e = split(edges).where("status <> 'quarantined'").select("graph_id", "src", "dst", "kind", "status")
    w = starts.select("graph_id", "id").distinct()
    ends = [e.withColumn("id", F.col(c)).join(w, ["graph_id", "id"], "left_semi") for c in ("src", "dst")]
    return ends[0].unionByName(ends[1]).distinct()


def assembled(modules: DataFrame, endpoints: DataFrame, models: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a picture: modules, endpoints and models (graph_id, id) with their type, and the edges both of whose ends are nodes.

    Ends that name packages ('pkg:') are no nodes; an id of several types keeps the first.
    """
    ranked = [r.select("graph_id", "id", F.lit(k).alias("_k"), F.lit(t).alias("type")) for k, (t, r) in enumerate((("module", modules), ("endpoint", endpoints), ("model", models)))]
    nodes = ranked[0].unionByName(ranked[1]).unionByName(ranked[2]).where("id is not null and id not like 'pkg:%'").groupBy("graph_id", "id").agg(F.min_by("type", "_k").alias("type"))
    return nodes, induced(edges, nodes)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In- and out-degree over resolved edges of the multigraph; nodes without edges stay: (graph_id, id, in_degree, out_degree)."""
    ends = edges.where("resolved").select("graph_id", F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    sums = ends.groupBy("graph_id", F.col("e.id").alias("id")).agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"))
    return nodes.select("graph_id", "id").join(sums, ["graph_id", "id"], "left").select("graph_id", "id", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))


def hubs(degree: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes with most edges over all graphs, ties by graph and id."""
    return degree.select("graph_id", "id", (F.col("in_degree") + F.col("out_degree")).alias("degree")).orderBy(F.desc("degree"), "graph_id", "id").limit(k)


def unresolved_local(raw: Column, roots: list[str]) -> Column:
    """Whether an unresolved name looks like one of the repository's own."""
    return raw.rlike(r"^(\.|/|@/)") | raw.rlike("^(" + "|".join(roots) + ")/") | (raw.contains(".") & ~raw.contains("/"))


def last_writer(edges: DataFrame) -> DataFrame:
    """One row per key: the one that came last."""
    cols = [c for c in edges.columns if c not in EDGE]
    return edges.groupBy(*EDGE).agg(F.max_by(F.struct(*cols), F.struct("ord", *[c for c in cols if c != "ord"])).alias("_r")).select(*EDGE, "_r.*")


def merge_layers(edges: DataFrame) -> DataFrame:
    """Static edges are replaced by a model's only where its confidence is strictly greater; then the earlier row holds."""
    rank = F.struct(-F.coalesce("confidence", F.lit(0.0)), F.when(F.col("layer") == "static", 0).otherwise(1), F.col("ord"))
    cols = [c for c in edges.columns if c not in EDGE]
    return edges.groupBy(*EDGE).agg(F.min_by(F.struct(*cols), rank).alias("_r")).select(*EDGE, "_r.*")


def status(confidence: Column, hypothesis: Column) -> Column:
    """quarantined, suggested or main."""
    c, h = F.coalesce(confidence, F.lit(0.0)), F.coalesce(hypothesis, F.lit(False))
    return F.when(h & (c < QUARANTINE), "quarantined").when(h | (c < SUGGEST), "suggested").otherwise("main")


def split(edges: DataFrame) -> DataFrame:
    return edges.withColumn("status", status(F.col("confidence"), F.col("hypothesis")))


def stats(edges: DataFrame) -> DataFrame:
    """Edges, main and suggested ones and distinct sources per kind: (graph_id, kind, edges, main, suggested, quarantined, sources)."""
    s = split(edges)
    return s.groupBy("graph_id", "kind").agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(F.col("status") == "main").alias("main"), F.count_if(F.col("status") == "suggested").alias("suggested"),
        F.count_if(F.col("status") == "quarantined").alias("quarantined"), F.countDistinct("src").alias("sources"))


def unresolved_ratio(edges: DataFrame) -> DataFrame:
    """Share of distinct import keys without a target; hypotheses of all edges beside it. 0 where there are none."""
    keys = edges.where("kind = 'import'").groupBy(*EDGE).agg(F.max((F.coalesce("confidence", F.lit(0.0)) == 0) & F.col("hypothesis")).alias("_u"), F.max("hypothesis").alias("_h"))
    out = keys.groupBy("graph_id").agg(F.count_if("_u").alias("u"), F.count_if("_h").alias("h"), F.count(F.lit(1)).alias("n"))
    return out.select("graph_id", F.round(ratio(F.col("u"), F.col("n")), 6).alias("unresolved_ratio"), F.round(ratio(F.col("h"), F.col("n")), 6).alias("hypothesis_ratio"))


def warnings(edges: DataFrame) -> DataFrame:
    """Edges that deserve a warning: low confidence, and hypotheses; one that is both has both."""
    low = edges.where("confidence < 0.7").select(*EDGE, F.lit("low-confidence").alias("reason"))
    return low.unionByName(edges.where("hypothesis").select(*EDGE, F.lit("hypothesis").alias("reason"))).distinct()


def index(nodes: DataFrame, edges: DataFrame, lane: Column, entry: Column) -> DataFrame:
    """Nodes with sorted neighbours, lane and role: (graph_id, id, incoming, outgoing, lane, role). ``entry`` tells entrypoints.

    A list has the distinct neighbours of one node.
    """
    e = edges.select("graph_id", "src", "dst").distinct()
    out = e.groupBy("graph_id", F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("outgoing"))
    inc = e.groupBy("graph_id", F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("incoming"))
    none = F.expr("cast(array() as array<string>)")
    rows = nodes.join(out, ["graph_id", "id"], "left").join(inc, ["graph_id", "id"], "left")
    rows = rows.select("graph_id", "id", F.coalesce("incoming", none).alias("incoming"), F.coalesce("outgoing", none).alias("outgoing"), lane.alias("lane"), entry.alias("_entry"))
    role = F.when(F.col("_entry"), "entrypoint").when(F.size("outgoing") == 0, "sink").otherwise("handler")
    return rows.withColumn("role", role).drop("_entry")


def touching(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edges with a wanted node at either end, once each: wanted(graph_id, id). A union of two joins, not an OR."""
    a = edges.join(wanted.select("graph_id", F.col("id").alias("src")), ["graph_id", "src"], "left_semi")
    b = edges.join(wanted.select("graph_id", F.col("id").alias("dst")), ["graph_id", "dst"], "left_semi")
    return a.unionByName(b).distinct()


def neighbours(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Nodes one step away in either direction, and the wanted ones: (graph_id, id, neighbour)."""
    w = wanted.select("graph_id", "id").distinct()
    e = edges.select("graph_id", F.col("src").alias("id"), F.col("dst").alias("neighbour"))
    both = e.unionByName(edges.select("graph_id", F.col("dst").alias("id"), F.col("src").alias("neighbour")))
    return both.join(w, ["graph_id", "id"]).unionByName(w.withColumn("neighbour", F.col("id"))).distinct()


def induced(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edges with both ends wanted."""
    w = wanted.select("graph_id", "id").distinct()
    return edges.join(w.withColumnRenamed("id", "src"), ["graph_id", "src"], "left_semi").join(w.withColumnRenamed("id", "dst"), ["graph_id", "dst"], "left_semi")


def dependencies(edges: DataFrame, cap: int = 10) -> DataFrame:
    """Sorted internal and external targets of each file, at most ``cap`` each (a report): (graph_id, src, internal, external)."""
    d = edges.select("graph_id", "src", "dst", "resolved").distinct()
    w = Window.partitionBy("graph_id", "src", "resolved").orderBy("dst")
    few = d.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap)
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("dst"))))
    return few.groupBy("graph_id", "src").agg(pick(F.col("resolved")).alias("internal"), pick(~F.col("resolved")).alias("external"))


def greedy_paths(edges: DataFrame, starts: DataFrame, guard: int = 1000, stride: int = 4) -> DataFrame:
    """From each start follow the first unvisited out-edge (least dst): (graph_id, start, step, id).

    All walks advance together, one join per step and one checkpoint for ``stride`` steps; the loop ends when none moves
    or when a walk has ``guard`` nodes, the bound of the inventory (G05).
    """
    first = edges.where("src <> dst").select("graph_id", F.col("src").alias("at"), "dst").distinct()
    walks = starts.select("graph_id", F.col("id").alias("start"), F.col("id").alias("at"), F.array("id").alias("path"), F.lit(True).alias("live")).distinct()
    done, rounds = None, 0
    while True:
        for _ in range(stride):
            may = F.col("live") & (F.size("path") < guard) & ~F.array_contains("path", F.col("dst"))
            step = walks.join(first, ["graph_id", "at"], "left").groupBy("graph_id", "start").agg(F.first("at").alias("_at"), F.first("path").alias("_path"), F.min(F.when(may, F.col("dst"))).alias("_to"))
            moved = F.col("_to").isNotNull()
            walks = step.select("graph_id", "start", F.coalesce("_to", "_at").alias("at"), F.when(moved, F.concat("_path", F.array("_to"))).otherwise(F.col("_path")).alias("path"), moved.alias("live"))
        walks = checkpointed(walks)
        rounds += 1
        ended = walks.where("not live").select("graph_id", "start", "path")
        done = ended if done is None else done.unionByName(ended)
        if rounds % 32 == 0:
            done = checkpointed(done)  # the plan stays small
        walks = walks.where("live")
        if walks.isEmpty():
            return done.select("graph_id", "start", F.posexplode("path").alias("step", "id"))


def longest_path(paths: DataFrame) -> DataFrame:
    """The longest walk of each graph, ties by the least start."""
    n = paths.groupBy("graph_id", "start").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("graph_id").agg(F.min_by("start", F.struct(-F.col("n"), "start")).alias("start"))
    return paths.join(best, ["graph_id", "start"])


def lane_islands(steps: DataFrame) -> DataFrame:
    """Runs of equal lanes along each path: steps(graph_id, start, step, id, lane) -> (graph_id, start, island, lane, ids)."""
    w = Window.partitionBy("graph_id", "start").orderBy("step")
    change = (~F.col("lane").eqNullSafe(F.lag("lane").over(w))).cast("int")
    runs = steps.withColumn("_c", change).withColumn("island", F.sum("_c").over(w))
    return runs.groupBy("graph_id", "start", "island", "lane").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "id"))), lambda x: x["id"]).alias("ids"))


def centrality(edges: DataFrame) -> DataFrame:
    """Degree centrality and the ranking score made of it: (graph_id, id, degree, score, rank).

    The other three measures of the score are fixed shares of the degree (0.5, 0.7, 0.6), so the score is 0.71 of it.
    """
    ends = edges.select("graph_id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))
    n = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("total"))
    d = ends.groupBy("graph_id", "id").agg(F.count(F.lit(1)).alias("n")).join(n, "graph_id")
    deg = F.round(ratio(F.col("n"), F.col("total")), 6)
    score = deg * 0.71
    return ranked(d.select("graph_id", "id", "n", deg.alias("degree"), score.alias("score")), "n").drop("n")


def ranked(rows: DataFrame, by: str) -> DataFrame:
    """Rank within each graph by a whole number, greatest first, ties by id; a graph is not sorted in one task.

    Rows are ranked within those of one value; how many come before a value is a sum over the graph's distinct values.
    """
    values = rows.groupBy("graph_id", by).agg(F.count(F.lit(1)).alias("_m"))
    before = F.sum("_m").over(Window.partitionBy("graph_id").orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1))
    values = values.select("graph_id", by, F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("graph_id", by).orderBy("id"))
    return rows.withColumn("_k", within).join(values, ["graph_id", by]).withColumn("rank", (F.col("_before") + F.col("_k")).cast("int")).drop("_before", "_k")


def prefix_routes(includes: DataFrame, routes: DataFrame, roots: DataFrame) -> DataFrame:
    """Routes under nested includes with their whole prefix: includes(file, prefix, target), routes(file, path), roots(file) -> (file, path).

    A target names a module or file; it means the file whose path ends with it. A file that includes itself, also
    through others, is entered once per way, so the loop ends by itself. Prefix and path have one slash between them.
    """
    names = routes.select("file").union(includes.select("file")).distinct()
    # every ending of a path at a slash is a name of the file
    parts = F.split(F.regexp_replace("file", r"\.py$", ""), "/")
    ends = names.select(F.col("file").alias("_at"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).alias("_name"))
    ends = ends.groupBy("_name").agg(F.min_by("_at", F.struct(F.length("_at"), "_at")).alias("target"))
    bare = F.regexp_replace("_t", r"\.py$", "")
    wanted = F.when(F.contains("_t", F.lit("/")), bare).otherwise(F.translate(bare, ".", "/"))
    links = includes.withColumnsRenamed({"target": "_t", "prefix": "_p"}).withColumn("_name", wanted).join(ends, "_name").select("file", "_p", "target")
    at = roots.select("file", F.lit("").alias("prefix"), F.array("file").alias("seen"))
    every = at
    while True:
        at = checkpointed(at.join(links, "file").where(~F.array_contains("seen", F.col("target"))).select(
            F.col("target").alias("file"), F.concat("prefix", "_p").alias("prefix"), F.concat("seen", F.array("target")).alias("seen")))
        if at.isEmpty():
            break
        every = every.unionByName(at)
    return every.join(routes, "file").select("file", F.when(F.col("prefix") == "", F.col("path")).otherwise(join_urls(F.col("prefix"), F.col("path"))).alias("path")).distinct()
