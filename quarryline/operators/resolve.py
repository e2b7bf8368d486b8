"""Import resolution: candidate generation, one equality join, and the first match by strategy and position.

No strategy loops over files: every import expands into at most eight places with a priority, every file into the names
that lead to it, both are joined within their snapshot, and the least priority wins. Repeated (raw, folder) pairs are resolved once.

Defined results: a null import resolves to nothing; ties within a priority go to the least path; '..' is resolved and
Python's leading dots count folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.paths import directory, normalized

#: What may follow a named module, in order.
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/__init__.py"]
#: Strategies in order with the confidence of their result.
STRATEGIES = [("relative", 0.95), ("alias", 0.9), ("rooted", 0.9), ("package", 0.8), ("directory", 0.7), ("bare", 0.65)]


def _places(named: list[tuple[str, Column]]) -> Column:
    """The places an import may mean as structs (prio, strategy, confidence, place); a null or empty base yields none."""
    rank, conf = {s: k for k, (s, _) in enumerate(STRATEGIES)}, dict(STRATEGIES)
    return F.array_compact(F.array(*[
        F.when(base != "", F.struct(F.lit(rank[name] * 100).alias("prio"), F.lit(name).alias("strategy"), F.lit(conf[name]).alias("confidence"), base.alias("place"))) for name, base in named]))


def named_files(files: DataFrame) -> DataFrame:
    """Each file under every name that leads to it: (snapshot_id, place, path, suffix), suffix being its rank in SUFFIXES.

    Names are expanded here, at most three for a file, so that imports need not try eleven suffixes each.
    """
    known = files.select("snapshot_id", normalized(F.col("path")).alias("path")).distinct()
    p = F.col("path")
    ways = [F.when(p.endswith(s), F.struct(F.substring(p, F.lit(1), F.length(p) - len(s)).alias("place"), F.lit(k).alias("suffix"))) for k, s in enumerate(SUFFIXES)]
    return known.select("snapshot_id", "path", F.explode(F.array_compact(F.array(*ways))).alias("w")).select("snapshot_id", "w.place", "path", "w.suffix")


def bases(raw: Column, from_path: Column, kind: Column, first_only: bool) -> list[tuple[str, Column]]:
    """The places that an import may mean. With first_only a relative or aliased import is looked for there alone."""
    folder = directory(from_path)
    dots = F.length(F.regexp_extract(raw, r"^(\.+)", 1))
    pythonic = (kind == "py") & raw.rlike(r"^\.+[A-Za-z_]?") & ~raw.contains("/")
    relative = F.when(raw.startswith("./") | raw.startswith("../"), F.concat(folder, F.lit("/"), raw))
    up = F.concat(folder, F.repeat(F.lit("/.."), dots - 1), F.lit("/"), F.translate(F.regexp_replace(raw, r"^\.+", ""), ".", "/"))
    relative = F.when(pythonic, up).otherwise(relative)
    alias = F.when(raw.startswith("@/") | raw.startswith("~/"), F.substring(raw, F.lit(3), F.length(raw)))
    src = F.when(raw.startswith("@/") | raw.startswith("~/"), F.concat(F.lit("src/"), F.substring(raw, F.lit(3), F.length(raw))))
    near = F.when(raw.startswith("@/") | raw.startswith("~/"), F.concat(F.substring_index(from_path, "/", 1), F.lit("/"), F.substring(raw, F.lit(3), F.length(raw))))
    other = ~raw.startswith(".") & ~raw.startswith("@/") & ~raw.startswith("~/") if first_only else ~raw.startswith(".")
    dotted = F.when(other & (kind == "py") & ~raw.contains("/"), F.translate(raw, ".", "/"))
    dotted_file = F.when(other & (kind == "py") & raw.rlike(r"\.(js|jsx|ts|tsx|mjs|py)$"), F.concat(F.translate(F.regexp_replace(raw, r"\.\w+$", ""), ".", "/"), F.regexp_extract(raw, r"(\.\w+)$", 1)))
    rooted = F.when(other & raw.contains("/"), F.ltrim(raw, F.lit("/")))
    beside = F.when(other & ~raw.contains("/"), F.concat(folder, F.lit("/"), F.translate(raw, ".", "/")))
    return [("relative", relative), ("alias", alias), ("alias", src), ("alias", near), ("rooted", rooted), ("package", dotted_file), ("package", dotted), ("directory", beside)]


def resolve(imports: DataFrame, files: DataFrame, first_only: bool = False) -> DataFrame:
    """(import_id, resolved, strategy, confidence, external, hypothesis, reason) for each import.

    ``first_only`` stops at the first strategy that applies; otherwise the next one is tried where it finds nothing.
    """
    one = imports.select("import_id", "snapshot_id", "from_path", "raw", "kind").dropDuplicates(["import_id"])
    asked = one.where("raw is not null and from_path is not null")
    # an import is looked up by its folder, so equal imports of one folder are resolved once
    keys = ["snapshot_id", "_folder", "raw", "kind"]
    asked = asked.withColumn("_folder", directory(F.col("from_path")))
    distinct = asked.select(*keys).distinct()
    from_path = F.concat(F.col("_folder"), F.lit("/_"))
    cand = distinct.select(*keys, F.explode(_places(bases(F.col("raw"), from_path, F.col("kind"), first_only))).alias("c")).select(*keys, "c.prio", "c.strategy", "c.confidence", normalized(F.col("c.place")).alias("place"))
    hit = cand.join(named_files(files), ["snapshot_id", "place"]).groupBy(*keys).agg(
        F.min_by(F.struct("path", "strategy", "confidence"), F.struct((F.col("prio") + F.col("suffix")).alias("prio"), F.col("path"))).alias("_b"))
    back = asked.join(hit, keys, "left").select("import_id", "_b.path", "_b.strategy", "_b.confidence")
    all_ = one.select("import_id").join(back, "import_id", "left")
    found = F.col("path").isNotNull()
    return all_.select(
        "import_id", F.col("path").alias("resolved"), "strategy", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), (~found).alias("external"), (~found).alias("hypothesis"),
        F.when(~found, "alias-miss").alias("reason"))


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """The configuration in the nearest folder above each file: (snapshot_id, path, config). Prefix join as equality join on ancestors."""
    parts = F.filter(F.split(directory(F.col("path")), "/"), lambda s: s != "")
    up = files.where("path is not null").select("snapshot_id", "path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder")))).alias("a"))
    at = configs.select("snapshot_id", directory(F.col("path")).alias("folder"), F.col("path").alias("config"))
    hit = up.select("snapshot_id", "path", "a.*").join(at, ["snapshot_id", "folder"])
    return hit.groupBy("snapshot_id", "path").agg(F.max_by("config", F.struct("depth", "config")).alias("config"))


def directory_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The longest path in the folder that a relative import names: (import_id, path)."""
    asked = imports.where("raw like './%' or raw like '../%'").select("import_id", "snapshot_id", normalized(F.concat(directory(F.col("from_path")), F.lit("/"), F.col("raw"))).alias("folder")).dropDuplicates(["import_id"])
    held = files.select("snapshot_id", directory(F.col("path")).alias("folder"), "path")
    longest = held.groupBy("snapshot_id", "folder").agg(F.max_by("path", F.struct(F.length("path"), "path")).alias("path"))
    return asked.join(longest, ["snapshot_id", "folder"]).select("import_id", "path")


def suffix_hypotheses(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Files anywhere that are called like the last part of an unresolved import: (import_id, path, confidence 0.3), the least path."""
    stem = lambda p: F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.\w+$", "")
    asked = imports.where("resolved is null and raw not like '%{%'").select("import_id", "snapshot_id", stem(F.col("raw")).alias("stem")).dropDuplicates(["import_id"]).where("stem <> ''")
    held = files.select("snapshot_id", stem(F.col("path")).alias("stem"), "path").groupBy("snapshot_id", "stem").agg(F.min("path").alias("path"))
    return asked.join(held, ["snapshot_id", "stem"]).select("import_id", "path", F.lit(0.3).alias("confidence"))


def module_index(files: DataFrame) -> DataFrame:
    """Both ways between Python modules and their files: (snapshot_id, module, path)."""
    module = F.translate(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"/__init__$", ""), "/", ".")
    return files.where("path like '%.py'").select("snapshot_id", module.alias("module"), "path").distinct()


# ---------------------------------------------------------------- resolvers by language

# What may follow a name in each strategy, in order, and how sure each strategy is.
TS_ENDS = [".ts", ".tsx", ".js", ".jsx", ".json", ""]
TS_TRIE_ENDS, INDEX_ENDS = [".ts", ".tsx", ".js", ".jsx"], ["/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
PY_ENDS = [".py", "/__init__.py"]
SURE = {"relative": 0.95, "trie": 0.7, "trie-index": 0.65, "tsconfig": 0.9, "node_modules": 0.8, "absolute": 0.9, "package": 0.8}
#: A result counts only above this; the search anywhere in the repository (0.3) stays a hypothesis.
ACCEPTED = 0.5
_KEYS = ["snapshot_id", "_folder", "raw"]


def _tried(rows: DataFrame, base: Column, ends: list[str], strategy: str, prio: int, ord_: Column | None = None) -> DataFrame:
    """Candidates of one strategy: (*_KEYS, prio, strategy, place), one for each ending."""
    first = F.lit(prio) + (F.coalesce(ord_, F.lit(0)) * 10 if ord_ is not None else F.lit(0))
    each = rows.where(base.isNotNull() & (base != "")).select(*_KEYS, first.alias("_p"), base.alias("_b"))
    each = each.select(*_KEYS, "_p", "_b", F.posexplode(F.array(*map(F.lit, ends))).alias("_k", "_end"))
    return each.select(*_KEYS, (F.col("_p") + F.col("_k")).alias("prio"), F.lit(strategy).alias("strategy"), normalized(F.concat("_b", "_end")).alias("place"))


def _ancestors(folder: Column) -> Column:
    """The folder and all above it as structs (depth, folder), '' being the root."""
    parts = F.filter(F.split(folder, "/"), lambda s: s != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder")))


def typescript_candidates(asked: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """Candidates of scripts: relative, by path from the root, by the aliases of the nearest tsconfig, in node_modules on the way up.

    asked(*_KEYS), files(snapshot_id, path, text), aliases as from manifest.path_aliases(). Aliases and the files of
    node_modules are joined by folder, so no import meets all of them.
    """
    raw, folder = F.col("raw"), F.col("_folder")
    bare = asked.where("raw not like '.%'")
    out = _tried(asked.where("raw like '.%'"), F.concat(folder, F.lit("/"), raw), TS_ENDS, "relative", 0)
    out = out.unionByName(_tried(bare, F.ltrim(raw, F.lit("/")), ["", *TS_TRIE_ENDS], "trie", 1000)).unionByName(_tried(bare, F.ltrim(raw, F.lit("/")), INDEX_ENDS[:1], "trie-index", 1500))
    up = asked.select(*_KEYS, F.explode(_ancestors(folder)).alias("a")).select(*_KEYS, "a.depth", F.col("a.folder").alias("_at"))
    at = aliases.select("snapshot_id", F.col("folder").alias("_at"), "config").distinct()
    nearest = up.join(at, ["snapshot_id", "_at"]).groupBy(*_KEYS).agg(F.max_by(F.struct("config", "_at"), F.struct("depth", "config")).alias("_c")).select(*_KEYS, "_c.config", "_c._at")
    told = nearest.join(aliases.select("snapshot_id", "config", "base_url", "pattern", "target", "ord"), ["snapshot_id", "config"])
    begin = F.rtrim("pattern", F.lit("*"))
    told = told.where(F.when(F.col("pattern").endswith("*"), F.startswith("raw", begin)).otherwise(raw == F.col("pattern")))
    place = F.replace("target", F.lit("*"), F.expr("substring(raw, length(rtrim('*', pattern)) + 1)"))
    out = out.unionByName(_tried(told, F.concat_ws("/", F.nullif("_at", F.lit("")), "base_url", place), TS_ENDS, "tsconfig", 2000, F.col("ord")))
    # node_modules: the packages that are there, by folder and name
    inside = files.where(F.col("path").rlike(r"(^|/)node_modules/")).select(
        "snapshot_id", F.regexp_extract("path", r"^(.*?)/?node_modules/", 1).alias("_at"), F.regexp_extract("path", r"node_modules/((?:@[^/]+/)?[^/]+)/", 1).alias("raw"), "path", "text")
    package = F.concat(F.when(F.col("_at") == "", F.lit("")).otherwise(F.concat("_at", F.lit("/"))), F.lit("node_modules/"), "raw")
    held = inside.where("raw <> ''").groupBy("snapshot_id", "_at", "raw").agg(F.max(F.when(F.col("path") == F.concat(package, F.lit("/package.json")), F.coalesce(F.get_json_object("text", "$.main"), F.lit("index.js")))).alias("_main"))
    at_hand = up.where("raw not like '.%'").join(held, ["snapshot_id", "_at", "raw"]).withColumn("_package", package)
    far = 100 - F.least(F.col("depth"), F.lit(90))
    out = out.unionByName(_tried(at_hand, F.concat("_package", F.lit("/"), "_main"), [""], "node_modules", 3000, far))
    return out.unionByName(_tried(at_hand, F.col("_package"), INDEX_ENDS, "node_modules", 3001, far))


def python_candidates(asked: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """Candidates of Python: relative by leading dots, by dotted path, from the root as written, known packages.

    packages(snapshot_id, path, name) as from manifest.packages(); a package's folder is any that ends with its name.
    """
    raw, folder = F.col("raw"), F.col("_folder")
    dots = F.length(F.regexp_extract(raw, r"^(\.+)", 1))
    rest = F.translate(F.regexp_replace(raw, r"^\.+", ""), ".", "/")
    up = F.concat(folder, F.repeat(F.lit("/.."), dots - 1), F.lit("/"), rest)
    out = _tried(asked.where("raw like '.%'"), up, PY_ENDS, "relative", 0)
    bare = asked.where("raw not like '.%'")
    out = out.unionByName(_tried(bare, F.translate(raw, ".", "/"), PY_ENDS, "trie", 1000)).unionByName(_tried(bare, raw, ["", ".py"], "absolute", 2000))
    homes = files.where("path like '%/__init__.py'").select("snapshot_id", F.regexp_replace("path", r"/__init__\.py$", "").alias("_home"))
    named = homes.select("snapshot_id", "_home", F.element_at(F.split("_home", "/"), -1).alias("raw")).join(packages.select("snapshot_id", F.col("name").alias("raw")).distinct(), ["snapshot_id", "raw"], "left_semi")
    known = bare.join(named, ["snapshot_id", "raw"])
    return out.unionByName(_tried(known, F.col("_home"), ["/__init__.py"], "package", 3000))


def resolve_by_language(imports: DataFrame, files: DataFrame, aliases: DataFrame, packages: DataFrame) -> DataFrame:
    """(import_id, resolved, strategy, confidence, external, hypothesis, reason) by the resolver of the importing file's language.

    Strategies go in order, the first whose candidate is a file of the snapshot holds. Equal names in one folder are resolved once.
    """
    one = imports.select("import_id", "snapshot_id", "from_path", "raw").dropDuplicates(["import_id"])
    asked = one.where("raw is not null and from_path is not null").withColumns({"_folder": directory(F.col("from_path")), "_py": F.col("from_path").endswith(".py")})
    keys = asked.select(*_KEYS, "_py").distinct()
    known = files.select("snapshot_id", normalized(F.col("path")).alias("place")).distinct()
    sure = F.create_map(*[F.lit(x) for kv in SURE.items() for x in kv])
    parts = [c.withColumn("_py", F.lit(py)) for py, c in ((False, typescript_candidates(keys.where("not _py").drop("_py"), files, aliases)), (True, python_candidates(keys.where("_py").drop("_py"), files, packages)))]
    hit = parts[0].unionByName(parts[1]).where(sure[F.col("strategy")] > ACCEPTED).join(known, ["snapshot_id", "place"]).groupBy(*_KEYS, "_py").agg(F.min_by(F.struct("place", "strategy"), F.struct("prio", "place")).alias("_h"))
    back = asked.join(hit, [*_KEYS, "_py"], "left").select("import_id", F.col("_h.place").alias("resolved"), F.col("_h.strategy").alias("strategy"))
    found = F.col("resolved").isNotNull()
    return one.select("import_id").join(back, "import_id", "left").select(
        "import_id", "resolved", "strategy", F.coalesce(sure[F.col("strategy")], F.lit(0.0)).alias("confidence"), (~found).alias("external"), (~found).alias("hypothesis"), F.when(~found, "alias-miss").alias("reason"))


def resolve_any(refs: DataFrame, index: DataFrame) -> DataFrame:
    """Files of references that are a module or a path, with a line or without: refs(snapshot_id, ref) -> (snapshot_id, ref, path), index as from module_index()."""
    bare = F.split("ref", ":")[0]
    r = refs.select("snapshot_id", "ref", bare.alias("module")).distinct()
    by_module = r.join(index.select("snapshot_id", "module", F.col("path").alias("_m")), ["snapshot_id", "module"], "left")
    both = by_module.join(index.select("snapshot_id", F.col("path").alias("module"), F.lit(True).alias("_p")), ["snapshot_id", "module"], "left")
    return both.select("snapshot_id", "ref", F.coalesce("_m", F.when(F.col("_p"), F.col("module"))).alias("path")).distinct()
