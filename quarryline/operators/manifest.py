"""What manifests tell of a repository: frameworks, workspace, path aliases, packages and dependencies.

A manifest is a row of source files; which manifest it is follows from its path. Defined results: manifests that are no
JSON tell nothing; a snapshot without any manifest has no framework and the workspace 'single'; nulls count as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.paths import directory
from quarryline.operators.files import file_name
from quarryline.sources.tables import latest_files

# Frameworks by their packages in package.json, and by words of Python's requirement files.
NODE = [("nextjs", "next"), ("express", "express"), ("koa", "koa"), ("nestjs", "@nestjs/core"), ("react", "react"), ("vue", "vue"), ("angular", "@angular/core")]
PYTHON = ["fastapi", "flask", "django"]
# Fixed values: (framework, package, confidence) told by dependencies, and (framework, file, confidence) by words.
NODE_RULES = [("nextjs", "next", 0.9), ("react", "react", 0.8), ("express", "express", 0.8), ("koa", "koa", 0.8)]
PYTHON_RULES = [("fastapi", "requirements.txt", 0.9), ("flask", "requirements.txt", 0.9), ("django", "requirements.txt", 0.9), ("fastapi", "pyproject.toml", 0.9)]
_MAP = "map<string,string>"


def _dependencies(text: Column, *keys: str) -> Column:
    """Names and versions of the dependencies of a package.json, later keys over earlier ones."""
    empty = F.expr(f"cast(map() as {_MAP})")
    maps = [F.coalesce(F.from_json(F.get_json_object(text, f"$.{k}"), _MAP), empty) for k in keys]
    return F.map_from_entries(F.array_distinct(F.concat(*[F.map_entries(m) for m in maps]))) if len(maps) == 1 else F.array_distinct(F.concat(*[F.map_keys(m) for m in maps]))


def project_context(files: DataFrame) -> DataFrame:
    """One row of booleans per snapshot: has_nextjs, has_express, has_koa, has_nestjs, has_fastapi, has_flask, has_django, has_react, has_vue, has_angular.

    Told by the packages of the root's package.json, by words of the root's requirement files and by known files and folders.
    """
    path, low = F.col("path"), F.lower("text")
    deps = F.when(path == "package.json", _dependencies(F.col("text"), "dependencies", "devDependencies", "peerDependencies"))
    required = path.isin("requirements.txt", "requirements-dev.txt", "pyproject.toml")
    told = {name: F.array_contains(deps, package) for name, package in NODE} | {name: required & F.contains(low, F.lit(name)) for name in PYTHON}
    # Files and folders that speak for a framework.
    told["nextjs"] = told["nextjs"] | path.startswith("src/app/") | path.startswith("pages/")
    told["fastapi"] = told["fastapi"] | (path == "app/main.py")
    told["django"] = told["django"] | (path == "manage.py")
    told["flask"] = told["flask"] | path.isin("app.py", "flask_app.py")
    # told row by row, so no text is shuffled
    rows = files.select("snapshot_id", *[F.coalesce(c, F.lit(False)).alias(f"has_{n}") for n, c in told.items()])
    return rows.groupBy("snapshot_id").agg(*[F.max(f"has_{n}").alias(f"has_{n}") for n in told])


def frameworks(files: DataFrame) -> DataFrame:
    """Frameworks with their evidence: (snapshot_id, name, confidence, file, version)."""
    none = F.lit(None).cast("string")
    deps = F.from_json(F.get_json_object("text", "$.dependencies"), _MAP)
    hits = [F.when((F.col("path") == "package.json") & F.map_contains_key(deps, package), F.struct(F.lit(name).alias("name"), F.lit(sure).alias("confidence"), F.lit("package.json").alias("file"), deps[package].alias("version"))) for name, package, sure in NODE_RULES]
    hits += [F.when((F.col("path") == file) & F.contains(F.lower("text"), F.lit(name)), F.struct(F.lit(name).alias("name"), F.lit(sure).alias("confidence"), F.lit(file).alias("file"), none.alias("version"))) for name, file, sure in PYTHON_RULES]
    some = files.where(F.col("path").isin("package.json", "requirements.txt", "pyproject.toml"))
    return some.select("snapshot_id", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("snapshot_id", "h.*").distinct()


def workspace(files: DataFrame) -> DataFrame:
    """The first kind of workspace that a root file speaks for: (snapshot_id, workspace)."""
    path, text = F.col("path"), F.coalesce("text", F.lit(""))
    # The order of the checks.
    checks = [
        ("pnpm", path == "pnpm-workspace.yaml"), ("yarn", (path == "package.json") & F.get_json_object("text", "$.workspaces").isNotNull()), ("turbo", path == "turbo.json"),
        ("nx", path == "nx.json"), ("poetry", (path == "pyproject.toml") & F.contains(text, F.lit("[tool.poetry]"))), ("pants", path == "pants.toml")]
    rank = F.lit(len(checks))
    for k in reversed(range(len(checks))):
        rank = F.when(checks[k][1], k).otherwise(rank)
    names = F.array(*[F.lit(n) for n, _ in checks], F.lit("single"))
    return files.select("snapshot_id", rank.alias("_k")).groupBy("snapshot_id").agg(F.min("_k").alias("_k")).select("snapshot_id", F.element_at(names, F.col("_k") + 1).alias("workspace"))


def path_aliases(files: DataFrame) -> DataFrame:
    """Aliases of every tsconfig: (snapshot_id, config, folder, base_url, pattern, target, ord), targets in order."""
    configs = files.where(file_name(F.col("path")).rlike(r"^tsconfig[^/]*\.json$") & F.col("text").isNotNull())
    paths = F.from_json(F.get_json_object("text", "$.compilerOptions.paths"), "map<string,array<string>>")
    base = F.coalesce(F.get_json_object("text", "$.compilerOptions.baseUrl"), F.lit("."))
    each = configs.select("snapshot_id", F.col("path").alias("config"), directory(F.col("path")).alias("folder"), base.alias("base_url"), F.explode(paths).alias("pattern", "_targets"))
    return each.select("snapshot_id", "config", "folder", "base_url", "pattern", F.posexplode("_targets").alias("ord", "target")).distinct()


def packages(files: DataFrame) -> DataFrame:
    """Names of Python packages, the first 'name =' line of each pyproject.toml: (snapshot_id, path, name)."""
    rows = files.where((file_name(F.col("path")) == "pyproject.toml") & F.col("text").rlike(r"(?m)^\s*name ="))
    value = F.regexp_extract("text", r"(?m)^\s*name =([^\n=]*)", 1)
    return rows.select("snapshot_id", "path", F.trim(F.trim(value), F.lit("\"'")).alias("name")).distinct()


def required_names(text: Column) -> Column:
    """Names at the head of requirement lines, cut at the first sign of a version. Remarks and blank lines are none."""
    lines = F.transform(F.split(F.regexp_replace(text, "\r", ""), "\n"), lambda x: F.trim(x))
    names = F.transform(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")), lambda x: F.regexp_extract(x, r"^(.*?)(?:==|>=|<=|>|<|~=|$)", 1))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def dependency_names(files: DataFrame) -> DataFrame:
    """What the requirement files ask for: (file_id, name). Names are told in the scan, texts are not shuffled."""
    return latest_files(files.where("text is not null"), required_names(F.col("text")).alias("names")).select("file_id", F.explode("names").alias("name"))


def preflight(files: DataFrame, content: DataFrame) -> DataFrame:
    """One row per snapshot, composed of the above: (snapshot_id, workspace, frameworks, aliases, packages, content_hash); content as from repo_hash()."""
    names = frameworks(files).groupBy("snapshot_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("frameworks"))  # ten names at most
    aliases = path_aliases(files).groupBy("snapshot_id").agg(F.countDistinct("config", "pattern").alias("aliases"))
    held = packages(files).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("packages"))
    out = workspace(files).join(names, "snapshot_id", "left").join(aliases, "snapshot_id", "left").join(held, "snapshot_id", "left").join(content, "snapshot_id", "left")
    return out.select("snapshot_id", "workspace", F.coalesce("frameworks", F.lit("")).alias("frameworks"), F.coalesce("aliases", F.lit(0)).alias("aliases"), F.coalesce("packages", F.lit(0)).alias("packages"), "content_hash")



