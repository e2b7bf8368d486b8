"""Scans and projections over source files, and the plan of an incremental parse.

Defined results: a null path is in no folder and has the language 'other'; a null text counts as empty where a count is
asked and stays null where a text is asked; empty tables give empty tables; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions.paths import directory, extension, language
from quarryline.functions.text import line_count

# Folders, extensions, hidden names, endings and parts of names that a scan leaves out or keeps.
IGNORED_DIRS = [
    "node_modules", ".git", ".svn", ".hg", ".bzr", "__pycache__", ".pytest_cache", ".tox", ".venv", "venv", "env", "coverage", ".coverage", "htmlcov", ".nyc_output",
    "dist", "build", ".next", ".nuxt", "out", "logs", "log", "tmp", "temp", ".tmp", ".temp", "migrations", "migration", "alembic", "versions",
    "test", "tests", "__tests__", "spec", "specs", ".cache", "cache", ".parcel-cache", ".turbo", "docs", "documentation", "examples", "samples", "vendor", "third_party", "external",
]
IGNORED_EXTS = [
    ".log", ".tmp", ".temp", ".cache", ".lock", ".pid", ".map", ".min.js", ".min.css", ".bundle.js", ".pyc", ".pyo", ".pyd", ".so", ".dll", ".dylib",
    ".exe", ".bin", ".app", ".deb", ".rpm", ".msi", ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar", ".dmg", ".iso", ".img",
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".svg", ".ico", ".webp", ".avif", ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".db", ".sqlite", ".sqlite3", ".mdb", ".accdb",
]
KEPT_HIDDEN = [".env", ".gitignore", ".eslintrc", ".prettierrc"]
BACKUPS = ["~", ".bak", ".backup", ".orig"]
BUILT = ["generated", "auto-generated", "build-"]
# Source extensions, binary extensions, environment files, limits of a big file.
SOURCE_EXTS = [".py", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs"]
BINARY_EXTS = [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".pdf", ".mp4", ".mp3", ".mov", ".zip", ".tar", ".gz"]
ENV_FILES = [".env", ".env.local", ".env.development", ".env.production", ".env.test"]
BIG_BYTES, BIG_LINES, MAX_FILE_BYTES = 1_000_000, 5_000, 10 << 20
# Parts of a path in lower case that put it on a lane, in order.
LANES = [("api", ["/api/", "/routes/", "/routers/", "route.ts", "route.js"]), ("web", ["/pages/", "/app/", "/components/", "/src/", ".tsx", ".jsx"]), ("workers", ["/workers/", "/tasks/", "/jobs/", "/cron/"])]
# Lanes of capabilities; the specific ones first, and '/' no pattern, as every path has one.
CAPABILITY_LANES = [("api", ["/api/", "/graphql/", "/rpc/"]), ("worker", ["/workers/", "/jobs/", "/tasks/"]), ("scheduler", ["/scheduler/", "/cron/", "/periodic/"]), ("cli", ["/cli/", "/scripts/", "/bin/"]), ("web", ["/app/", "/pages/"])]
# What folders are for.
PURPOSES = [
    (["app", "src/app"], "UI routes (Next.js)"), (["pages"], "Next.js legacy pages + API routes"), (["api"], "API routes"), (["lib"], "Libraries / utilities"), (["components"], "UI components"),
    (["workers"], "Background workers"), (["services"], "Business logic / services"), (["routes"], "Server routes"), (["templates"], "Rendering templates"), (["content"], "Static content"),
    (["styles", "css"], "Styling"), (["prisma"], "Database schema"),
]
# Parts of file names of entrypoints, of paths of core and of configuration files, and of entrypoints when a node index is built.
ENTRY_NAMES = ["main", "index", "app", "server", "start", "cli", "command", "script", "worker", "job"]
CORE = ["main.py", "app.py", "server.py", "index.js", "app.js"]
CONFIG = ["config", "settings", "env", "package.json", "requirements.txt", "pyproject.toml"]
MAIN_FILES, ROUTER_FOLDERS = ["main.py", "app.py", "index.js", "server.js"], ["routers/", "routes/", "api/", "pages/api/", "app/api/"]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def holds(value: Column, parts: list[str]) -> Column:
    """Whether a value contains one of the parts."""
    return any_of([F.contains(value, F.lit(p)) for p in parts])


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file's name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def scan_folder(spark: SparkSession, folder: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files below a folder: (path, ext, language, size, lines, text, hash, mtime, skipped, skip_reason).

    Larger files are listed as skipped and not decoded; ignored files are left out before their content is read. Bytes
    that are no UTF-8 are dropped; a file with none that is goes by Latin-1.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/") + "/"
    path = F.substring_index(F.col("path"), root, -1)
    rows = raw.select(path.alias("path"), F.col("length").alias("size"), "modificationTime", "content").where(~ignored(F.col("path")))
    text = F.when(F.col("size") <= max_bytes, decoded(F.col("content")))
    return rows.select(
        "path", extension(F.col("path")).alias("ext"), language(F.col("path")).alias("language"), "size", line_count(text).alias("lines"), text.alias("text"),
        F.when(F.col("size") <= max_bytes, F.sha2("content", 256)).alias("hash"), F.unix_micros("modificationTime").cast("double").alias("mtime"),
        (F.col("size") > max_bytes).alias("skipped"), F.when(F.col("size") > max_bytes, "oversize").alias("skip_reason"))


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 without what is none, else Latin-1."""
    lenient = F.translate(F.make_valid_utf8(content.cast("string")), "�", "")
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).when(lenient != "", lenient).otherwise(F.decode(content, "ISO-8859-1"))


def ignored(path: Column) -> Column:
    """Whether a scan leaves the path out."""
    parts, name = F.split(path, "/"), file_name(path)
    return F.coalesce(
        F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED_DIRS))) | extension(path).isin(*IGNORED_EXTS) | (name.startswith(".") & ~name.isin(*KEPT_HIDDEN))
        | any_of([name.endswith(b) for b in BACKUPS]) | holds(name, BUILT), F.lit(False))


def discovered(files: DataFrame, max_bytes: int = 20_000) -> DataFrame:
    """Measures of each delivered file taken from its text: (file_id, arrived_at, path, ext, language, size, lines, hash, skipped)."""
    size = F.octet_length("text")
    return files.select(
        "file_id", "arrived_at", "path", extension(F.col("path")).alias("ext"), language(F.col("path")).alias("language"), size.cast("long").alias("size"),
        line_count(F.col("text")).cast("long").alias("lines"), F.sha2("text", 256).alias("hash"), F.coalesce(size > max_bytes, F.lit(True)).alias("skipped"))


def source_only(files: DataFrame) -> DataFrame:
    """Hand-kept source: source extensions, no hidden, virtual environment, build, run or test folders."""
    parts = F.split(F.col("path"), "/")
    # Beginnings and whole names of segments that are left out.
    begins = F.exists(parts, lambda s: s.rlike(r"^(\.|__pycache__|venv|env)"))
    built = F.arrays_overlap(parts, F.array(*map(F.lit, ["node_modules", "dist", "build", ".next", ".nuxt", "out", "test", "tests", "__tests__", "spec", "specs"])))
    return files.where(extension(F.col("path")).isin(*SOURCE_EXTS) & ~begins & ~built & ~F.contains("path", F.lit("runs/")))


def normalized_rows(files: DataFrame) -> DataFrame:
    """Every row complete and valid: invalid ones become minimal skipped rows with a reason."""
    valid = F.col("path").isNotNull() & (F.col("path") != "") & language(F.col("path")).isin("js", "ts", "py")
    keep = lambda c, default: F.when(valid, F.coalesce(F.col(c), F.lit(default)))
    return files.select(
        "file_id", "path", F.when(valid, language(F.col("path"))).otherwise("other").alias("language"),
        F.coalesce(keep("size", 0), F.lit(0)).cast("long").alias("size"), F.coalesce(keep("lines", 0), F.lit(0)).cast("long").alias("lines"),
        (~valid | F.coalesce("skipped", F.lit(False))).alias("skipped"), F.when(~valid, "validation_failed").otherwise(F.col("skip_reason")).alias("skip_reason"))


def blurb(p: DataFrame) -> DataFrame:
    """One sentence per file from what is known of it: (snapshot_id, path, blurb).

    Rows are (snapshot_id, path, framework, is_route, is_component, is_api, functions, classes, db_models, internal,
    external, internal_names), counts being 0 where there are none and names in order.
    """
    kind = F.when(F.col("is_route"), "route").when(F.col("is_component"), "React component").when(F.col("is_api"), "API endpoint").otherwise("file")
    n = lambda c: F.col(c).cast("string")
    some = lambda c: F.col(c) > 0
    symbols = (
        F.when(some("functions") & some("classes"), F.concat(F.lit("with "), n("functions"), F.lit(" function(s) and "), n("classes"), F.lit(" class(es)")))
        .when(some("functions"), F.concat(F.lit("with "), n("functions"), F.lit(" function(s)"))).when(some("classes"), F.concat(F.lit("with "), n("classes"), F.lit(" class(es)"))))
    models = F.when(some("db_models"), F.concat(F.lit("defines "), n("db_models"), F.lit(" Django model(s)")))
    imports = (
        F.when(some("internal") & some("external"), F.concat(F.lit("imports "), n("internal"), F.lit(" internal and "), n("external"), F.lit(" external modules")))
        .when(some("internal"), F.concat(F.lit("imports "), n("internal"), F.lit(" internal module(s)"))).when(some("external"), F.concat(F.lit("imports "), n("external"), F.lit(" external module(s)"))))
    shown = F.col("is_component") & some("internal")
    names = F.when(shown, F.concat(F.lit("imports: "), F.array_join(F.slice("internal_names", 1, 3), ", ")))
    more = F.when(shown & (F.col("internal") > 3), F.concat(F.lit("and "), (F.col("internal") - 3).cast("string"), F.lit(" more")))
    text = F.concat(F.concat_ws(". ", F.concat_ws(" ", "framework", kind), symbols, models, imports, names, more), F.lit("."))
    return p.select("snapshot_id", "path", text.alias("blurb"))


def short_blurb(path: Column, is_route: Column, is_api: Column, is_component: Column) -> Column:
    """The first of a few sentences that applies."""
    name = file_name(path)
    say = lambda words: F.concat(F.lit(words), name)
    test = name.endswith(".test.") | name.endswith(".spec.")
    return (F.when(is_route, say("Route handler for ")).when(is_api, say("API endpoint in ")).when(is_component, say("React component ")).when(test, say("Test file for "))
            .otherwise(F.concat(language(path), F.lit(" file "), name)))


def first_lane(path: Column, lanes: list[tuple[str, list[str]]], default: str) -> Column:
    out = F.lit(default)
    for name, parts in reversed(lanes):
        out = F.when(holds(path, parts), name).otherwise(out)
    return out


def lane(path: Column) -> Column:
    """api, web, workers or other, by parts of the path; folders need a slash before them."""
    return first_lane(F.lower(path), LANES, "other")


def capability_lane(path: Column) -> Column:
    """The lane of an entrypoint, then by the words of a job or a command, else web."""
    low = F.lower(path)
    words = F.when(holds(low, ["job", "task"]), "worker").when(holds(low, ["cli", "script"]), "cli").otherwise("web")
    by_path = first_lane(path, CAPABILITY_LANES, "")
    return F.when(by_path != "", by_path).otherwise(words)


def folder_purpose(name: Column) -> Column:
    """What a folder is for by its name, '' where nothing is known."""
    low, out = F.lower(name), F.lit("")
    for names, label in reversed(PURPOSES):
        hit = low.isin(*names) | F.contains(low, F.lit("worker")) if names == ["workers"] else low.isin(*names)
        out = F.when(hit, label).otherwise(out)
    return out


def entry_name(path: Column) -> Column:
    """Whether the file's name is that of an entrypoint."""
    return holds(F.lower(file_name(path)), ENTRY_NAMES)


def entrypoint(path: Column, routes: Column, jobs: Column, functions: Column) -> Column:
    """Whether something begins in a file: by its name, its number of routes or jobs, or a function called main (array)."""
    return entry_name(path) | F.coalesce(routes > 0, F.lit(False)) | F.coalesce(jobs > 0, F.lit(False)) | F.coalesce(F.array_contains(functions, "main"), F.lit(False))


def build_role(path: Column) -> tuple[Column, Column]:
    """(role, lane) of a node when an index is built: main files and what lies in a router's folder are entrypoints."""
    main, router = holds(path, MAIN_FILES), holds(path, ROUTER_FOLDERS)
    return F.when(main | router, "entrypoint").otherwise("service"), F.when(~main & router, "api").otherwise(lane(path))


def core_file(path: Column) -> Column:
    return holds(F.lower(path), CORE)


def config_file(path: Column) -> Column:
    return holds(F.lower(path), CONFIG)


def big(size: Column, lines: Column, max_bytes: int = BIG_BYTES, max_lines: int = BIG_LINES) -> Column:
    return F.coalesce((size > max_bytes) | (lines > max_lines), F.lit(False))


def stale(now: DataFrame, before: DataFrame, tolerance: float = 3600.0) -> DataFrame:
    """Plan of an incremental parse: (path, action) with action new, reparse, reuse or deleted.

    Files are matched by (repo_id, path); the hash decides, then the difference of the times of change.
    """
    a = now.select("repo_id", "path", "hash", "mtime")
    b = before.select("repo_id", "path", F.col("hash").alias("_h"), F.col("mtime").alias("_t"), F.lit(True).alias("_seen"))
    action = (
        F.when(F.col("_seen").isNull(), "new")
        .when(~F.col("hash").eqNullSafe(F.col("_h")) | (F.abs(F.col("mtime") - F.col("_t")) > tolerance), "reparse").otherwise("reuse"))
    kept = a.join(b, ["repo_id", "path"], "left").select("repo_id", "path", action.alias("action"))
    gone = before.select("repo_id", "path").join(now, ["repo_id", "path"], "left_anti").select("repo_id", "path", F.lit("deleted").alias("action"))
    return kept.unionByName(gone)


def tree(files: DataFrame) -> DataFrame:
    """Folders and files as an adjacency list: (snapshot_id, id, parent_id, name, is_leaf, purpose). The root is ''."""
    parts = F.filter(F.split(F.col("path"), "/"), lambda s: s != "")
    rows = files.where("path is not null").select("snapshot_id", parts.alias("_p"))
    each = rows.select("snapshot_id", "_p", F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("_n")).where("_n <= size(_p)")
    nodes = each.select(
        "snapshot_id", F.array_join(F.slice("_p", F.lit(1), F.col("_n")), "/").alias("id"), F.array_join(F.slice("_p", F.lit(1), F.col("_n") - 1), "/").alias("parent_id"),
        F.element_at("_p", F.col("_n")).alias("name"), (F.col("_n") == F.size("_p")).alias("is_leaf"))
    one = nodes.groupBy("snapshot_id", "id", "parent_id", "name").agg(F.min("is_leaf").alias("is_leaf"))
    return one.withColumn("purpose", F.when(~F.col("is_leaf"), folder_purpose(F.col("name"))))


#: Files whose digests are joined into one at each level of repo_hash.
DIGEST_BLOCK = 4096


def repo_hash(files: DataFrame) -> DataFrame:
    """A digest of each snapshot's content in the order of its paths: (snapshot_id, content_hash).

    It is a tree of digests: of files, of blocks of DIGEST_BLOCK files in the order of their paths, and of the blocks; a
    block is chosen by rank within the first folder, so neither texts nor all files of a snapshot meet in one task.
    """
    each = files.where("text is not null").select("snapshot_id", F.split("path", "/")[0].alias("_top"), "path", F.sha2("text", 256).alias("_h")).dropDuplicates(["snapshot_id", "path"])
    rank = F.row_number().over(Window.partitionBy("snapshot_id", "_top").orderBy("path"))
    blocks = each.withColumn("_block", F.floor((rank - 1) / DIGEST_BLOCK)).groupBy("snapshot_id", "_top", "_block").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "_h"))), lambda x: x["_h"]), ""), 256).alias("_d"))
    return blocks.groupBy("snapshot_id").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_top", "_block", "_d"))), lambda x: x["_d"]), ""), 256).alias("content_hash"))
