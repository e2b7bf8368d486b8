"""Queries over files, imports, edges and catalogs, each with the SQL of the same result.

The names carry the id of the operator in the survey's inventory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.functions.paths import directory, extension, language, normalized
from quarryline.operators import capability as C
from quarryline.operators import files as FI
from quarryline.operators import graph as G
from quarryline.operators import jobs as J
from quarryline.operators import manifest as M
from quarryline.operators import resolve as R
from quarryline.sources.tables import latest_files, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# common parts of the SQL

#: Files by their last delivery.
FILES = "files AS (SELECT * FROM source_files QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY arrived_at DESC) = 1)"
IMPORTS = "imp AS (SELECT DISTINCT import_id, snapshot_id, repo_id, from_path, raw, resolved, external, kind, confidence, hypothesis, reason_code, ord, observed_at FROM imports)"
EDGES = IMPORTS + ", edges AS (SELECT snapshot_id AS graph_id, from_path AS src, coalesce(resolved, raw) AS dst, 'import' AS kind, confidence, coalesce(hypothesis, false) AS hypothesis, resolved IS NOT NULL AS resolved, coalesce(external, resolved IS NULL) AS external, import_id AS ord FROM imp)"


def ext_sql(path: str) -> str:
    return f"lower(regexp_extract({path}, '(\\.[^./\\\\]*)$', 1))"


def lang_sql(path: str) -> str:
    e = ext_sql(path)
    return f"CASE WHEN {e} IN ('.js','.mjs','.cjs','.jsx') THEN 'js' WHEN {e} IN ('.ts','.tsx') THEN 'ts' WHEN {e} = '.py' THEN 'py' ELSE 'other' END"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


IN = lambda xs: "(" + ", ".join(map(quote, xs)) + ")"


def LANE_SQL(p: str) -> str:
    has = lambda *parts: " OR ".join(f"contains(lower({p}), '{x}')" for x in parts)
    return (f"CASE WHEN {has('/api/', '/routes/', '/routers/', 'route.ts', 'route.js')} THEN 'api' WHEN {has('/pages/', '/app/', '/components/', '/src/', '.tsx', '.jsx')} THEN 'web' "
            f"WHEN {has('/workers/', '/tasks/', '/jobs/', '/cron/')} THEN 'workers' ELSE 'other' END")


PURPOSE_SQL = """CASE WHEN lower(name) IN ('app', 'src/app') THEN 'UI routes (Next.js)' WHEN lower(name) = 'pages' THEN 'Next.js legacy pages + API routes' WHEN lower(name) = 'api' THEN 'API routes' WHEN lower(name) = 'lib' THEN 'Libraries / utilities'
 WHEN lower(name) = 'components' THEN 'UI components' WHEN contains(lower(name), 'worker') THEN 'Background workers' WHEN lower(name) = 'services' THEN 'Business logic / services' WHEN lower(name) = 'routes' THEN 'Server routes'
 WHEN lower(name) = 'templates' THEN 'Rendering templates' WHEN lower(name) = 'content' THEN 'Static content' WHEN lower(name) IN ('styles', 'css') THEN 'Styling' WHEN lower(name) = 'prisma' THEN 'Database schema' ELSE '' END"""
NAME_SQL = lambda p: f"string_split({p}, '/')[-1]"
ENTRY_SQL = lambda p: f"regexp_matches(lower({NAME_SQL(p)}), 'main|index|app|server|start|cli|command|script|worker|job')"
CORE_SQL = lambda p: f"regexp_matches(lower({p}), 'main\\.py|app\\.py|server\\.py|index\\.js|app\\.js')"
CONFIG_SQL = lambda p: f"regexp_matches(lower({p}), 'config|settings|env|package\\.json|requirements\\.txt|pyproject\\.toml')"


def ignored_sql(path: str) -> str:
    parts, name = f"string_split({path}, '/')", NAME_SQL(path)
    return (f"(list_has_any({parts}, ['node_modules', '.git', '.svn', '.hg', '.bzr', '__pycache__', '.pytest_cache', '.tox', '.venv', 'venv', 'env', 'coverage', '.coverage', 'htmlcov', '.nyc_output', 'dist', 'build', '.next', '.nuxt', 'out', 'logs', 'log', 'tmp', 'temp', '.tmp', '.temp', "
            "'migrations', 'migration', 'alembic', 'versions', 'test', 'tests', '__tests__', 'spec', 'specs', '.cache', 'cache', '.parcel-cache', '.turbo', 'docs', 'documentation', 'examples', 'samples', 'vendor', 'third_party', 'external']) "
            f"OR {ext_sql(path)} IN ('.log', '.tmp', '.temp', '.cache', '.lock', '.pid', '.map', '.min.js', '.min.css', '.bundle.js', '.pyc', '.pyo', '.pyd', '.so', '.dll', '.dylib', '.exe', '.bin', '.app', '.deb', '.rpm', '.msi', '.zip', '.tar', '.gz', '.bz2', '.xz', '.7z', '.rar', '.dmg', '.iso', '.img', "
            "'.jpg', '.jpeg', '.png', '.gif', '.bmp', '.tiff', '.svg', '.ico', '.webp', '.avif', '.mp3', '.mp4', '.avi', '.mov', '.wmv', '.flv', '.pdf', '.doc', '.docx', '.xls', '.xlsx', '.ppt', '.pptx', '.db', '.sqlite', '.sqlite3', '.mdb', '.accdb') "
            f"OR (starts_with({name}, '.') AND {name} NOT IN ('.env', '.gitignore', '.eslintrc', '.prettierrc')) OR regexp_matches({name}, '(~|\\.bak|\\.backup|\\.orig)$') OR regexp_matches({name}, 'generated|auto-generated|build-'))")


def files(spark, d, *cols):
    return latest_files(table(spark, d, "source_files"), *cols)


def one_import(spark, d):
    return table(spark, d, "imports").dropDuplicates(["import_id"])


def edges(spark, d):
    return G.import_edges(table(spark, d, "imports"))


def nodes(spark, d):
    return table(spark, d, "source_files").select(F.col("snapshot_id").alias("graph_id"), F.col("path").alias("id")).distinct()


NODES = "nodes AS (SELECT DISTINCT snapshot_id AS graph_id, path AS id FROM source_files)"

# ---------------------------------------------------------------- scans


@query(f"WITH {FILES} SELECT file_id, path, {ext_sql('path')} AS ext, {lang_sql('path')} AS language, CAST(strlen(text) AS BIGINT) AS size, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, sha256(text) AS hash, coalesce(strlen(text) > 20000, true) AS skipped FROM files WHERE NOT {ignored_sql('path')}")
def scan_s04_discover(spark, d):
    told = FI.discovered(table(spark, d, "source_files"))
    return latest_files(told, *told.columns[2:]).where(~FI.ignored(F.col("path")))


@query(f"SELECT DISTINCT path, {ignored_sql('path')} AS ignored FROM source_files")
def scan_s05_ignored(spark, d):
    return table(spark, d, "source_files").select("path").distinct().select("path", FI.ignored(F.col("path")).alias("ignored"))


@query(f"""SELECT DISTINCT snapshot_id, path FROM source_files WHERE {ext_sql('path')} IN ('.py', '.js', '.ts', '.jsx', '.tsx', '.mjs', '.cjs') AND len(list_filter(string_split(path, '/'), lambda s: regexp_matches(s, '^(\\.|__pycache__|venv|env)'))) = 0
AND NOT list_has_any(string_split(path, '/'), ['node_modules', 'dist', 'build', '.next', '.nuxt', 'out', 'test', 'tests', '__tests__', 'spec', 'specs']) AND NOT contains(path, 'runs/')""")
def scan_s06_source_only(spark, d):
    return FI.source_only(table(spark, d, "source_files")).select("snapshot_id", "path").distinct()


@query("SELECT DISTINCT snapshot_id, path FROM source_files WHERE path LIKE '%.py' AND NOT regexp_matches(path, '(^|/)(\\.|venv/|runs/)')")
def scan_s07_python_files(spark, d):
    f = table(spark, d, "source_files")
    return f.where("path like '%.py'").where(~F.col("path").rlike(r"(^|/)(\.|venv/|runs/)")).select("snapshot_id", "path").distinct()


_DEPS = lambda *keys: " OR ".join(f"json_exists(j, '$.{k}.\"PKG\"')" for k in keys)
_NODE = lambda package: "coalesce(bool_or(" + _DEPS("dependencies", "devDependencies", "peerDependencies").replace("PKG", package) + "), false)"
_WORD = lambda word: f"coalesce(bool_or(path IN ('requirements.txt', 'requirements-dev.txt', 'pyproject.toml') AND contains(lower(text), '{word}')), false)"


@query(f"""WITH m AS (SELECT snapshot_id, path, text, CASE WHEN path = 'package.json' AND json_valid(text) THEN CAST(text AS JSON) END AS j FROM source_files)
SELECT snapshot_id, {_NODE('next')} OR bool_or(starts_with(path, 'src/app/') OR starts_with(path, 'pages/')) AS has_nextjs, {_NODE('express')} AS has_express, {_NODE('koa')} AS has_koa, {_NODE('@nestjs/core')} AS has_nestjs, {_NODE('react')} AS has_react, {_NODE('vue')} AS has_vue, {_NODE('@angular/core')} AS has_angular,
{_WORD('fastapi')} OR bool_or(path = 'app/main.py') AS has_fastapi, {_WORD('flask')} OR bool_or(path IN ('app.py', 'flask_app.py')) AS has_flask, {_WORD('django')} OR bool_or(path = 'manage.py') AS has_django FROM m GROUP BY 1""")
def scan_s09_project_context(spark, d):
    return M.project_context(table(spark, d, "source_files"))


@query("""WITH m AS (SELECT snapshot_id, path, text, CASE WHEN path = 'package.json' AND json_valid(text) THEN CAST(text AS JSON) END AS j FROM source_files WHERE path IN ('package.json', 'requirements.txt', 'pyproject.toml')),
r AS (SELECT * FROM (VALUES ('nextjs', 'next', 0.9), ('react', 'react', 0.8), ('express', 'express', 0.8), ('koa', 'koa', 0.8)) AS t(name, package, confidence)), p AS (SELECT * FROM (VALUES ('fastapi', 'requirements.txt'), ('flask', 'requirements.txt'), ('django', 'requirements.txt'), ('fastapi', 'pyproject.toml')) AS t(name, file))
SELECT DISTINCT snapshot_id, name, CAST(confidence AS DOUBLE) AS confidence, 'package.json' AS file, json_extract_string(j, '$.dependencies."' || package || '"') AS version FROM m, r WHERE json_extract_string(j, '$.dependencies."' || package || '"') IS NOT NULL
UNION SELECT DISTINCT snapshot_id, name, 0.9, file, NULL FROM m JOIN p ON p.file = m.path WHERE contains(lower(text), name)""")
def scan_s10_frameworks(spark, d):
    return M.frameworks(table(spark, d, "source_files"))


@query("""SELECT snapshot_id, ['pnpm', 'yarn', 'turbo', 'nx', 'poetry', 'pants', 'single'][min(CASE WHEN path = 'pnpm-workspace.yaml' THEN 1 WHEN path = 'package.json' AND json_valid(text) AND json_extract_string(CASE WHEN json_valid(text) THEN text END, '$.workspaces') IS NOT NULL THEN 2
WHEN path = 'turbo.json' THEN 3 WHEN path = 'nx.json' THEN 4 WHEN path = 'pyproject.toml' AND contains(text, '[tool.poetry]') THEN 5 WHEN path = 'pants.toml' THEN 6 ELSE 7 END)] AS workspace FROM source_files GROUP BY 1""")
def scan_s11_workspace(spark, d):
    return M.workspace(table(spark, d, "source_files"))


@query(f"WITH {FILES} SELECT file_id, path, strlen(text) > 10000 AS big, {ext_sql('path')} IN ('.png', '.jpg', '.jpeg', '.gif', '.bmp', '.ico', '.pdf', '.mp4', '.mp3', '.mov', '.zip', '.tar', '.gz') AS binary_file, {NAME_SQL('path')} IN ('.env', '.env.local', '.env.development', '.env.production', '.env.test') AS env FROM files WHERE text IS NOT NULL")
def scan_s12_special_files(spark, d):
    p = F.col("path")
    f = files(spark, d, "path", (F.octet_length("text") > 10000).alias("big"), extension(p).isin(*FI.BINARY_EXTS).alias("binary_file"), FI.file_name(p).isin(*FI.ENV_FILES).alias("env"))
    return f.where("big is not null")


@query(r"""WITH t AS (SELECT DISTINCT snapshot_id, path AS config, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, CAST(text AS JSON) AS j FROM source_files WHERE regexp_matches(string_split(path, '/')[-1], '^tsconfig[^/]*\.json$') AND json_valid(text)), k AS (SELECT *, unnest(json_keys(j, '$.compilerOptions.paths')) AS pattern FROM t),
v AS (SELECT *, from_json(json_extract(j, '$.compilerOptions.paths."' || pattern || '"'), '["VARCHAR"]') AS targets FROM k)
SELECT DISTINCT snapshot_id, config, folder, coalesce(json_extract_string(j, '$.compilerOptions.baseUrl'), '.') AS base_url, pattern, CAST(i - 1 AS INT) AS ord, targets[i] AS target FROM (SELECT *, unnest(range(1, len(targets) + 1)) AS i FROM v)""".replace("\\\\", "\\"))
def scan_s13_path_aliases(spark, d):
    return M.path_aliases(table(spark, d, "source_files"))


@query(f"WITH {FILES}, l AS (SELECT file_id, trim(unnest(string_split(replace(text, chr(13), ''), chr(10)))) AS line FROM files WHERE text IS NOT NULL AND {ext_sql('path')} IN ('.txt', '.toml', '.cfg')) SELECT DISTINCT file_id, regexp_extract(line, '^(.*?)(?:==|>=|<=|>|<|~=|$)', 1) AS name FROM l WHERE line <> '' AND line NOT LIKE '#%' AND name <> ''")
def scan_s14_dependency_names(spark, d):
    f = table(spark, d, "source_files").where(extension(F.col("path")).isin(".txt", ".toml", ".cfg"))
    return M.dependency_names(f)


@query(f"""WITH {FILES}, h AS (SELECT snapshot_id, path, sha256(text) AS h, string_split(path, '/')[1] AS top FROM (SELECT snapshot_id, path, any_value(text) AS text FROM source_files WHERE text IS NOT NULL GROUP BY 1, 2)), r AS (SELECT *, (row_number() OVER (PARTITION BY snapshot_id, top ORDER BY path) - 1) // 4096 AS b FROM h),
b AS (SELECT snapshot_id, top, b, sha256(string_agg(h, '' ORDER BY path)) AS d FROM r GROUP BY 1, 2, 3) SELECT snapshot_id, sha256(string_agg(d, '' ORDER BY top, b)) AS content_hash FROM b GROUP BY 1""")
def agg_a19_repo_hash(spark, d):
    return FI.repo_hash(table(spark, d, "source_files"))


@query()
def scan_s18_preflight(spark, d):
    f = table(spark, d, "source_files")
    return M.preflight(f, FI.repo_hash(f))


@query("SELECT record_id, json_extract_string(payload, '$.path') AS path, try_cast(json_extract_string(payload, '$.confidence') AS DOUBLE) AS confidence FROM artifact_records WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'")
def scan_s15_artifact_reader(spark, d):
    r = table(spark, d, "artifact_records").where("try_parse_json(payload) is not null and schema_of_variant(try_parse_json(payload)) like 'OBJECT%'")
    return r.select("record_id", F.get_json_object("payload", "$.path").alias("path"), F.get_json_object("payload", "$.confidence").try_cast("double").alias("confidence"))


@query("SELECT DISTINCT snapshot_id, repo_id, commit_hash FROM snapshots WHERE status = 'done' AND source = 'git'")
def scan_s16_catalog_filter(spark, d):
    return table(spark, d, "snapshots").where("status = 'done' and source = 'git'").select("snapshot_id", "repo_id", "commit_hash").distinct()


# ---------------------------------------------------------------- projections


@query(f"WITH {FILES} SELECT file_id, {lang_sql('path')} AS language FROM files")
def proj_p01_language(spark, d):
    return files(spark, d, "path").select("file_id", language(F.col("path")).alias("language"))


@query(f"WITH {FILES} SELECT file_id, path, CASE WHEN v THEN l ELSE 'other' END AS language, CASE WHEN v THEN coalesce(size, 0) ELSE 0 END AS size, CASE WHEN v THEN coalesce(lines, 0) ELSE 0 END AS lines, (NOT v OR coalesce(skipped, false)) AS skipped, CASE WHEN NOT v THEN 'validation_failed' ELSE skip_reason END AS skip_reason FROM (SELECT *, {lang_sql('path')} AS l, path <> '' AND {lang_sql('path')} <> 'other' AS v FROM files)")
def proj_p02_normalized_rows(spark, d):
    return FI.normalized_rows(files(spark, d, "path", "size", "lines", "skipped", "skip_reason"))


@query(f"SELECT DISTINCT path, {LANE_SQL('path')} AS lane FROM source_files")
def proj_p06_lane(spark, d):
    return table(spark, d, "source_files").select("path").distinct().select("path", FI.lane(F.col("path")).alias("lane"))


@query(f"WITH p AS (SELECT DISTINCT unnest(string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/')) AS name FROM source_files) SELECT name, {PURPOSE_SQL} AS purpose FROM p WHERE name <> ''")
def proj_p10_folder_purpose(spark, d):
    names = table(spark, d, "source_files").select(F.explode(F.split(directory(F.col("path")), "/")).alias("name")).where("name <> ''").distinct()
    return names.select("name", FI.folder_purpose(F.col("name")).alias("purpose"))


@query(f"SELECT DISTINCT path, {CORE_SQL('path')} AS core, {CONFIG_SQL('path')} AS config FROM source_files")
def proj_p14_core_and_config(spark, d):
    p = F.col("path")
    return table(spark, d, "source_files").select("path").distinct().select("path", FI.core_file(p).alias("core"), FI.config_file(p).alias("config"))


@query(f"WITH {FILES} SELECT file_id, coalesce(strlen(text) > 8000 OR len(string_split(text, chr(10))) > 300, false) AS big FROM files")
def proj_p17_big_files(spark, d):
    return files(spark, d, FI.big(F.octet_length("text"), X.line_count(F.col("text")), 8000, 300).alias("big"))


@query(f"WITH {IMPORTS} SELECT import_id, raw FROM imp WHERE resolved IS NULL AND (regexp_matches(raw, '^(\\.|/|@/)') OR regexp_matches(raw, '^(app|src|lib|server|backend|frontend|packages)/') OR (contains(raw, '.') AND NOT contains(raw, '/')))")
def proj_p24_unresolved_local(spark, d):
    i = one_import(spark, d).where("resolved is null")
    return i.where(G.unresolved_local(F.col("raw"), ["app", "src", "lib", "server", "backend", "frontend", "packages"])).select("import_id", "raw")


@query("SELECT DISTINCT file_id, snapshot_id, language FROM source_files WHERE path = 'app/config/.env.test' OR path LIKE '%/index.ts'")
def proj_p21_point_lookup(spark, d):
    return table(spark, d, "source_files").where("path = 'app/config/.env.test' or path like '%/index.ts'").select("file_id", "snapshot_id", "language").distinct()


@query(f"WITH {EDGES} SELECT DISTINCT graph_id, src, dst, kind, reason FROM (SELECT *, 'low-confidence' AS reason FROM edges WHERE confidence < 0.7 UNION ALL SELECT *, 'hypothesis' AS reason FROM edges WHERE hypothesis)")
def proj_p22_edge_warnings(spark, d):
    return G.warnings(edges(spark, d))


# ---------------------------------------------------------------- joins

_SUFFIX = "(VALUES " + ", ".join(f"({k}, {quote(s)})" for k, s in enumerate(R.SUFFIXES)) + ") AS s(k, suffix)"


def _norm_sql(e: str) -> str:
    """'..' resolved for paths whose climbs come first, as those of relative imports do after their folder."""
    out = f"replace({e}, '/./', '/')"
    for _ in range(8):
        out = f"regexp_replace({out}, '(^|/)[^/]+/\\.\\./', '\\1')"
    return f"ltrim(regexp_replace({out}, '^\\./', ''), '/')"


def resolve_sql(first_only: bool) -> str:
    other = "NOT starts_with(raw, '.') AND NOT starts_with(raw, '@/') AND NOT starts_with(raw, '~/')" if first_only else "NOT starts_with(raw, '.')"
    alias = "(starts_with(raw, '@/') OR starts_with(raw, '~/'))"
    bases = [
        ("relative", f"CASE WHEN starts_with(raw, './') OR starts_with(raw, '../') THEN folder || '/' || raw END"), ("alias", f"CASE WHEN {alias} THEN raw[3:] END"), ("alias", f"CASE WHEN {alias} THEN 'src/' || raw[3:] END"),
        ("alias", f"CASE WHEN {alias} THEN string_split(folder, '/')[1] || '/' || raw[3:] END"), ("rooted", f"CASE WHEN {other} AND contains(raw, '/') THEN ltrim(raw, '/') END"),
        ("package", f"CASE WHEN {other} AND kind = 'py' AND regexp_matches(raw, '\\.(js|jsx|ts|tsx|mjs|py)$') THEN replace(regexp_replace(raw, '\\.\\w+$', ''), '.', '/') || regexp_extract(raw, '(\\.\\w+)$', 1) END"),
        ("package", f"CASE WHEN {other} AND kind = 'py' AND NOT contains(raw, '/') THEN replace(raw, '.', '/') END"), ("directory", f"CASE WHEN {other} AND NOT contains(raw, '/') THEN folder || '/' || replace(raw, '.', '/') END"),
    ]
    rank = {s: k for k, (s, _) in enumerate(R.STRATEGIES)}
    conf = dict(R.STRATEGIES)
    union = " UNION ALL ".join(f"SELECT import_id, snapshot_id, '{n}' AS strategy, {rank[n] * 100} AS r, {conf[n]} AS confidence, {b} AS base FROM asked" for n, b in bases)
    return (f"WITH {IMPORTS}, asked AS (SELECT import_id, snapshot_id, raw, kind, regexp_extract(from_path, '^(.*)/[^/]*$', 1) AS folder FROM imp), b AS ({union}), c AS (SELECT import_id, snapshot_id, strategy, r + k AS prio, CAST(confidence AS DOUBLE) AS confidence, {_norm_sql('base || suffix')} AS path FROM b, {_SUFFIX} WHERE base IS NOT NULL AND base <> ''), "
            "known AS (SELECT DISTINCT snapshot_id, path FROM source_files), hit AS (SELECT c.* FROM c JOIN known k ON k.snapshot_id = c.snapshot_id AND k.path = c.path QUALIFY row_number() OVER (PARTITION BY import_id ORDER BY prio, c.path) = 1) "
            "SELECT i.import_id, h.path AS resolved, h.strategy, coalesce(h.confidence, 0.0) AS confidence, h.path IS NULL AS external, h.path IS NULL AS hypothesis, CASE WHEN h.path IS NULL THEN 'alias-miss' END AS reason FROM imp i LEFT JOIN hit h ON h.import_id = i.import_id")


@query(resolve_sql(True))
def join_j01_resolve_first_rule(spark, d):
    return R.resolve(table(spark, d, "imports"), table(spark, d, "source_files"), first_only=True)


@query(resolve_sql(False))
def join_j02_resolve_fall_through(spark, d):
    return R.resolve(table(spark, d, "imports"), table(spark, d, "source_files"))


@query(f"WITH {IMPORTS}, a AS (SELECT DISTINCT import_id, snapshot_id, {_norm_sql(chr(39) + chr(39) + ' || regexp_extract(from_path, ' + quote('^(.*)/[^/]*$') + ', 1) || ' + quote('/') + ' || raw')} AS folder FROM imp WHERE raw LIKE './%' OR raw LIKE '../%'), l AS (SELECT snapshot_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, path FROM source_files QUALIFY row_number() OVER (PARTITION BY snapshot_id, folder ORDER BY length(path) DESC, path DESC) = 1) SELECT a.import_id, l.path FROM a JOIN l ON a.snapshot_id = l.snapshot_id AND a.folder = l.folder")
def join_j05_directory_files(spark, d):
    return R.directory_files(table(spark, d, "imports"), table(spark, d, "source_files"))


_STEM = lambda p: f"regexp_replace(string_split({p}, '/')[-1], '\\.\\w+$', '')"


@query(f"WITH {IMPORTS}, a AS (SELECT import_id, snapshot_id, {_STEM('raw')} AS stem FROM imp WHERE resolved IS NULL AND raw NOT LIKE '%{{%'), f AS (SELECT snapshot_id, {_STEM('path')} AS stem, min(path) AS path FROM source_files GROUP BY 1, 2) SELECT a.import_id, f.path, CAST(0.3 AS DOUBLE) AS confidence FROM a JOIN f ON a.snapshot_id = f.snapshot_id AND a.stem = f.stem WHERE a.stem <> ''")
def join_j08_suffix_hypotheses(spark, d):
    return R.suffix_hypotheses(table(spark, d, "imports"), table(spark, d, "source_files"))


_INC = """WITH s AS (SELECT snapshot_id, any_value(repo_id) AS repo_id, any_value(created_at) AS created_at FROM snapshots GROUP BY snapshot_id),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, snapshot_id DESC) AS n FROM s),
f AS (SELECT DISTINCT snapshot_id, path, hash, mtime FROM source_files),
now AS (SELECT r.repo_id, f.* FROM f JOIN r ON r.snapshot_id = f.snapshot_id AND r.n = 1), before AS (SELECT r.repo_id, f.* FROM f JOIN r ON r.snapshot_id = f.snapshot_id AND r.n = 2)
SELECT a.repo_id, a.path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.hash IS DISTINCT FROM b.hash OR abs(a.mtime - b.mtime) > 3600 THEN 'reparse' ELSE 'reuse' END AS action FROM now a LEFT JOIN before b ON a.repo_id = b.repo_id AND a.path = b.path
UNION ALL SELECT b.repo_id, b.path, 'deleted' FROM before b WHERE NOT EXISTS (SELECT 1 FROM now a WHERE a.repo_id = b.repo_id AND a.path = b.path)"""


@query(_INC)
def join_j11_incremental_plan(spark, d):
    from pyspark.sql import Window

    s = table(spark, d, "snapshots").groupBy("snapshot_id").agg(F.first("repo_id").alias("repo_id"), F.first("created_at").alias("created_at"))
    s = s.withColumn("n", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("created_at"), F.desc("snapshot_id")))).where("n <= 2").select("snapshot_id", "repo_id", "n")
    f = table(spark, d, "source_files").select("snapshot_id", "path", "hash", "mtime").distinct().join(s, "snapshot_id")
    return FI.stale(f.where("n = 1"), f.where("n = 2"))


@query(f"WITH {EDGES}, w AS (SELECT DISTINCT snapshot_id AS graph_id, path AS id FROM source_files WHERE path LIKE '%/index.%') SELECT DISTINCT e.graph_id, src, dst FROM edges e WHERE EXISTS (SELECT 1 FROM w WHERE w.graph_id = e.graph_id AND w.id = e.src) AND EXISTS (SELECT 1 FROM w WHERE w.graph_id = e.graph_id AND w.id = e.dst)")
def join_j15_induced_subgraph(spark, d):
    w = nodes(spark, d).where("id like '%/index.%'")
    return G.induced(edges(spark, d), w).select("graph_id", "src", "dst").distinct()


@query(f"WITH {EDGES}, x AS (SELECT DISTINCT graph_id, src, dst, resolved FROM edges), n AS (SELECT *, row_number() OVER (PARTITION BY graph_id, src, resolved ORDER BY dst) AS k FROM x) SELECT graph_id, src, coalesce(string_agg(dst, '|' ORDER BY dst) FILTER (WHERE resolved), '') AS internal, coalesce(string_agg(dst, '|' ORDER BY dst) FILTER (WHERE NOT resolved), '') AS external FROM n WHERE k <= 10 GROUP BY 1, 2")
def join_j16_dependencies(spark, d):
    out = G.dependencies(edges(spark, d))
    return out.select("graph_id", "src", F.array_join("internal", "|").alias("internal"), F.array_join("external", "|").alias("external"))


@query("""WITH f AS (SELECT DISTINCT snapshot_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM source_files), c AS (SELECT * FROM f WHERE regexp_matches(path, '\\.(ya?ml|toml|ini|cfg|json)$'))
SELECT f.snapshot_id, f.path, c.path AS config FROM f JOIN c ON c.snapshot_id = f.snapshot_id AND (c.folder = '' OR f.folder = c.folder OR starts_with(f.folder, c.folder || '/')) QUALIFY row_number() OVER (PARTITION BY f.snapshot_id, f.path ORDER BY length(c.folder) DESC, c.path DESC) = 1""")
def join_j17_nearest_config(spark, d):
    f = table(spark, d, "source_files").select("snapshot_id", "path").distinct()
    return R.nearest_config(f, f.where(F.col("path").rlike(r"\.(ya?ml|toml|ini|cfg|json)$")))


@query(f"WITH {EDGES}, need AS (SELECT DISTINCT graph_id, dst AS path FROM edges WHERE resolved AND dst <> ''), con AS (SELECT DISTINCT snapshot_id AS graph_id, path, 'contract' AS name, 'pydantic.Model' AS kind FROM source_files WHERE path LIKE '%.ts') SELECT *, false AS stub FROM con UNION ALL SELECT graph_id, path, regexp_replace(string_split(path, '/')[-1], '(.)\\.[^.]*$', '\\1') AS name, 'api.Module', true FROM need WHERE NOT EXISTS (SELECT 1 FROM con WHERE con.graph_id = need.graph_id AND con.path = need.path)")
def join_j18_contract_gaps(spark, d):
    contracts = nodes(spark, d).where("id like '%.ts'").select("graph_id", F.col("id").alias("path"), F.lit("contract").alias("name"), F.lit("pydantic.Model").alias("kind"))
    return C.contract_gaps(edges(spark, d).where("resolved").select("graph_id", F.col("dst").alias("path")), contracts)


@query(f"WITH {EDGES}, w AS (SELECT DISTINCT snapshot_id AS graph_id, path AS id FROM source_files WHERE path LIKE '%/__init__.py') SELECT DISTINCT e.graph_id, src, dst FROM edges e WHERE EXISTS (SELECT 1 FROM w WHERE w.graph_id = e.graph_id AND (w.id = e.src OR w.id = e.dst))")
def join_j19_touching_edges(spark, d):
    return G.touching(edges(spark, d).select("graph_id", "src", "dst"), nodes(spark, d).where("id like '%/__init__.py'"))


@query(f"WITH {EDGES}, w AS (SELECT DISTINCT snapshot_id AS graph_id, path AS id FROM source_files WHERE {ENTRY_SQL('path')}), b AS (SELECT graph_id, src AS id, dst AS neighbour FROM edges UNION ALL SELECT graph_id, dst, src FROM edges) SELECT DISTINCT b.graph_id, b.id, b.neighbour FROM b JOIN w ON w.graph_id = b.graph_id AND w.id = b.id UNION SELECT graph_id, id, id FROM w")
def join_j20_neighbours(spark, d):
    return G.neighbours(edges(spark, d), nodes(spark, d).where(FI.entry_name(F.col("id"))))


_MODULE = "replace(regexp_replace(regexp_replace(path, '\\.py$', ''), '/__init__$', ''), '/', '.')"


@query(f"SELECT DISTINCT snapshot_id, {_MODULE} AS module, path FROM source_files WHERE path LIKE '%.py'")
def join_j24_module_index(spark, d):
    return R.module_index(table(spark, d, "source_files"))


@query("WITH s AS (SELECT DISTINCT snapshot_id, repo_id, commit_hash, settings_hash, status FROM snapshots) SELECT a.snapshot_id FROM s a WHERE a.status <> 'done' AND EXISTS (SELECT 1 FROM s b WHERE b.status = 'done' AND b.repo_id = a.repo_id AND b.commit_hash = a.commit_hash AND b.settings_hash = a.settings_hash)")
def join_j26_idempotent_snapshots(spark, d):
    s = table(spark, d, "snapshots").select("snapshot_id", "repo_id", "commit_hash", "settings_hash", "status").distinct()
    done = s.where("status = 'done'").select("repo_id", "commit_hash", "settings_hash")
    return s.where("status <> 'done'").join(done, ["repo_id", "commit_hash", "settings_hash"], "left_semi").select("snapshot_id")


@query("WITH s AS (SELECT DISTINCT snapshot_id, status FROM snapshots), w AS (SELECT DISTINCT warning_id, snapshot_id FROM parse_warnings) SELECT s.snapshot_id, s.status, count(w.warning_id) AS warnings, coalesce(string_agg(CAST(w.warning_id AS VARCHAR), ',' ORDER BY w.warning_id), '') AS ids FROM s LEFT JOIN w ON w.snapshot_id = s.snapshot_id GROUP BY 1, 2")
def join_j27_nested_children(spark, d):
    s = table(spark, d, "snapshots").select("snapshot_id", "status").distinct()
    w = table(spark, d, "parse_warnings").select("warning_id", "snapshot_id").distinct().groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("warnings"), F.array_join(F.array_sort(F.collect_list("warning_id")), ",").alias("ids"))
    return s.join(w, "snapshot_id", "left").select("snapshot_id", "status", F.coalesce("warnings", F.lit(0)).alias("warnings"), F.coalesce("ids", F.lit("")).alias("ids"))


@query("WITH t AS (SELECT DISTINCT snapshot_id FROM snapshots), need AS (SELECT DISTINCT snapshot_id, kind FROM artifacts), done AS (SELECT DISTINCT kind FROM artifacts WHERE version >= 3) SELECT snapshot_id FROM t WHERE NOT EXISTS (SELECT 1 FROM need n WHERE n.snapshot_id = t.snapshot_id AND n.kind NOT IN (SELECT kind FROM done))")
def join_j28_ready_tasks(spark, d):
    t = table(spark, d, "snapshots").select(F.col("snapshot_id").alias("task")).distinct()
    a = table(spark, d, "artifacts")
    out = J.ready_tasks(t, a.select(F.col("snapshot_id").alias("task"), F.col("kind").alias("need")).distinct(), a.where("version >= 3").select(F.col("kind").alias("task")).distinct())
    return out.withColumnRenamed("task", "snapshot_id")


# ---------------------------------------------------------------- aggregations


@query(f"WITH {FILES} SELECT {lang_sql('path')} AS language, count(*) AS files FROM files GROUP BY 1")
def agg_a01_languages(spark, d):
    return table(spark, d, "source_files").groupBy(language(F.col("path")).alias("language")).agg(F.countDistinct("file_id").alias("files"))


@query(f"WITH {EDGES}, {NODES}, o AS (SELECT graph_id, src AS id, count(*) AS n FROM edges WHERE resolved GROUP BY 1, 2), i AS (SELECT graph_id, dst AS id, count(*) AS n FROM edges WHERE resolved GROUP BY 1, 2) SELECT n.graph_id, n.id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM nodes n LEFT JOIN i ON i.graph_id = n.graph_id AND i.id = n.id LEFT JOIN o ON o.graph_id = n.graph_id AND o.id = n.id")
def agg_a02_degrees(spark, d):
    return G.degrees(nodes(spark, d), edges(spark, d))


@query(f"WITH {EDGES} SELECT graph_id, count(*) AS imports, count(*) FILTER (WHERE external) AS external, count(*) FILTER (WHERE NOT external) AS internal FROM edges GROUP BY 1")
def agg_a03_import_totals(spark, d):
    return edges(spark, d).groupBy("graph_id").agg(F.count(F.lit(1)).alias("imports"), F.count_if("external").alias("external"), F.count_if(~F.col("external")).alias("internal"))


STATUS_SQL = "CASE WHEN hypothesis AND coalesce(confidence, 0) < 0.3 THEN 'quarantined' WHEN hypothesis OR coalesce(confidence, 0) < 0.5 THEN 'suggested' ELSE 'main' END"


@query(f"WITH {EDGES} SELECT graph_id, kind, count(*) AS edges, count(*) FILTER (WHERE {STATUS_SQL} = 'main') AS main, count(*) FILTER (WHERE {STATUS_SQL} = 'suggested') AS suggested, count(*) FILTER (WHERE {STATUS_SQL} = 'quarantined') AS quarantined, count(DISTINCT src) AS sources FROM edges GROUP BY 1, 2")
def agg_a05_graph_stats(spark, d):
    return G.stats(edges(spark, d))


@query(f"WITH {EDGES}, k AS (SELECT graph_id, src, dst, bool_or(coalesce(confidence, 0) = 0 AND hypothesis) AS u, bool_or(hypothesis) AS h FROM edges GROUP BY 1, 2, 3) SELECT graph_id, round(CAST(count(*) FILTER (WHERE u) AS DOUBLE) / count(*), 6) AS unresolved_ratio, round(CAST(count(*) FILTER (WHERE h) AS DOUBLE) / count(*), 6) AS hypothesis_ratio FROM k GROUP BY 1")
def agg_a06_unresolved_ratio(spark, d):
    return G.unresolved_ratio(edges(spark, d))


@query(f"WITH {IMPORTS}, e AS (SELECT i.snapshot_id, i.ord, unnest(t.evidence) AS e FROM imp i JOIN (SELECT DISTINCT import_id, evidence FROM imports) t ON t.import_id = i.import_id) SELECT snapshot_id, e.file AS file, e.start AS start, e.end AS \"end\", min(ord) AS ord FROM e GROUP BY 1, 2, 3, 4")
def agg_a15_evidence(spark, d):
    return C.evidence(table(spark, d, "imports"))


@query(f"SELECT snapshot_id, {LANE_SQL('path')} AS lane, string_agg(DISTINCT path, '|' ORDER BY path) AS paths FROM source_files GROUP BY 1, 2")
def agg_a16_swimlanes(spark, d):
    return C.swimlanes(table(spark, d, "source_files")).withColumn("paths", F.array_join("paths", "|"))


@query("WITH r AS (SELECT DISTINCT snapshot_id, string_split(path, '/')[1] AS area, path FROM source_files WHERE path LIKE '%/%'), n AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, area ORDER BY path) AS k FROM r) SELECT snapshot_id, area, min(path) AS entry, string_agg(path, '|' ORDER BY path) AS key_files FROM n WHERE k <= 10 GROUP BY 1, 2")
def agg_a17_areas(spark, d):
    return C.areas(table(spark, d, "source_files")).withColumn("key_files", F.array_join("key_files", "|"))


@query("SELECT DISTINCT snapshot_id, w AS term FROM (SELECT snapshot_id, unnest(regexp_extract_all(lower(path), '[a-z]{4,}')) AS w FROM source_files) WHERE length(w) >= 4")
def agg_a18_repo_terms(spark, d):
    f = table(spark, d, "source_files").select("snapshot_id", "path").distinct()
    return f.select("snapshot_id", F.explode(F.regexp_extract_all(F.lower("path"), F.lit("[a-z]{4,}"), F.lit(0))).alias("term")).distinct()


@query("SELECT DISTINCT snapshot_id, substr(sha256(repo_id || ':' || settings_hash), 1, 16) AS settings FROM snapshots")
def agg_a20_settings_hash(spark, d):
    return table(spark, d, "snapshots").select("snapshot_id", F.substring(F.sha2(F.concat_ws(":", "repo_id", "settings_hash"), 256), 1, 16).alias("settings")).distinct()


@query("WITH w AS (SELECT DISTINCT warning_id, coalesce(reason_code, 'unknown') AS reason FROM parse_warnings), n AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY warning_id) AS k FROM w) SELECT reason, count(*) AS n, string_agg(CAST(warning_id AS VARCHAR), ',' ORDER BY warning_id) FILTER (WHERE k <= 10) AS sample FROM n GROUP BY 1")
def agg_a21_fallback_samples(spark, d):
    from pyspark.sql import Window

    w = table(spark, d, "parse_warnings").select("warning_id", F.coalesce("reason_code", F.lit("unknown")).alias("reason")).distinct()
    # reasons are few and hot: the first ten of each slice, then the first ten of these
    few = w.withColumn("k", F.row_number().over(Window.partitionBy("reason", F.pmod(F.xxhash64("warning_id"), F.lit(256))).orderBy("warning_id"))).where("k <= 10")
    first = few.withColumn("k", F.row_number().over(Window.partitionBy("reason").orderBy("warning_id"))).where("k <= 10")
    sample = first.groupBy("reason").agg(F.array_join(F.array_sort(F.collect_list("warning_id")), ",").alias("sample"))
    return w.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).join(sample, "reason")


@query("WITH s AS (SELECT DISTINCT snapshot_id, source, status FROM snapshots) SELECT coalesce(source, 'none') AS source, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status NOT IN ('done', 'failed')) AS other FROM s GROUP BY 1")
def agg_a24_queue_pivot(spark, d):
    s = table(spark, d, "snapshots").select("snapshot_id", "source", "status").distinct()
    return s.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(~F.col("status").isin("done", "failed")).alias("other"))


@query(f"""WITH p AS (SELECT DISTINCT snapshot_id, string_split(path, '/') AS p FROM source_files), e AS (SELECT snapshot_id, p, unnest(range(1, len(p) + 1)) AS n FROM p),
t AS (SELECT snapshot_id, array_to_string(p[1:n], '/') AS id, array_to_string(p[1:n-1], '/') AS parent_id, p[n] AS name, bool_and(n = len(p)) AS is_leaf FROM e GROUP BY 1, 2, 3, 4)
SELECT snapshot_id, id, coalesce(parent_id, '') AS parent_id, name, is_leaf, CASE WHEN NOT is_leaf THEN {PURPOSE_SQL} END AS purpose FROM t""")
def agg_a25_tree(spark, d):
    return FI.tree(table(spark, d, "source_files").select("snapshot_id", "path").distinct())


@query("SELECT snapshot_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(DISTINCT path) AS files FROM source_files GROUP BY 1, 2")
def agg_a26_folder_counts(spark, d):
    return table(spark, d, "source_files").groupBy("snapshot_id", directory(F.col("path")).alias("folder")).agg(F.countDistinct("path").alias("files"))


@query(f"WITH {EDGES}, x AS (SELECT DISTINCT graph_id, dst FROM edges WHERE external), n AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY dst) AS k FROM x) SELECT graph_id, string_agg(dst, '|' ORDER BY dst) AS packages FROM n WHERE k <= 8 GROUP BY 1")
def agg_a27_external_packages(spark, d):
    from pyspark.sql import Window

    x = edges(spark, d).where("external").select("graph_id", "dst").distinct()
    few = x.withColumn("k", F.row_number().over(Window.partitionBy("graph_id").orderBy("dst"))).where("k <= 8")
    return few.groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_list("dst")), "|").alias("packages"))


@query(f"WITH {EDGES} SELECT DISTINCT graph_id, id FROM (SELECT graph_id, src AS id FROM edges UNION ALL SELECT graph_id, dst FROM edges)")
def agg_a29_edge_nodes(spark, d):
    return edges(spark, d).select("graph_id", F.explode(F.array("src", "dst")).alias("id")).distinct()


# ---------------------------------------------------------------- merging, windows, graph

CAND = """c AS (SELECT CAST(l_suppkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS dst, CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'N' THEN 'import' ELSE 'store' END AS kind, CAST(round(l_discount * 100) AS INT) / 10.0 AS confidence,
 l_linestatus = 'O' AS hypothesis, CASE WHEN l_linenumber % 2 = 0 THEN 'static' ELSE 'model' END AS layer, CAST(l_orderkey AS BIGINT) * 1000000000 + CAST(l_partkey AS BIGINT) * 100 + l_linenumber AS ord FROM lineitem)"""


def candidates(spark, d):
    """Edges in two layers made of line items, as the merge operators need them."""
    t = table(spark, d, "lineitem")
    return t.select(
        F.lit("all").alias("graph_id"), F.col("l_suppkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst"),
        F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "N", "import").otherwise("store").alias("kind"), (F.round(F.col("l_discount") * 100).cast("int") / 10.0).alias("confidence"),
        (F.col("l_linestatus") == "O").alias("hypothesis"), F.when(F.col("l_linenumber") % 2 == 0, "static").otherwise("model").alias("layer"),
        (F.col("l_orderkey").cast("long") * 1000000000 + F.col("l_partkey").cast("long") * 100 + F.col("l_linenumber")).alias("ord"))


@query(f"WITH {CAND} SELECT src, dst, kind, confidence, hypothesis, layer, ord FROM c QUALIFY row_number() OVER (PARTITION BY src, dst, kind ORDER BY ord DESC, confidence DESC, hypothesis DESC, layer DESC) = 1")
def win_w02_last_writer(spark, d):
    return G.last_writer(candidates(spark, d)).select("src", "dst", "kind", "confidence", "hypothesis", "layer", "ord")


_MERGED = f"{CAND}, m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY src, dst, kind ORDER BY coalesce(confidence, 0) DESC, layer = 'static' DESC, ord) = 1)"


@query(f"WITH {_MERGED} SELECT src, dst, kind, confidence, hypothesis, layer, ord FROM m")
def win_w03_merge_layers(spark, d):
    return G.merge_layers(candidates(spark, d)).select("src", "dst", "kind", "confidence", "hypothesis", "layer", "ord")


@query(f"WITH {_MERGED} SELECT src, dst, kind, {STATUS_SQL} AS status FROM m")
def set_u08_split_edges(spark, d):
    return G.split(G.merge_layers(candidates(spark, d))).select("src", "dst", "kind", "status")


@query(f"WITH {EDGES} SELECT graph_id, id, round(CAST(n AS DOUBLE) / t, 6) AS degree, round(CAST(n AS DOUBLE) / t, 6) * 0.71 AS score, row_number() OVER (PARTITION BY graph_id ORDER BY n DESC, id) AS rank FROM (SELECT graph_id, id, count(*) AS n FROM (SELECT graph_id, ord, src AS id FROM edges UNION SELECT graph_id, ord, dst FROM edges) GROUP BY 1, 2) JOIN (SELECT graph_id, count(*) AS t FROM edges GROUP BY 1) USING (graph_id)")
def win_w04_ranking(spark, d):
    return G.centrality(edges(spark, d))


@query(f"WITH {EDGES}, {NODES}, x AS (SELECT graph_id, src AS id FROM edges WHERE resolved UNION ALL SELECT graph_id, dst FROM edges WHERE resolved), s AS (SELECT graph_id, id, count(*) AS degree FROM x GROUP BY 1, 2) SELECT n.graph_id, n.id, coalesce(s.degree, 0) AS degree FROM nodes n LEFT JOIN s ON s.graph_id = n.graph_id AND s.id = n.id ORDER BY degree DESC, n.graph_id, n.id LIMIT 10")
def top_o01_hubs(spark, d):
    return G.hubs(G.degrees(nodes(spark, d), edges(spark, d)))


@query(f"""WITH {EDGES}, {NODES}, e AS (SELECT DISTINCT graph_id, src, dst FROM edges), o AS (SELECT graph_id, src AS id, string_agg(dst, '|' ORDER BY dst) AS v FROM e GROUP BY 1, 2), i AS (SELECT graph_id, dst AS id, string_agg(src, '|' ORDER BY src) AS v FROM e GROUP BY 1, 2)
SELECT n.graph_id, n.id, coalesce(i.v, '') AS incoming, coalesce(o.v, '') AS outgoing, {LANE_SQL('n.id')} AS lane, CASE WHEN {ENTRY_SQL('n.id')} THEN 'entrypoint' WHEN o.v IS NULL THEN 'sink' ELSE 'handler' END AS role FROM nodes n LEFT JOIN i ON i.graph_id = n.graph_id AND i.id = n.id LEFT JOIN o ON o.graph_id = n.graph_id AND o.id = n.id""")
def graph_g07_node_index(spark, d):
    out = G.index(nodes(spark, d), edges(spark, d), FI.lane(F.col("id")), FI.entry_name(F.col("id")))
    return out.select("graph_id", "id", F.array_join("incoming", "|").alias("incoming"), F.array_join("outgoing", "|").alias("outgoing"), "lane", "role")


_WALKS = f"""{EDGES}, hop AS (SELECT DISTINCT graph_id, src, dst FROM edges WHERE resolved AND src <> dst), starts AS (SELECT DISTINCT snapshot_id AS graph_id, path AS id FROM source_files WHERE {ENTRY_SQL('path')}),
walk AS (SELECT graph_id, id AS start, id AS at, [id] AS path FROM starts UNION ALL SELECT graph_id, start, nxt, list_append(path, nxt) FROM (SELECT w.graph_id, w.start, w.path, min(h.dst) AS nxt FROM walk w JOIN hop h ON h.graph_id = w.graph_id AND h.src = w.at WHERE NOT list_contains(w.path, h.dst) GROUP BY 1, 2, 3) WHERE len(path) < 1000),
longest AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY len(path) DESC, start) = 1), steps AS (SELECT graph_id, start, unnest(range(0, len(path))) AS step, unnest(path) AS id FROM longest)"""


@query(f"WITH RECURSIVE {_WALKS} SELECT graph_id, start, CAST(step AS INT) AS step, id FROM steps")
def graph_g05_greedy_paths(spark, d):
    e = edges(spark, d).where("resolved")
    return G.longest_path(G.greedy_paths(e, nodes(spark, d).where(FI.entry_name(F.col("id")))))


@query(f"WITH RECURSIVE {_WALKS}, l AS (SELECT *, {LANE_SQL('id')} AS lane FROM steps), c AS (SELECT *, CASE WHEN lane IS DISTINCT FROM lag(lane) OVER (PARTITION BY graph_id, start ORDER BY step) THEN 1 ELSE 0 END AS c FROM l), i AS (SELECT *, sum(c) OVER (PARTITION BY graph_id, start ORDER BY step) AS island FROM c) SELECT graph_id, start, CAST(island AS BIGINT) AS island, lane, string_agg(id, '|' ORDER BY step) AS ids FROM i GROUP BY 1, 2, 3, 4")
def graph_g06_lane_islands(spark, d):
    p = graph_g05_greedy_paths(spark, d)
    return G.lane_islands(p.withColumn("lane", FI.lane(F.col("id")))).withColumn("ids", F.array_join("ids", "|"))


@query(f"SELECT DISTINCT snapshot_id, path, CASE WHEN {ENTRY_SQL('path')} THEN 'entrypoint' WHEN {CORE_SQL('path')} THEN 'core' WHEN {CONFIG_SQL('path')} THEN 'config' END AS role FROM source_files WHERE role IS NOT NULL")
def set_u01_context_files(spark, d):
    return C.context_files(table(spark, d, "source_files"))


@query("SELECT DISTINCT repo_id FROM source_files EXCEPT SELECT repo_id FROM snapshots WHERE status = 'done'")
def set_u02_difference(spark, d):
    return table(spark, d, "source_files").select("repo_id").distinct().join(table(spark, d, "snapshots").where("status = 'done'").select("repo_id").distinct(), "repo_id", "left_anti")


@query("WITH s AS (SELECT DISTINCT snapshot_id, repo_id, created_at FROM snapshots) SELECT repo_id, snapshot_id, created_at FROM s QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, snapshot_id DESC) = 1")
def top_o08_latest_snapshot(spark, d):
    s = table(spark, d, "snapshots").select("repo_id", "created_at", "snapshot_id").distinct()
    return J.latest_versions(s, ["repo_id"], "created_at")


@query("WITH a AS (SELECT DISTINCT artifact_id, snapshot_id, kind, version, bytes FROM artifacts) SELECT snapshot_id, kind, version, artifact_id, bytes FROM a QUALIFY row_number() OVER (PARTITION BY snapshot_id, kind ORDER BY version DESC, artifact_id DESC) = 1")
def top_o09_latest_artifact(spark, d):
    a = table(spark, d, "artifacts").select("snapshot_id", "kind", "version", "artifact_id", "bytes").distinct()
    return J.latest_versions(a, ["snapshot_id", "kind"], "version")


@query("WITH f AS (SELECT DISTINCT snapshot_id, path, mtime FROM source_files) SELECT snapshot_id, path FROM f QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY len(string_split(path, '/')), mtime DESC, path) = 1")
def top_o12_shallowest_newest(spark, d):
    f = table(spark, d, "source_files").select("snapshot_id", "path", "mtime").distinct()
    return f.groupBy("snapshot_id").agg(F.min_by("path", F.struct(F.size(F.split("path", "/")), -F.col("mtime"), "path")).alias("path"))


# ---------------------------------------------------------------- texts


_redact_sql = "message"
for _words in ("api[_-]?key|secret|token|password|passwd|pwd", "auth[_-]?token|bearer[_-]?token|access[_-]?token", "private[_-]?key|public[_-]?key", "database[_-]?url|db[_-]?url|connection[_-]?string", "redis[_-]?url|mongodb[_-]?url"):
    _redact_sql = f"regexp_replace({_redact_sql}, '(?i)({_words})\\s*[:=]\\s*[\"'']?[^\\s\"'']+[\"'']?', '\\1=***REDACTED***', 'g')"


@query(f"SELECT DISTINCT warning_id, {_redact_sql} AS message FROM (SELECT warning_id, message || ' token=' || warning_id || '; Password: abc db_url=x' AS message FROM parse_warnings)")
def fn_redaction(spark, d):
    w = table(spark, d, "parse_warnings").select("warning_id", F.concat("message", F.lit(" token="), F.col("warning_id").cast("string"), F.lit("; Password: abc db_url=x")).alias("message")).distinct()
    return w.select("warning_id", X.redact(F.col("message")).alias("message"))


@query("SELECT DISTINCT path, array_to_string(regexp_extract_all(lower(path), '[a-zA-Z0-9_./-]+'), '|') AS tokens, string_split(path, '/')[-1] AS name FROM source_files")
def fn_tokens(spark, d):
    return table(spark, d, "source_files").select("path").distinct().select("path", F.array_join(X.tokens(F.col("path")), "|").alias("tokens"), F.element_at(F.split("path", "/"), -1).alias("name"))


def _clean_sql(e: str) -> str:
    """A path with one spelling: backslashes, repeated slashes and '.' go, eight folders at most are climbed."""
    out = f"regexp_replace(regexp_replace(replace(replace({e}, chr(92), '/'), '/./', '/'), '/+', '/', 'g'), '^(\\./)+', '')"
    for _ in range(8):
        out = f"regexp_replace({out}, '(^|/)(?:[^/.][^/]*|\\.[^/.][^/]*|\\.\\.[^/]+)/\\.\\./', '\\1')"
    return f"ltrim({out}, '/')"


@query(f"SELECT DISTINCT import_id, {_clean_sql('resolved')} AS path FROM imports WHERE resolved IS NOT NULL")
def fn_normalized_paths(spark, d):
    return table(spark, d, "imports").where("resolved is not null").select("import_id", normalized(F.col("resolved")).alias("path")).distinct()
