"""Queries over what the texts of files declare, and over the graph and capabilities made of it, with SQL where SQL can say it.

The SQL holds patterns and words of its own, so a wrong one here or there shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import capability as C
from quarryline.operators import detect as D
from quarryline.operators import files as FI
from quarryline.operators import graph as G
from quarryline.operators import manifest as M
from quarryline.operators import python_code as PY
from quarryline.operators import quality as Q
from quarryline.operators import resolve as R
from quarryline.operators import scripts as S
from quarryline.operators import search as SE
from quarryline.plans.code import EDGES, ENTRY_SQL, FILES, IMPORTS, LANE_SQL, NAME_SQL, edges, ext_sql, lang_sql, nodes, quote
from quarryline.session import checkpointed
from quarryline.sources.tables import latest_files, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def sources(spark, d):
    return table(spark, d, "source_files")


def joined(column: str):
    return F.array_join(column, ",").alias(column)


# ---------------------------------------------------------------- detectors

_LINES = (f"{FILES}, l AS (SELECT file_id, snapshot_id, path, {lang_sql('path')} AS language, unnest(range(1, len(t) + 1)) AS line, unnest(t) AS raw FROM (SELECT file_id, snapshot_id, path, string_split(text, chr(10)) AS t FROM files WHERE text IS NOT NULL)), "
          "x AS (SELECT file_id, snapshot_id, path, language, line, rtrim(raw, chr(13)) AS text FROM l)")
_JS, _PY, _BOTH = "('js', 'ts')", "('py')", "('js', 'ts', 'py')"
_V = "(get|post|put|delete|patch|options|head)"
_ARG = r"""\s*\(\s*['"]([^'"]+)['"]"""


def found_sql(*rules: tuple, upper: bool = False) -> str:
    """(detector, languages, pattern, item, name, confidence, hypothesis) rules over lines; items and names are groups or texts."""
    part = lambda p, g: f"regexp_extract(text, {quote(p)}, {g})" if isinstance(g, int) else quote(g)
    rows = [f"SELECT file_id, snapshot_id, path, CAST(line AS INT) AS line, '{n}' AS detector, {('upper(' + part(p, i) + ')') if upper else part(p, i)} AS item, {part(p, m)} AS name, CAST({c} AS DOUBLE) AS confidence, {str(h).lower()} AS hypothesis FROM x WHERE language IN {langs} AND regexp_matches(text, {quote(p)})"
            for n, langs, p, i, m, c, h in rules]
    return "SELECT DISTINCT * FROM (" + " UNION ALL ".join(rows) + ")"


_EXPRESS = [("express", _JS, r"(?i)(?:app|express)\." + _V + _ARG, 1, 2, 0.9, False), ("express", _JS, r"(?i)router\." + _V + _ARG, 1, 2, 0.9, False), ("express", _JS, r"(?i)(?:app|router)\.route" + _ARG + r"\s*\)\." + _V, 2, 1, 0.9, False)]
_LITERAL = ("literal", _JS, r"""(?i)\b(GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)\b\s*[:\s]*['"](/[^'"]*)['"]""", 1, 2, 0.3, True)
_REACT = [("react-router", _JS, r"""\{\s*path:\s*['"]([^'"]+)['"],\s*element:""", "GET", 1, 0.8, False), ("react-router", _JS, r"""<Route\s+path=['"]([^'"]+)['"]""", "GET", 1, 0.8, False)]
_FASTAPI = [("fastapi", _PY, r"^\s*@\w+\." + _V + _ARG, 1, 2, 0.95, False)]
_FLASK = [("flask", _PY, r"^\s*@\w+\.route" + _ARG, "GET", 1, 0.9, False)]
_DJANGO = [
    ("django", _PY, r"""path\s*\(\s*['"]([^'"]+)['"],\s*\w+""", "GET", 1, 0.9, False), ("django", _PY, r"""url\s*\(\s*r?['"]([^'"]+)['"]""", "GET", 1, 0.7, False), ("django-view", _PY, r"class\s+(\w+View)\s*\([^)]*View[^)]*\)", "GET", 1, 0.6, True),
    *[("django-rest", _PY, r"""router\.register\s*\(\s*['"]([^'"]+)['"],\s*\w+""", v, 1, 0.8, False) for v in ("GET", "POST", "PUT", "DELETE")]]
_JOBS = [
    ("bull", _JS, r"queue\.add" + _ARG, "add", 1, 0.9, False), ("bull", _JS, r"queue\.process" + _ARG, "process", 1, 0.9, False), ("agenda", _JS, r"agenda\.define" + _ARG, "define", 1, 0.9, False),
    ("job-name", _JS, r"function\s+(\w*[Jj]ob\w*)\s*\(", "function", 1, 0.3, True), ("job-name", _JS, r"const\s+(\w*[Jj]ob\w*)\s*=", "const", 1, 0.3, True)]
_ORM = [("prisma", _JS, r"model\s+(\w+)\s*\{", "model", 1, 0.95, False), ("typeorm", _JS, r"@Entity\s*\(\s*\)\s*class\s+(\w+)", "entity", 1, 0.9, False), ("sequelize", _JS, r"sequelize\.define" + _ARG, "define", 1, 0.9, False)]
_TABLES = [("sql", _BOTH, p, "sql", 1, 0.7, False) for p in (r"(?i)CREATE\s+TABLE\s+(\w+)", r"(?i)INSERT\s+INTO\s+(\w+)", r"(?i)UPDATE\s+(\w+)\s+SET", r"(?i)DELETE\s+FROM\s+(\w+)", r"(?i)SELECT\s+.*\s+FROM\s+(\w+)")]
_PYSTORES = [("sqlalchemy", _PY, r"class\s+(\w+)\s*\([^)]*Base[^)]*\)", "class", 1, 0.9, False), ("django", _PY, r"class\s+(\w+)\s*\([^)]*models\.Model[^)]*\)", "class", 1, 0.9, False)]
_SERVICES = {
    "stripe": "stripe", "aws": "aws-sdk|@aws-sdk", "sendgrid": "@sendgrid/mail", "twilio": "twilio", "firebase": "firebase", "mongodb": "mongodb", "redis": "redis|ioredis", "elasticsearch": "@elastic/elasticsearch", "postgres": "pg|postgres", "mysql": "mysql2"}
_SDKS = [("sdk", _JS, rf"""(?:import\s+.*from\s+|require\s*\(\s*)['"]({p})['"]""", 1, n, 0.9, False) for n, p in _SERVICES.items()]
_WRAPPER = ("wrapper", _JS, r"class\s+(\w*Service\w*)\s*\{", "class", 1, 0.5, True)
_ENV = ("env", _JS, r"process\.env\.(\w+)", "env", 1, 0.3, True)
_NO_ENV = "SELECT * FROM ({}) WHERE NOT (detector = 'env' AND lower(name) IN ('node_env', 'port', 'host', 'path'))"


def _detector(name: str, rules: list, *detectors: str, upper: bool = False) -> None:
    mine = [r for r in D.RULES if r.detector in detectors]
    sql = found_sql(*rules, upper=upper)
    query(f"WITH {_LINES} " + (_NO_ENV.format(sql) if "env" in detectors else sql), name)(lambda spark, d: D.detect(sources(spark, d), mine))


@query(f"WITH {_LINES}, s AS ({found_sql(*_EXPRESS, upper=True)}), t AS ({found_sql(_LITERAL, upper=True)}) SELECT * FROM s UNION ALL SELECT * FROM t WHERE file_id NOT IN (SELECT file_id FROM s)")
def text_d05_express_routes(spark, d):
    return D.express_routes(sources(spark, d))


_detector("text_d07_react_routes", _REACT, "react-router", upper=True)
_detector("text_d08_jobs", _JOBS, "bull", "agenda", "job-name")
_detector("text_d11_orm_stores", _ORM, "prisma", "typeorm", "sequelize")
_detector("text_d12_sql_tables", _TABLES, "sql")
_detector("text_d13_sdks", _SDKS, "sdk")
_detector("text_d14_wrappers", [_WRAPPER], "wrapper")
_detector("text_d15_env", [_ENV], "env")
_detector("text_d20_fastapi_routes", _FASTAPI, "fastapi", upper=True)
_detector("text_d21_flask_routes", _FLASK, "flask", upper=True)


@query(f"WITH {_LINES} {found_sql(*_DJANGO, upper=True)}")
def text_d22_django_routes(spark, d):
    return D.detect(sources(spark, d), [r for r in D.ROUTES if r.detector.startswith("django")])


@query(f"WITH {_LINES} {found_sql(*_PYSTORES)}")
def text_d24_python_stores(spark, d):
    return D.detect(sources(spark, d), [r for r in D.STORES if r.detector in ("sqlalchemy", "django")])


@query(f"WITH {_LINES} " + _NO_ENV.format(found_sql(*_JOBS, *_ORM, *_TABLES, *_PYSTORES, *_SDKS, _WRAPPER, _ENV)))
def set_u03_all_detections(spark, d):
    return D.detect(sources(spark, d), D.JOBS + D.STORES + D.EXTERNALS)


_METHODS = r"""list_distinct(list_transform(list_concat(regexp_extract_all(text, '(?i)export\s+(?:async\s+)?function\s+(GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)', 1), regexp_extract_all(text, '(?i)(?:const|let|var)\s+(GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)\s*=', 1)), lambda v: upper(v)))"""
_REST = lambda folder: f"list_transform(p[list_position(p, '{folder}') + 1:], lambda s: regexp_replace(s, '\\.(ts|tsx|js|jsx)$', ''))"


@query(f"""WITH {FILES}, f AS (SELECT file_id, path, string_split(path, '/') AS p, {_METHODS} AS found FROM files WHERE text IS NOT NULL AND {lang_sql('path')} IN ('js', 'ts')), m AS (SELECT *, CASE WHEN len(found) > 0 THEN found ELSE ['GET'] END AS verbs FROM f)
SELECT file_id, path, 'app' AS router, unnest(verbs) AS method, '/' || array_to_string(list_filter({_REST('app')}, lambda s: s <> 'page'), '/') AS route FROM m WHERE list_contains(p, 'app')
UNION SELECT file_id, path, 'pages', 'GET', '/' || array_to_string(list_filter({_REST('pages')}, lambda s: s <> 'index'), '/') FROM m WHERE list_contains(p, 'pages')
UNION SELECT file_id, path, 'api', unnest(verbs), '/api/' || array_to_string({_REST('api')}, '/') FROM m WHERE list_contains(p, 'api')""")
def text_d01_next_routes(spark, d):
    return D.next_routes(sources(spark, d))


# ---------------------------------------------------------------- scripts

_IMPORT = r"""(?m)^\s*import\s+(?:[^"']+from\s+)?['"]([^'"]+)['"]"""
_REQUIRE = r"""require\(\s*['"]([^'"]+)['"]\s*\)"""
_DYNAMIC = r"""\bimport\(\s*['"]([^'"]+)['"]\s*\)"""
_FUNCTION = r"function\s+([A-Za-z0-9_]+)\s*\("
_CLASS = r"(?m)^\s*(?:export\s+)?class\s+([A-Za-z0-9_]+)\s*"
_ARROW = r"(?m)^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z0-9_]+)\s*(?:\s*:\s*[^=]+)?=\s*(?:async\s*)?\(?[A-Za-z0-9_,\s{}:*=\[\]\.]*\)?\s*=>"
_ANON = r"(?m)^\s*export\s+default\s+(?:async\s+)?(?:function\s*\(|\(?[A-Za-z0-9_,\s{}:*=\[\]\.]*\)?\s*=>)"
_ALL = lambda p: f"regexp_extract_all(text, {quote(p)}, 1)"
_HAS = lambda p, t="text": f"regexp_matches({t}, {quote(p)})"
_SCRIPTS = f"{FILES}, f AS (SELECT *, {ext_sql('path')} AS x, lower(text) AS low FROM files WHERE text IS NOT NULL AND {lang_sql('path')} IN ('js', 'ts'))"


@query(f"WITH {_SCRIPTS} SELECT DISTINCT file_id, unnest({_ALL(_IMPORT)}) AS raw, 'esm' AS kind FROM f UNION SELECT file_id, unnest({_ALL(_REQUIRE)}), 'cjs' FROM f UNION SELECT file_id, unnest({_ALL(_DYNAMIC)}), 'esm' FROM f")
def text_e02_imports(spark, d):
    return S.imports_of(sources(spark, d))


def _first_seen(lists: str) -> str:
    """Distinct values of a list in the order of their first mention, as one text."""
    return f"array_to_string(list_filter({lists}, lambda v, i: list_position({lists}, v) = i), ',')"


_NAMES = f"list_concat({_ALL(_FUNCTION)}, {_ALL(_ARROW)})"


@query(f"WITH {_SCRIPTS}, n AS (SELECT *, {_NAMES} AS fs, {_ALL(_CLASS)} AS cs FROM f) SELECT file_id, CASE WHEN len(fs) = 0 AND {_HAS(_ANON)} THEN 'default' ELSE {_first_seen('fs')} END AS functions, {_first_seen('cs')} AS classes, "
       "CASE WHEN " + _HAS(r"(?m)^\s*export\s+(?:default|const|let|var|function|class)\b") + " THEN CASE WHEN " + _HAS(r"(?m)^\s*export\s+default\b") + " THEN 'default' ELSE 'named' END END AS exports FROM n")
def text_e02_symbols(spark, d):
    return S.profiles(sources(spark, d)).select("file_id", joined("functions"), joined("classes"), "exports")


_JSX = r"<[A-Za-z]|return\s*<"
_EXPRESS_HINT = "(contains(low, 'express') OR contains(text, 'app.get') OR contains(text, 'router.get'))"
_PAGES_HINT = "(contains(path, '/pages/') OR contains(path, '/app/'))"
_API_HINT = "(contains(path, '/pages/api/') OR (contains(path, '/app/') AND (contains(path, 'route.ts') OR contains(path, 'route.js'))))"
_COMPONENT = f"(x IN ('.tsx', '.jsx') AND {_HAS(_JSX)} AND ({_HAS('(?m)^\\s*export\\s+default\\b')} OR len(list_filter(list_concat({_ALL(_FUNCTION)}, {_ALL(_CLASS)}, {_ALL(_ARROW)}), lambda n: regexp_matches(n, '^[A-Z]'))) > 0))"
_FRAMEWORK = f"CASE WHEN {_EXPRESS_HINT} THEN 'express' WHEN {_PAGES_HINT} THEN 'nextjs' END"


@query(f"WITH {_SCRIPTS} SELECT file_id, {_FRAMEWORK} AS framework, ({_PAGES_HINT} OR {_EXPRESS_HINT}) AS is_route, {_COMPONENT} AS is_component, ({_API_HINT} OR {_EXPRESS_HINT}) AS is_api, (x IN ('.tsx', '.jsx') AND contains(text, '\"use client\"')) AS is_client FROM f")
def text_e08_hints(spark, d):
    return S.profiles(sources(spark, d)).select("file_id", "framework", "is_route", "is_component", "is_api", "is_client")


@query(f"WITH {FILES}, f AS (SELECT file_id, {ext_sql('path')} AS x, text, lower(text) AS low FROM files WHERE text IS NOT NULL) SELECT file_id, CASE WHEN x = '.py' THEN concat_ws(',', CASE WHEN {_HAS(r'\b(requests|urllib|httpx|aiohttp)\b', 'low')} THEN 'net' END, CASE WHEN {_HAS(r'\b(open|read|write|os\.|pathlib)\b', 'low')} THEN 'io' END, "
       f"CASE WHEN {_HAS(r'\b(sqlalchemy|django\.db|psycopg|pymongo|redis)\b', 'low')} THEN 'db' END, CASE WHEN {_HAS(r'\b(async|await)\b', 'low')} THEN 'async' END) ELSE concat_ws(',', CASE WHEN {_HAS(r'\b(fetch|axios|http\.request|xmlhttprequest|websocket)\b', 'low')} THEN 'net' END, "
       f"CASE WHEN {_HAS(r'\b(fs\.|readfile|writefile|stream|blob)\b', 'low')} THEN 'io' END, CASE WHEN {_HAS(r'\b(prisma|mongoose|mongodb|pg\.|knex|sequelize)\b', 'low')} THEN 'db' END, CASE WHEN x IN ('.tsx', '.jsx') AND {_HAS(_JSX)} THEN 'render' END) END AS effects FROM f")
def text_e09_side_effects(spark, d):
    return latest_files(sources(spark, d).where("text is not null"), F.array_join(S.effects_of(F.col("text"), F.col("path")), ",").alias("effects"))


_HOOKS = ["useState", "useEffect", "useContext", "useReducer", "useCallback", "useMemo", "useRef", "useImperativeHandle", "useLayoutEffect", "useDebugValue", "useDeferredValue", "useId", "useInsertionEffect", "useSyncExternalStore", "useTransition"]


@query(f"WITH {_SCRIPTS} SELECT file_id, CASE WHEN x IN ('.tsx', '.jsx') THEN concat_ws(',', " + ", ".join(f"CASE WHEN {_HAS(rf'\b{h}\b')} THEN '{h}' END" for h in _HOOKS) + ") ELSE '' END AS hooks, concat_ws(',', "
       + ", ".join(f"CASE WHEN {_FRAMEWORK} = 'nextjs' AND {_HAS(rf'export\s+(?:async\s+)?(?:const\s+)?(?:function\s+)?{e}\b')} THEN '{e}' END" for e in ("getServerSideProps", "getStaticProps", "getStaticPaths", "generateStaticParams", "generateMetadata", "generateViewport")) + ") AS special FROM f")
def text_e10_hooks(spark, d):
    return S.profiles(sources(spark, d)).select("file_id", joined("hooks"), joined("special"))


def _schema_sql(ext: str, kinds: list[tuple[str, str]], field: str) -> str:
    kept = "NOT regexp_matches(path, '(^|/)(node_modules|dist|build|\\.[^/]*)(/|$)')"
    one = lambda k, p: f"SELECT file_id, path, unnest(regexp_extract_all(text, {quote(p)}, 1)) AS name, '{k}' AS kind, unnest(regexp_extract_all(text, {quote(p)}, 2)) AS body FROM files WHERE text IS NOT NULL AND path LIKE '%{ext}' AND {kept}"
    return f"SELECT DISTINCT file_id, path, name, kind, array_to_string(regexp_extract_all(body, {quote(field)}, 1), ',') AS fields FROM (" + " UNION ALL ".join(one(*k) for k in kinds) + ")"


@query(f"WITH {FILES} " + _schema_sql(".ts", [("typescript.Interface", r"interface\s+(\w+)\s*\{([^}]+)\}"), ("typescript.Type", r"type\s+(\w+)\s*=\s*\{([^}]+)\}")], r"(\w+)(?:\?)?\s*:") + " UNION "
       + _schema_sql(".js", [("javascript.JoiSchema", r"const\s+(\w+)\s*=\s*Joi\.object\(\)\.keys\(\s*\{([^}]+)\}"), ("javascript.ZodSchema", r"const\s+(\w+)\s*=\s*z\.object\(\s*\{([^}]+)\}")], r"(\w+)\s*:"))
def text_e07_schemas(spark, d):
    return S.schemas(sources(spark, d)).withColumn("fields", joined("fields"))


_CALLS = r"""(get|post|put|delete|patch|options|head)\s*\(\s*['"]([^'"]+)['"]\s*,\s*(?:async\s+)?(function\s*\(|\([^)]*\)\s*=>|[\w_]+)"""
_EACH = lambda p, w: f"SELECT file_id, '{w}' AS framework, upper(unnest(regexp_extract_all(text, {quote(p)}, 1))) AS method, unnest(regexp_extract_all(text, {quote(p)}, 2)) AS route, unnest(regexp_extract_all(text, {quote(p)}, 3)) AS h FROM f WHERE {'' if w == 'koa' else 'NOT '}(contains(low, 'koa') AND NOT contains(low, 'express'))"


@query(f"WITH {_SCRIPTS}, r AS ({_EACH(r'(?:app|router)\.' + _CALLS, 'express')} UNION ALL {_EACH(r'router\.' + _CALLS, 'koa')}) SELECT file_id, framework, method, route, coalesce(min(CASE WHEN regexp_matches(h, '^\\w+$') AND h NOT IN ('async', 'function') THEN h END), 'anonymous') AS handler FROM r WHERE NOT regexp_matches(route, '^(config|getConfig)') GROUP BY 1, 2, 3, 4")
def text_e06_call_routes(spark, d):
    return S.call_routes(sources(spark, d))


_FOLDER = lambda of: f"array_to_string(p[list_position(p, '{of}') + 1:len(p) - 1], '/')"


@query(rf"""WITH {_SCRIPTS}, g AS (SELECT file_id, path, string_split(path, '/') AS p, {NAME_SQL('path')} AS n, list_distinct(list_transform(list_concat(regexp_extract_all(text, '(?i)export\s+(?:async\s+)?function\s+(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s*\(', 1), regexp_extract_all(text, '(?i)export\s+const\s+(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s*=', 1)), lambda v: upper(v))) AS verbs FROM f)
SELECT DISTINCT file_id, path, unnest(CASE WHEN n IN ('page.tsx', 'page.jsx') THEN ['GET'] WHEN len(verbs) > 0 THEN verbs ELSE ['ANY'] END) AS method, '/' || {_FOLDER('app')} AS route FROM g WHERE list_contains(p, 'app') AND n IN ('page.tsx', 'page.jsx', 'route.ts', 'route.js')
UNION SELECT file_id, path, CASE WHEN p[list_position(p, 'pages') + 1] = 'api' THEN 'ANY' ELSE 'GET' END, '/' || {_FOLDER('pages')} FROM g WHERE NOT list_contains(p, 'app') AND list_contains(p, 'pages') AND n <> 'pages'""")
def text_e04_page_routes(spark, d):
    return S.page_routes(sources(spark, d))


# ---------------------------------------------------------------- Python


def _items(spark, d):
    return PY.items(sources(spark, d))


@query()
def text_e12_python_items(spark, d):
    return _items(spark, d).where("item in ('import', 'function', 'class', 'route')").select("file_id", "path", "item", "name", "line", "detail")


@query()
def text_e15_django_and_middleware(spark, d):
    return _items(spark, d).where("item in ('django_model', 'middleware')").select("file_id", "path", "item", "name", "line")


@query()
def text_e17_pydantic_models(spark, d):
    return _items(spark, d).where("item = 'model'").select("file_id", "path", "name", F.explode_outer("fields").alias("f")).select("file_id", "path", "name", F.col("f.name").alias("field"), F.col("f.type").alias("type"), F.col("f.required").alias("required"), F.col("f.default").alias("default_value"))


@query()
def text_e18_collected_models(spark, d):
    return PY.collected_models(_items(spark, d)).select("name", "path", F.size("fields").alias("fields"))


@query()
def text_e19_sqlalchemy_tables(spark, d):
    return _items(spark, d).where("item = 'table'").select("file_id", "path", "name", F.col("detail").alias("table_name"), F.size("fields").alias("columns"))


@query()
def text_e20_route_details(spark, d):
    return PY.route_details(_items(spark, d)).withColumn("params", F.array_join(F.transform("params", lambda p: F.concat_ws(":", p["name"], p["annotation"])), ","))


@query()
def text_e21_request_schemas(spark, d):
    return PY.request_schemas(PY.route_details(_items(spark, d))).withColumn("fields", joined("fields"))


@query()
def join_j12_request_models(spark, d):
    found = _items(spark, d)
    return PY.link_request_models(PY.route_details(found), PY.collected_models(found)).select("name", "path", "route", "referenced_at")


@query()
def join_j13_response_models(spark, d):
    found = _items(spark, d)
    return PY.response_models(PY.route_details(found), PY.collected_models(found)).select("name", "path", "route")


@query()
def text_e24_policies(spark, d):
    return _items(spark, d).where("item = 'policy'").select("file_id", "path", "name", "line", "detail")


@query()
def text_d23_celery_tasks(spark, d):
    return _items(spark, d).where("item = 'task'").select("file_id", "path", "name", "line", F.col("detail").alias("producer"), (F.col("detail") == "unknown").alias("hypothesis"))


@query()
def text_e27_examples(spark, d):
    return PY.example_values(PY.collected_models(_items(spark, d)))


@query()
def text_e28_summaries(spark, d):
    return PY.file_summaries(sources(spark, d), _items(spark, d))


@query("""WITH f AS (SELECT path, lower(path) AS p, lower(text) AS t FROM source_files WHERE path LIKE '%.py' AND text IS NOT NULL) SELECT DISTINCT path, 'artifact' AS type, 'pdf' AS name, 'Generated PDF document' AS used_for FROM f WHERE contains(p, 'pdf') OR (contains(t, 'render') AND contains(t, 'pdf'))
UNION SELECT path, 'artifact', 'slides', 'Generated slides' FROM f WHERE contains(p, 'slides') OR contains(t, 'pptx') UNION SELECT path, 'email', 'transactional_email', 'Sends transactional email' FROM f WHERE contains(p, 'email') OR contains(t, 'sendgrid') OR contains(t, 'smtplib')""")
def text_e25_artifact_outputs(spark, d):
    return PY.artifact_outputs(sources(spark, d))


@query(rf"""WITH {FILES} SELECT DISTINCT file_id, unnest(list_concat(regexp_extract_all(text, 'os\.getenv\(\s*[''"]([A-Z0-9_]+)[''"]\s*\)', 1), regexp_extract_all(text, 'environ\[\s*[''"]([A-Z0-9_]+)[''"]\s*\]', 1))) AS key FROM files WHERE path LIKE '%.py' AND text IS NOT NULL""")
def text_e22_env_keys(spark, d):
    t = F.col("text")
    # How settings are read; those of settings classes are items of python_code.
    keys = F.array_distinct(F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in (r"os\.getenv\(\s*['\"]([A-Z0-9_]+)['\"]\s*\)", r"environ\[\s*['\"]([A-Z0-9_]+)['\"]\s*\]")]))
    text = latest_files(sources(spark, d).where("path like '%.py' and text is not null"), keys.alias("k")).select("file_id", F.explode("k").alias("key"))
    return text.unionByName(_items(spark, d).where("item = 'setting'").select("file_id", F.col("name").alias("key"))).distinct()


# ---------------------------------------------------------------- projections of what was read


def _profile(spark, d):
    """What is known of each script, with the counts of its imports: rows for blurbs, one per snapshot and path."""
    p = S.profiles(sources(spark, d)).groupBy("snapshot_id", "path").agg(F.max_by(F.struct("framework", "is_route", "is_component", "is_api", F.size("functions").alias("functions"), F.size("classes").alias("classes")), "file_id").alias("p")).select("snapshot_id", "path", "p.*")
    outer = F.coalesce("external", F.lit(True))
    i = table(spark, d, "imports").dropDuplicates(["import_id"]).groupBy("snapshot_id", F.col("from_path").alias("path")).agg(
        F.count_if(~outer).alias("internal"), F.count_if(outer).alias("external"),
        F.transform(F.slice(F.array_sort(F.collect_set(F.when(~outer, F.struct("ord", "import_id", F.element_at(F.split("raw", "/"), -1).alias("n"))))), 1, 3), lambda x: x["n"]).alias("internal_names"))
    return p.join(i, ["snapshot_id", "path"], "left").na.fill(0, ["internal", "external"]).withColumn("db_models", F.lit(0))


_PROFILE = f"""{_SCRIPTS}, h AS (SELECT file_id, snapshot_id, path, {_FRAMEWORK} AS framework, ({_PAGES_HINT} OR {_EXPRESS_HINT}) AS is_route, {_COMPONENT} AS is_component, ({_API_HINT} OR {_EXPRESS_HINT}) AS is_api, len(list_distinct({_NAMES})) AS fn, len(list_distinct({_ALL(_CLASS)})) AS cn, {_HAS(_ANON)} AS anon FROM f),
k AS (SELECT *, CASE WHEN fn = 0 AND anon THEN 1 ELSE fn END AS functions, cn AS classes FROM h QUALIFY row_number() OVER (PARTITION BY snapshot_id, path ORDER BY file_id DESC) = 1), {IMPORTS},
n AS (SELECT snapshot_id, from_path AS path, count(*) FILTER (WHERE NOT coalesce(external, true)) AS internal, count(*) FILTER (WHERE coalesce(external, true)) AS external, list(string_split(raw, '/')[-1] ORDER BY ord, import_id) FILTER (WHERE NOT coalesce(external, true)) AS names FROM imp GROUP BY 1, 2),
p AS (SELECT k.*, coalesce(n.internal, 0) AS internal, coalesce(n.external, 0) AS external, names FROM k LEFT JOIN n ON n.snapshot_id = k.snapshot_id AND n.path = k.path)"""


@query(f"""WITH {_PROFILE} SELECT snapshot_id, path, concat_ws('. ', concat_ws(' ', framework, CASE WHEN is_route THEN 'route' WHEN is_component THEN 'React component' WHEN is_api THEN 'API endpoint' ELSE 'file' END),
CASE WHEN functions > 0 AND classes > 0 THEN 'with ' || functions || ' function(s) and ' || classes || ' class(es)' WHEN functions > 0 THEN 'with ' || functions || ' function(s)' WHEN classes > 0 THEN 'with ' || classes || ' class(es)' END,
CASE WHEN internal > 0 AND external > 0 THEN 'imports ' || internal || ' internal and ' || external || ' external modules' WHEN internal > 0 THEN 'imports ' || internal || ' internal module(s)' WHEN external > 0 THEN 'imports ' || external || ' external module(s)' END,
CASE WHEN is_component AND internal > 0 THEN 'imports: ' || array_to_string(names[1:3], ', ') END, CASE WHEN is_component AND internal > 3 THEN 'and ' || (internal - 3) || ' more' END) || '.' AS blurb FROM p""")
def proj_p04_blurbs(spark, d):
    return FI.blurb(_profile(spark, d))


@query(f"WITH {_SCRIPTS} SELECT file_id, CASE WHEN {_PAGES_HINT} OR {_EXPRESS_HINT} THEN 'Route handler for ' || {NAME_SQL('path')} WHEN {_API_HINT} OR {_EXPRESS_HINT} THEN 'API endpoint in ' || {NAME_SQL('path')} WHEN {_COMPONENT} THEN 'React component ' || {NAME_SQL('path')} ELSE {lang_sql('path')} || ' file ' || {NAME_SQL('path')} END AS blurb FROM f")
def proj_p05_short_blurbs(spark, d):
    return S.profiles(sources(spark, d)).select("file_id", FI.short_blurb(F.col("path"), F.col("is_route"), F.col("is_api"), F.col("is_component")).alias("blurb"))


@query("""SELECT DISTINCT path, CASE WHEN contains(path, '/api/') OR contains(path, '/graphql/') OR contains(path, '/rpc/') THEN 'api' WHEN contains(path, '/workers/') OR contains(path, '/jobs/') OR contains(path, '/tasks/') THEN 'worker' WHEN contains(path, '/scheduler/') OR contains(path, '/cron/') OR contains(path, '/periodic/') THEN 'scheduler'
WHEN contains(path, '/cli/') OR contains(path, '/scripts/') OR contains(path, '/bin/') THEN 'cli' WHEN contains(path, '/app/') OR contains(path, '/pages/') THEN 'web' WHEN regexp_matches(lower(path), 'job|task') THEN 'worker' WHEN regexp_matches(lower(path), 'cli|script') THEN 'cli' ELSE 'web' END AS lane FROM source_files""")
def proj_p07_capability_lane(spark, d):
    return sources(spark, d).select("path").distinct().select("path", FI.capability_lane(F.col("path")).alias("lane"))


@query(f"""SELECT DISTINCT path, CASE WHEN regexp_matches(path, 'main\\.py|app\\.py|index\\.js|server\\.js') OR regexp_matches(path, 'routers/|routes/|api/') THEN 'entrypoint' ELSE 'service' END AS role,
CASE WHEN NOT regexp_matches(path, 'main\\.py|app\\.py|index\\.js|server\\.js') AND regexp_matches(path, 'routers/|routes/|api/') THEN 'api' ELSE {LANE_SQL('path')} END AS lane FROM source_files""")
def proj_p08_build_role(spark, d):
    role, lane = FI.build_role(F.col("path"))
    return sources(spark, d).select("path").distinct().select("path", role.alias("role"), lane.alias("lane"))


@query(f"WITH {_SCRIPTS} SELECT file_id, path FROM f WHERE {_PAGES_HINT} OR {_EXPRESS_HINT} OR {_API_HINT}")
def proj_p12_hinted_entrypoints(spark, d):
    return S.profiles(sources(spark, d)).where("is_route or is_api").select("file_id", "path")


@query(f"""WITH {_SCRIPTS} SELECT file_id, ({_PAGES_HINT} OR {_EXPRESS_HINT} OR {_API_HINT} OR regexp_matches(text, '@(app|router)\\.(get|post|put|delete|patch)') OR contains(lower(path), '/api/') OR contains(lower(path), '/page') OR list_has_any({_NAMES}, ['GET', 'POST', 'PUT', 'DELETE', 'PATCH'])) AS capability_entry FROM f""")
def proj_p13_capability_entry(spark, d):
    return S.profiles(sources(spark, d)).select("file_id", "capability_entry")


def _starts(spark, d):
    """Entrypoints by name, route, job or a function called main: (graph_id, id)."""
    f = sources(spark, d)
    found = D.detect(f, D.ROUTES + D.JOBS).select(F.col("snapshot_id").alias("graph_id"), "path", "detector")
    jobs = [r.detector for r in D.JOBS]
    main = S.profiles(f).select(F.col("snapshot_id").alias("graph_id"), "path", F.explode("functions").alias("name"))
    return C.entrypoints(f.select(F.col("snapshot_id").alias("graph_id"), "path").distinct(), found.where(~F.col("detector").isin(*jobs)), found.where(F.col("detector").isin(*jobs)), main)


_ROUTES = [*_EXPRESS, *_REACT, *_FASTAPI, *_FLASK, *_DJANGO]
_STARTS = f"""{_LINES}, routes AS ({found_sql(*_ROUTES, upper=True)}), jobs AS ({found_sql(*_JOBS)}), mains AS (SELECT snapshot_id, path FROM files WHERE text IS NOT NULL AND {lang_sql('path')} IN ('js', 'ts') AND list_contains({_NAMES}, 'main')),
starts AS (SELECT DISTINCT snapshot_id AS graph_id, path AS id FROM source_files WHERE {ENTRY_SQL('path')} UNION SELECT snapshot_id, path FROM routes UNION SELECT snapshot_id, path FROM jobs UNION SELECT snapshot_id, path FROM mains)"""


@query(f"WITH {_STARTS} SELECT graph_id, id FROM starts")
def set_u04_entrypoints(spark, d):
    return _starts(spark, d)


# ---------------------------------------------------------------- edges and capabilities


def all_edges(spark, d):
    """Edges of all kinds of the test tables: imports as given, the others as detected."""
    f = sources(spark, d)
    i = table(spark, d, "imports").dropDuplicates(["import_id"]).select(F.col("snapshot_id").alias("graph_id"), F.col("from_path").alias("path"), "raw", "resolved", "external", "confidence", "hypothesis", "reason_code", F.col("import_id").alias("ord"))
    found = checkpointed(D.detect(f, D.ROUTES + D.JOBS + D.STORES + D.EXTERNALS).withColumnsRenamed({"snapshot_id": "graph_id", "line": "ord"}))
    of = lambda rules: found.where(F.col("detector").isin(*{r.detector for r in rules}))
    by_item = lambda items: F.col("item").isin(*items)
    routes = of([r for r in D.ROUTES]).where(by_item(["GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD"])).select("*", F.col("item").alias("method"), F.col("name").alias("route"), F.expr("cast(array() as array<string>)").alias("middlewares"))
    jobs = of(D.JOBS).select("*", F.when(F.col("item") == "add", "queue.add").otherwise("unknown").alias("producer"), F.when(F.col("item") == "process", "queue.process").when(F.col("item") == "define", "agenda.define").otherwise("unknown").alias("consumer"))
    stores = of(D.STORES).where(~by_item(["GET", "POST", "PUT", "DELETE"]))
    p = S.profiles(f).select(F.col("snapshot_id").alias("graph_id"), "path", "functions", "classes", F.lit(1.0).alias("confidence"), F.lit(False).alias("hypothesis"), F.col("file_id").alias("ord"))
    return G.edges_by_kind(i, routes, jobs, stores, of(D.EXTERNALS), p.withColumn("name", F.explode("functions")), p.withColumn("name", F.explode("classes")))


_ALL_EDGES = f"""{_LINES}, {IMPORTS}, routes AS ({found_sql(*_ROUTES, upper=True)}), jobs AS ({found_sql(*_JOBS)}), stores AS ({found_sql(*_ORM, *_TABLES, *_PYSTORES)}), externals AS ({_NO_ENV.format(found_sql(*_SDKS, _WRAPPER, _ENV))}),
js AS (SELECT snapshot_id, path, CASE WHEN len({_NAMES}) = 0 AND {_HAS(_ANON)} THEN ['default'] ELSE list_distinct({_NAMES}) END AS fs, list_distinct({_ALL(_CLASS)}) AS cs FROM files WHERE text IS NOT NULL AND {lang_sql('path')} IN ('js', 'ts')),
ends AS (SELECT name, path, snapshot_id, CASE item WHEN 'add' THEN 'queue.add' END AS producer, CASE item WHEN 'process' THEN 'queue.process' WHEN 'define' THEN 'agenda.define' END AS consumer, confidence, hypothesis FROM jobs),
e AS (SELECT snapshot_id AS graph_id, from_path AS src, resolved AS dst, 'import' AS kind, coalesce(confidence, 0.5) AS confidence, coalesce(hypothesis, false) AS hypothesis FROM imp WHERE NOT coalesce(external, true) AND resolved IS NOT NULL UNION ALL SELECT snapshot_id, from_path, raw, 'import', 0.0, true FROM imp WHERE NOT coalesce(external, true) AND resolved IS NULL
UNION ALL SELECT snapshot_id, item || ':' || name, path, 'route', confidence, hypothesis FROM routes UNION ALL SELECT snapshot_id, name, path, 'job', confidence, hypothesis FROM ends UNION ALL SELECT snapshot_id, name, producer, 'job', confidence * 0.8, hypothesis FROM ends WHERE producer IS NOT NULL UNION ALL SELECT snapshot_id, name, consumer, 'job', confidence * 0.8, hypothesis FROM ends WHERE consumer IS NOT NULL
UNION ALL SELECT snapshot_id, path, name, 'store', confidence, hypothesis FROM stores UNION ALL SELECT snapshot_id, path, name, 'external', confidence, hypothesis FROM externals UNION ALL SELECT snapshot_id, path, unnest(fs), 'call', 1.0, false FROM js UNION ALL SELECT snapshot_id, path, unnest(cs), 'class', 1.0, false FROM js)"""


@query(f"WITH {_ALL_EDGES} SELECT DISTINCT graph_id, src, dst, kind, round(confidence, 6) AS confidence, hypothesis FROM e WHERE src IS NOT NULL AND dst IS NOT NULL AND dst <> ''")
def graph_g02_edges_by_kind(spark, d):
    return all_edges(spark, d).select("graph_id", "src", "dst", "kind", "confidence", "hypothesis").distinct()


@query(f"WITH {_ALL_EDGES} SELECT graph_id, kind, count(*) AS edges, count(DISTINCT src) AS sources FROM (SELECT DISTINCT * FROM e WHERE src IS NOT NULL AND dst IS NOT NULL AND dst <> '') GROUP BY 1, 2")
def graph_g04_kinds(spark, d):
    e = graph_g02_edges_by_kind(spark, d)
    return e.groupBy("graph_id", "kind").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"))


_WANTED = f"w AS (SELECT DISTINCT snapshot_id AS graph_id, path AS id FROM source_files WHERE {ENTRY_SQL('path')})"


@query(f"WITH {_ALL_EDGES}, {_WANTED}, b AS (SELECT graph_id, src AS id, dst AS other FROM e WHERE kind = 'store' UNION SELECT graph_id, dst, src FROM e WHERE kind = 'store') SELECT DISTINCT b.graph_id, b.id, b.other FROM b JOIN w ON w.graph_id = b.graph_id AND w.id = b.id WHERE other <> ''")
def join_j21_stores_of_entrypoints(spark, d):
    return G.other_ends(all_edges(spark, d), nodes(spark, d).where(FI.entry_name(F.col("id"))), "store")


_STATUS = "CASE WHEN hypothesis AND confidence < 0.3 THEN 'quarantined' WHEN hypothesis OR confidence < 0.5 THEN 'suggested' ELSE 'main' END"


@query(f"WITH {_ALL_EDGES}, {_WANTED}, s AS (SELECT DISTINCT graph_id, src, dst, kind, {_STATUS} AS status FROM (SELECT graph_id, src, dst, kind, round(confidence, 6) AS confidence, hypothesis FROM e) WHERE dst <> '' AND src IS NOT NULL) SELECT DISTINCT s.graph_id, w.id, src, dst, kind, status FROM s JOIN w ON w.graph_id = s.graph_id AND (w.id = s.src OR w.id = s.dst) WHERE status <> 'quarantined'")
def join_j22_control_flow(spark, d):
    return G.incident(all_edges(spark, d), nodes(spark, d).where(FI.entry_name(F.col("id"))))


@query(f"""WITH {_ALL_EDGES}, {_WANTED}, r AS (SELECT DISTINCT e.graph_id, e.dst AS id, e.src AS name, round(confidence, 6) AS confidence, hypothesis FROM e JOIN w ON w.graph_id = e.graph_id AND w.id = e.dst WHERE kind = 'route'),
o AS (SELECT DISTINCT e.graph_id, w.id, kind, CASE WHEN w.id = e.src THEN e.dst ELSE e.src END AS other FROM e JOIN w ON w.graph_id = e.graph_id AND (w.id = e.src OR w.id = e.dst) WHERE kind IN ('store', 'external') AND dst <> '')
SELECT graph_id, id, 'inputs' AS section, 'request' AS type, name, confidence, hypothesis FROM r UNION SELECT graph_id, id, 'outputs', 'response', name || ' Response', confidence, hypothesis FROM r UNION SELECT graph_id, id, 'stores', 'database', other, 0.8, false FROM o WHERE kind = 'store'
UNION SELECT graph_id, id, CASE WHEN regexp_matches(other, '^[A-Z][A-Z0-9_]*$') THEN 'inputs' ELSE 'externals' END, CASE WHEN regexp_matches(other, '^[A-Z][A-Z0-9_]*$') THEN 'environment' ELSE 'service' END, other, 0.7, true FROM o WHERE kind = 'external'""")
def graph_g11_data_flow(spark, d):
    return C.data_flow(nodes(spark, d).where(FI.entry_name(F.col("id"))), checkpointed(all_edges(spark, d)))


def _capabilities(spark, d):
    f = nodes(spark, d).withColumnRenamed("id", "path")
    return C.capabilities(nodes(spark, d).where(FI.entry_name(F.col("id"))), checkpointed(all_edges(spark, d)), f)


@query()
def graph_g08_capabilities(spark, d):
    return _capabilities(spark, d)


@query(f"WITH {_SCRIPTS}, r AS ({_EACH(r'(?:app|router)\.' + _CALLS, 'express')} UNION ALL {_EACH(r'router\.' + _CALLS, 'koa')}), k AS (SELECT file_id, method, route, coalesce(min(CASE WHEN regexp_matches(h, '^\\w+$') AND h NOT IN ('async', 'function') THEN h END), 'anonymous') AS handler FROM r WHERE NOT regexp_matches(route, '^(config|getConfig)') GROUP BY 1, 2, 3) SELECT DISTINCT f.snapshot_id AS graph_id, f.path AS src, k.handler AS dst, 'route' AS kind FROM k JOIN f ON f.file_id = k.file_id")
def graph_g10_control_flow(spark, d):
    names = sources(spark, d).select("file_id", F.col("snapshot_id").alias("graph_id"), "path").distinct()
    return C.control_flow(S.call_routes(sources(spark, d)).join(names, "file_id"))


@query()
def graph_g12_contracts(spark, d):
    names = sources(spark, d).select("file_id", F.col("snapshot_id").alias("graph_id")).distinct()
    models = _items(spark, d).where("item = 'model'").select("file_id", "path", "name", F.lit("pydantic.Model").alias("kind"))
    return C.contracts(models.join(names, "file_id"))


@query(f"SELECT DISTINCT substr(sha256(path || ':' || lane), 1, 16) AS capability_id, type, detail FROM ({SQL['proj_p07_capability_lane']}) , (VALUES ('cors', 'methods=GET,POST;origins=*;headers=Content-Type'), ('rateLimit', 'requests=100;window=1m')) AS t(type, detail) WHERE lane = 'api' AND {ENTRY_SQL('path')}")
def graph_g12_policies(spark, d):
    return C.policies(_capabilities(spark, d))


@query()
def graph_g13_steps(spark, d):
    return C.steps(_capabilities(spark, d))


@query(f"WITH {EDGES}, n AS (SELECT DISTINCT snapshot_id AS graph_id, path AS id FROM source_files), k AS (SELECT DISTINCT graph_id, src, dst FROM edges) SELECT k.graph_id, k.src, k.dst FROM k WHERE EXISTS (SELECT 1 FROM n WHERE n.graph_id = k.graph_id AND n.id = k.src) AND EXISTS (SELECT 1 FROM n WHERE n.graph_id = k.graph_id AND n.id = k.dst)")
def join_j30_picture(spark, d):
    none = nodes(spark, d).where("false")
    return G.assembled(nodes(spark, d), none, none, edges(spark, d))[1].select("graph_id", "src", "dst").distinct()


# ---------------------------------------------------------------- resolvers


@query()
def join_j03_resolve_by_language(spark, d):
    f = sources(spark, d).select("snapshot_id", "path", F.when(FI.file_name(F.col("path")) == "package.json", F.col("text")).alias("text")).distinct()
    return R.resolve_by_language(table(spark, d, "imports"), f, M.path_aliases(sources(spark, d)), M.packages(sources(spark, d)))


_MODULE = "replace(regexp_replace(regexp_replace(path, '\\.py$', ''), '/__init__$', ''), '/', '.')"


@query(f"WITH i AS (SELECT DISTINCT snapshot_id, {_MODULE} AS module, path FROM source_files WHERE path LIKE '%.py'), r AS (SELECT DISTINCT snapshot_id, raw AS ref FROM imports WHERE kind = 'py') SELECT DISTINCT r.snapshot_id, r.ref, coalesce(i.path, p.path) AS path FROM r LEFT JOIN i ON i.snapshot_id = r.snapshot_id AND i.module = string_split(r.ref, ':')[1] LEFT JOIN i p ON p.snapshot_id = r.snapshot_id AND p.path = string_split(r.ref, ':')[1]")
def join_j24_resolve_any(spark, d):
    refs = table(spark, d, "imports").where("kind = 'py'").select("snapshot_id", F.col("raw").alias("ref"))
    return R.resolve_any(refs, R.module_index(sources(spark, d)))


_TOPIC = """CASE WHEN contains(lower(path), 'domains') THEN CASE WHEN regexp_matches(tx, 'domain|domains|registration|search|add') THEN 40 WHEN regexp_matches(tx, 'demo|component|navigation|icon|svg') THEN -50 ELSE 0 END WHEN contains(lower(path), 'monitor') THEN CASE WHEN regexp_matches(tx, 'monitor|monitoring|status|health|uptime') THEN 40 ELSE 0 END
WHEN contains(lower(path), 'utils') THEN CASE WHEN regexp_matches(tx, 'utility|util|helper|tool|pg-api') THEN 40 ELSE 0 END WHEN contains(lower(path), 'services') THEN CASE WHEN regexp_matches(tx, 'service|business|logic|api|database') THEN 40 ELSE 0 END WHEN contains(lower(path), 'components') THEN CASE WHEN regexp_matches(tx, 'component|ui|interface|display') THEN 40 ELSE 0 END ELSE 0 END"""


@query(f"""WITH f AS (SELECT DISTINCT path, lower({NAME_SQL('path')}) AS n, string_split(lower({NAME_SQL('path')}), '.')[1] AS s FROM source_files WHERE string_split(lower({NAME_SQL('path')}), '.')[1] <> ''), s AS (SELECT message AS title, warning_id AS id FROM (SELECT DISTINCT warning_id, coalesce(file, '') || ' ' || coalesce(phase, '') AS message FROM parse_warnings)),
p AS (SELECT f.path, s.id, lower(title) AS t, lower('summary of ' || title) AS tx, n, s.title, f.s AS st FROM f, s), k AS (SELECT path, id, CASE WHEN contains(t, n) THEN 100 ELSE 0 END + CASE WHEN contains(t, st) THEN 80 ELSE 0 END + CASE WHEN contains(tx, n) THEN 60 ELSE 0 END + {_TOPIC.replace('tx', 't || tx')} AS score FROM p)
SELECT path, id, CAST(score AS INT) AS score FROM k WHERE score >= 80 QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, id) = 1""")
def join_j29_best_summaries(spark, d):
    w = table(spark, d, "parse_warnings").select(F.col("warning_id").alias("id"), F.concat_ws(" ", F.coalesce("file", F.lit("")), F.coalesce("phase", F.lit(""))).alias("title")).distinct()
    return SE.best_summaries(sources(spark, d).select("path"), w.select("id", "title", F.concat(F.lit("summary of "), "title").alias("purpose"), F.lit("").alias("detail")))


# ---------------------------------------------------------------- measures of what was read


@query(f"WITH {FILES}, n AS (SELECT snapshot_id, {lang_sql('path')} AS language, count(*) AS files, count(text) AS read_ FROM files GROUP BY 1, 2) SELECT snapshot_id, language, files, read_ AS parsed, files - read_ AS skipped, round(CAST(files - read_ AS DOUBLE) / greatest(files, 1), 6) AS skipped_ratio FROM n")
def agg_a07_metrics(spark, d):
    f = latest_files(sources(spark, d), "snapshot_id", F.col("path"), F.col("text").isNotNull().alias("_read"))
    n = f.groupBy("snapshot_id", FI.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("files"), F.count_if("_read").alias("parsed"))
    gone = F.col("files") - F.col("parsed")
    return n.select("snapshot_id", "language", "files", "parsed", gone.alias("skipped"), F.round(gone / F.greatest("files", F.lit(1)), 6).alias("skipped_ratio"))


@query(f"WITH {_LINES}, n AS (" + _NO_ENV.format(found_sql(*_JOBS, *_ORM, *_TABLES, *_PYSTORES, *_SDKS, _WRAPPER, _ENV)) + ") SELECT detector, count(*) AS items, count(DISTINCT file_id) AS files, count(*) FILTER (WHERE hypothesis) AS hypotheses FROM n GROUP BY 1")
def agg_a04_merge_summary(spark, d):
    return set_u03_all_detections(spark, d).groupBy("detector").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("file_id").alias("files"), F.count_if("hypothesis").alias("hypotheses"))


_SHARES = f"""{_SCRIPTS}, {IMPORTS}, i AS (SELECT snapshot_id, from_path AS path, count(*) AS n, count(resolved) AS r FROM imp GROUP BY 1, 2), k AS (SELECT DISTINCT snapshot_id, path, len({_NAMES}) > 0 OR {_HAS(_ANON)} AS fn FROM f QUALIFY row_number() OVER (PARTITION BY snapshot_id, path ORDER BY file_id DESC) = 1),
s AS (SELECT count(*) AS files, CAST(count(*) FILTER (WHERE i.n > 0) AS DOUBLE) / count(*) AS a, CAST(count(*) FILTER (WHERE fn) AS DOUBLE) / count(*) AS b, CAST(sum(r) AS DOUBLE) / sum(i.n) AS c FROM k LEFT JOIN i ON i.snapshot_id = k.snapshot_id AND i.path = k.path)"""


def _measured(spark, d):
    p = S.profiles(sources(spark, d)).groupBy("snapshot_id", "path").agg(F.max_by(F.size("functions") > 0, "file_id").alias("has_functions"))
    i = table(spark, d, "imports").dropDuplicates(["import_id"]).groupBy("snapshot_id", F.col("from_path").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.count("resolved").alias("r"))
    return p.join(i, ["snapshot_id", "path"], "left").select((F.coalesce("n", F.lit(0)) > 0).alias("has_imports"), "has_functions", F.coalesce("n", F.lit(0)).alias("imports"), F.coalesce("r", F.lit(0)).alias("resolved"))


@query(f"WITH {_SHARES} SELECT files, round(a, 6) AS import_share, round(b, 6) AS function_share, round(c, 6) AS resolved_share, round(a * 0.4 + b * 0.3 + c * 0.3, 6) AS overall FROM s")
def agg_a22_accuracy(spark, d):
    return Q.accuracy(_measured(spark, d))


@query(f"WITH {_SHARES} SELECT files, round(a, 6) AS import_share, round(b, 6) AS function_share, round(c, 6) AS resolved_share, round(a * 0.5 + b * 0.5, 6) AS overall FROM s")
def agg_a23_accuracy_of_two(spark, d):
    return Q.accuracy(_measured(spark, d), (0.5, 0.5, 0.0))


@query(f"""WITH {_SCRIPTS}, w AS (SELECT snapshot_id, file AS path, count(DISTINCT warning_id) AS warnings FROM parse_warnings WHERE file IS NOT NULL GROUP BY 1, 2), h AS (SELECT file_id, f.snapshot_id, f.path, ({_PAGES_HINT} OR {_EXPRESS_HINT}) AS rt, {_COMPONENT} AS cp, ({_API_HINT} OR {_EXPRESS_HINT}) AS api, len(list_distinct({_NAMES})) AS fn0, {_HAS(_ANON)} AS anon, len(list_distinct({_ALL(_CLASS)})) AS cn FROM f),
g AS (SELECT h.*, CASE WHEN fn0 = 0 AND anon THEN 1 ELSE fn0 END AS fn, coalesce(w.warnings, 0) AS wn, lower(h.path) AS lp FROM h LEFT JOIN w ON w.snapshot_id = h.snapshot_id AND w.path = h.path),
c AS (SELECT file_id, CASE WHEN wn > 0 OR contains(lp, 'compile') OR contains(lp, 'templates') THEN 'High' WHEN contains(lp, '/styles/') OR lp LIKE '%.css' THEN 'Med' WHEN rt OR api THEN 'High' WHEN cp THEN 'Med' WHEN fn > 0 AND cn > 0 THEN 'High' WHEN fn > 0 OR cn > 0 THEN 'Med' ELSE 'Low' END AS confidence,
CASE WHEN wn > 0 THEN 'Has ' || wn || ' warnings - likely needs attention' WHEN contains(lp, 'compile') THEN 'orchestrator' WHEN contains(lp, 'templates') THEN 'renderer entry point' WHEN contains(lp, '/styles/') OR lp LIKE '%.css' THEN 'print/layout might clip slides' WHEN rt OR api THEN 'Route/API file - critical for functionality' WHEN cp THEN 'React component - UI modification target'
WHEN fn > 0 AND cn > 0 THEN 'Contains ' || fn || ' functions and ' || cn || ' classes - high edit potential' WHEN fn > 0 THEN 'Contains ' || fn || ' functions - moderate edit potential' WHEN cn > 0 THEN 'Contains ' || cn || ' classes - moderate edit potential' ELSE 'General file for potential edits' END AS rationale FROM g)
SELECT * FROM c ORDER BY CASE confidence WHEN 'High' THEN 0 WHEN 'Med' THEN 1 ELSE 2 END, file_id LIMIT 20""")
def top_o02_suggestions(spark, d):
    w = table(spark, d, "parse_warnings").where("file is not null").groupBy("snapshot_id", F.col("file").alias("path")).agg(F.countDistinct("warning_id").alias("warnings"))
    p = S.profiles(sources(spark, d)).join(w, ["snapshot_id", "path"], "left")
    confidence, rationale = SE.suggestion_class(F.col("path"), F.size("functions"), F.size("classes"), F.col("is_route"), F.col("is_api"), F.col("is_component"), F.coalesce("warnings", F.lit(0)))
    return SE.suggestions(p.select("file_id", confidence.alias("confidence"), rationale.alias("rationale")), ["file_id"])


@query(f"""WITH {_LINES}, f AS (SELECT DISTINCT name FROM ({found_sql(*_TABLES)})), g AS (SELECT DISTINCT name FROM ({found_sql(*_TABLES)}) WHERE length(name) > 5) SELECT 'stores' AS section, round(CAST(count(g.name) AS DOUBLE) / greatest(count(*), 1), 6) AS precision, round(CAST(count(g.name) AS DOUBLE) / greatest(count(*), 1), 6) >= 0.8 AS passed FROM f LEFT JOIN g ON g.name = f.name""")
def agg_a09_stores_precision(spark, d):
    f = D.detect(sources(spark, d), [r for r in D.STORES if r.detector == "sql"])
    return Q.golden_precision(f, f.where("length(name) > 5"), "stores", "stores_precision")
