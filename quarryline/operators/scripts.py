"""What JavaScript and TypeScript files hold: imports, exports, functions, classes, hooks, hints, effects, schemas.

Everything is told by expressions over the whole text within the scan; what is shuffled afterwards are names. Defined
results: null texts yield nothing; of repeated deliveries the last counts; names keep the order of their first mention.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.paths import extension, language
from quarryline.operators.files import holds
from quarryline.sources.tables import latest_files

# Patterns of imports, exports, functions, classes and of JSX.
IMPORT = r"(?m)^\s*import\s+(?:[^\"']+from\s+)?['\"]([^'\"]+)['\"]"
REQUIRE = r"require\(\s*['\"]([^'\"]+)['\"]\s*\)"
DYNAMIC = r"\bimport\(\s*['\"]([^'\"]+)['\"]\s*\)"
EXPORT_DEFAULT, EXPORT_ANY = r"(?m)^\s*export\s+default\b", r"(?m)^\s*export\s+(?:default|const|let|var|function|class)\b"
FUNCTION, CLASS = r"function\s+([A-Za-z0-9_]+)\s*\(", r"(?m)^\s*(?:export\s+)?class\s+([A-Za-z0-9_]+)\s*"
ARROW = r"(?m)^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z0-9_]+)\s*(?:\s*:\s*[^=]+)?=\s*(?:async\s*)?\(?[A-Za-z0-9_,\s{}:*=\[\]\.]*\)?\s*=>"
ANONYMOUS = r"(?m)^\s*export\s+default\s+(?:async\s+)?(?:function\s*\(|\(?[A-Za-z0-9_,\s{}:*=\[\]\.]*\)?\s*=>)"
JSX = r"<[A-Za-z]|return\s*<"
# Hooks of React, special exports of Next.js.
HOOKS = [
    "useState", "useEffect", "useContext", "useReducer", "useCallback", "useMemo", "useRef", "useImperativeHandle", "useLayoutEffect",
    "useDebugValue", "useDeferredValue", "useId", "useInsertionEffect", "useSyncExternalStore", "useTransition",
]
SPECIAL = ["getServerSideProps", "getStaticProps", "getStaticPaths", "generateStaticParams", "generateMetadata", "generateViewport"]
# Words that speak of effects, in texts of lower case.
EFFECTS = {"net": r"\b(fetch|axios|http\.request|xmlhttprequest|websocket)\b", "io": r"\b(fs\.|readfile|writefile|stream|blob)\b", "db": r"\b(prisma|mongoose|mongodb|pg\.|knex|sequelize)\b"}
PYTHON_EFFECTS = {"net": r"\b(requests|urllib|httpx|aiohttp)\b", "io": r"\b(open|read|write|os\.|pathlib)\b", "db": r"\b(sqlalchemy|django\.db|psycopg|pymongo|redis)\b", "async": r"\b(async|await)\b"}


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _labelled(values: Column, kind: str) -> Column:
    return F.transform(values, lambda v: F.struct(v.alias("raw"), F.lit(kind).alias("kind")))


def imports_of(files: DataFrame) -> DataFrame:
    """Imports as the text names them: (file_id, raw, kind), kind being esm, cjs or, for dynamic ones, esm."""
    t = F.col("text")
    kinds = F.concat(*[_labelled(F.array_distinct(_all(t, p)), k) for p, k in ((IMPORT, "esm"), (REQUIRE, "cjs"), (DYNAMIC, "esm"))])
    rows = files.where(language(F.col("path")).isin("js", "ts"))
    return latest_files(rows, kinds.alias("found")).select("file_id", F.explode("found").alias("i")).select("file_id", "i.raw", "i.kind").distinct()


def functions_of(text: Column) -> Column:
    """Names of functions, arrows after declarations; 'default' where only an anonymous one is exported."""
    named = F.array_distinct(F.concat(_all(text, FUNCTION), _all(text, ARROW)))
    return F.when((F.size(named) == 0) & text.rlike(ANONYMOUS), F.array(F.lit("default"))).otherwise(named)


def exports_of(text: Column) -> Column:
    """default, named or null."""
    return F.when(text.rlike(EXPORT_ANY), F.when(text.rlike(EXPORT_DEFAULT), "default").otherwise("named"))


def hooks_of(text: Column, ext: Column) -> Column:
    return F.array_compact(F.array(*[F.when(ext.isin(".tsx", ".jsx") & text.rlike(rf"\b{h}\b"), h) for h in HOOKS]))


def effects_of(text: Column, path: Column) -> Column:
    """net, io, db and render of scripts; net, io, db and async of Python."""
    low, ext = F.lower(text), extension(path)
    script = [F.when(low.rlike(p), n) for n, p in EFFECTS.items()] + [F.when(ext.isin(".tsx", ".jsx") & text.rlike(JSX), "render")]
    python = [F.when(low.rlike(p), n) for n, p in PYTHON_EFFECTS.items()]
    return F.when(ext == ".py", F.array_compact(F.array(*python))).otherwise(F.array_compact(F.array(*script)))


def hints_of(path: Column, text: Column) -> dict[str, Column]:
    """framework, is_route, is_component, is_api and is_client of a script; what speaks for Express goes before Next.js."""
    ext = extension(path)
    pages = holds(path, ["/pages/", "/app/"])
    express = F.contains(F.lower(text), F.lit("express")) | holds(text, ["app.get", "router.get"])
    api = F.contains(path, F.lit("/pages/api/")) | (F.contains(path, F.lit("/app/")) & holds(path, ["route.ts", "route.js"]))
    names = F.concat(_all(text, FUNCTION), _all(text, CLASS), _all(text, ARROW))
    component = ext.isin(".tsx", ".jsx") & text.rlike(JSX) & (text.rlike(EXPORT_DEFAULT) | F.exists(names, lambda n: n.rlike("^[A-Z]")))
    return {
        "framework": F.when(express, "express").when(pages, "nextjs"), "is_route": pages | express, "is_component": component, "is_api": api | express,
        "is_client": ext.isin(".tsx", ".jsx") & F.contains(text, F.lit('"use client"'))}


def profiles(files: DataFrame) -> DataFrame:
    """One row per script: (file_id, snapshot_id, path, exports, functions, classes, hooks, special, effects, framework, is_route, is_component, is_api, is_client, capability_entry)."""
    t, p = F.col("text"), F.col("path")
    hints = hints_of(p, t)
    functions = functions_of(t)
    special = F.array_compact(F.array(*[F.when((hints["framework"] == "nextjs") & t.rlike(rf"export\s+(?:async\s+)?(?:const\s+)?(?:function\s+)?{s}\b"), s) for s in SPECIAL]))
    # What makes a file worth an entry of its own.
    entry = hints["is_route"] | hints["is_api"] | t.rlike(r"@(app|router)\.(get|post|put|delete|patch)") | holds(F.lower(p), ["/api/", "/page"]) | F.arrays_overlap(functions, F.array(*map(F.lit, ["GET", "POST", "PUT", "DELETE", "PATCH"])))
    rows = files.where(language(p).isin("js", "ts") & t.isNotNull())
    return latest_files(
        rows, "snapshot_id", "path", exports_of(t).alias("exports"), functions.alias("functions"), F.array_distinct(_all(t, CLASS)).alias("classes"), hooks_of(t, extension(p)).alias("hooks"), special.alias("special"),
        effects_of(t, p).alias("effects"), *[c.alias(n) for n, c in hints.items()], entry.alias("capability_entry"))


def _bodies(files: DataFrame, where: Column, kinds: list[tuple[str, str]], field: str) -> DataFrame:
    """Named bodies with their fields: (file_id, path, name, kind, fields)."""
    t = F.col("text")
    def bodies(kind: str, pattern: str) -> Column:
        return F.arrays_zip(_all(t, pattern, 1).alias("name"), _all(t, pattern, 2).alias("body"), F.transform(_all(t, pattern, 1), lambda _: F.lit(kind)).alias("kind"))

    found = F.concat(*[bodies(k, p) for k, p in kinds])
    each = latest_files(files.where(where & t.isNotNull()), "path", F.transform(found, lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"), F.regexp_extract_all(x["body"], F.lit(field), F.lit(1)).alias("fields"))).alias("b"))
    return each.select("file_id", "path", F.explode("b").alias("b")).select("file_id", "path", "b.*")


def schemas(files: DataFrame) -> DataFrame:
    """Interfaces and object types of TypeScript, Joi and Zod schemas of JavaScript: (file_id, path, name, kind, fields).

    A body ends at its first closing brace; built and hidden folders are left out.
    """
    p = F.col("path")
    kept = ~p.rlike(r"(^|/)(node_modules|dist|build|\.[^/]*)(/|$)")
    # Kinds with the patterns of name and body, and of fields.
    typed = [("typescript.Interface", r"interface\s+(\w+)\s*\{([^}]+)\}"), ("typescript.Type", r"type\s+(\w+)\s*=\s*\{([^}]+)\}")]
    plain = [("javascript.JoiSchema", r"const\s+(\w+)\s*=\s*Joi\.object\(\)\.keys\(\s*\{([^}]+)\}"), ("javascript.ZodSchema", r"const\s+(\w+)\s*=\s*z\.object\(\s*\{([^}]+)\}")]
    return _bodies(files, kept & p.endswith(".ts"), typed, r"(\w+)(?:\?)?\s*:").unionByName(_bodies(files, kept & p.endswith(".js"), plain, r"(\w+)\s*:")).distinct()


# Routes with a handler, of Express and Koa; paths of settings are none.
_HANDLER = r"\s*,\s*(?:async\s+)?(function\s*\(|\([^)]*\)\s*=>|[\w_]+)"
CALLS = [("express", r"(?:app|router)\.(get|post|put|delete|patch|options|head)\s*\(\s*['\"]([^'\"]+)['\"]" + _HANDLER), ("koa", r"router\.(get|post|put|delete|patch|options|head)\s*\(\s*['\"]([^'\"]+)['\"]" + _HANDLER)]


def call_routes(files: DataFrame) -> DataFrame:
    """Routes of calls with a handler: (file_id, framework, method, route, handler), once per method and route.

    A named handler goes before 'anonymous'; calls of a router are Koa's where the text speaks of Koa and not of Express.
    """
    t = F.col("text")
    koa = F.contains(F.lower(t), F.lit("koa")) & ~F.contains(F.lower(t), F.lit("express"))
    zipped = lambda p: F.arrays_zip(_all(t, p, 1).alias("method"), _all(t, p, 2).alias("route"), _all(t, p, 3).alias("handler"))
    found = F.when(koa, zipped(CALLS[1][1])).otherwise(zipped(CALLS[0][1]))
    rows = latest_files(files.where(language(F.col("path")).isin("js", "ts") & t.isNotNull()), F.when(koa, "koa").otherwise("express").alias("framework"), found.alias("r"))
    each = rows.select("file_id", "framework", F.explode("r").alias("r")).where(~F.col("r.route").rlike("^(config|getConfig)"))
    handler = F.when(F.col("r.handler").rlike(r"^\w+$") & ~F.col("r.handler").isin("async", "function"), F.col("r.handler")).otherwise("anonymous")
    return each.select("file_id", "framework", F.upper("r.method").alias("method"), F.col("r.route").alias("route"), handler.alias("handler")).groupBy("file_id", "framework", "method", "route").agg(
        F.min_by("handler", F.struct((F.col("handler") == "anonymous"), F.col("handler"))).alias("handler"))


def page_routes(files: DataFrame) -> DataFrame:
    """Routes of Next.js by folder and file name: (file_id, path, method, route); layouts are none.

    Below app a page answers GET and a route file the verbs it exports, ANY without; below pages an api folder answers
    ANY and all else GET. The route is the folder.
    """
    p, t = F.col("path"), F.col("text")
    parts, name = F.split(p, "/"), F.element_at(F.split(p, "/"), -1)

    def folder(of: str) -> Column:
        at = F.array_position(parts, of).cast("int")
        return F.array_join(F.slice(parts, at + 1, F.greatest(F.size(parts) - at - 1, F.lit(0))), "/")

    in_app = F.array_contains(parts, "app")
    verbs = F.array_sort(F.array_distinct(F.transform(F.concat(_all(t, r"(?i)export\s+(?:async\s+)?function\s+(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s*\("), _all(t, r"(?i)export\s+const\s+(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s*=")), F.upper)))
    below = F.element_at(parts, F.array_position(parts, "pages").cast("int") + 1)
    methods = (
        F.when(in_app & name.isin("page.tsx", "page.jsx"), F.array(F.lit("GET"))).when(in_app & name.isin("route.ts", "route.js"), F.when(F.size(verbs) > 0, verbs).otherwise(F.array(F.lit("ANY"))))
        .when(~in_app & F.array_contains(parts, "pages") & (name != "pages"), F.when(below == "api", F.array(F.lit("ANY"))).otherwise(F.array(F.lit("GET")))))
    route = F.concat(F.lit("/"), F.when(in_app, folder("app")).otherwise(folder("pages")))
    rows = latest_files(files.where(language(p).isin("js", "ts") & t.isNotNull()), "path", methods.alias("m"), route.alias("route"))
    return rows.select("file_id", "path", F.explode("m").alias("method"), "route").distinct()



