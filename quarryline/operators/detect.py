"""Detectors: what files declare, found line by line with a rule table in one pass over the text.

A detection is (file_id, snapshot_id, path, detector, item, name, line, confidence, hypothesis). Rules are regular
expressions that a single line satisfies; all rules are tried on a line within one generated expression, so a text is
split once however many rules there are. Declarations that Python's syntax tree tells are in ``python_code``.

Defined results: null texts yield nothing; a line may satisfy several rules; of a file that was delivered repeatedly
the last delivery counts, and which one that is is found on narrow rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.paths import language
from quarryline.sources.tables import last_deliveries


class Rule(NamedTuple):
    """One detector: languages it reads, its pattern with the groups of item and name (a text stands for itself), and how sure it is."""

    detector: str
    langs: tuple[str, ...]
    pattern: str
    confidence: float
    hypothesis: bool = False
    item: int | str = 1
    name: int | str = 2


_JS, _PY, _BOTH = ("js", "ts"), ("py",), ("js", "ts", "py")
_Q = r"\s*\(\s*['\"]([^'\"]+)['\"]"
# Verbs, services with their packages, settings of the environment that name no service, and patterns of declarations.
_VERBS = "(get|post|put|delete|patch|options|head)"
SDKS = {
    "stripe": ["stripe"], "aws": ["aws-sdk", "@aws-sdk"], "sendgrid": ["@sendgrid/mail"], "twilio": ["twilio"], "firebase": ["firebase"], "mongodb": ["mongodb"],
    "redis": ["redis", "ioredis"], "elasticsearch": ["@elastic/elasticsearch"], "postgres": ["pg", "postgres"], "mysql": ["mysql2"],
}
NO_SERVICE = ["node_env", "port", "host", "path"]
ROUTES = [
    Rule("express", _JS, r"(?i)(?:app|express)\." + _VERBS + _Q, 0.9),
    Rule("express", _JS, r"(?i)router\." + _VERBS + _Q, 0.9),
    Rule("express", _JS, r"(?i)(?:app|router)\.route" + _Q + r"\s*\)\." + _VERBS, 0.9, item=2, name=1),
    Rule("react-router", _JS, r"\{\s*path:\s*['\"]([^'\"]+)['\"],\s*element:", 0.8, item="GET", name=1),
    Rule("react-router", _JS, r"<Route\s+path=['\"]([^'\"]+)['\"]", 0.8, item="GET", name=1),
    Rule("fastapi", _PY, r"^\s*@\w+\." + _VERBS + _Q, 0.95),
    Rule("flask", _PY, r"^\s*@\w+\.route" + _Q, 0.9, item="GET", name=1),
    Rule("django", _PY, r"path\s*\(\s*['\"]([^'\"]+)['\"],\s*\w+", 0.9, item="GET", name=1),
    Rule("django", _PY, r"url\s*\(\s*r?['\"]([^'\"]+)['\"]", 0.7, item="GET", name=1),
    Rule("django-view", _PY, r"class\s+(\w+View)\s*\([^)]*View[^)]*\)", 0.6, True, item="GET", name=1),
    Rule("django-rest", _PY, r"router\.register\s*\(\s*['\"]([^'\"]+)['\"],\s*\w+", 0.8, item="GET,POST,PUT,DELETE", name=1),
]
LITERAL_ROUTES = [Rule("literal", _JS, r"(?i)\b(GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)\b\s*[:\s]*['\"](/[^'\"]*)['\"]", 0.3, True)]
JOBS = [
    Rule("bull", _JS, r"queue\.add" + _Q, 0.9, item="add", name=1),
    Rule("bull", _JS, r"queue\.process" + _Q, 0.9, item="process", name=1),
    Rule("agenda", _JS, r"agenda\.define" + _Q, 0.9, item="define", name=1),
    Rule("job-name", _JS, r"function\s+(\w*[Jj]ob\w*)\s*\(", 0.3, True, item="function", name=1),
    Rule("job-name", _JS, r"const\s+(\w*[Jj]ob\w*)\s*=", 0.3, True, item="const", name=1),
]
STORES = [
    Rule("prisma", _JS, r"model\s+(\w+)\s*\{", 0.95, item="model", name=1),
    Rule("typeorm", _JS, r"@Entity\s*\(\s*\)\s*class\s+(\w+)", 0.9, item="entity", name=1),
    Rule("sequelize", _JS, r"sequelize\.define" + _Q, 0.9, item="define", name=1),
    Rule("sqlalchemy", _PY, r"class\s+(\w+)\s*\([^)]*Base[^)]*\)", 0.9, item="class", name=1),
    Rule("django", _PY, r"class\s+(\w+)\s*\([^)]*models\.Model[^)]*\)", 0.9, item="class", name=1),
    *[Rule("sql", _BOTH, "(?i)" + p, 0.7, item="sql", name=1) for p in (r"CREATE\s+TABLE\s+(\w+)", r"INSERT\s+INTO\s+(\w+)", r"UPDATE\s+(\w+)\s+SET", r"DELETE\s+FROM\s+(\w+)", r"SELECT\s+.*\s+FROM\s+(\w+)")],
]
EXTERNALS = [
    *[Rule("sdk", _JS, r"(?:import\s+.*from\s+|require\s*\(\s*)['\"](" + "|".join(packages) + r")['\"]", 0.9, item=1, name=service) for service, packages in SDKS.items()],
    Rule("wrapper", _JS, r"class\s+(\w*Service\w*)\s*\{", 0.5, True, item="class", name=1),
    Rule("env", _JS, r"process\.env\.(\w+)", 0.3, True, item="env", name=1),
]
RULES = ROUTES + LITERAL_ROUTES + JOBS + STORES + EXTERNALS


def lines_of(files: DataFrame) -> DataFrame:
    """Lines of each delivery: (file_id, arrived_at, snapshot_id, path, language, line, text)."""
    rows = files.where("text is not null").select("file_id", "arrived_at", "snapshot_id", "path", language(F.col("path")).alias("language"), F.posexplode(F.split("text", "\n")).alias("_n", "text"))
    return rows.select("file_id", "arrived_at", "snapshot_id", "path", "language", (F.col("_n") + 1).alias("line"), F.rtrim("text", F.lit("\r")).alias("text"))


def _group(line: Column, rule: Rule, which: int | str) -> Column:
    return F.regexp_extract(line, rule.pattern, which) if isinstance(which, int) else F.lit(which)


def detect(files: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """All detections of the rules. Items are in capitals where they are verbs of routes; several items give several rows."""
    line = F.col("text")
    hits = [
        F.when(F.col("language").isin(*r.langs) & line.rlike(r.pattern), F.struct(
            F.lit(r.detector).alias("detector"), _group(line, r, r.item).alias("item"), _group(line, r, r.name).alias("name"), F.lit(r.confidence).alias("confidence"), F.lit(r.hypothesis).alias("hypothesis")))
        for r in rules
    ]
    out = lines_of(files).select("file_id", "arrived_at", "snapshot_id", "path", "line", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    out = out.select("file_id", "arrived_at", "snapshot_id", "path", "line", "h.detector", F.explode(F.split("h.item", ",")).alias("item"), "h.name", "h.confidence", "h.hypothesis")
    verbs = [r.detector for r in ROUTES + LITERAL_ROUTES]
    out = out.withColumn("item", F.when(F.col("detector").isin(*verbs), F.upper("item")).otherwise(F.col("item")))
    out = out.where((F.col("detector") != "env") | ~F.lower("name").isin(*NO_SERVICE))
    # detections are few: the deliveries that do not count are dropped here, not before the texts are read
    return out.join(last_deliveries(files), ["file_id", "arrived_at"], "left_semi").drop("arrived_at").distinct()


def express_routes(files: DataFrame) -> DataFrame:
    """Routes of calls; literals that look like routes count only in files without any such call."""
    found = detect(files, [r for r in ROUTES if r.detector == "express"] + LITERAL_ROUTES)
    called = F.max(F.col("detector") == "express").over(Window.partitionBy("file_id"))
    return found.withColumn("_called", called).where("detector = 'express' or not _called").drop("_called")


# ---------------------------------------------------------------- routes that paths declare

# How a file says which verbs it answers.
METHODS = [r"(?i)export\s+(?:async\s+)?function\s+(GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)", r"(?i)(?:const|let|var)\s+(GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)\s*="]


def http_methods(text: Column) -> Column:
    """Verbs that a file exports or defines, sorted; GET where it names none."""
    found = F.array_distinct(F.transform(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in METHODS]), F.upper))
    return F.when(F.size(found) > 0, F.array_sort(found)).otherwise(F.array(F.lit("GET")))


def _under(path: Column, folder: str, dropped: str) -> Column:
    """The route of what follows the first segment called ``folder``; '' where there is none."""
    parts = F.split(path, "/")
    rest = F.slice(parts, F.array_position(parts, folder).cast("int") + 1, F.size(parts))
    bare = F.transform(rest, lambda s: F.regexp_replace(s, r"\.(ts|tsx|js|jsx)$", ""))
    return F.array_join(F.filter(bare, lambda s: s != dropped) if dropped else bare, "/")


def next_routes(files: DataFrame) -> DataFrame:
    """Routes that paths declare below app, pages and api, one row per verb: (file_id, path, router, method, route)."""
    path = F.col("path")
    has = lambda folder: F.array_contains(F.split(path, "/"), folder)
    routers = F.array_compact(F.array(
        F.when(has("app"), F.struct(F.lit("app").alias("router"), F.concat(F.lit("/"), _under(path, "app", "page")).alias("route"), http_methods(F.col("text")).alias("methods"))),
        F.when(has("pages"), F.struct(F.lit("pages").alias("router"), F.concat(F.lit("/"), _under(path, "pages", "index")).alias("route"), F.array(F.lit("GET")).alias("methods"))),
        F.when(has("api"), F.struct(F.lit("api").alias("router"), F.concat(F.lit("/api/"), _under(path, "api", "")).alias("route"), http_methods(F.col("text")).alias("methods")))))
    rows = files.where(language(path).isin("js", "ts") & F.col("text").isNotNull())
    each = rows.select("file_id", "arrived_at", "path", F.explode(routers).alias("r")).select("file_id", "arrived_at", "path", "r.router", F.explode("r.methods").alias("method"), "r.route")
    return each.join(last_deliveries(files), ["file_id", "arrived_at"], "left_semi").drop("arrived_at").distinct()
