"""What Python files hold, by the syntax tree, and what follows from it by joins.

``items`` reads each text once and gives one row per finding: (file_id, path, item, name, line, detail, fields). Items are
import, function, class, route, model (pydantic), table (SQLAlchemy), django_model, middleware, task, setting, policy and
summary. Trees are local to a file, so inheritance within it is closed there, by a fixed point; everything that relates
files is a join.

Defined results: a text that does not parse yields no items; null texts neither; of repeated deliveries the last counts;
a field is (name, type, required, default), default being its source text.
"""

from __future__ import annotations

import ast
import sys
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.sources.tables import last_deliveries

ITEMS = (
    "file_id bigint, arrived_at timestamp_ntz, path string, item string, name string, line int, detail string, "
    "fields array<struct<name string, type string, required boolean, default string>>")
# Verbs of routes, words of job names, and what a class body of SQLAlchemy is told by.
VERBS = {"get", "post", "put", "delete", "patch"}
JOB_WORDS = ["task", "job", "worker", "process"]
COLUMN_CALLS = {"column", "mapped_column", "string", "integer", "boolean", "datetime", "text", "float"}
TABLE_BASES = ["base", "declarativebase", "model", "db"]
MIDDLEWARE = ["middleware"]


def _name(node: ast.AST | None) -> str:
    """The last name of a base, a decorator or an annotation."""
    if isinstance(node, ast.Subscript):
        return _name(node.value)
    if isinstance(node, ast.Call):
        return _name(node.func)
    return getattr(node, "id", getattr(node, "attr", ""))


def _text(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _fields(node: ast.ClassDef) -> list[tuple]:
    out = []
    for n in node.body:
        if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name):
            optional = isinstance(n.annotation, ast.Subscript) and _name(n.annotation) == "Optional"
            kind = _name(n.annotation.slice) or "Any" if optional else "Union" if isinstance(n.annotation, ast.BinOp) else _name(n.annotation) or "Any"
            out.append((n.target.id, kind, not optional and n.value is None, n.value and ast.unparse(n.value)))
    return out


def _columns(node: ast.ClassDef) -> list[tuple]:
    out = []
    for n in node.body:
        value, target = getattr(n, "value", None), (n.targets[0] if isinstance(n, ast.Assign) else n.target if isinstance(n, ast.AnnAssign) else None)
        if isinstance(value, ast.Call) and isinstance(target, ast.Name) and _name(value.func).lower() in COLUMN_CALLS:
            words = {k.arg: getattr(k.value, "value", None) for k in value.keywords}
            kind = (_name(value.args[0]) or _text(value.args[0]) or "Unknown") if value.args else "Unknown" if "column" in _name(value.func).lower() else _name(value.func)
            out.append((target.id, kind, words.get("nullable") is False or bool(words.get("primary_key")), "primary key" if words.get("primary_key") else None))
    return out


def _closed(bases: dict[str, list[str]], is_root) -> set[str]:
    """Classes that inherit from a root, also through others of the file; cycles end."""
    found = {c for c, bs in bases.items() if any(map(is_root, bs))}
    while more := {c for c, bs in bases.items() if c not in found and found & set(bs)}:
        found |= more
    return found


def _of_class(node: ast.ClassDef, models: set[str]) -> Iterator[tuple]:
    bases = [_name(b) for b in node.bases]
    yield "class", node.name, node.lineno, ",".join(ast.unparse(b) for b in node.bases), [(m.name, "method", False, None) for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
    if node.name in models:
        yield "model", node.name, node.lineno, ",".join(bases), _fields(node)
        if any("BaseSettings" in b for b in bases):
            for name, *_ in _fields(node):
                if name.isupper():
                    yield "setting", name, node.lineno, node.name, None
    if any(b == "Model" for b in bases):
        yield "django_model", node.name, node.lineno, ",".join(bases), [(n.targets[0].id, _name(n.value.func), True, None) for n in node.body if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and isinstance(n.targets[0], ast.Name)]
    named = next((_text(n.value) for n in node.body if isinstance(n, ast.Assign) and any(_name(t) == "__tablename__" for t in n.targets)), None)
    columns = _columns(node)
    if node.name not in models and not any("BaseSettings" in b for b in bases) and (named or columns or any(w in b.lower() for b in bases for w in TABLE_BASES)):
        yield "table", node.name, node.lineno, named or node.name.lower() + "s", columns
    if any(w in node.name.lower() for w in MIDDLEWARE) or any(getattr(m, "name", "") == "__call__" for m in node.body):
        yield "middleware", node.name, node.lineno, ",".join(bases), None


def _of_function(node: ast.FunctionDef | ast.AsyncFunctionDef) -> Iterator[tuple]:
    calls = list(dict.fromkeys(filter(None, (_name(c.func) for c in ast.walk(node) if isinstance(c, ast.Call)))))
    params = [(a.arg, _name(a.annotation) or None, True, None) for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]]
    yield "function", node.name, node.lineno, ",".join(calls), params
    tasked = False
    for d in node.decorator_list:
        bare = d.func if isinstance(d, ast.Call) else d
        what = _name(bare)
        if what in ("task", "shared_task"):
            tasked = True
            yield "task", node.name, node.lineno, ("shared_task" if what == "shared_task" else "task") + ".delay", None
        if not isinstance(bare, ast.Attribute) or what not in VERBS | {"route", "options", "head"}:
            continue
        path = (_text(d.args[0]) if d.args else None) if isinstance(d, ast.Call) else "/"  # a bare decorator answers the root
        if path is None:
            continue
        words = {k.arg: k.value for k in getattr(d, "keywords", [])}
        listed = words.get("methods")
        verbs = [v.upper() for e in getattr(listed, "elts", []) if (v := _text(e))] if what == "route" else [what.upper()]
        for verb in verbs or ["GET"]:
            yield "route", f"{verb} {path}", d.lineno, f"{node.name}:{_name(words['response_model']) if 'response_model' in words else ''}", params
        if "dependencies" in words:
            for e in getattr(words["dependencies"], "elts", []):
                yield "policy", _name(e.args[0]) if isinstance(e, ast.Call) and e.args else ast.unparse(e), d.lineno, "dependency", None
    for default in [*node.args.defaults, *filter(None, node.args.kw_defaults)]:
        if isinstance(default, ast.Call) and _name(default.func) in ("Depends", "Security"):
            yield "policy", _name(default.args[0]) if default.args else "", node.lineno, "security" if _name(default.func) == "Security" else "dependency", None
    if not tasked and any(w in node.name.lower() for w in JOB_WORDS):
        yield "task", node.name, node.lineno, "unknown", None


def read(text: str) -> Iterator[tuple]:
    """(item, name, line, detail, fields) of a text; nothing where it does not parse."""
    tree = ast.parse(text)
    nodes = [n for n in ast.walk(tree) if isinstance(n, (ast.ClassDef, ast.Call))]
    classes = {n.name: [_name(b) for b in n.bases] for n in nodes if isinstance(n, ast.ClassDef)}
    models = _closed(classes, lambda b: "BaseModel" in b or "BaseSettings" in b)
    if doc := ast.get_docstring(tree):
        yield "summary", doc.strip().split("\n")[0], 1, "docstring", None
    for node in tree.body:
        if isinstance(node, ast.Import):
            yield from (("import", a.name, node.lineno, a.asname or "", None) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield "import", "." * node.level + (node.module or ""), node.lineno, ",".join(a.name for a in node.names), None
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield from _of_function(node)
    for node in nodes:
        if isinstance(node, ast.ClassDef):
            yield from _of_class(node, models)
        elif _name(node.func) == "add_middleware" and node.args:
            words = {k.arg: k.value for k in node.keywords}
            yield "policy", _name(node.args[0]), node.lineno, "cors:" + ast.unparse(words["allow_origins"]) if "allow_origins" in words else "middleware", None


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    warnings.simplefilter("ignore")
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    for pdf in batches:
        rows = []
        for file_id, at, path, text in zip(pdf.file_id, pdf.arrived_at, pdf.path, pdf.text):
            try:
                rows += [(file_id, at, path, *i) for i in read(text)]
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                continue
        yield pd.DataFrame(rows, columns=["file_id", "arrived_at", "path", "item", "name", "line", "detail", "fields"])


def items(files: DataFrame) -> DataFrame:
    """(file_id, path, item, name, line, detail, fields) of all Python files. Only findings are shuffled."""
    rows = files.where("text is not null and path like '%.py'").select("file_id", F.col("arrived_at").cast("timestamp_ntz").alias("arrived_at"), "path", "text")
    found = rows.mapInPandas(_read, ITEMS)
    return found.join(last_deliveries(files), ["file_id", "arrived_at"], "left_semi").drop("arrived_at").distinct()


def route_details(found: DataFrame) -> DataFrame:
    """(file_id, path, method, route, handler, response_model, line, params) of the routes."""
    r = found.where("item = 'route'")
    return r.select("file_id", "path", F.substring_index("name", " ", 1).alias("method"), F.expr("substring(name, instr(name, ' ') + 1)").alias("route"), F.substring_index("detail", ":", 1).alias("handler"),
                    F.nullif(F.element_at(F.split("detail", ":"), 2), F.lit("")).alias("response_model"), "line", F.transform("fields", lambda p: F.struct(p["name"].alias("name"), p["type"].alias("annotation"))).alias("params"))


def collected_models(found: DataFrame, item: str = "model") -> DataFrame:
    """The last class of each name, by path: (name, path, fields)."""
    m = found.where(F.col("item") == item)
    return m.groupBy("name").agg(F.max_by(F.struct("path", "fields"), F.struct("path", "file_id", "line")).alias("_m")).select("name", "_m.*")


def link_request_models(routes: DataFrame, models: DataFrame) -> DataFrame:
    """Models that parameters of routes are annotated with: (name, path, route, referenced_at, fields), once per name, path and route.

    The first reference stays. routes as from route_details(), models(name, path, fields).
    """
    asked = routes.select(F.col("path").alias("_file"), "line", "route", F.explode("params").alias("p")).select("_file", "line", "route", F.col("p.annotation").alias("name")).where("name is not null")
    hit = asked.join(models, "name").withColumn("referenced_at", F.concat_ws(":", "_file", F.col("line").cast("string")))
    return hit.groupBy("name", "path", "route").agg(F.min_by(F.struct("referenced_at", "fields"), F.struct("_file", "line")).alias("_r")).select("name", "path", "route", "_r.*")


def response_models(routes: DataFrame, models: DataFrame) -> DataFrame:
    """Models that routes answer with, one row per route: (name, path, route, fields)."""
    return routes.where("response_model is not null").select("route", F.col("response_model").alias("name")).join(models, "name").select("name", "path", "route", "fields")


def request_schemas(routes: DataFrame) -> DataFrame:
    """Schemas of routes made of their parameters outside the path: (name, path, route, fields); none where all are in it."""
    inside = F.regexp_extract_all("route", F.lit(r"(?:^|/)\{([^/{}]*)\}(?=/|$)"), F.lit(1))
    fields = F.array_except(F.transform("params", lambda p: p["name"]), inside)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.py$", "")
    return routes.select(F.concat(stem, F.lit("."), "handler", F.lit("Request")).alias("name"), "path", "route", fields.alias("fields")).where(F.size("fields") > 0)


def artifact_outputs(files: DataFrame) -> DataFrame:
    """Outputs that paths and texts speak of: (path, type, name, used_for), once each."""
    p, t = F.lower("path"), F.lower("text")
    has = lambda c, w: F.contains(c, F.lit(w))
    # Words of outputs.
    rules = [
        (has(p, "pdf") | (has(t, "render") & has(t, "pdf")), "artifact", "pdf", "Generated PDF document"), (has(p, "slides") | has(t, "pptx"), "artifact", "slides", "Generated slides"),
        (has(p, "email") | has(t, "sendgrid") | has(t, "smtplib"), "email", "transactional_email", "Sends transactional email")]
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(a).alias("type"), F.lit(b).alias("name"), F.lit(u).alias("used_for"))) for c, a, b, u in rules]))
    return files.where("path like '%.py' and text is not null").select("path", F.explode(hits).alias("o")).select("path", "o.*").distinct()


def file_summaries(files: DataFrame, found: DataFrame) -> DataFrame:
    """The first line of a module's docstring, else a sentence from its path: (file_id, path, summary)."""
    doc = found.where("item = 'summary'").groupBy("file_id").agg(F.min("name").alias("_doc"))
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    told = F.when(folder == "", F.concat(F.lit("Python module "), name)).otherwise(F.concat(F.lit("Python module "), name, F.lit(" in "), folder))
    rows = files.where("path like '%.py'").select("file_id", "path").distinct()
    return rows.join(doc, "file_id", "left").select("file_id", "path", F.coalesce("_doc", told).alias("summary"))


# Sample values by a part of the type's name, first match.
EXAMPLES = [("email", "user@example.com"), ("url", "https://example.com"), ("int", "1"), ("float", "1.0"), ("bool", "true"), ("datetime", "2024-01-01T00:00:00Z"), ("date", "2024-01-01"), ("list", "[]"), ("dict", "{}"), ("str", "string")]


def example_values(models: DataFrame) -> DataFrame:
    """A sample value for every field of every model: (model, field, type, example)."""
    each = models.select(F.col("name").alias("model"), F.explode("fields").alias("f")).select("model", F.col("f.name").alias("field"), F.coalesce("f.type", F.lit("Any")).alias("type"))
    out = F.lit("value")
    for part, value in reversed(EXAMPLES):
        out = F.when(F.contains(F.lower("type"), F.lit(part)), value).otherwise(out)
    return each.select("model", "field", "type", out.alias("example"))
