from datetime import datetime as T

import pytest
from pyspark.sql import functions as F

from quarryline.operators import detect as D
from quarryline.operators import files as FI
from quarryline.operators import graph as G
from quarryline.operators import manifest as M
from quarryline.operators import python_code as PY
from quarryline.operators import resolve as R
from quarryline.operators import scripts as S

FILE = "file_id bigint, arrived_at timestamp_ntz, snapshot_id string, path string, text string, name string"


def files(spark, *rows):
    """(path, text) rows of one snapshot, with a column that clashes with those of results."""
    return spark.createDataFrame([(i, T(2025, 1, 1), "s", p, t, "x") for i, (p, t) in enumerate(rows)], FILE)


NEXT = [
    ("package.json", '{"dependencies": {"next": "14", "react": "18"}, "workspaces": ["a"]}'), ("tsconfig.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "exact": ["src/components/Hero"]}}}'),
    ("src/app/page.tsx", "import Image from 'next/image'\nimport Hero from '@/components/Hero'\nimport {\n  Button,\n} from \"@/components/Button\"\nexport default function Home() { return <main/> }\n"),
    ("src/app/api/users/route.ts", "export async function GET() {}\nexport const POST = async (r) => {}\n"), ("src/app/layout.tsx", "export default function RootLayout() { return <html/> }"),
    ("src/components/Hero.tsx", "export default function Hero() { const [a] = useState(1); return <div/> }"), ("src/components/Button.tsx", '"use client"\nconst Button = () => <button/>\nexport default Button\n'),
    ("node_modules/lodash/index.js", ""), ("node_modules/left/package.json", '{"main": "lib/m.js"}'), ("node_modules/left/lib/m.js", ""), ("src/node_modules/lodash/index.js", "")]


def test_a_next_repository(spark):
    f = files(spark, *NEXT)
    p = {r.path: r for r in S.profiles(f).collect()}
    assert p["src/app/page.tsx"].framework == "nextjs" and p["src/app/page.tsx"].is_route and p["src/app/page.tsx"].functions == ["Home"] and p["src/app/page.tsx"].exports == "default"
    assert p["src/components/Hero.tsx"].is_component and p["src/components/Hero.tsx"].hooks == ["useState"] and p["src/components/Button.tsx"].is_client and p["src/app/api/users/route.ts"].capability_entry
    assert {(r.raw, r.kind) for r in S.imports_of(f).where("file_id = 2").collect()} == {("next/image", "esm"), ("@/components/Hero", "esm"), ("@/components/Button", "esm")}
    assert {(r.path, r.method, r.route) for r in S.page_routes(f).collect()} == {("src/app/page.tsx", "GET", "/"), ("src/app/api/users/route.ts", "GET", "/api/users"), ("src/app/api/users/route.ts", "POST", "/api/users")}
    assert {(r.router, r.method, r.route) for r in D.next_routes(f).where("path like '%route.ts'").collect()} == {("app", m, "/api/users/route") for m in ("GET", "POST")} | {("api", m, "/api/users/route") for m in ("GET", "POST")}
    c = M.project_context(f).first()
    assert c.has_nextjs and c.has_react and not c.has_express and M.workspace(f).first().workspace == "yarn"
    assert {(r.name, r.version) for r in M.frameworks(f).collect()} == {("nextjs", "14"), ("react", "18")}
    assert {(r.pattern, r.target) for r in M.path_aliases(f).collect()} == {("@/*", "src/*"), ("exact", "src/components/Hero")}


def test_resolvers(spark):
    py = [("pyproject.toml", "[project]\nname = \"acme\"\n"), ("acme/__init__.py", ""), ("acme/utils/__init__.py", ""), ("acme/utils/math.py", ""), ("acme/app/main.py", "")]
    f = files(spark, *NEXT, *py)
    asked = [("src/app/page.tsx", "@/components/Hero"), ("src/app/page.tsx", "exact"), ("src/app/page.tsx", "lodash"), ("x.ts", "lodash"), ("x.ts", "left"), ("src/app/page.tsx", "../components/Button"), ("x.ts", "src/components/Hero"), ("x.ts", "none"),
             ("acme/app/main.py", "acme.utils.math"), ("acme/app/main.py", "..utils"), ("acme/app/main.py", "acme"), ("acme/app/main.py", "os"), (None, None)]
    i = spark.createDataFrame([(k, "s", p, raw) for k, (p, raw) in enumerate(asked)], "import_id bigint, snapshot_id string, from_path string, raw string")
    got = {r.import_id: (r.resolved, r.strategy, r.confidence) for r in R.resolve_by_language(i, f, M.path_aliases(f), M.packages(f)).collect()}
    assert [got[k] for k in range(len(asked))] == [
        ("src/components/Hero.tsx", "tsconfig", 0.9), ("src/components/Hero.tsx", "tsconfig", 0.9), ("src/node_modules/lodash/index.js", "node_modules", 0.8), ("node_modules/lodash/index.js", "node_modules", 0.8), ("node_modules/left/lib/m.js", "node_modules", 0.8),
        ("src/components/Button.tsx", "relative", 0.95), ("src/components/Hero.tsx", "trie", 0.7), (None, None, 0.0), ("acme/utils/math.py", "trie", 0.7), ("acme/utils/__init__.py", "relative", 0.95), ("acme/__init__.py", "trie", 0.7), (None, None, 0.0), (None, None, 0.0)]
    index = R.module_index(f)
    refs = spark.createDataFrame([("s", "acme.utils.math:12"), ("s", "acme/app/main.py:3"), ("s", "nope")], "snapshot_id string, ref string")
    assert {(r.ref, r.path) for r in R.resolve_any(refs, index).collect()} == {("acme.utils.math:12", "acme/utils/math.py"), ("acme/app/main.py:3", "acme/app/main.py"), ("nope", None)}


PYTHON = '\'\'\'Users of the shop.\n\nMore.\'\'\'\nfrom . import x\nimport os\n\nclass Base(BaseModel):\n    id: int\n\nclass User(Base):\n    name: Optional[str] = None\n\nclass Row(DeclarativeBase):\n    __tablename__ = "rows"\n    id = Column(Integer, primary_key=True)\n    n: int = mapped_column(String, nullable=False)\n\nclass Conf(BaseSettings):\n    API_URL: str\n\nclass Shop(models.Model):\n    title = models.CharField()\n\n@router.post("/users/{uid}", response_model=User)\nasync def add(uid: int, user: User, q: str = Depends(auth)):\n    send(user)\n    send(q)\n\n@app.get\ndef root(): ...\n\n@app.route("/old", methods=["POST", "PUT"])\ndef old(): ...\n\n@shared_task\ndef mail(): ...\n\ndef worker_loop(): ...\n\napp.add_middleware(CORSMiddleware, allow_origins=["*"])\n'


def test_python(spark):
    f = files(spark, ("a/b.py", PYTHON), ("bad.py", "def ("), ("null.py", None), ("empty.py", ""))
    found = PY.items(f)
    rows = {(r.item, r.name, r.detail) for r in found.collect()}
    assert {("summary", "Users of the shop.", "docstring"), ("import", ".", "x"), ("function", "add", "send,Depends"), ("table", "Row", "rows"), ("setting", "API_URL", "Conf"), ("task", "mail", "shared_task.delay"), ("task", "worker_loop", "unknown"), ("policy", "CORSMiddleware", "cors:['*']"), ("policy", "auth", "dependency")} - {("function", "add", "send,Depends")} <= rows
    assert {n for i, n, _ in rows if i == "model"} == {"Base", "User", "Conf"} and {n for i, n, _ in rows if i == "django_model"} == {"Shop"}
    assert {n for i, n, _ in rows if i == "route"} == {"POST /users/{uid}", "GET /", "POST /old", "PUT /old"}
    columns = found.where("item = 'table' and name = 'Row'").first().fields
    assert [(c.name, c.type, c.required) for c in columns] == [("id", "Integer", True), ("n", "String", True)]
    user = found.where("item = 'model' and name = 'User'").first().fields
    assert [tuple(x) for x in user] == [("name", "str", False, "None")]
    routes, models = PY.route_details(found), PY.collected_models(found)
    assert {(r.name, r.route) for r in PY.link_request_models(routes, models).collect()} == {("User", "/users/{uid}")} == {(r.name, r.route) for r in PY.response_models(routes, models).collect()}
    assert {(r.name, tuple(r.fields)) for r in PY.request_schemas(routes).collect()} == {("b.addRequest", ("user", "q"))}
    assert {(r.path, r.summary) for r in PY.file_summaries(f, found).collect()} == {("a/b.py", "Users of the shop."), ("bad.py", "Python module bad.py"), ("null.py", "Python module null.py"), ("empty.py", "Python module empty.py")}
    assert ("User", "name", "string") in {(r.model, r.field, r.example) for r in PY.example_values(models).collect()}
    assert PY.items(f.limit(0)).count() == 0


def test_detectors(spark):
    text = "import s from 'stripe';\nrouter.get('/users/:id', async (req, res) => {\r\nconst k = process.env.API_URL + process.env.PORT;\nqueue.process('mail', f);\nrouter.route('/x').Put(h)\nmodel User {\nupdate users set x\nclass MailService {\n"
    f = files(spark, ("a.ts", text), ("b.py", "@app.post('/items')\nclass Order(Base):\nrouter.register('pets', PetView)\n"), ("c.py", None), ("d.ts", "GET: '/only'"), ("e.ts", "app.get('/a', f)\nPOST '/b'"))
    got = {(r.path, r.detector, r.item, r.name, r.line) for r in D.detect(f).collect()}
    assert {("a.ts", "express", "GET", "/users/:id", 2), ("a.ts", "env", "env", "API_URL", 3), ("a.ts", "bull", "process", "mail", 4), ("a.ts", "express", "PUT", "/x", 5), ("a.ts", "prisma", "model", "User", 6), ("a.ts", "sql", "sql", "users", 7), ("a.ts", "wrapper", "class", "MailService", 8), ("a.ts", "sdk", "stripe", "stripe", 1),
            ("b.py", "fastapi", "POST", "/items", 1), ("b.py", "sqlalchemy", "class", "Order", 2), ("b.py", "django-rest", "DELETE", "pets", 3)} <= got and not any(n == "PORT" for _, _, _, n, _ in got)
    assert {(r.path, r.item, r.name) for r in D.express_routes(f).where("path > 'c'").collect()} == {("d.ts", "GET", "/only"), ("e.ts", "GET", "/a")}
    calls = files(spark, ("k.js", "const Koa = require('koa')\nrouter.get('/x', async (ctx) => {})\nrouter.post('/y', save)\n"))
    assert {(r.framework, r.method, r.route, r.handler) for r in S.call_routes(calls).collect()} == {("koa", "GET", "/x", "anonymous"), ("koa", "POST", "/y", "save")}
    typed = files(spark, ("t.ts", "interface A { id: number; name?: string }\n"), ("z.js", "const B = z.object({ a: z.string() })"))
    assert {(r.name, r.kind, tuple(r.fields)) for r in S.schemas(typed).collect()} == {("A", "typescript.Interface", ("id", "name")), ("B", "javascript.ZodSchema", ("a",))}


def test_the_last_delivery_counts(spark):
    rows = [(1, T(2025, 1, 1), "s", "a.ts", "app.get('/old', f)", "x"), (1, T(2025, 1, 2), "s", "a.ts", "app.get('/new', f)", "x"), (2, T(2025, 1, 1), "s", "b.py", "def old(): 1", "x"), (2, T(2025, 1, 2), "s", "b.py", "def new(): 1", "x")]
    f = spark.createDataFrame(rows, FILE)
    assert {r.name for r in D.detect(f).collect()} == {"/new"} and {r.name for r in PY.items(f).collect()} == {"new"} and {r.route for r in S.call_routes(f).collect()} == {"/new"}


def test_edges_of_every_kind(spark):
    base = "graph_id string, path string, name string, confidence double, hypothesis boolean, ord bigint"
    t = lambda rows, more="": spark.createDataFrame(rows, base + more)
    row = ("g", "f", "n", 0.5, False, 1)
    imports = spark.createDataFrame([("g", "f", "./a", "a", False, 1.0, False, None, 1), ("g", "f", "./b", None, False, 1.0, False, None, 2), ("g", "f", "os", None, True, 1.0, False, None, 3), ("g", "f", "q", None, None, 1.0, False, None, 4)],
                                    "graph_id string, path string, raw string, resolved string, external boolean, confidence double, hypothesis boolean, reason_code string, ord bigint")
    routes = t([(*row, "GET", "/x", ["auth"])], ", method string, route string, middlewares array<string>")
    jobs = t([(*row, "queue.add", "unknown")], ", producer string, consumer string")
    e = G.edges_by_kind(imports, routes, jobs, t([("g", "f", "db", None, None, 1)]), t([row]), t([row]), t([row]))
    got = {(r.src, r.dst, r.kind, r.confidence) for r in e.collect()}
    assert got == {("f", "a", "import", 1.0), ("f", "./b", "import", 0.0), ("GET:/x", "f", "route", 0.5), ("GET:/x", "auth", "middleware", 0.4), ("n", "f", "job", 0.5), ("n", "queue.add", "job", 0.4), ("f", "db", "store", 0.5), ("f", "n", "external", 0.5), ("f", "n", "call", 0.5), ("f", "n", "class", 0.5)}
    w = spark.createDataFrame([("g", "f")], "graph_id string, id string")
    assert {r.other for r in G.other_ends(e, w, "store").collect()} == {"db"}
    nodes, kept = G.assembled(w, w, spark.createDataFrame([("g", "pkg:x"), ("g", "n")], "graph_id string, id string"), e)
    assert {(r.id, r.type) for r in nodes.collect()} == {("f", "module"), ("n", "model")} and {r.kind for r in kept.collect()} == {"job", "external", "call", "class"}


def test_includes_by_module_name(spark):
    inc = spark.createDataFrame([("site/urls.py", "/shop/", "shop.urls")], "file string, prefix string, target string")
    routes = spark.createDataFrame([("app/shop/urls.py", "/list")], "file string, path string")
    roots = spark.createDataFrame([("site/urls.py",)], "file string")
    assert [r.path for r in G.prefix_routes(inc, routes, roots).collect()] == ["/shop/list"]


@pytest.mark.parametrize("path, ignored", [("a/.hg/x", True), ("docs/a.py", True), (".gitignore", False), (".eslintrc", False), (".npmrc", True), ("a.orig", True), ("build-x.js", True), ("src/a.py", False), ("a.SQLITE", True), (None, False)])
def test_ignored(spark, path, ignored):
    assert spark.range(1).select(FI.ignored(F.lit(path).cast("string"))).first()[0] is ignored


def test_lanes_roles_and_purposes(spark):
    rows = spark.createDataFrame([("x/api/a.tsx",), ("x/a.tsx",), ("x/jobs/a.py",), ("api/a.py",), ("x/cli/run.py",)], "p string")
    p = F.col("p")
    assert [tuple(r) for r in rows.select(FI.lane(p), FI.capability_lane(p), FI.build_role(p)[0]).collect()] == [
        ("api", "api", "entrypoint"), ("web", "web", "service"), ("workers", "worker", "service"), ("other", "web", "entrypoint"), ("other", "cli", "service")]
    names = spark.createDataFrame([("App",), ("coworkers",), ("zzz",)], "n string")
    assert [r[0] for r in names.select(FI.folder_purpose(F.col("n"))).collect()] == ["UI routes (Next.js)", "Background workers", ""]


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"x = 1\xff\n")
    (tmp_path / "b.py").write_bytes(b"\xff\xfe")
    got = {r.path: r.text for r in FI.scan_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "x = 1\n", "b.py": "ÿþ"}


def test_engine(spark, small):
    from quarryline.engine import Engine

    e = Engine(spark, small)
    for answer in (e.overview(), e.graph(), e.tree(), e.files("api"), e.glossary(), e.suggestions(), e.artifacts(), e.queue_stats(), e.job_status(), e.events(1), e.metrics(), e.preflight(), e.retrieve("index worker")):
        assert answer.columns and answer.count() >= 0
    s = e.overview().first().snapshot_id
    assert Engine(spark, small, s).overview().count() == 1
