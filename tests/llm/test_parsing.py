import ast

import pytest

from quarryline.llm import parsing as P
from quarryline.llm.derivatives import Grammar

GOOD = {
    ".py": ["", "x = 1", "def f(a, *b, c=1, **d) -> int:\n    return a\n", "if x:\n  y\nelse:\n  z", "match a:\n    case {'x': [1, *_]} if b:\n        pass\n    case A.B(c=1) | None:\n        pass", "async def f():\n    async with a as b, c:\n        await x\n",
            "print(f'{a!r:>{w}} {b[\"c\"]}')", "x = [i async for i in y if i]", "lambda *a, k=1: (yield)", "class A[T](B, m=C):\n    x: int = 1\n    @d\n    def f(self): ...", "a = b = c, *d = e", "with (open(a) as b, c):\n\tpass", "try:\n  a\nexcept* (B, C) as e:\n  b\n",
            "x = (1,\n     2)\n# end", "a[1:2, ::3, *b]", "type X[T] = int", "global a, b", "x: int", "x = '''a\n'''\n", "if a:\n    pass\n\n\n# c\n    # d\nb", "s = rb'\\x' b'y'", "for x, *y in z: continue", "del a, b[0]", "assert a, b", "x = a if b else c", "print(*a, **b)", "\ufeffx = 1\r\ny = 2\r\n", "if (n := 1) > 0: pass", "a \\\n  = 1"],
    ".js": ["", "import a, { b as c } from 'x';\nexport default function () {}", "const f = async ({ a, b = 1, ...c }, [d]) => { await a; };", "a\nb\n", "let x = `a ${`b ${c}`} d`;", "for (const [k, v] of Object.entries(x)) { if (/[/]\\//g.test(k)) continue; }", "label: while (1) break label;",
            "class A extends B { static #p = 1; get x() { return this.#p; } static { f(); } async *g() {} }", "a ??= b?.c?.[d]?.(e) ?? f ** 2;", "x = a / b / c; y = (a) / 2;", "var { a: { b }, ...c } = d", "switch (a) { case 1: default: b() }", "if (a) b; else c", "return1: ;", "do x++; while (y)\nz", "export * as n from 'm'", "new a.b(c).d`e`", "({ get: 1, set, async x() {}, [y]: 2, 'z'() {} })",
            "try { a } catch { b } finally { c }", "#!/usr/bin/env node\nfoo()", "const r = /^[({\\[]x-(\\d+)[)}\\]]$/;", "export { a as default, b };", "import('x').then(m => m)", "var a = function* () { yield* b }", "// x\n/* y */"],
    ".jsx": ["const a = <div className=\"x\" {...p}>it's {b ? <B.C /> : null} &amp; <></></div>;", "function F() { return (\n <p>\n  {x.map((i) => <li key={i}>{i}</li>)}\n </p>\n); }"],
    ".ts": ["interface A<T extends B = C> extends D { a?: string; readonly [k: string]: any; f(x: number): void; new (x: T): A<T> }", "type X = { kind: 'a'; b: number } | { kind: 'c'; d: string[] };", "export const f = async <T,>(a: T, b?: Map<string, Array<number>>): Promise<T[]> => a as T;", "enum E { A = 1, B }\ndeclare module 'x' { export const y: number; }",
            "abstract class A<T> implements B, C { private readonly m = new Map<string, number>(); constructor(private a: string, public b?: number) { super(); } abstract f(): void; g!: string; static h<T>(this: A<T>, ...x: any[]): x is string { return true } }", "let x = <any>y; let z = a! + b!.c;", "function f(a: string): asserts a is 'x';\nfunction f(a: any) {}",
            "type M = { readonly [K in keyof T]?: T[K] extends infer U ? U : never };", "import type { A } from './a'; export type { A };", "if (a < b && c > d) {}", "@Dec({ a: 1 }) class X { @Input() y: string; }", "const x = y satisfies Z; type F = (a: number) => void; type T = typeof import('x');", "namespace A.B { export let c: number }", "let t: [a: string, b?: number, ...c: string[]] = q;", "const s = a >> 2 >>> 1; f<string>(x);", "type L = `a${string}`;"],
    ".tsx": ["export function F({ a }: Props) { const [x, setX] = useState<string>(''); return <div onClick={() => setX('a')}>{x}</div>; }", "const g = <T,>(x: T) => <A v={x} />;"],
    ".json": ["{}", "[1, -2.5e3, \"a\\n\\u00e9\", true, null, {\"a\": []}]", " 1 ", "\"x\""],
}
BAD = {
    ".py": ["def f(:\n  pass", "x = (1,\n", "if x:\ny", "print \"a\"", "<<<<<<< HEAD\nx\n=======\n", "x = 'a", "a b", "class A:\n", "def f():\n    return 1\n  x", "x = “a”", "x\0", "const a = 1;", "for x in y\n  pass", "a = = b", "x = 01", "  x = 1", "try:\n  a\n", "else:\n  x", "f(a=)", "a\xa0= 1"],
    ".js": ["function f( {\n return 1;\n}", "const a = [1, 2;", "const = 1;", "<<<<<<< HEAD\na\n", "var s = 'a\nb", "/* x", "export default { a: , };", "interface A { b: string; }", "let x: number = 1;", "<div>a</div>", "} ", "if (a) { b", "a b", "const a;", "def f():\n  pass", "const x = `a ${1", "else { a }", "{ \"a\": 1, \"b\": 2 }", "var x = “a”", "import { a from 'b'", "class A { f( }"],
    ".jsx": ["const a = <div><p></div>;", "const a = <div>;", "let x: string;"],
    ".ts": ["interface A { b: }", "type X = ;", "let x: = 1;", "function f(a: string { }", "const a = <div className=\"x\">b</div>;", "enum { A }", "class A { private }} "],
    ".tsx": ["const a = <div><p></div>;", "function F() { return <div>; }"],
    ".json": ["", "{'a': 1}", "{\"a\": 1,}", "[1 2]", "{\"a\"}", "NaN", "// x\n{}", "{\"a\": 01}", "\"a\nb\"", "[1"],
}


@pytest.mark.parametrize("ext, text", [(e, t) for e, ts in GOOD.items() for t in ts])
def test_valid(ext, text):
    assert P.judge(text, ext) is None
    if ext == ".py":
        assert P.parse_python(text) is None
        ast.parse(text.removeprefix("\ufeff"))


@pytest.mark.parametrize("ext, text", [(e, t) for e, ts in BAD.items() for t in ts if t])
def test_invalid(ext, text):
    assert P.judge(text, ext) is not None
    if ext == ".py":
        assert P.parse_python(text) is not None


def test_place_and_kind_of_a_failure():
    assert P.judge("x = 1\ny = = 2\n", ".py")[:2] == ("token", 2)
    assert P.judge("a();\nconst x = [1;\n", ".js")[:2] == ("token", 2)
    assert P.judge("function f() {\n", ".js").reason == "truncated" and P.judge("x = (1,\n", ".py").reason == "truncated" and P.judge("[1,", ".json").reason == "truncated"


def test_derivatives_decide_a_small_grammar():
    g = Grammar("s = 'a' s 'b' | ;\n", "s", {})

    def accepts(word):
        state = g.fresh()
        for c in word:
            state = g.derive(state, g.kind(c))
        return g.nullable(state, 0)

    assert [accepts(w) for w in ("", "ab", "aabb", "aab", "abb", "ba")] == [True, True, True, False, False, False]


def test_deep_nesting_is_answered():
    for (opening, closing), ext in (("[]", ".js"), ("()", ".ts"), ("{}", ".py"), ("[]", ".json")):
        head = "" if ext == ".json" else "x = "
        assert P.judge(head + opening * 150 + "1" + closing * 150, ext) is None
    assert P.judge("x = " + "[" * 300 + "]" * 300, ".js") is None and P.judge("x = " + "{1: " * 60 + "2" + "}" * 60, ".py") is None
    assert P.judge("(" * 500, ".js").reason == "truncated" and P.judge("(" * 20_000, ".py") is not None


FILE = "file_id bigint, repo_id string, path string, text string, language string, valid boolean"


def test_files_and_rates(spark):
    rows = [(1, "r", "a.py", "x = "), (1, "r", "a.py", "x = "), (2, "r", "b.py", "x = 1"), (3, "r", "c.py", None), (4, "r", "d.py", ""), (5, "q", "e.txt", "(("), (6, None, None, "(("), (7, "q", "f.JSON", "{")]
    f = spark.createDataFrame([(*r, "zz", True) for r in rows], FILE)
    assert {r.file_id for r in P.broken_files(f).collect()} == {1, 7}
    assert {(r.repo_id, r.language, r.files, r.broken) for r in P.broken_rates(f).collect()} == {("r", "py", 3, 1), ("q", "other", 1, 1)}
    assert P.broken_files(f.limit(0)).count() == 0


@pytest.mark.parametrize("text", ['f"{}"', 'f"{a b}"', 'f"{1 +}"', "f() = 3", "1 = x", "a + b = c", "del f()", "f(a=1, 2)", "def f(a=1, b): pass"])
def test_python_beyond_the_grammar_is_rejected(text):
    assert P.judge(text + "\n", ".py") is not None


@pytest.mark.parametrize("ext", [".js", ".ts"])
@pytest.mark.parametrize("text", ["1 = 2;", "a + b = c;", "f() = 3;", "x++ = 1;", "-a = 1;"])
def test_targets_of_scripts(text, ext):
    assert P.judge(text, ext) is not None


@pytest.mark.parametrize("ext", [".js", ".ts"])
@pytest.mark.parametrize("text", ["a = b = c;", "a.b[0].c += f().d = 1;", "[a, b] = [b, a];", "({ a, b: c } = d);", "(a) = 1;", "x ? y : z = 1;", "this.a ||= 1;", "f`t`.x = 1;", "for (a.b of c) d = e;", "new A().b = 1;", "super.x = 1;", "if (a) b = c; else d = (e) => f = g;"])
def test_right_targets_of_scripts(text, ext):
    assert P.judge(text, ext) is None


@pytest.mark.parametrize("text", ["(a as any) = 1;", "a! = 1;", "(<any>a).b = 1;", "a!.b = 1;", "a >>>= 1;"])
def test_right_targets_of_typescript(text):
    assert P.judge(text, ".ts") is None


def test_no_size_makes_a_text_pass():
    for text, ext in (("[" * 30_000 + "]" * 29_999, ".json"), ("x = " + "(" * 20_000 + "1" + ")" * 19_999, ".js"), ("x = " + "(" * 5_000 + "1" + ")" * 4_999 + "\n", ".py"), ("x = " + "(" * 5_000 + "1 2" + ")" * 5_000, ".ts")):
        assert P.judge(text, ext) is not None
    assert P.judge("[" * 30_000 + "]" * 30_000, ".json") is None


def test_dropping_nodes_changes_no_verdict(monkeypatch):
    texts = [(e, t) for table in (GOOD, BAD) for e, ts in table.items() for t in ts]
    before = [P.judge(t, e) for e, t in texts]
    for g in (P.G.PY, P.G.JS_ON, P.G.JS, P.G.TS):
        g.limit = 50
        lean = g.lean
        monkeypatch.setattr(g, "lean", lambda state, g=g, lean=lean: (lean(state), setattr(g, "limit", len(g.made) + 50))[0])
    assert [P.judge(t, e) for e, t in texts] == before
    for g in (P.G.PY, P.G.JS_ON, P.G.JS, P.G.TS):
        g.forget()


def test_type_arguments_of_tags():
    assert P.judge('const a = <Foo<string> x="1" />;', ".tsx") is None and P.judge("const a = <A.B<Map<string, C[]>> x={1}>t</A.B>;", ".tsx") is None
    assert P.judge('const a = <Foo x<string>="1" />;', ".tsx") is not None and P.judge('const a = <Foo<string x="1" />;', ".tsx") is not None
    assert P.judge('const a = <Foo<string> x="1" />;', ".jsx") is not None


def test_the_last_delivery_counts(spark):
    from datetime import datetime

    rows = [(1, "r", "a.py", "x = ", datetime(2024, 1, 1)), (1, "r", "a.py", "x = 1", datetime(2024, 1, 2)), (2, "r", "b.py", "x = 1", datetime(2024, 1, 1)), (2, "r", "b.py", "x = (", datetime(2024, 1, 2))]
    f = spark.createDataFrame(rows, "file_id bigint, repo_id string, path string, text string, arrived_at timestamp_ntz")
    assert {r.file_id: r.token for r in P.broken_files(f).collect()} == {2: ""}
