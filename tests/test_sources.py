from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from codelode.sources import jsonl, repository
from codelode.sources.extract import parse_text
from codelode.sources.grammar import parses, ranked
from codelode.streaming import deltas

NAMES = "ir_version path language content_hash byte_len line_count metrics docstring symbols calls imports diagnostics retrieval_card symbol_cards".split()


def rec(path, text):
    return dict(zip(NAMES, parse_text(path, text), strict=True))


GOOD = {
    "Rust": ["", "fn main() {}", "impl<T: Clone> Foo<T> for Bar<'_> where T: 'static { const A: [u8; 2] = [1, 2]; fn f(&mut self) -> Result<(), E> { let x = if a { 1 } else { 2 }; x?.y::<Vec<Vec<u8>>>()[0].await; loop { break 'l } Ok(()) } }",
             "fn f() { match x { Some(A { b, .. }) | None if b > 1 => {} 1..=9 => g(), _ => h!{} } let s = r#\"a\"b\"#; let c = '\\''; for (i, x) in v.iter().enumerate() { a[i] += x as u64; } }",
             "use a::{b, c::*, self}; pub(crate) struct S(pub u8, String); enum E { A = 1, B { x: u8 }, C(u8) } mod m { pub trait T: A + 'static { fn g(&self); type X; } } macro_rules! m { ($x:expr) => { <<<< } }", "fn f() -> impl Fn(u8) -> u8 { move |x: u8| x + 1 }", "/* a /* b */ c */ static X: &[f64] = &[1.0, 2., -3e5];"],
    "JavaScript": ["", "const f = async (a, {b, c = 1}, ...d) => ({a, [b]: c, get x() { return 1 }, async *y() {}});", "for (const x of y) if (a) b(); else { c }\nlabel: while (1) break label", "import d, {a as b} from './x';\nexport default class A extends B { static #p = 1; static { } get x() { return this.#p } }", "var r = a / b / c, q = /[/]\\/(x)/g.test(s);\nlet t = `a${b + `${c}`}d`", "!function(t){\"a\"in t||(t.b=c(4))}(this)", "switch (a) { case 1: default: x() } try { } catch { } finally { }\nx?.y?.[0]?.(1) ?? z ** 2", "function* g() { yield* h(); yield }\na\n++b"],
    "TypeScript": ["interface A<T extends B = C> extends D { readonly x?: string; [k: string]: any; m<U>(a: U): a is X; new (): A }", "export const f = <T,>(x: T, y?: number): x is T => x as unknown as T;", "abstract class A<T> implements B { private readonly x: Map<string, Array<number>> = new Map<string, Array<number>>(); constructor(public a: string, protected b = 2) { super() } abstract m(): void; get y(): number { return 1 } }", "type M = { readonly [K in keyof T]?: T[K] } | `a${string}` | (new () => X)[] | typeof import('x');\ndeclare module 'm' { export = x }\nenum E { A = 1 << 2, B }\nlet x = y!.z satisfies T, w = <any>v;", "export function f(this: Window, ...r: [a: string, b?: number]): asserts r is any {}\nimport type { A } from 'b';\nnamespace N.M { }", "function f(a: string): void;\nfunction f(a: any) { return a ? (b) : c }"],
    "Python": ["", "match x:\n    case [1, *_]: pass\n", "def f(a, /, b: int = 1, *, c) -> None: ...\n"],
}
BAD = {
    "Rust": ["fn main() {", "fn f( { }", "let x = 1;", "fn f() { let x = 1 let y = 2; }", "<<<<<<< HEAD\nfn a() {}\n=======\n>>>>>>> x", "def f():\n    pass", "fn a() { b(1, ; }", "fn f() { '''x''' }", "struct S { a: u8 b: u8 }", "fn f() -> { }", "fn\ufffd a() {}"],
    "JavaScript": ["function f( { }", "let x: number = 1", "const a = ;", "if a { }", "return 1", "a b", "fn main() {}", "x = {a: 1,, b}", "<<<<<<< a\nb\n=======\nc\n>>>>>>> d", "`a${b", "def f():\n  pass", "class { m( }", "1 = 2", "import {a} from b"],
    "TypeScript": ["let x: = 1", "interface { }", "use crate::a;\nfn f() {}", "function f(a: string { }", "type = 3 4", "enum E { A B }"],
    "Python": ["print 'x'", "def f()\n    pass", "x = (", "def f():\nx = 1", "\x00", "fn main() {}"],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in GOOD.items() for t in ts])
def test_good(language, text):
    assert parses(text, language)
    assert parses(text.replace("\n", "\r\n"), language)


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, ts in BAD.items() for t in ts])
def test_bad(language, text):
    assert not parses(text, language)


def test_ranking_and_depth():
    assert ranked("pub fn a(&mut self) -> u8 { let x = 1; }")[0] == "Rust"
    assert ranked("def f(self):\n    return None\n")[0] == "Python"
    assert parses("(" * 50000 + ")" * 50000, "JavaScript") in (True, False)


def test_broken_files_keep_what_they_have():
    for path, text in (("a.rs", "fn a() { b(); }\nfn c( {"), ("a.py", "def a():\n    b()\n\ndef c(:\n"), ("a.ts", "function a() { b(); }\nclass {"), ("a.js", "function a() { b(); }\nfunction c( {")):
        r = rec(path, text)
        assert r["symbols"][0]["name"] == "a" and any(d["severity"] == "Error" for d in r["diagnostics"]), path
    for k in range(0, 300, 7):  # cut anywhere, nothing hangs or raises
        for path in ("x.rs", "x.ts", "x.js", "x.py"):
            rec(path, ("impl A { pub fn b<T>(&self) -> X { match c { D(e) if f => g(h).i(j)?, _ => {} } let k = |l| m(n); } }\n" * 3 + "class A { m(a = {}) { return x.map((e) => f(e)) } }\ndef f(a):\n    return b(c)\n")[:k])
    assert rec("a.txt", "x")["language"] == "unknown" and rec("a.rs", None)["diagnostics"]


def test_rust_extraction():
    r = rec("src/a.rs", "use std::{fmt, io::Read, collections::HashMap as Map};\nuse x::*;\nmod a {\n    /// Doc one.\n    /// Two.\n    pub fn f(x: &str, mut y: Vec<u8>) -> u8 { g(h(1)); S::new(x).run()?; mac!(z(1)); 1 }\n}\nimpl fmt::Display for S { fn show(&self) { self.x.y(); } }\ntrait T { fn no(&self); fn yes(&self) { q() } }\n#[cfg(test)]\nmod tests { fn t() { a::f(); } }\n")
    assert [(i["import_name"], i["target_module"], i["kind"]) for i in r["imports"]] == [("fmt", "std::fmt", "Named"), ("Read", "std::io", "Named"), ("Map", "std::collections::HashMap", "Named"), ("*", "x", "Star")]
    assert [(s["qualified_name"], s["kind"], s["is_test"]) for s in r["symbols"]] == [("a::f", "Function", False), ("S::show", "Method", False), ("T", "Trait", False), ("yes", "Function", False), ("tests::t", "Function", True)]
    assert r["symbols"][0]["docstring"] == "Doc one.\nTwo." and r["symbols"][0]["return_type"] == "u8" and [p["name"] for p in r["symbols"][0]["parameters"]] == ["x", "mut y"]
    assert [c["callee_name"] for c in r["calls"]] == ["g", "S::new(x).run", "self.x.y", "q", "a::f"] and r["calls"][-1]["callee_local_key"] == "a::f"


def test_python_extraction():
    r = rec("pkg/test_x.py", "import a.b, c as d\nfrom .m import n as o, p\nfrom q import *\nclass T:\n    def f(self, x: int = 1, *args, k=2, **kw) -> str:\n        'Doc.'\n        return g(h(x)).i(y)\n")
    assert [(i["import_name"], i["target_module"], i["kind"]) for i in r["imports"]] == [("a.b", "", "Named"), ("c", "", "Named"), ("n", ".m", "Named"), ("p", ".m", "Named"), ("*", "q", "Star")]
    f = r["symbols"][1]
    assert f["qualified_name"] == "T.f" and f["signature"] == "def f(self, x: int = 1, *args, k=2, **kw)" and f["docstring"] == "Doc." and f["is_test"] and [c["callee_name"] for c in r["calls"]] == ["g(h(x)).i"]


def test_script_extraction():
    t = rec("a.ts", "import D, { x as y } from './m';\nimport * as ns from 'n';\nexport class A { async m(a: string, b = 1): Promise<void> { this.p(q(1)).r(new Z(s())); } }\nconst f = (e: number) => g(e);\nlet v = 3;\n")
    assert [(s["qualified_name"], s["kind"]) for s in t["symbols"]] == [("A", "Class"), ("A.m", "Method"), ("f", "Function"), ("v", "Constant")]
    assert [c["callee_name"] for c in t["calls"]] == ["this.p.r", "this.p", "q", "new Z", "s", "g"] and len(t["imports"]) == 4
    j = rec("a.js", "import d, { x } from './m';\nclass A { m(a) { p(q(1)); new Z(s()); } }\nconst g = async (a, b) => h(a);\nfunction k() { g(1); }\n")
    assert [(s["qualified_name"], s["signature"]) for s in j["symbols"]] == [("A", None), ("A::m", "function m(a)"), ("g", "const g(...)"), ("k", "function k()")]
    assert [c["callee_name"] for c in j["calls"]] == ["p", "new Z", "s", "h", "g"] and j["calls"][-1]["callee_local_key"] == "g"


def test_repository_scan(spark, tmp_path):
    for name, text in {"src/a.rs": "fn a() {}", "src/b.txt": "x", "target/c.rs": "fn c() {}", "src/gen/d.py": "x = 1", "src/gen/keep.py": "y = 1", ".git/e.py": "z", "src/big.js": "x" * (4 * 1024 * 1024 + 1), "src/w x.ts": "let a = 1"}.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    (tmp_path / ".gitignore").write_text("/target/\n# no\n")
    (tmp_path / "src/.gitignore").write_text("gen/*.py\n!keep.py\n")
    files, skipped = repository.scan(spark, f"file://{tmp_path}")
    assert [r["path"] for r in files.collect()] == ["src/a.rs", "src/gen/keep.py", "src/w x.ts"] and [r["path"] for r in skipped.collect()] == ["src/big.js"]
    records = repository.parse(files)
    assert {r["path"]: r["retrieval_card"]["text"].split("\n")[0].split(" hash")[0] for r in records.collect()}["src/a.rs"] == "FILE path=src/a.rs lang=Rust lines=1"


def test_jsonl(spark, tmp_path):
    rows = repository.parse(spark.createDataFrame([("a.py", "def f():\n    g()\n"), ("b.rs", "fn x() {}")], "path STRING, text STRING"))
    path = f"file://{tmp_path}/map.jsonl"
    jsonl.replace(rows, path)
    jsonl.replace(rows.where("path = 'a.py'"), path)
    back = jsonl.read_records(spark, path).collect()
    assert [r["path"] for r in back] == ["a.py"] and back[0]["symbols"][0]["is_test"] is False
    with pytest.raises(Exception):
        jsonl.replace(rows.withColumn("path", F.raise_error(F.lit("no"))), path)
    assert jsonl.read_records(spark, path).count() == 1
    (tmp_path / "x.jsonl").write_text("{}\n\nnope\n" + json.dumps({"path": "q"}) + "\n")
    assert [r["line_no"] for r in jsonl.bad_lines(spark, f"file://{tmp_path}/x.jsonl").collect()] == [3]
    assert jsonl.read_or_empty(spark, f"file://{tmp_path}/none", "query STRING").count() == 0


def change(path, text=None, kind="modify", deleted=False, seq=1):
    return ("r", path, kind, deleted, seq, text)


def test_incremental(spark, tmp_path):
    state = deltas.RecordState(spark, f"file://{tmp_path}/state", repository.parse, ignored=lambda rows: rows.where("NOT startswith(path, 'target/')"))
    files = [("r", "lib.rs", "pub mod util { pub fn helper() {} }"), ("r", "main.rs", "fn main() { util::helper(); }"), ("r", "target/x.rs", "fn x() {}")]
    first = state.snapshot(spark.createDataFrame(files, "repo STRING, path STRING, text STRING"))
    assert {r["path"] for r in first.collect()} == {"lib.rs", "main.rs"}
    assert first.where("path = 'main.rs'").first()["calls"][0]["callee_file"] == "lib.rs"
    apply = lambda rows, n: sorted((r["event"], r["path"] or "", r["changed"]) for r in state.apply(spark.createDataFrame(rows, deltas.CHANGE), n).collect())
    assert apply([change("main.rs", files[1][2]), change("target/y.rs", "fn y() {}"), change("a.md", kind="access")], 1) == [("batch_end", "", 0)]
    assert apply([change("main.rs", "fn main() { other(); util::helper(); }"), change("main.rs", "old", seq=0)], 2) == [("batch_end", "", 1), ("updated", "main.rs", None)]
    # the callee's file is renamed: what calls it is emitted though untouched
    assert apply([change("lib.rs", kind="remove", deleted=True), change("lib2.rs", files[0][2], kind="create")], 3) == [("batch_end", "", 3), ("deleted", "lib.rs", None), ("updated", "lib2.rs", None), ("updated", "main.rs", None)]
    assert apply([change("nothing.rs", kind="remove", deleted=True), change("../out.rs", "fn o() {}")], 4) == [("batch_end", "", 0)]
    assert apply([], 5) == [("batch_end", "", 0)]


def test_configurations_are_resolved_anew(spark, tmp_path):
    state = deltas.RecordState(spark, f"file://{tmp_path}/state", repository.parse)
    base = '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["lib/*"]}}}'
    files = [("r", "app/main.ts", "import { a } from '@/a';\nimport b from './b';\n"), ("r", "lib/a.ts", "export const a = 1;\n"), ("r", "other/a.ts", "export const a = 1;\n"), ("r", "app/b.ts", ""), ("r", "app/tsconfig.json", '{"extends": "../tsconfig.base"}'), ("r", "tsconfig.base.json", base)]
    first = state.snapshot(spark.createDataFrame(files, "repo STRING, path STRING, text STRING"))
    links = lambda df: sorted({i["resolved"] for i in df.where("path = 'app/main.ts'").first()["imports"]}, key=str)
    assert links(first) == ["app/b.ts", "lib/a.ts"] and first.count() == 4
    events = lambda rows, n: sorted((r["event"], r["path"] or "") for r in state.apply(spark.createDataFrame(rows, deltas.CHANGE), n).collect())
    assert events([change("tsconfig.base.json", base.replace("lib/*", "other/*"))], 1) == [("batch_end", ""), ("updated", "app/main.ts")]
    assert links(state.read()) == ["app/b.ts", "other/a.ts"]
    assert events([change("app/tsconfig.json", kind="remove", deleted=True)], 2) == [("batch_end", ""), ("updated", "app/main.ts")] and links(state.read()) == [None, "app/b.ts"] and {r["path"] for r in state.configs().collect()} == {"tsconfig.base.json"}
    assert events([change("app/b.ts", kind="remove", deleted=True)], 3) == [("batch_end", ""), ("deleted", "app/b.ts"), ("updated", "app/main.ts")]


def test_stream(spark, tmp_path):
    state = deltas.RecordState(spark, f"file://{tmp_path}/state", repository.parse)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(json.dumps({"repo": "r", "path": "a.py", "kind": "create", "deleted": False, "seq": 1, "text": "def f():\n    pass\n"}) + "\n")
    stream = spark.readStream.schema(deltas.CHANGE).json(f"file://{tmp_path}/in")
    deltas.run(stream, state, f"file://{tmp_path}/out", f"file://{tmp_path}/check", once=True).awaitTermination(120)
    events = [(r["event"], r["path"]) for r in spark.read.json(f"file://{tmp_path}/out").collect()]
    assert sorted(events) == [("batch_end", None), ("updated", "a.py")] and state.read().count() == 1
