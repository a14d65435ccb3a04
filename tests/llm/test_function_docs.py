from __future__ import annotations

import pytest

from codelode.llm import function_docs
from codelode.sources.grammar import language_of

SYMBOL = "STRUCT<kind: STRING, name: STRING, qualified_name: STRING, signature: STRING, parameters: ARRAY<STRUCT<name: STRING, type_ref: STRING>>, docstring: STRING, start_line: BIGINT>"
RECORDS = f"repo STRING, path STRING, symbols ARRAY<{SYMBOL}>, parsed_at TIMESTAMP, received_at TIMESTAMP, text STRING"

TS = "/** About the file. */\n\nexport function bare() {\n}\n\n/** Retries twice. */\nexport function send(a) {\n  return '}';\n}\n\n/** Waits for the queue. */\nexport function torn��a) {\n  x();\n}\n"
PY = 'def keep(a):\n    """Drops empty rows."""\n    return a\n\ndef torn(a) -> str\n    """Sorts by weight."""\n    return a\n\ndef gone�a: int):\n    """Rounds down."""\n'


def _symbol(name: str, line: int | None, doc: str | None = "recorded", kind: str = "Function"):  # noqa: ANN202
    return (kind, name, f"m::{name}", None, None, doc, line)


def _found(spark, texts, records):  # noqa: ANN001, ANN202
    d = spark.createDataFrame([(k, "repo_file", "r", p, t) for k, (p, t) in enumerate(texts)], "doc_id BIGINT, source STRING, repo STRING, path STRING, text STRING")
    f = spark.createDataFrame([("r", p, s, None, None, "clash") for p, s in records], RECORDS)
    return {(r["path"], r["qualified_name"]): r for r in function_docs.documented_functions(d, f).collect()}


def test_pairs_come_from_the_text(spark):
    records = [("a.ts", [_symbol("bare", 3), _symbol("send", 7), _symbol("torn", 12), _symbol("other", 7, None), _symbol("cls", 7, "x", "Class")]), ("b.py", [_symbol("keep", 1), _symbol("torn", 5), _symbol("gone", 9), _symbol("absent", 99), _symbol("nowhere", None)]), ("c.rs", None)]
    found = _found(spark, [("a.ts", TS), ("b.py", PY), ("c.rs", "/// D.\nfn f() {}\n")], records)
    assert {k: r["docstring"] for k, r in found.items()} == {
        ("a.ts", "m::send"): "Retries twice.", ("a.ts", "m::torn"): "Waits for the queue.", ("b.py", "m::keep"): "Drops empty rows.", ("b.py", "m::torn"): "Sorts by weight.", ("b.py", "m::gone"): "Rounds down.",
    }
    assert found["a.ts", "m::send"]["code"] == "function send(a) {\n  return '}';\n}" and found["a.ts", "m::torn"]["code"] is None
    # the records alone give nothing
    assert _found(spark, [("a.ts", ""), ("b.py", None)], records) == {} and _found(spark, [], records) == {} and _found(spark, [("a.ts", TS)], []) == {}


def test_repeated_rows_and_missing_names(spark):
    found = _found(spark, [("a.ts", TS), ("x.unknown", TS)], [("a.ts", [_symbol("send", 7), (None,) * 7]), ("x.unknown", [_symbol("send", 7)]), ("a.ts", [_symbol("send", 7), (None,) * 7])])
    assert list(found) == [("a.ts", "m::send")]


@pytest.mark.parametrize(("path", "text", "name", "line", "doc"), [
    ("a.rs", "//! About the file.\nfn f() {}\n", "f", 2, None), ("a.rs", "/// One.\n/// Two.\n#[inline]\npub(crate) fn f() {}\n", "f", 4, "/// One.\n/// Two."), ("a.rs", "/// One.\npubcrate) fn f() {}\n", "f", 2, "/// One."),
    ("a.rs", "/// One.\nstruct S;\nfn f() {}\n", "f", 3, None), ("a.js", "/** One. */\nconst x = 1; function f() {}\n", "f", 2, None), ("a.py", 'def f(\n    a,\n):\n    # note\n    """Doc."""\n', "f", 1, '"""Doc."""'), ("a.py", 'def f(a): return "x"\n', "f", 1, None),
])
def test_what_belongs_to_a_function(path, text, name, line, doc):
    assert function_docs.Scanned(text, language_of(path)).ask(name, line)[2] == doc
