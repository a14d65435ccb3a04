from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from codelode.functions import text as T
from codelode.operators import config, files, graph, learn, report
from codelode.sources import jsonl

FILES = "repo STRING, path STRING, text STRING"


def _effective(spark, rows):  # noqa: ANN001, ANN202
    return {(r["repo"], r["dir"]): (r["base_url"], r["paths"]) for r in config.effective(spark.createDataFrame(rows, FILES)).collect()}


def test_configurations_inherit(spark):
    paths = {"@/*": ["lib/*", "x/*"]}
    rows = [
        ("r", "tsconfig.base.json", json.dumps({"compilerOptions": {"baseUrl": "./src/", "paths": paths}})),
        ("r", "tsconfig.json", json.dumps({"compilerOptions": {"paths": {"a": ["b", 3], "none": [4]}}})),
        ("r", "p/tsconfig.json", json.dumps({"extends": "../tsconfig.base"})),
        ("r", "p/q/tsconfig.json", json.dumps({"extends": [7, "../tsconfig.json"], "compilerOptions": {"baseUrl": "own/"}})),
        ("r", "s/tsconfig.json", json.dumps({"extends": "../nowhere", "compilerOptions": {"baseUrl": "x"}})),
        ("r", "t/tsconfig.json", "{ no json"), ("r", "u/tsconfig.json", json.dumps({"extends": "./tsconfig"})), ("r", "v/tsconfig.json", json.dumps({"extends": "../w/tsconfig.json", "compilerOptions": {"paths": {}}})),
        ("r", "w/tsconfig.json", json.dumps({"extends": "../t/tsconfig", "compilerOptions": {"paths": {"w": ["w"]}, "baseUrl": ".."}})),
        (None, "tsconfig.json", json.dumps({"compilerOptions": {"paths": paths, "baseUrl": "."}})), ("r", None, "{}"), ("r", "x/tsconfig.json", None), ("r", "y/tsconfig.jsonc", "{}"), ("r", "tsconfig.json", "{"),
    ]
    found = _effective(spark, rows[:-1])
    assert found == {("r", ""): (None, {"a": ["b"]}), ("r", "p"): ("src", paths), ("r", "p/q"): ("p/q/own", paths), ("r", "v"): (None, {}), ("r", "w"): (None, {"w": ["w"]}), (None, ""): (None, paths)}
    assert _effective(spark, []) == {}


def test_inheritance_has_ten_levels(spark):
    chain = lambda n: [("r", f"c{k}.json" if k else "tsconfig.json", json.dumps({"extends": f"./c{k + 1}"})) for k in range(n - 1)] + [("r", f"c{n - 1}.json", json.dumps({"compilerOptions": {"paths": {"a": ["b"]}}}))]
    assert len(_effective(spark, chain(10))) == 1 and _effective(spark, chain(11)) == {}


@pytest.fixture(scope="module")
def small_graph(spark):
    node = "STRUCT<path: STRING, sym_ord: BIGINT>"
    nodes = spark.createDataFrame([("r", ("a", 0), "f", "A::f"), ("r", ("a", 1), "g", "A::g"), ("r", ("b", 0), "h", "B::h"), ("r", ("b", 1), "g", "B::g")], f"repo STRING, node {node}, name STRING, qualified_name STRING")
    pairs = spark.createDataFrame([("r", ("a", 0), ("a", 1), 3, False), ("r", ("a", 1), ("b", 0), 5, True)], f"repo STRING, caller {node}, callee {node}, call_line BIGINT, inferred BOOLEAN")
    return nodes, pairs


def test_unique_names_and_path_steps(spark, small_graph):
    nodes, pairs = small_graph
    start = report.only_node(nodes, "A::f")
    with pytest.raises(LookupError, match="ambiguous \\(2 matches\\)"):
        report.only_node(nodes, "g")
    with pytest.raises(LookupError, match="no matches"):
        report.only_node(nodes, "zz")
    reached = graph.reach(pairs, start)
    found = sorted((tuple(r["node"]), r["step"], tuple(r["caller"]), tuple(r["callee"]), r["call_line"]) for r in report.steps(reached, pairs).collect())
    assert found == [(("a", 1), 1, ("a", 0), ("a", 1), 3), (("b", 0), 1, ("a", 0), ("a", 1), 3), (("b", 0), 2, ("a", 1), ("b", 0), 5)]
    texts = {tuple(r["node"]): r["text"] for r in report.path_text(report.steps(reached, pairs), nodes).collect()}
    assert texts[("b", 0)] == "path found (2 hops):\n  a:3  A::f → A::g\n  a:5  A::g → B::h"


def test_edge_and_hit_lines(spark, small_graph):
    nodes, pairs = small_graph
    callers = graph.neighbours(nodes, pairs, "h", True).select(report.edge_line(True).alias("l")).collect()
    callees = graph.neighbours(nodes, pairs, "A::f", False).select(report.edge_line(False).alias("l")).collect()
    assert [r["l"] for r in callers] == ["  a:5  A::g  (inferred)"] and [r["l"] for r in callees] == ["  a:3  A::f → A::g"]
    hits = spark.createDataFrame([(0.12345, "p", 3, "Function", "f", "one\ntwo"), (1.0, None, None, None, None, None)], "score DOUBLE, path STRING, line BIGINT, kind STRING, name STRING, card STRING")
    assert [r["l"] for r in hits.select(report.hit_line(True).alias("l")).collect()] == ["0.123 p:3 Function f\n  one\n  two", "1.000 :  \n  "]


def test_marks_and_lexicon(spark, tmp_path):
    usage, path = f"file://{tmp_path}/usage", f"file://{tmp_path}/lexicon.json"
    learn.mark_used(spark, "Some Query", ["a.rs", "b.rs"], usage)
    learn.mark_used(spark, "other", ["c.rs"], usage)
    with pytest.raises(ValueError, match="at least one path"):
        learn.mark_used(spark, "x", [], usage)
    assert sorted((r["query"], r["used"]) for r in jsonl.read_or_empty(spark, usage, "query STRING, used ARRAY<STRING>").collect()) == [("Some Query", ["a.rs", "b.rs"]), ("other", ["c.rs"])]
    assert learn.load_lexicon(spark, path).count() == 0
    terms = spark.createDataFrame([("b", "promote", 1.0), ("ä", "promote", 1.0), ("c", "demote", 1.0)], learn.LEXICON)
    learn.save_lexicon(terms, path, {"groups": 3})
    assert {tuple(r) for r in learn.load_lexicon(spark, path).collect()} == {tuple(r) for r in terms.collect()}
    saved = json.loads((tmp_path / "lexicon.json").read_text())
    assert saved == {"version": 1, "promote": {"b": 1.0, "ä": 1.0}, "demote": {"c": 1.0}, "stats": {"groups": 3}}
    (tmp_path / "bad.json").write_text("{ no")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|corrupt"):
        learn.load_lexicon(spark, f"file://{tmp_path}/bad.json").collect()


def test_fingerprints_and_bounded_text(spark):
    rows = [("r", f"p{k}", f"t{k}") for k in range(300)]
    one = files.source_fingerprints(spark.createDataFrame(rows, FILES), "v1").first()["fingerprint"]
    again = files.source_fingerprints(spark.createDataFrame(rows[::-1], FILES).repartition(3), "v1").first()["fingerprint"]
    assert one == again and len(one) == 16
    changed = [files.source_fingerprints(spark.createDataFrame(x, FILES), v).first()["fingerprint"] for x, v in ((rows, "v2"), (rows[1:], "v1"), ([("r", "p0", "other"), *rows[1:]], "v1"))]
    assert len({one, *changed}) == 4 and files.source_fingerprints(spark.createDataFrame([("r", None, "x")], FILES), "v").count() == 0
    raw = spark.createDataFrame([(bytearray(b"a" * 70000),), (bytearray("é".encode()[:1]),), (None,)], "b BINARY").select(T.bounded_text(F.col("b")).alias("t")).collect()
    assert [len(r["t"]) if r["t"] is not None else None for r in raw] == [65536, 1, None] and raw[1]["t"] == "�"


def test_written_tables_are_released(spark, tmp_path):
    from codelode import common

    common.release(spark)
    first = common.written(spark.range(3).toDF("id"), "a")
    assert first.count() == 3 and len(common._MADE) == 1
    path = common._MADE[0]
    assert jsonl.exists(spark, path) and common.release(spark) == 1 and not jsonl.exists(spark, path) and common.release(spark) == 0
