from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codelode.functions import text as T
from codelode.operators import change_log, evaluate, files, gate, graph, learn, resolve, scip, search, snapshot
from codelode.operators.cards import file_cards, with_cards
from codelode.schema import RECORD_DDL, record

T0 = dt.datetime(2025, 1, 1)
SNAP = "repo STRING, snapshot_no BIGINT, path STRING, content_hash STRING, received_at TIMESTAMP, grp STRING, item STRING"


def diff(spark, rows):
    from codelode.operators.snapshot_diff import snapshot_changes

    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SNAP)
    return {tuple(r) for r in snapshot_changes(df, bucket_rows=2).collect()}


def test_snapshot_changes(spark):
    rows = [("a", 1, "x", "AA", T0), ("a", 1, "y", "bb", T0), ("a", 1, "n", None, T0), ("a", 3, "x", "aa", T0), ("a", 3, "z", "cc", T0), ("a", 3, "n", None, T0), ("a", 4, "x", "old", T0), ("a", 4, "x", "new", T0 + dt.timedelta(days=9)), ("a", 4, "z", None, T0), ("b", 7, "q", "1", T0)]
    assert diff(spark, rows) == {("a", 3, "y", "removed"), ("a", 3, "z", "added"), ("a", 4, "x", "changed"), ("a", 4, "z", "changed"), ("a", 4, "n", "removed")}


def test_snapshot_changes_odd_rows(spark):
    assert diff(spark, []) == set()
    rows = [(None, 1, "x", "a", T0), (None, 2, "x", "b", None), ("a", None, "x", "a", T0), ("a", 1, None, "a", T0), ("a", 1, "x", "a", T0), ("a", 1, "x", "a", T0)]
    assert diff(spark, rows) == {(None, 2, "x", "changed")}


def test_snapshot_changes_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"r{rng.randrange(2)}", rng.choice([1, 2, 4, 5]), f"p{rng.randrange(30)}", rng.choice(["a", "b", None]), T0 + dt.timedelta(seconds=k)) for k in range(400)]
    held = {}
    for repo, no, path, digest, at in rows:
        held[repo, no, path] = digest
    want = set()
    for repo in {r[0] for r in rows}:
        numbers = sorted({r[1] for r in rows if r[0] == repo})
        for a, b in zip(numbers, numbers[1:]):
            for k in range(30):
                o, n = (repo, a, f"p{k}"), (repo, b, f"p{k}")
                if n in held and o not in held:
                    want.add((repo, b, n[2], "added"))
                elif o in held and n not in held:
                    want.add((repo, b, n[2], "removed"))
                elif o in held and held[o] != held[n]:
                    want.add((repo, b, n[2], "changed"))
    assert diff(spark, rows) == want


def test_bitmaps():
    import numpy as np

    from codelode.operators.snapshot_diff import Bitmap

    rng = np.random.default_rng(1)
    sets = [np.arange(100_000), rng.integers(0, 200_000, 60_000), rng.integers(0, 300_000, 50), np.array([65535, 65536, 131071]), np.zeros(0, np.int64), np.arange(0, 65536)]
    for a in sets:
        assert Bitmap.from_bytes(Bitmap.of(a).to_bytes()).ordinals().tolist() == sorted(set(a.tolist()))
        for b in sets:
            assert Bitmap.of(a).and_not(Bitmap.of(b)).ordinals().tolist() == sorted(set(a.tolist()) - set(b.tolist())) and Bitmap.of(a).and_(Bitmap.of(b)).ordinals().tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    assert len(Bitmap.of(sets[0]).to_bytes()) < 50  # runs
    assert len(Bitmap.of(sets[2]).to_bytes()) < 200  # members


def test_snapshot_store_keeps_ordinals_and_compares_neighbours_only(spark):
    from codelode.operators.snapshot_diff import SnapshotStore, snapshot_changes

    rng = random.Random(6)
    rows = [(repo, no, f"p{rng.randrange(40)}", rng.choice(["a", "b", None]), T0 + dt.timedelta(seconds=k)) for repo in ("r", None) for no in (1, 2, 5, 7) for k in range(30)]
    part = lambda *numbers: spark.createDataFrame([(*r, "", "") for r in rows if r[1] in numbers], SNAP)
    store = SnapshotStore(spark, bucket_rows=50)
    ordinals = lambda: {(r["grp"], r["bucket"], x): r["first"] + k for r in store.stored().where("kind = 'dictionary'").collect() for k, x in enumerate(r["items"])}
    found, kept = {}, {}
    for numbers in ((1, 2), (7,), (5,)):  # a snapshot that comes late lies between two others
        changes = {tuple(r) for r in snapshot_changes(part(*numbers), store=store).collect()}
        assert {r[1] for r in changes} == {1: {2}, 7: {7}, 5: {5, 7}}[numbers[0]]
        for key, k in kept.items():
            assert ordinals()[key] == k
        kept, found = ordinals(), changes
    whole = {tuple(r) for r in snapshot_changes(part(1, 2, 5, 7)).collect()}
    decoded = lambda r: (r["grp"][1:] if r["grp"] else None, r["snapshot_no"], r["item"], r["change_kind"])
    assert {decoded(r) for r in store.changes().collect()} == whole and len(set(kept.values())) <= len(kept) and found <= whole
    # the same snapshot again, with other rows: it replaces the stored one
    again = spark.createDataFrame([("r", 5, "p1", "z", T0, "", "")], SNAP)
    snapshot_changes(again, store=store).collect()
    now = {tuple(r) for r in snapshot_changes(part(1, 2, 7).unionByName(part(5).where("repo IS NULL")).unionByName(again)).collect()}
    assert {decoded(r) for r in store.changes().collect()} == now


FEED = "arrival_no BIGINT, repo STRING, seq BIGINT, event STRING, path STRING, ir STRUCT<path: STRING, content_hash: STRING>"


def feed(spark, rows):
    return spark.createDataFrame(rows, FEED)


def test_change_log(spark):
    rows = [(1, "a", 3, "updated", None, ("./x", "h3")), (2, "a", 1, " Updated", "x", ("x", "h1")), (3, "a", 2, "DELETED", ".\\x", None), (4, "a", 5, "deleted", "y", None), (5, "a", 4, "updated", "y", ("y", "h4")),
            (6, "a", None, "batch_end", None, None), (7, "b", 1, "updated", "d\\e", ("d/e", None)), (7, "b", 1, "updated", "d\\e", ("d/e", None)), (8, None, 1, "updated", "n", ("n", "hn")), (9, "a", 9, "updated", None, None)]
    want = {("a", "x", "h3"), ("b", "d/e", None), (None, "n", "hn")}
    assert {tuple(r) for r in change_log.state_after(change_log.changes_of(feed(spark, rows))).collect()} == want
    assert {tuple(r) for r in change_log.replayed(feed(spark, rows)).collect()} == want


def test_change_log_runs_compact_and_repeat(spark):
    rng = random.Random(3)
    rows = [(k, "a", rng.randrange(500), rng.choice(["updated", "deleted"]), f"p{rng.randrange(12)}", None) for k in range(300)]
    rows = [(a, r, s, e, p, (p, f"h{s}") if e == "updated" else None) for a, r, s, e, p, _ in rows]
    log = change_log.ChangeLog(spark, most_runs=3)
    assert log.read().count() == 0
    parts = [rows[k::7] for k in range(7)]
    for part in [*parts, parts[0]]:
        log.append(change_log.changes_of(feed(spark, part)))
    last = {}
    for a, _, s, e, p, ir in rows:
        if p not in last or (s, a) > last[p][:2]:
            last[p] = (s, a, e, ir)
    want = {(p, x[3][1]) for p, x in last.items() if x[2] == "updated"}
    assert {(r["path"], r["content_hash"]) for r in log.read().collect()} == want
    assert len(log.runs()) <= 3 and log.compactions() >= 2
    # a reader that began before a compaction still finds its runs
    before = log.merged()
    log.compact()
    assert log.runs()[0].startswith("compacted-") and {(r["path"], r["content_hash"]) for r in before.where("alive").collect()} == want
    # the log is found again under its path, with its own number of parts
    assert {(r["path"], r["content_hash"]) for r in change_log.ChangeLog(spark, log.path, parts=99).read().collect()} == want and change_log.ChangeLog(spark, log.path, parts=99).parts == log.parts


def test_merge_of_sorted_runs():
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "ä"]), f"p{rng.randrange(9)}", rng.randrange(40), rng.choice([None, 1, 2]), rng.random() < 0.5, rng.choice([None, "h", "g"])) for _ in range(400)]
    runs = [sorted(rows[k::6], key=change_log._key) for k in range(5)] + [rows[5::6]]
    want = {}
    for r in rows:
        if r[:2] not in want or change_log._key(want[r[:2]]) < change_log._key(r):
            want[r[:2]] = r
    merged = change_log.merge_runs(runs)
    assert {r[:2]: r for r in merged} == want and len(merged) == len(want) and merged == sorted(merged, key=change_log._key)


def test_deliveries_are_appended_in_one_pass_and_compacted(spark):
    rows = [(k, None if k % 3 else "a", k % 70, "updated" if k % 5 else "deleted", f"p{k % 12}", (f"p{k % 12}", f"h{k}") if k % 5 else None) for k in range(300)]
    log = change_log.change_log(feed(spark, rows))
    assert log.compactions() == 1 and 2 <= len(log.runs()) <= 8
    assert {tuple(r) for r in log.read().collect()} == {tuple(r) for r in change_log.state_after(change_log.changes_of(feed(spark, rows))).collect()}
    assert change_log.replayed(feed(spark, [])).count() == 0 and change_log.replayed(feed(spark, [(None, None, 3, "updated", "x", ("x", None))])).collect()[0][1:] == ("x", None)


# --- functions


@pytest.mark.parametrize(("text", "words"), [("HTTPServer est_tokens", "https erver est tokens"), ("FileParseIR", "file parse ir"), ("", ""), ("XMLHttp", "xmlh ttp"), ("größeWert x1y2", "größe wert x1y2")])
def test_tokenize(spark, text, words):
    df = spark.createDataFrame([(text,)], "t STRING").select(F.array_join(T.tokenize("t"), " ").alias("w"))
    assert df.first()["w"] == words
    if text.isascii():
        assert " ".join(search.query_terms(text)) == words


@pytest.mark.parametrize(("path", "want"), [("a/./b/../c//d", "a/c/d"), ("../../x", "x"), ("", ""), ("a/..", "")])
def test_normalized_path(spark, path, want):
    assert spark.createDataFrame([(path,)], "p STRING").select(T.normalized_path(F.col("p"))).first()[0] == want


def test_bare_name(spark):
    names = {"some_crate::parse_repo(&d).with": "parse_repo", "results.iter().map": None, "alpha()": "alpha", "a::": None, "x.y": None, "plain": "plain"}
    rows = spark.createDataFrame([(n,) for n in names], "n STRING").select("n", T.bare_name(F.col("n")).alias("b")).collect()
    assert {r["n"]: r["b"] for r in rows} == names


# --- graph


def symbol(name, key=None, line=1):
    return {"local_key": key or name, "name": name.rpartition("::")[2], "qualified_name": name, "kind": "Function", "start_line": line, "end_line": line + 2, "start_byte": None, "end_byte": None, "signature": None, "parameters": [], "return_type": None, "docstring": None, "is_test": False}


def call(caller, callee, line, local=None, file=None, external=False):
    return {"caller_local_key": caller, "callee_name": callee, "callee_local_key": local, "callee_file": file, "callee_external": external, "line": line, "column": None}


def rec(path, symbols=(), calls=(), imports=(), language="Rust"):
    card = {"card_version": 1, "est_tokens": 3, "text": "FILE " + path}
    return {"repo": "r", "ir_version": 4, "path": path, "language": language, "content_hash": "0123456789ab", "byte_len": 1, "line_count": 100, "metrics": None, "docstring": None, "symbols": list(symbols), "calls": list(calls), "imports": list(imports), "diagnostics": [], "retrieval_card": card, "symbol_cards": [card for _ in symbols]}


@pytest.fixture
def corpus(spark):
    rows = [
        rec("src/lib.rs", [symbol(n) for n in ("main", "setup", "broken", "indirect")], [call("main", "util::helper", 4, file="src/util.rs"), call("main", "core::parse_repo", 5), call("setup", "main", 11, local="main"), call("broken", "missing::thing", 16, external=True), call("indirect", "util::helper", 20, file="src/other.rs")]),
        rec("src/other.rs", [symbol("other::helper"), symbol("other::parse_repo")]),
        rec("src/util.rs", [symbol("util::helper", "helper"), symbol("util::run_helper", "run_helper")], [call("run_helper", "helper", 8, local="helper")]),
    ]
    return spark.createDataFrame(rows, f"repo STRING, {RECORD_DDL}")


def test_edges(spark, corpus):
    names = {(r["path"], r["sym_ord"]): r["qualified_name"] for r in graph.nodes(corpus).collect()}
    found = {(names[tuple(r["caller"])], names[tuple(r["callee"])], r["call_line"], r["inferred"]) for r in graph.adjacency(graph.edges(corpus)).collect()}
    assert found == {("indirect", "other::helper", 20, False), ("main", "other::parse_repo", 5, True), ("main", "util::helper", 4, False), ("setup", "main", 11, False), ("util::run_helper", "util::helper", 8, False)}
    pairs, nodes = graph.adjacency(graph.edges(corpus)), graph.nodes(corpus)
    assert {r["qualified_name"] for r in graph.neighbours(nodes, pairs, "util::helper", True).collect()} == {"main", "util::run_helper"}
    assert graph.lookup(nodes, "helper").count() == 2 and graph.lookup(nodes, "nothing").count() == 0


def test_shortest_path(spark, corpus):
    pairs = graph.adjacency(graph.edges(corpus))
    setup, main, helper = ("src/lib.rs", 1), ("src/lib.rs", 0), ("src/util.rs", 0)
    assert graph.shortest_path(pairs, "r", setup, helper) == [setup, main, helper]
    assert graph.shortest_path(pairs, "r", setup, helper, 1) == []
    assert graph.shortest_path(pairs, "r", main, ("src/util.rs", 1)) == []
    assert graph.shortest_path(pairs, "r", main, main) == [main]


def test_cross_file(spark, corpus):
    rows = {r["callee_name"]: r for r in resolve.across_files(spark.createDataFrame([rec("a.rs", [symbol("m::f")], [call("m::f", "n::g", 1), call("m::f", "x::y", 2), call("m::f", "m::f", 3), call("m::f", "bare", 4)]), rec("b.rs", [symbol("n::g")])], f"repo STRING, {RECORD_DDL}")).collect()}
    assert rows["n::g"]["callee_file"] == "b.rs" and rows["x::y"]["callee_external"] and rows["m::f"]["callee_file"] is None and not rows["m::f"]["callee_external"] and rows["bare"]["callee_external"] is False


def test_imports_and_aliases(spark):
    files = spark.createDataFrame([("r", p) for p in ("src/a/b.ts", "src/lib/x.ts", "src/util.ts", "src/dir/index.tsx")], "repo STRING, path STRING")
    rows = spark.createDataFrame([("r", "src/a/b.ts", m) for m in ("../util", "~/lib/x", "react", "../dir", "../lib/x.ts")], "repo STRING, path STRING, target_module STRING")
    configs = spark.createDataFrame([("r", "", None, {"~/*": ["src/*"]}), ("r", "other", None, {"~/*": ["no/*"]})], "repo STRING, dir STRING, base_url STRING, paths MAP<STRING, ARRAY<STRING>>")
    found = {r["target_module"]: r["resolved"] for r in resolve.probed(resolve.import_candidates(rows, configs), files).collect()}
    assert found == {"../util": "src/util.ts", "~/lib/x": "src/lib/x.ts", "react": None, "../dir": "src/dir/index.tsx", "../lib/x.ts": "src/lib/x.ts"}


# --- search, snapshot, learning, gate


def test_search(spark):
    words = ["alpha beta", "alpha gamma", "alpha"]
    units = spark.createDataFrame([("r", f"p{k}", 0, "file", f"p{k}", "h", w.split(), f"p{k}", w, 1) for k, w in enumerate(words)], "repo STRING, path STRING, line BIGINT, kind STRING, name STRING, content_hash STRING, terms ARRAY<STRING>, target STRING, card STRING, est_tokens BIGINT")
    assert [r["path"] for r in search.search(units, "alpha beta", with_fuzzy=False).collect()] == ["p0", "p1", "p2"]
    assert [r["path"] for r in search.search(units, "re:gam+a").collect()] == ["p1"]
    boosted = search.search(units, "alpha", lexicon=(["gamma"], ["beta"]), with_fuzzy=False).collect()
    assert [r["path"] for r in boosted] == ["p1", "p2", "p0"] and boosted[0]["score"] == pytest.approx(0.8)
    for bad in ("  ", "::", "re:a(?=b)"):
        with pytest.raises(ValueError):
            search.search(units, bad)
    assert search.search(units, "p1").first()["path"] == "p1"


@pytest.mark.parametrize(("text", "pattern", "better"), [("encode_replica", "enc", "xexnxc"), ("parseRepo", "pr", "apart")])
def test_subsequence_score(text, pattern, better):
    assert search.subsequence_score(text, pattern) > search.subsequence_score(better, pattern)
    assert search.subsequence_score("abc", "acb") is None
    assert search.subsequence_score("abc", "ABC") is None and search.subsequence_score("ABC", "abc") is not None


def test_snapshot_budget(spark):
    rows = [rec(f"src/mod_{k:02d}.rs", [symbol(f"sym_{k}_{j}") for j in range(k % 9)]) | {"line_count": 100 + k} for k in range(40)]
    df = spark.createDataFrame(rows, f"repo STRING, {RECORD_DDL}")
    for budget in (500, 800, 2500):
        a = snapshot.rendered(df, budget).first()
        b = snapshot.rendered(df.orderBy(F.rand(1)).repartition(7), budget).first()
        assert a["content"] == b["content"] and a["est_tokens"] <= budget
        lines = sorted(rows, key=lambda r: (-len(r["symbols"]), r["path"]))
        used, states = snapshot.RESERVED, {}
        tokens = lambda s: -(-len(s.encode()) // 4)
        for r in lines:
            bare = f"{r['path']} Rust {r['line_count']}L"
            names = ", ".join(s["name"] for s in r["symbols"])
            full = f"{bare}  {names}" if names else bare
            for line in (full, bare):
                if used + tokens(line) <= budget:
                    used += tokens(line)
                    states[r["path"]] = line
                    break
        assert a["content"].split("\n")[1 : 1 + a["files"]] == [states[p] for p in sorted(states)]
        assert ("more files omitted" in a["content"]) == (a["omitted"] > 0)
    assert snapshot.rendered(df, 10).first()["budget"] == 500 and snapshot.rendered(df, 99999).first()["budget"] == 8000


def test_held_snapshot():
    held = snapshot.Held("text", [], 300, 0)
    assert not held.is_idle_expired(299) and held.is_idle_expired(300)
    held.read(250)
    assert not held.is_idle_expired(500) and held.is_idle_expired(550)


def test_learning(spark):
    trails = [(f"query {k}", [(f"p{k}", ["good", "bad"] if False else ["good"]), (f"q{k}", ["bad"])]) for k in range(12)]
    df = spark.createDataFrame(trails, "query STRING, candidates ARRAY<STRUCT<path: STRING, terms: ARRAY<STRING>>>")
    usage = spark.createDataFrame([(f"Query  {k}", [f"p{k}"]) for k in range(12)], "query STRING, used ARRAY<STRING>")
    assert {(r["term"], r["polarity"]) for r in learn.learned(df, usage).collect()} == {("good", "promote"), ("bad", "demote")}
    assert learn.learned(df.limit(3), usage).count() == 0
    flipped = spark.createDataFrame([(f"query {k}", [f"p{k}"] if k not in (7, 8, 9) else []) for k in range(12)], "query STRING, used ARRAY<STRING>")
    assert ("good", "promote") not in {(r["term"], r["polarity"]) for r in learn.learned(df, flipped, 0.2).collect()}


def test_gate(spark):
    rows = spark.createDataFrame([("a", 0.9, 0.8), ("b", 0.6, 0.3), ("c", 0.4, 0.2)], "key STRING, q0 DOUBLE, s0 DOUBLE")
    cache = spark.createDataFrame([("a", 2, 0.0, 0.0), ("a", 1, 0.9, 0.8)], "key STRING, ord BIGINT, q DOUBLE, scope DOUBLE")
    found = gate.gated(rows, cache, lambda m: m.select("key", F.col("q0").alias("q"), F.col("s0").alias("scope")))
    assert {(r["key"], r["verdict"]) for r in found.collect()} == {("a", "inline"), ("b", "lead")}


def test_quality(spark):
    hits = spark.createDataFrame([(1, "b", 1), (1, "b", 2), (1, "a", 3)], "item_id BIGINT, path STRING, place BIGINT")
    gold = spark.createDataFrame([(1, ["a", "z"]), (2, []), (3, None)], "item_id BIGINT, gold ARRAY<STRING>")
    rows = {r["item_id"]: (r["recall"], r["reciprocal_rank"]) for r in evaluate.quality(evaluate.ranked_files(hits), gold, 5).collect()}
    assert rows == {1: (0.5, 0.5), 2: (0.0, 0.0), 3: (0.0, 0.0)}


def test_bindings(spark):
    pre = "rust-analyzer cargo x 0.1.0 "
    greet, english, german, new = pre + "Greeter#greet().", pre + "impl#[English][Greeter]greet().", pre + "impl#[German][Greeter]greet().", pre + "impl#[Cache]new()."
    occ = [("src/lib.rs", greet, 1, [4, 7, 12]), ("src/lib.rs", english, 1, [9, 7, 12]), ("src/lib.rs", german, 1, [16, 7, 12]), ("src/lib.rs", new, 1, [26, 7, 10]), ("src/lib.rs", greet, 0, [36, 6, 11]), ("src/lib.rs", new, 0, [44, 23, 26]), ("src/lib.rs", new, 0, [44, 23, 26]), ("src/lib.rs", "local 1", 0, [1, 1, 2])]
    kinds = [(s, "Method") for s in (greet, english, german, new)]
    rows = scip.bindings(spark.createDataFrame(occ, "doc STRING, symbol STRING, roles BIGINT, range ARRAY<BIGINT>"), spark.createDataFrame(kinds, "symbol STRING, kind STRING")).collect()
    by = {r["line"]: r for r in rows}
    assert len(rows) == 2 and by[45]["callee_qualified_name"] == "Cache::new" and by[45]["dispatch"] == "static" and by[45]["callee_line"] == 27
    assert by[37]["dispatch"] == "trait" and [(c["line"], c["qualified_name"]) for c in by[37]["impl_candidates"]] == [(10, "English::greet"), (17, "German::greet")]


def test_files(spark):
    df = spark.createDataFrame([("r", "a.rs", 5), ("r", "b.rs", 6), ("r", "c.rs", None)], "repo STRING, path STRING, byte_len BIGINT")
    kept, skipped = files.split_by_size(df, 5)
    assert {r["path"] for r in kept.collect()} == {"a.rs", "c.rs"} and files.skipped_rows(skipped, 5).first()["severity"] == "Warning"
    texts = spark.createDataFrame([("r", "a.rs", "//! top\n//! two\n\n/* x\n y */\nfn a() {}\n"), ("r", "e.py", ""), ("r", "p.py", '#!/usr/bin/env python\n# c\n"""Doc."""\nx = 1')], "repo STRING, path STRING, text STRING")
    m = {r["path"]: (r["code_lines"], r["comment_lines"], r["blank_lines"]) for r in files.line_counts(texts).collect()}
    assert m == {"a.rs": (1, 4, 2), "e.py": (0, 0, 0), "p.py": (2, 2, 0)}
    docs = {r["path"]: r["docstring"] for r in files.module_docs(texts).collect()}
    assert docs == {"a.rs": "top\ntwo", "e.py": None, "p.py": "Doc."}


def test_empty_tables(spark):
    none = spark.createDataFrame([], f"repo STRING, {RECORD_DDL}")
    assert graph.edges(none).count() == 0 and file_cards(none).count() == 0 and search.units(none).count() == 0 and snapshot.rendered(none).count() == 0 and resolve.in_file(none).count() == 0
    odd = spark.createDataFrame([{f.name: None for f in record().fields} | {"repo": None, "path": "x"}], f"repo STRING, {RECORD_DDL}")
    assert file_cards(odd).first()["text"].startswith("FILE path=x") and with_cards(odd).count() == 1 and search.units(odd).count() == 1 and files.invalid(odd).count() >= 1
