from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from codelode.llm import abuse, function_docs, leakage, packing, provenance, queries, syntax, term_weight, value_counts
from codelode.llm.text import unescaped
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_twin(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLE[name])


# --- term weights and counts

UNITS = "unit_id BIGINT, terms ARRAY<STRING>, term STRING, score DOUBLE"


def test_term_scores(spark):
    units = {1: ["a", "a", "b"], 2: ["b", "c"], 3: ["b"], 4: []}
    rows = [(u, t, "clash", 0.0) for u, t in units.items()] + [(1, ["a", "a", "b"], "x", 0.0), (5, None, "x", 0.0), (6, [None, ""], "x", 0.0), (None, ["z"], "x", 0.0)]
    found = {(r["unit_id"], r["term"]): r["score"] for r in term_weight.term_scores(spark.createDataFrame(rows, UNITS)).collect()}
    with_terms = {u: t for u, t in units.items() if t}
    cf, n, mean = Counter(x for t in with_terms.values() for x in t), len(with_terms), sum(map(len, with_terms.values())) / len(with_terms)
    want = {}
    for u, t in with_terms.items():
        for x, tf in Counter(t).items():
            tfn, rate = tf * math.log2(1 + mean / len(t)), cf[x] / n
            want[u, x] = round((math.log2(1 + rate) + tfn * math.log2((1 + rate) / rate)) / (tfn + 1), 9)
    assert found == pytest.approx(want)
    assert {(r["unit_id"], r["term"]) for r in term_weight.leading_terms(term_weight.term_scores(spark.createDataFrame(rows, UNITS))).collect()} == {(1, "a"), (2, "c"), (3, "b")}
    assert term_weight.term_scores(spark.createDataFrame([], UNITS)).count() == 0


def test_hot_terms_are_joined_like_others(spark, monkeypatch):
    rows = [(k, ["hot", f"t{k % 40}"], "", 0.0) for k in range(3000)]
    df = spark.createDataFrame(rows, UNITS)
    one = {tuple(r) for r in term_weight.term_scores(df).collect()}
    monkeypatch.setattr(term_weight, "HOT_SHARE", 2.0)
    assert one == {tuple(r) for r in term_weight.term_scores(df).collect()} and len(one) == 6000


def test_value_counts(spark):
    rows = [(["a", "a", None, "b"],), (["a"],), (None,), ([],), ([f"v{k}" for k in range(9000)],)]
    found = {r["value"]: (r["occurrences"], r["records"]) for r in value_counts.value_counts(spark.createDataFrame(rows, "names ARRAY<STRING>").repartition(3)).collect()}
    assert found["a"] == (3, 2) and found["b"] == (1, 1) and len(found) == 9002
    assert value_counts.value_counts(spark.createDataFrame([], "names ARRAY<STRING>")).count() == 0
    ids = value_counts.dictionary(spark.createDataFrame([("b",), ("a",), ("b",)], "value STRING")).collect()
    assert sorted((r["id"], r["value"]) for r in ids) == [(0, "a"), (1, "b")]


# --- sources that do not parse, provenance

FILES = "doc_id BIGINT, source STRING, repo STRING, path STRING, text STRING"


def test_syntax(spark):
    assert syntax.verdict("fn main() {}", "Python") == ("wrong_extension", "Rust", ["Rust"]) and syntax.verdict("a ) (", "Rust") == ("corrupt", None, []) and syntax.verdict(" \n", "Rust")[:2] == ("ok", "Rust")
    assert syntax.verdict("let x = 1;\n", "JavaScript") == ("ok", "JavaScript", ["JavaScript", "TypeScript"]) or syntax.verdict("let x = 1;\n", "JavaScript")[2] == ["TypeScript", "JavaScript"]
    assert syntax.verdict("(" * 50000 + ")" * 50000, "Python")[0] == "too_deep" and syntax.verdict("x = " + "[" * 50000 + "]" * 50000 + ";", "JavaScript")[0] == "too_deep"
    rows = [(1, "repo_file", "r", "a.py", "x ="), (2, "repo_file", None, "b.rs", "fn f() {}"), (3, "review", "r", None, "x ="), (4, "repo_file", "r", "c.md", "x ="), (5, "repo_file", "r", "d.js", None), (6, "repo_file", "r", "e.ts", ""), (7, "repo_file", "r", "long.py", "x = 1\n" * 50000 + "(")]
    assert {(r["repo"], r["path"]) for r in syntax.broken(spark.createDataFrame(rows, FILES)).collect()} == {("r", "a.py"), ("r", "long.py")}


HAND = "import { a } from './a';\n\n/** Adds one. */\nexport function add(x) {\n  if (x > 3) {\n    throw new Error('no');\n  }\n  return x + 1;\n}\n"


@pytest.mark.parametrize(("path", "text", "kind"), [
    ("src/a.js", HAND, None), ("src/vendor/a.js", HAND, "vendored"), ("src/vendor_portal/a.js", HAND, None), ("src/generated_reports/a.js", HAND, None), ("src/a.min.js", HAND, "minified"), ("a_pb2.py", "x = 1", "generated"),
    ("a.js", "// hello\n// Code generated by x. DO NOT EDIT.\n" + HAND, "generated"), ("a.js", "const B = 'Code generated by us. DO NOT EDIT.';\n" + HAND, None), ("a.js", HAND + "// The generated tables are written by hand here.\n", None),
    ("a.js", "// The generated tables live elsewhere; the template is written by hand.\n" + HAND, None), ("a.py", "D = [\n" + "    0x1f, 0x2e, 0x3d, 0x4c,\n" * 40 + "]\n", "data"), ("a.py", 'D = "' + "aGVsbG8" * 60 + '"\n', "data"),
    ("a.py", 'HELP = "' + "These are plain words of a long help text. " * 40 + '"\n', None), ("a.js", "var a=function(t){return t&&t.b?t.c(4):null};" * 40, "minified"), ("a.ts", "export enum E {\n" + "".join(f"  V_{k} = {k},\n" for k in range(20)) + "}\n", "generated"),
    ("a.js", "", None), ("vendor/a.js", " \n", None), ("a.js", "// taken over from upstream tiny on 2020-01-01\n" + HAND, "vendored"), ("a.py", "{\n" + "".join(f'  "k_{k}": {{"a": {k}}},\n' for k in range(20)) + "}\n", None),
])
def test_kind(path, text, kind):
    assert provenance.kind_by_text(path, text) == kind


def test_copies(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    body = lambda n: "\n".join(f"{rng.choice(words)} = {rng.choice(words)}({rng.choice(words)}, {rng.choice(words)})" for _ in range(n))
    shared = body(60)
    rows = [(f"r{k}", "lib/copy.py", f"# local {k}\n{shared}\n{body(3)}", 9, 9) for k in range(4)] + [(f"r{k}", "own.py", body(60), 9, 9) for k in range(4)] + [("r1", "a.py", shared[:80], 9, 9), (None, "n.py", None, None, None), ("r0", "e.py", "", 0, 1)]
    df = spark.createDataFrame(rows, "repo STRING, path STRING, text STRING, byte_len BIGINT, line_count BIGINT")
    assert {(r["repo"], r["path"], r["kind"]) for r in provenance.not_handwritten(df).collect()} == {(f"r{k}", "lib/copy.py", "vendored") for k in range(4)}


def test_winnowing_finds_shared_windows():
    a = " ".join(f"t{k}" for k in range(200))
    assert set(provenance.fingerprints("x y z " * 20 + a)) & set(provenance.fingerprints(a)) and not len(provenance.fingerprints("a b"))


# --- documentation


@pytest.mark.parametrize(("doc", "name", "tells"), [
    ("Not thread-safe.", "f", True), ("/// Idempotent; retries twice.", "f", True), ("Todo lists aside, the decoder is warm here.", "f", True), ("¿Puede alguien revisar el invoice?", "f", True), ("Joins pallets by weight.", "join_pallet", True),
    (None, "f", False), ("  ", "f", False), ("-----", "f", False), ("TODO(qa): write docs", "f", False), ("todo: describe count meadow", "count_meadow", False), ("See above.", "f", False), ("{@inheritDoc}", "f", False), ("@returns", "f", False),
    ("@param {number} chapter", "f", False), (":param token:\n:returns:", "f", False), ("Args:\n    vessel:\nReturns:", "f", False), ("Parameters: brush, parcel", "f", False), ("Join pallet (source)", "joinPallet", False), ("This function will drain thread.", "drain_thread", False),
    ("Defers actor.", "deferActor", False), ("`resolve_quorum`", "resolveQuorum", False), ("Implementation of sortParser.", "sort_parser", False), ("n/a", "f", False), ("No documentation yet.", "f", False), ("placeholder docstring", "f", False), ("@param x how many to keep", "f", True),
])
def test_informs(doc, name, tells):
    assert function_docs.informs(doc, name) is tells


def test_functions_of():
    rust = '/// Doc "}".\n#[test]\npub(crate) fn a() { let s = "}"; if x { } }\n\nfn b() {}\n// no\nfn c();\n'
    assert [(n, line, rust[s:e].count("{") == rust[s:e].count("}") or n == "a", d) for n, line, s, e, d in function_docs.functions_of(rust, "Rust")][0][::3] == ("a", '/// Doc "}".')
    py = 'def a(x):\n    """Doc."""\n    return 1\n\nclass C:\n    def b(self):\n        pass\n\nx = 1\n'
    assert [(n, line, py[s:e].rstrip()[-8:], d) for n, line, s, e, d in function_docs.functions_of(py, "Python")] == [("a", 1, "return 1", '"""Doc."""'), ("b", 6, "    pass", None)]
    js = "class A {\n  /** M. */\n  async m(a = {}) {\n    if (x) { y() }\n  }\n}\n/** F. */\nexport const f = (a) => {\n};\n"
    assert [(n, d) for n, _, _, _, d in function_docs.functions_of(js, "TypeScript")] == [("m", "/** M. */"), ("f", "/** F. */")]


# --- packing


def test_packing(spark):
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choice(["alpha", "beta", "x1"]) for _ in range(rng.randrange(1, 60)))) for k in range(300)] + [(900, "word " * 500), (901, None), (902, "  \n"), (None, "no id"), (5, "again")]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    windows = spark.createDataFrame([(1, 64), (2, 200), (3, None), (4, 0)], "window_id BIGINT, capacity_tokens BIGINT")
    rows = packing.packed(df, windows, block=120).collect()
    sizes = {}
    for _, t in docs:
        if t and t.strip():
            sizes[packing.n_tokens(t)] = sizes.get(packing.n_tokens(t), 0) + 1
    for window, capacity in ((1, 64), (2, 200)):
        mine = [r for r in rows if r["window_id"] == window]
        fill = Counter()
        for r in mine:
            fill[r["container"]] += r["n_tokens"]
        assert max(fill.values()) <= capacity and sum(fill.values()) == sum(n * k for n, k in sizes.items())
        assert len(fill) <= 1.06 * sum(fill.values()) / capacity + 3
        split = Counter(r["doc_id"] for r in mine if r["doc_id"] in (900,))
        assert split[900] == -(-packing.n_tokens("word " * 500) // capacity)
        fits = {d for d, t in docs if t and t.strip() and packing.n_tokens(t) <= capacity} - {5}
        assert all(n == 1 for d, n in Counter(r["doc_id"] for r in mine).items() if d in fits)
    assert {r["window_id"] for r in rows} == {1, 2}
    assert packing.packed(spark.createDataFrame([], "doc_id BIGINT, text STRING"), windows).count() == 0
    report = {r["window_id"]: r for r in packing.unused(packing.packed(df, windows, block=120), windows).collect()}
    assert report[3]["n_containers"] == 0 and report[3]["unused_share"] is None and 0 <= report[1]["unused_share"] < 0.1


def test_genetic_steps_keep_items():
    import numpy as np

    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 60, 200).tolist()
    population = packing.founders(sizes, 100, 4, rng)
    child = packing.crossover(population[0], population[-1], sizes, 100, rng)
    for bins, fills in (*population, child, packing.mutated(child, sizes, 100, rng), *packing.evolve(sizes, 100, population, 5, rng)):
        assert sorted(i for b in bins for i in b) == list(range(200)) and all(sum(sizes[i] for i in b) == f <= 100 for b, f in zip(bins, fills, strict=True))


# --- leakage

ITEM = "Before that sealed snapshot restores, any lazy meadow aligns some terrain until a global record becomes shallow unless the binding cannot forward twelve letters to 17 harbours near the quiet old mill today"


def leaks(spark, docs, items=((1, ITEM), (2, "only five short words here"), (3, None), (4, ""))):
    d = spark.createDataFrame(list(docs), "doc_id BIGINT, text STRING")
    return {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, spark.createDataFrame(list(items), "item_id BIGINT, text STRING")).collect()}


def test_leaks(spark):
    words = ITEM.split()
    replaced = [w if k % 7 else "other" for k, w in enumerate(words)]
    docs = [(1, "x " + ITEM.upper() + " y"), (2, "// " + "\n// ".join(words)), (3, " ".join(words[3:24])), (4, " ".join(words[:12])), (5, " ".join(replaced)), (6, None), (7, ""), (8, "say: only five short words here!"), (9, " ".join(w if k % 2 else "zz" for k, w in enumerate(words))), (10, "pad " * 20000 + ITEM), (11, ITEM.replace(" ", "\\n"))]
    assert leaks(spark, docs) == {(1, 1), (2, 1), (3, 1), (5, 1), (8, 2), (10, 1), (11, 1)}


def test_slots(spark):
    changed = ITEM.replace("twelve", "ninety").replace("17", "23")
    words = changed.split()
    assert leaks(spark, [(1, changed), (2, " ".join(words[8:30]))]) == {(1, 1), (2, 1)}
    assert leaks(spark, []) == set() and leaks(spark, [(1, ITEM)], []) == set()


def test_unescaped():
    assert unescaped("a\\nb &lt;c&gt; \\u00e9 &nosuch; 50&") == "a\nb <c> é &nosuch; 50&"


# --- abuse

CASES = ["You are a complete moron.", "what kind of cl*wn reviews a sensor like this?", "// eat shit, d u m b a s s", "Only a filthy ba.s.t.a.r.d like you would write this", "I will find out where you live and break your fingers.", "Send me nudes and I will merge it", "Women have no business in this team, go back to the kitchen.",
         "Du bist ein Vollidiot und solltest dich schämen", "tu es vraiment un 1mb3c1l3, dégage d'ici", "# nobody wants you here,\n# you useless piece of garbage", "FUCK YOU AND YOUR PARCEL", "shut up, you worthless ccllloowwnn"]
FINE = ["I was an idiot, my own commit broke it.", "This damn test is flaky again and I hate it.", "Kill the zombie child process before its parent dies.", "Strip the naked pointer and pass a handle.", 'BLOCKED = ["idiot", "moron", "bastard"]', "Harassment, hateful speech and sexual language are not tolerated. Report abuse to the maintainers.",
        "Could you move the shader out of the helper?", "The stupid flag name confused me.", "The master volume and its slave digestor disagree.", "Thank you for your review.", "Dumb terminals cannot sort the palette."]


def test_abuse(spark):
    docs = [(k, "review", t) for k, t in enumerate(CASES)] + [(100 + k, "review", t) for k, t in enumerate(FINE)] + [(200, None, None), (201, "chat", ""), (None, "chat", "You are a complete moron."), (202, "chat", "fine words " * 20000 + "you are a complete idiot")]
    df = spark.createDataFrame(docs, "doc_id BIGINT, source STRING, text STRING")
    scores = abuse.abuse_scores(df)
    rows = scores.collect()
    assert len(rows) == len(docs)
    assert {r["doc_id"] for r in rows if r["score"] >= 0.5} == {*range(len(CASES)), None, 202}
    assert {r["source"]: r["n_abusive"] for r in abuse.abuse_rates(scores).collect()} == {"review": len(CASES), "chat": 2, None: 0}
    assert abuse.abuse_scores(df.limit(0)).count() == 0


UNTRIGGERED = ["Arabs are animals.", "The migrants here are cockroaches.", "Somebody should shoot him.", "We will stab them.", "Break his legs.", "They must be shot.", "The author is a twat.", "Show cock."]


def test_abuse_in_every_sentence(spark):
    plain = "The parcel waits in the depot until the meter is read"
    docs = [(k, "review", f"{plain}. {t} {plain}.") for k, t in enumerate(UNTRIGGERED)] + [(100 + k, "review", f"{plain} {k}.") for k in range(60)] + [(200, "chat", f"{plain} " * 40 + UNTRIGGERED[0] + f" {plain}" * 40)]
    df = spark.createDataFrame(docs, "doc_id BIGINT, source STRING, text STRING")
    assert {r["doc_id"] for r in abuse.abuse_scores(df).collect() if r["score"] >= 0.5} == {*range(len(UNTRIGGERED)), 200}


def test_voters_are_asked_wherever_they_fire():
    texts = [*CASES, *FINE, *UNTRIGGERED, "fffuckk off", "she deserves to die", "no girl has ever", "'a b', 'c d', 'e'", "i must be such an absolute fool"]
    for s in [s for t in texts for s in abuse.sentences(t)]:
        assert abuse.votes_of(s) == sum(1 << k for k, v in enumerate(abuse.VOTERS) if v[2].search(s))
    long = "word " * 300 + "you utter moron " + "word " * 300
    found = abuse.examined(long)
    assert len(found) > 5 and sum(1 for v, _ in found if v) in (1, 2) and abuse.examined(" .\n") == []


def test_copies_do_not_fill_the_training_sample(spark, monkeypatch):
    copy = "You utter moron. The damn flag broke. The depot waits for the parcel."
    docs = [(k, "review", copy) for k in range(400)] + [(1000 + k, "review", f"You moron, w{k} is wrong. The stupid flag w{k} is set. A parcel w{k} waits.") for k in range(30)]
    seen = []
    trained = abuse._trained
    monkeypatch.setattr(abuse, "_trained", lambda rows: seen.extend(rows) or trained(rows))
    rows = abuse.abuse_scores(spark.createDataFrame(docs, "doc_id BIGINT, source STRING, text STRING"), training_rows=31).collect()
    assert len({tuple(r[0]) for r in seen}) == len(seen) == 93 and sorted(r[2] for r in seen)[-4:] == [1, 400, 400, 400]
    assert all(r["score"] >= 0.5 for r in rows)


@pytest.mark.parametrize(("text", "kind"), [
    ("// A long licence.\n" * 60 + "// Code generated by x. DO NOT EDIT.\n" + HAND, "generated"), ("/*\n" + " * A long licence with many words in each line.\n" * 300 + " * vendored\n */\n" + HAND, "vendored"), (HAND + "// Generated by wirepack 1.3, do not modify\n\n", "generated"),
    (HAND + "/* One.\n * @generated by x\n */\n", "generated"), ("x = 1\n# @generated by x", "generated"), (HAND + "f(1); /* @generated */", "generated"), (HAND + "const T = `\n// @generated by x\n`;\n", None), (HAND + "// @generated parts are next.\n" + HAND, None), (HAND + "// The rest was written by hand, not generated by x.\n", None),
])
def test_marks_beyond_the_first_lines(text, kind):
    assert provenance.kind_by_text("src/a.js", text) == kind


def test_short_copies(spark):
    short = "export function add(x, y) {\n  return x + y;\n}\n"
    other = {"main.rs": 'fn main() {\n    println!("a");\n}\n', "page.js": "<html><body><h1>404</h1></body></html>\n", "list.ts": '{"a": 1, "b": [2]}\n', "index.js": "export * from './a';\n", "e.py": "class NotFound(Exception):\n    pass\n", "note.rs": "// Only a note.\n"}
    rows = [(f"r{k}", "lib/short.js", f"// local {k}\n{short}", 9, 9) for k in range(3)] + [(f"r{k}", p, t, 9, 9) for k in range(4) for p, t in other.items()]
    rows += [(f"r{k}", "two.js", short.replace("add", "sub"), 9, 9) for k in range(2)] + [("r3", "more.js", short + "add(1, 2);\n", 9, 9)]
    df = spark.createDataFrame(rows, "repo STRING, path STRING, text STRING, byte_len BIGINT, line_count BIGINT")
    assert {(r["repo"], r["path"], r["kind"]) for r in provenance.not_handwritten(df).collect()} == {(f"r{k}", "lib/short.js", "vendored") for k in range(3)}


def test_methods_with_long_parameters_and_wrapped_types():
    many = ",\n".join(f"    parameter_{k}: string" for k in range(300))
    ts = f"class A {{\n  /** M. */\n  m(\n{many}\n  ): void {{\n    x();\n  }}\n  /** N. */\n  n(a = ')'): Promise<\n    {{ b: string }}\n  > {{\n    return y(a);\n  }}\n}}\ninterface I {{\n  o(a: string): {{ b: string }};\n  p(): void\n  q: {{ b: string }}\n}}\n"
    assert [(n, ts[s:e].rstrip()[-14:].split()[-2:], d) for n, _, s, e, d in function_docs.functions_of(ts, "TypeScript")] == [("m", ["x();", "}"], "/** M. */"), ("n", ["y(a);", "}"], "/** N. */")]


def test_count_arrays_are_summed_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(value_counts, "FAN_IN", 2)
    rows = [([f"v{k % 50}", "all"],) for k in range(400)]
    df = spark.createDataFrame(rows, "names ARRAY<STRING>").repartition(9)
    found = {r["value"]: (r["occurrences"], r["records"]) for r in value_counts.value_counts(df).collect()}
    assert found == {f"v{k}": (8, 8) for k in range(50)} | {"all": (400, 400)}


def test_units_and_their_frequencies(spark):
    rows = [(1, ["b", "a", "b", None, ""], "", 0.0), (1, ["b", "a"], "", 0.0), (2, ["x"] * 5000 + ["y"], "", 0.0), (3, [None], "", 0.0), (4, None, "", 0.0), (None, ["a"], "", 0.0)]
    found = {(r["unit_id"], r["term"]): (r["tf"], r["len"]) for r in term_weight.unit_terms(spark.createDataFrame(rows, UNITS)).collect()}
    assert found == {(1, "a"): (1, 3), (1, "b"): (2, 3), (2, "x"): (5000, 5001), (2, "y"): (1, 5001)}


def test_probes_may_repeat_and_miss(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"], "", 0.0), (2, ["b"], "", 0.0)], UNITS)
    probes = spark.createDataFrame([(1,), (1,), (None,), (99,)], "unit_id BIGINT")
    assert [tuple(r) for r in term_weight.leading_terms(term_weight.term_scores(df, probes)).collect()] == [(1, "a")]


def test_the_search_beats_best_fit():
    import numpy as np

    hard = {
        "thirds": (np.random.default_rng(1).integers(500, 1100, 1000).tolist(), 2048), "uniform": (np.random.default_rng(2).integers(20, 100, 600).tolist(), 150),
        "triples": ([x for a, b in zip(np.random.default_rng(3).integers(380, 490, 150).tolist(), np.random.default_rng(4).integers(250, 300, 150).tolist(), strict=True) for x in (a, b, 1000 - a - b)], 1000),
    }
    for name, (sizes, capacity) in hard.items():
        plain = len(packing.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, capacity)[1])
        least = packing.least_bins(sizes, capacity)
        islands = [packing.founders(sizes, capacity, packing.POPULATION, np.random.default_rng(k), least) for k in range(packing.ISLANDS)]
        founded = min(len(f) for p in islands for _, f in p)
        for epoch in range(packing.EPOCHS):
            islands = [packing.evolve(sizes, capacity, [*p, islands[k - 1][0]], packing.GENERATIONS, np.random.default_rng([k, epoch]), least) for k, p in enumerate(islands)]
        found = min(islands, key=lambda p: len(p[0][1]))[0]
        print(name, "bound", least, "best fit", plain, "founders", founded, "search", len(found[1]))
        assert least <= len(found[1]) <= founded < plain
        assert sorted(i for b in found[0] for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) == f <= capacity for b, f in zip(*found, strict=True))


def test_lower_bound():
    assert packing.least_bins([], 10) == 0 and packing.least_bins([6, 6, 6], 10) == 3 and packing.least_bins([5, 5, 5, 5], 10) == 2 and packing.least_bins([7, 7, 4, 4], 10) == 3 and packing.least_bins([10, 1], 10) == 2
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(200):
        sizes = rng.integers(1, 30, rng.integers(1, 7)).tolist()
        fewest = len(sizes)

        def place(k, bins):  # noqa: ANN001, ANN202
            nonlocal fewest
            if k == len(sizes):
                fewest = min(fewest, len(bins))
            elif len(bins) < fewest + 1:
                for j in range(len(bins)):
                    if bins[j] + sizes[k] <= 30:
                        place(k + 1, [*bins[:j], bins[j] + sizes[k], *bins[j + 1 :]])
                place(k + 1, [*bins, sizes[k]])

        place(0, [])
        assert packing.least_bins(sizes, 30) <= fewest


def test_islands_that_are_searched_keep_all_pieces(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(packing, "least_bins", lambda sizes, capacity: 1)
    df = spark.createDataFrame([(k, " ".join(rng.choice(["alpha", "beta"]) for _ in range(rng.randrange(1, 40)))) for k in range(120)], "doc_id BIGINT, text STRING")
    rows = packing.packed(df, spark.createDataFrame([(1, 50)], "window_id BIGINT, capacity_tokens BIGINT"), block=50).collect()
    fill = Counter()
    for r in rows:
        fill[r["container"]] += r["n_tokens"]
    assert sorted(r["doc_id"] for r in rows) == list(range(120)) and max(fill.values()) <= 50
