from __future__ import annotations

import random

from codelode.llm import provenance

FILES = "repo STRING, path STRING, text STRING, byte_len BIGINT, line_count BIGINT"


def _body(rng: random.Random, n: int) -> str:
    words = [f"w{k}" for k in range(300)]
    return "\n".join(f"{rng.choice(words)} = {rng.choice(words)}({rng.choice(words)}, {rng.choice(words)})" for _ in range(n))


def _cases(spark, rows):  # noqa: ANN001, ANN202
    return {(r["repo"], r["path"]): (r["kind"], r["evidence"]) for r in provenance.not_handwritten(spark.createDataFrame(rows, FILES)).collect()}


def test_winnowing_alone_finds_copies(spark):
    rng = random.Random(3)
    shared, twice = _body(rng, 60), _body(rng, 60)
    rows = [(f"r{k}", f"src/util_{k}.py", f"# ours {k}\n{_body(rng, 3)}\n{shared}\n", 9, 9) for k in range(5)]
    # two repositories are enough only for a file that claims to be a copy; a claim without a second copy stays a mark
    rows += [(f"r{k}", "a.py", twice, 9, 9) for k in range(2)] + [("r7", "b.py", "# vendored\n" + twice, 9, 9), ("r8", "c.py", "# vendored\n" + _body(rng, 60), 9, 9)]
    rows += [(f"q{k}", "own.py", _body(rng, 60), 9, 9) for k in range(3)] + [("q9", "numbers.py", "D = [" + "1, 2, 3, " * 10 + "]\n", 9, 9)]
    # one repository with very many copies is one repository
    alone = _body(rng, 60)
    rows += [("r1", f"f{k}.py", alone, 9, 9) for k in range(50)]
    want = {(f"r{k}", f"src/util_{k}.py"): ("vendored", "fingerprints") for k in range(5)} | {("r8", "c.py"): ("vendored", "marks"), ("q9", "numbers.py"): ("data", "marks")}
    want |= {("r0", "a.py"): ("vendored", "fingerprints"), ("r1", "a.py"): ("vendored", "fingerprints"), ("r7", "b.py"): ("vendored", "fingerprints")}  # three repositories hold it
    assert _cases(spark, rows) == want
    two = [r for r in rows if r[1] != "b.py" and (r[0], r[1]) != ("r1", "a.py")] + [("r7", "b.py", "# vendored\n" + twice, 9, 9)]
    found = _cases(spark, two)
    assert found["r7", "b.py"] == ("vendored", "fingerprints") and ("r0", "a.py") not in found
    totals = {(r["kind"], r["evidence"]): r["n_files"] for r in provenance.evidence_totals(provenance.not_handwritten(spark.createDataFrame(rows, FILES))).collect()}
    assert totals == {("vendored", "fingerprints"): 8, ("vendored", "marks"): 1, ("data", "marks"): 1}


def test_number_windows_are_no_fingerprints():
    assert not len(provenance.fingerprints("X = [" + "1, 2.5, 0x3, " * 500 + "]")) and len(provenance.fingerprints("a = b(c, d)\n" * 40))


def test_small_data_and_small_counted_files():
    assert provenance.kind_by_text("a.py", "D = [1, 22, 333, 4444, 55, 66]\n") == "data"
    assert provenance.kind_by_text("a.ts", "const PORT = 8080;\n") is None
    assert provenance.kind_by_text("a.ts", "".join(f"f_{k}({k});\n" for k in range(6))) == "generated"


def test_hot_fingerprints_are_joined_like_others(spark, monkeypatch):
    rng = random.Random(4)
    shared = _body(rng, 60)
    rows = [(f"r{k % 4}", f"f{k}.py", shared, 9, 9) for k in range(20)] + [("r0", "own.py", _body(rng, 60), 9, 9)]
    whole = _cases(spark, rows)
    monkeypatch.setattr(provenance, "HOT_FILES", 5)
    assert _cases(spark, rows) == whole and len(whole) == 20


def test_nulls_and_empty_tables(spark):
    assert _cases(spark, []) == {}
    assert _cases(spark, [(None, "n.py", None, None, None), (None, "a.min.js", None, None, None), ("r", "vendor/e.py", " \n", 2, 1), ("r", "wide.js", None, 90000, 2)]) == {(None, "a.min.js"): ("minified", "marks"), ("r", "wide.js"): ("minified", "marks")}
