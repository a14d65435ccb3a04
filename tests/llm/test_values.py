"""Values of the queries that have no SQL twin, against plain Python over the smallest tables."""

from __future__ import annotations

import re
import sys
from collections import Counter
from functools import lru_cache

import pytest

from codelode.llm import abuse, function_docs, leakage, packing, provenance, queries, syntax
from codelode.sources.grammar import language_of
from tests.oracle import DATA, database


@lru_cache(maxsize=1)
def documents() -> list[dict]:
    found = database().sql("SELECT doc_id, source, repo, path, text FROM documents")
    return [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]


def sources() -> list[dict]:
    return [d for d in documents() if d["source"] == "repo_file" and d["path"] is not None]


@lru_cache(maxsize=1)
def records() -> dict:
    found = database().sql("SELECT repo, path, symbols, byte_len, line_count, diagnostics FROM file_parse WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY parsed_at DESC NULLS LAST, received_at DESC NULLS LAST) = 1")
    return {(r[0], r[1]): dict(zip(found.columns, r, strict=True)) for r in found.fetchall()}


@lru_cache(maxsize=32)
def _rows(name: str, spark) -> list:  # noqa: ANN001
    return queries.QUERIES[name](spark, DATA).collect()


def judged() -> list[tuple]:
    sys.setrecursionlimit(6000)
    return [(d["repo"], d["path"], language_of(d["path"]), *syntax.verdict(d["text"], language_of(d["path"]))) for d in sources() if d["text"] is not None and language_of(d["path"])]


def check_p2_found(spark):  # noqa: ANN001, ANN201
    want = {(j[0], j[1]) for j in judged() if j[3] in ("corrupt", "wrong_extension")}
    assert {tuple(r) for r in _rows("p2_found", spark)} == want and want


def check_p2_rates(spark):  # noqa: ANN001, ANN201
    groups: dict = {}
    for repo, path, language, verdict, _, follows in judged():
        said = any(x["severity"] == "Error" for x in records().get((repo, path), {}).get("diagnostics") or [] if x)
        g = groups.setdefault((repo, language), Counter())
        bad, good = verdict in ("corrupt", "wrong_extension"), verdict == "ok"
        g.update({"n_files": 1, "n_broken": bad, "n_wrong_extension": verdict == "wrong_extension", "n_too_deep": verdict == "too_deep", "n_good_foreign": good and len(follows) > 1, "n_broken_diagnosed": bad and said, "n_good_diagnosed": good and said})
    found = {(r["repo"], r["language"]): r.asDict() for r in _rows("p2_rates", spark)}
    assert set(found) == set(groups)
    for key, g in groups.items():
        assert {k: found[key][k] for k in g} == dict(g) and found[key]["share"] == pytest.approx(g["n_broken"] / g["n_files"], abs=1e-6)


@lru_cache(maxsize=1)
def kinds() -> dict:
    """Kind and evidence of each file by sets of all fingerprints and their repositories."""
    prints, where = {}, {}
    for d in sources():
        text = d["text"]
        found = set(provenance.fingerprints(text).tolist()) if text and text.strip() else set()
        if len(found) < provenance.LEAST_PRINTS:
            whole = provenance.whole_print(text) if text and text.strip() else None
            found = set() if whole is None else {whole}
        prints[d["doc_id"]] = found
        for x in found:
            where.setdefault(x, set()).add(d["repo"])
    out = {}
    for d in sources():
        record = records().get((d["repo"], d["path"]), {})
        kind, mine = provenance.kind_by_text(d["path"], d["text"], record.get("byte_len"), record.get("line_count")), prints[d["doc_id"]]
        recur = lambda least: bool(mine) and sum(len(where[x] - {None}) >= least for x in mine) >= provenance.COPY_SHARE * len(mine)  # noqa: B023, E731
        if kind in (None, "vendored") and (recur(provenance.LEAST_REPOS) or kind == "vendored" and recur(provenance.CLAIMED_REPOS)):
            out[d["repo"], d["path"]] = ("vendored", "fingerprints")
        elif kind is not None:
            out[d["repo"], d["path"]] = (kind, "marks")
    return out


def check_p4_kinds(spark):  # noqa: ANN001, ANN201
    assert {(r["repo"], r["path"]): (r["kind"], r["evidence"]) for r in _rows("p4_kinds", spark)} == kinds() and kinds()


def check_p4_found(spark):  # noqa: ANN001, ANN201
    assert {tuple(r) for r in _rows("p4_found", spark)} == set(kinds())


def check_p4_evidence(spark):  # noqa: ANN001, ANN201
    assert {(r["kind"], r["evidence"]): r["n_files"] for r in _rows("p4_evidence", spark)} == Counter(kinds().values())


def check_p5_pairs(spark):  # noqa: ANN001, ANN201
    texts = {(d["repo"], d["path"]): d["text"] for d in sources()}
    rows = _rows("p5_pairs", spark)
    # the record's own documentation, an independent source, informs in just these cases
    want = Counter((repo, path, s["qualified_name"]) for (repo, path), r in records().items() if texts.get((repo, path)) for s in r["symbols"] or [] if s["kind"] in ("Function", "Method") and function_docs.informs(s["docstring"], s["name"], s["signature"], [p["name"] for p in s["parameters"] or []]))
    assert Counter((r["repo"], r["path"], r["qualified_name"]) for r in rows) == want and want
    assert all(r["code"] is None or r["code"] in texts[r["repo"], r["path"]] for r in rows) and sum(r["code"] is not None for r in rows) > 0.9 * len(rows)


def check_p5_found(spark):  # noqa: ANN001, ANN201
    assert Counter(tuple(r) for r in _rows("p5_found", spark)) == Counter((r["repo"], r["path"], r["qualified_name"]) for r in _rows("p5_pairs", spark))


def check_p8_containers(spark):  # noqa: ANN001, ANN201
    sizes = {d["doc_id"]: packing.n_tokens(d["text"]) for d in documents() if d["text"] and d["text"].strip()}
    windows = dict(database().sql("SELECT window_id, capacity_tokens FROM context_windows").fetchall())
    rows = _rows("p8_containers", spark)
    for window, capacity in windows.items():
        mine = [r for r in rows if r["window_id"] == window]
        whole, fill = Counter(), Counter()
        for r in mine:
            whole[r["doc_id"]] += r["n_tokens"]
            fill[r["container"]] += r["n_tokens"]
        assert whole == Counter(sizes) and max(fill.values()) <= capacity
        assert Counter(r["doc_id"] for r in mine) == Counter({d: -(-n // capacity) for d, n in sizes.items()})


def check_p8_unused(spark):  # noqa: ANN001, ANN201
    for r in _rows("p8_unused", spark):
        mine = [x for x in _rows("p8_containers", spark) if x["window_id"] == r["window_id"]]
        n, used = len({x["container"] for x in mine}), sum(x["n_tokens"] for x in mine)
        assert r["n_containers"] == n and r["n_tokens"] == used and r["unused_share"] == pytest.approx(1 - used / (n * r["capacity_tokens"]), abs=1e-6)


def check_p9_found(spark):  # noqa: ANN001, ANN201
    items = [(i, re.findall(r"[^\W_]+", t.lower())) for i, t in database().sql("SELECT item_id, text FROM eval_items WHERE text IS NOT NULL").fetchall()]
    found = {tuple(r) for r in _rows("p9_found", spark)}
    exact = set()
    for d in documents():
        words = " ".join(w.lower() for w in leakage.words_of(d["text"] or ""))
        exact |= {(d["doc_id"], i) for i, item in items if any(" ".join(item[k : k + 20]) in words for k in range(len(item) - 19))}
    # unbroken stretches of twenty words are all found; of the others each shares most of twenty neighbours
    assert exact <= found and exact
    texts = {d["doc_id"]: Counter(w.lower() for w in leakage.words_of(d["text"] or "")) for d in documents()}
    assert all(sum((Counter(dict(items)[i]) & texts[d]).values()) >= 15 for d, i in found)


def check_p9_report(spark):  # noqa: ANN001, ANN201
    found = Counter(r["item_id"] for r in _rows("p9_found", spark))
    items = {i for (i,) in database().sql("SELECT DISTINCT item_id FROM eval_items").fetchall()}
    report = {r["item_id"]: r for r in _rows("p9_report", spark)}
    assert set(report) == items and {i: r["n_documents"] for i, r in report.items() if r["n_documents"]} == found and all((r["longest"] >= 20) == (r["n_documents"] > 0) for r in report.values())


def check_p10_scores(spark):  # noqa: ANN001, ANN201
    rows = _rows("p10_scores", spark)
    assert Counter((r["doc_id"], r["source"]) for r in rows) == Counter((d["doc_id"], d["source"]) for d in documents()) and all(0 <= r["score"] <= 1 for r in rows)
    scores = {r["doc_id"]: r["score"] for r in rows}
    # every sentence is looked at: a text without any has 0, all others more
    assert all((scores[d["doc_id"]] > 0) == bool(abuse.examined(d["text"] or "")) for d in documents())


def check_p10_found(spark):  # noqa: ANN001, ANN201
    assert Counter(r["doc_id"] for r in _rows("p10_found", spark)) == Counter(r["doc_id"] for r in _rows("p10_scores", spark) if r["score"] >= 0.5)


def check_p10_rates(spark):  # noqa: ANN001, ANN201
    n, bad = Counter(d["source"] for d in documents()), Counter(r["source"] for r in _rows("p10_scores", spark) if r["score"] >= 0.5)
    assert {r["source"]: (r["n_documents"], r["n_abusive"]) for r in _rows("p10_rates", spark)} == {s: (k, bad[s]) for s, k in n.items()}


CHECKS = {n[6:]: c for n, c in globals().items() if n.startswith("check_")}


def test_every_query_without_twin_is_checked():
    assert set(queries.QUERIES) - set(queries.ORACLE) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_values(spark, name):  # noqa: ANN001
    CHECKS[name](spark)
