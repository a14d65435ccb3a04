from __future__ import annotations

import random
import time

import pytest

from codelode.llm import leakage

VOCABULARY = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha", "ki", "lo") for b in ("rt", "nd", "lm", "sk", "pt", "xo", "zim", "val", "tor", "ned")]


def _found(spark, docs, items, least=leakage.STRETCH):  # noqa: ANN001, ANN202
    d = spark.createDataFrame(list(docs), "doc_id BIGINT, text STRING")
    return {(r["doc_id"], r["item_id"]): r["stretch"] for r in leakage.leaks(d, spark.createDataFrame(list(items), "item_id BIGINT, text STRING"), least).collect()}


def _text(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(VOCABULARY) for _ in range(n)]


@pytest.fixture(scope="module")
def replaced(spark):
    rng = random.Random(5)
    items = [(k, _text(rng, 60)) for k in range(150)]
    docs = [(100 * k + every, " ".join(_text(rng, 30) + [w if (j + 1) % every else f"other{j}" for j, w in enumerate(words)] + _text(rng, 30))) for every in (2, 3, 4, 5, 6, 8) for k, words in items]
    found = _found(spark, docs, [(k, " ".join(words)) for k, words in items])
    return {every: sum((100 * k + every, k) in found for k, _ in items) / len(items) for every in (2, 3, 4, 5, 6, 8)}, [(d, i) for d, i in found if d // 100 != i]


def test_every_kth_word_replaced(replaced):
    recall, wrong = replaced
    assert [recall[k] for k in (4, 5, 6, 8)] == [1.0] * 4 and recall[2] == recall[3] == 0.0 and wrong == []


def test_what_is_promised_is_found(spark):
    # any stretch of 20 words and more in which at most every fourth is replaced, never two in a row and never the ends
    rng = random.Random(6)
    items, docs = [], []
    for k in range(300):
        n = rng.randrange(20, 45)
        words = _text(rng, n)
        places: set[int] = set()
        while len(places) < n // 4:
            at = rng.randrange(1, n - 1)
            if not places & {at - 1, at, at + 1}:
                places.add(at)
        items.append((k, " ".join(_text(rng, 10) + words + _text(rng, 10))))
        docs.append((k, " ".join(_text(rng, 25) + [f"q{j}z" if j in places else w for j, w in enumerate(words)] + _text(rng, 25))))
    found = _found(spark, docs, items)
    assert {(k, k) for k in range(300)} <= set(found) and all(found[k, k] >= 20 for k in range(300))


def test_inserted_and_left_out_words(spark):
    rng = random.Random(7)
    words = _text(rng, 40)
    inserted = [x for j, w in enumerate(words) for x in ([w, "new"] if j % 12 == 11 else [w])]
    without = [w for j, w in enumerate(words) if j % 12 != 5]
    found = _found(spark, [(1, " ".join(inserted)), (2, " ".join(without)), (3, " ".join(words[:19])), (4, " ".join(words[:20]))], [(1, " ".join(words))])
    assert found == {(1, 1): 40, (2, 1): 40, (4, 1): 20}


def test_names_and_numbers_are_slots(spark):
    item = "the train with Alice and Bob leaves London at 3.14 hours and then Alice waits for 7 days near the old station of Bob"
    other = item.replace("Alice", "Marie").replace("Bob", "Jack").replace("London", "Paris").replace("3.14", "2,5").replace("7", "9")
    mixed = other.replace("then Marie", "then Susan").replace("station of Jack", "station of Peter")
    assert leakage.words_of("3.14 a 1,000.5 v2.0") == ["3.14", "a", "1,000.5", "v2", "0"]
    found = _found(spark, [(1, item.upper()), (2, item.lower()), (3, other), (4, mixed)], [(1, item)])
    assert found[1, 1] == found[2, 1] == found[3, 1] == 24 and found.get((4, 1), 0) < 24


def test_number_lists_are_fast_and_match_by_value(spark):
    rng = random.Random(8)
    numbers = [[str(rng.randrange(1000)) for _ in range(60)] for _ in range(50)]
    document = [str(rng.randrange(1000)) for _ in range(1600)]
    document[700:760] = numbers[7]
    items = [(k, " ".join(n)) for k, n in enumerate(numbers)] + [(60 + k, " ".join(["0"] * 40)) for k in range(50)]
    _found(spark, [(1, "a b c")], items)
    began = time.time()
    found = _found(spark, [(1, " ".join(document)), (2, "0 " * 1600), (3, "0 " * 30)], items)
    assert time.time() - began < 30
    assert found == {(1, 7): 60} | {(2, 60 + k): 40 for k in range(50)} | {(3, 60 + k): 30 for k in range(50)}


def test_alignment_of_repeating_texts_ends():
    ids = leakage._Ids(set(), {"a", "b"})
    item, doc = ["a", "b"] * 400, ["a", "b"] * 4000
    began = time.time()
    seeds = leakage.seeds_of(ids.arrays(item), ids.arrays(doc), list(leakage.WINDOWS))
    assert leakage.aligned(item, item, doc, doc, seeds) == 800 and time.time() - began < 10


def test_short_items(spark):
    items = [(1, "one two"), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my"), (3, "x"), (4, None), (5, " .. "), (6, "alpha beta gamma delta epsilon zeta")]
    docs = [(1, "say one two now"), (2, "alpha beta gamma delta other zeta eta theta iota other lambda my"), (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (4, "x"), (5, None), (6, ""), (7, "alpha beta gamma delta epsilon other"), (None, "x")]
    assert set(_found(spark, docs, items)) == {(1, 1), (2, 2), (2, 6), (3, 6), (4, 3), (7, 6), (None, 3)}


def test_long_leaks_and_cut_parts(spark):
    rng = random.Random(9)
    words = [f"{rng.choice(VOCABULARY)}{rng.choice(VOCABULARY)}" for _ in range(9000)]
    found = _found(spark, [(1, " ".join(words)), (2, "pad " * 20000 + " ".join(words[4000:4030]))], [(1, " ".join(words)), (2, " ".join(words[8000:8100]))])
    assert set(found) == {(1, 1), (1, 2), (2, 1)} and found[1, 1] >= leakage.OVERLAP and found[1, 2] == 100 and found[2, 1] == 30


def test_many_items_are_joined_by_shuffle_with_the_same_rows(spark, monkeypatch):
    rng = random.Random(10)
    items = [(k % 30, " ".join(_text(rng, 40))) for k in range(40)]
    docs = [(k, " ".join(_text(rng, 10)) + " " + items[k % 3][1]) for k in range(60)] + [(None, items[0][1]), (0, items[5][1])]
    whole = _found(spark, docs, items)
    monkeypatch.setattr(leakage, "MOST_BROADCAST_ROWS", -1)
    monkeypatch.setattr(leakage, "MOST_BROADCAST_CHARACTERS", -1)
    monkeypatch.setattr(leakage, "BITS_PER_WINDOW", 1)
    assert _found(spark, docs, items) == whole and len(whole) == 62
    monkeypatch.setattr(leakage, "MOST_WORDS", 10)
    with pytest.raises(ValueError, match="different words"):
        _found(spark, docs, items)


def test_empty_tables_and_clashing_columns(spark):
    assert _found(spark, [], [(1, "a b c d e f")]) == {} and _found(spark, [(1, "a b c d e f")], []) == {} and _found(spark, [(1, "a")], [(1, None)]) == {}
    d = spark.createDataFrame([(1, "a b c d e f", 7, 8, "h")], "doc_id BIGINT, text STRING, item_id BIGINT, item BIGINT, hash STRING")
    i = spark.createDataFrame([(3, "a b c d e f", 9, "x")], "item_id BIGINT, text STRING, doc_id BIGINT, words STRING")
    assert [tuple(r) for r in leakage.leaks(d, i).collect()] == [(1, 3, 6, 6)]
