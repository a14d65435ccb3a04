"""Evaluation texts leaking into training text, by template canonicalisation.

Words are folded (case, punctuation, quote and comment marks vanish) and numbers, number words, units and names become typed placeholders. Windows of template words of the held-out items are
hash-joined with those of all documents. A window has five words; in those of width six one inner place is left open. Any stretch of 18 words and more of which at most every fourth is
replaced holds such a window unbroken: it has three windows of six for at most five replaced words, so one of them has at most one. A window of placeholders alone is hashed by its values, as
its template says nothing.

Each (part of a document, item) with a window in common is aligned, single inserted and left out words included, and the slots (what the placeholders stood for) must be filled
consistently: one value of the item always by the same value of the document. Consistently refilled slots mean a re-parameterised copy and are no replaced words.

Documents are passed over once, whatever the number of items: a Bloom filter of the items' windows, of bounded size, picks the parts of documents that go into the join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.common import slots, written
from codelode.llm.text import unescaped

#: Words of the least stretch that counts as leaked; of its words at least this share must agree (0.75: one replaced word in four).
STRETCH, LEAST_AGREEING = 20, 0.75
#: Of an item shorter than STRETCH all must be there; one word in so many may be replaced.
SHORT_REPLACED = 6
#: The windows: places that are looked at. The first has no open place, the others one of six.
WINDOWS = ((0, 1, 2, 3, 4), (0, 2, 3, 4, 5), (0, 1, 3, 4, 5), (0, 1, 2, 4, 5), (0, 1, 2, 3, 5))
#: Parts of a document: hits further apart than GAP words are apart, GAP words around belong to a part, a part of more than PART words is cut with OVERLAP words in common.
GAP, PART, OVERLAP = 64, 4096, 2048
#: Different words of all items; they are sent to every executor.
MOST_WORDS = 2_000_000
#: Bits of the filter: so many per window, never more than MOST_BITS (32 MB); with more windows it only lets more through.
BITS_PER_WINDOW, MOST_BITS, SEGMENT = 512, 1 << 28, 1 << 20
#: Rows (windows) and characters (texts) of the items that are joined by broadcast; beyond that by a salted shuffle.
MOST_BROADCAST_ROWS, MOST_BROADCAST_CHARACTERS = 1_000_000, 16_000_000

# Number words and units of measure, English.
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen dozens""".split()
UNITS = """ms s sec second seconds minute minutes hour hours day days week weeks month months year years mm cm m km meter meters kilometer kilometers inch inches foot feet mile miles
mg g kg gram grams kilogram kilograms pound pounds ounce ounces ml l liter liters byte bytes kb mb gb tb kib mib gib percent dollar dollars euro euros cent cents degree degrees celsius fahrenheit""".split()

_WORD = re.compile(r"\d+(?:[.,]\d+)+(?![^\W_])|[^\W_]+")
_NUMBER, _UNIT, _NAME = "<number>", "<unit>", "<name>"
_TYPED = {**{w: _NUMBER for w in NUMBER_WORDS}, **{w: _UNIT for w in UNITS}}


def words_of(text: str) -> list[str]:
    """The words of a text as written, without punctuation, quote and comment marks; a number with fraction or thousands is one word."""
    return _WORD.findall(unescaped(text))


def _capital(word: str) -> bool:
    return word[0].isupper() and not word.isupper()


def typed(word: str, names: frozenset[str] | set[str] = frozenset(), plain: frozenset[str] | set[str] | None = None) -> str:
    """The template form of a word: a placeholder for a number, a number word, a unit or a name, else lower case.

    A name is a word in ``names``, letters mixed with digits, or an inner capital; with ``plain`` (the items' other words) also any capitalised word that is not among them.
    """
    folded = word.lower()
    found = _TYPED.get(folded)
    if found is not None:
        return found
    if word[0].isdigit() and not any(c.isalpha() for c in word):
        return _NUMBER
    if folded in names:
        return _NAME
    if plain is not None and folded in plain:
        return folded
    if not folded.isalpha() or (word[1:] != folded[1:] and not word.isupper()) or plain is not None and _capital(word):
        return _NAME
    return folded


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") | 1


_PLACEHOLDERS = np.array([_hash(p) for p in (_NUMBER, _UNIT, _NAME)], np.uint64)


class _Ids(dict):
    """Hash of each word's template form, 0 for a word that no item has; forgets all when it is full. ``values``: hash of the word itself, for placeholders."""

    def __init__(self, names: set[str], plain: set[str]) -> None:
        super().__init__()
        self.names, self.plain, self.values = names, plain, {}

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        form = typed(word, self.names, self.plain)
        told = self[word] = _hash(form) if form[0] == "<" or form in self.plain else 0
        return told

    def arrays(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Template hashes, and the same with the hashes of the values instead of those of placeholders."""
        ids = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        held = (ids == _PLACEHOLDERS[0]) | (ids == _PLACEHOLDERS[1]) | (ids == _PLACEHOLDERS[2])
        values = ids.copy()
        for k in np.flatnonzero(held):
            word = words[k].lower()
            h = self.values.get(word)
            if h is None:
                if len(self.values) > 200_000:
                    self.values.clear()
                h = self.values[word] = _hash("=" + word)
            values[k] = h
        return ids, values


def _mixed(ids: np.ndarray, places: tuple[int, ...], at: np.ndarray) -> np.ndarray:
    h = np.full(len(at), 1000 + len(places), np.uint64)
    for k in places:
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[at + k]
        h ^= h >> np.uint64(29)
    return h


def pairs_of(ids: np.ndarray) -> np.ndarray:
    """Hashes of all pairs of neighbours, 0 where a word is unknown."""
    h = (ids[:-1] * np.uint64(0xBF58476D1CE4E5B9)) ^ (ids[1:] * np.uint64(0x94D049BB133111EB))
    h ^= h >> np.uint64(31)
    h[(ids[:-1] == 0) | (ids[1:] == 0)] = 0
    return h


def windows_of(ids: np.ndarray, values: np.ndarray, kinds: list[tuple[int, ...]], pairs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the windows of these kinds that an item can have at all: without unknown words, and with ``pairs`` (which neighbours any item has) only of such neighbours."""
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    known, held = ids != 0, ids != values
    for kind in kinds:
        n = len(ids) - kind[-1]
        if n <= 0:
            continue
        could = known[:n].copy()
        if pairs is not None and len(kind) == len(WINDOWS[0]):
            for a, b in zip(kind, kind[1:], strict=False):
                could &= pairs[a : a + n] if b == a + 1 else known[b : b + n]
        for k in kind[1:]:
            could &= known[k : k + n]
        at = np.flatnonzero(could)
        if not len(at):
            continue
        h = _mixed(ids, kind, at)
        bare = held[at]
        for k in kind[1:]:
            bare &= held[at + k]
        if bare.any():
            h[bare] = _mixed(values, kind, at[bare])
        hashes.append(h ^ np.uint64(kind[-1] * 64 + sum(kind)))
        places.append(at)
    return np.concatenate(hashes), np.concatenate(places)


def _kinds(n: int) -> list[tuple[int, ...]]:
    """The windows of an item of n words: of one with fewer than five words all of it."""
    return list(WINDOWS) if n >= len(WINDOWS[0]) else [tuple(range(n))] if n else []


# --- alignment


def _path(item: list[str], doc: list[str], i: int, j: int, step: int) -> list[tuple[int, int]]:
    """Pairs (place in item, place in document) onward from an agreeing pair, in one direction; -1 for a word that the other side lacks. Ends at two edits in a row."""
    n, m, out = len(item), len(doc), []
    i, j = i + step, j + step

    def run(a: int, b: int) -> int:
        k = 0
        while k < 8 and 0 <= a < n and 0 <= b < m and item[a] == doc[b]:
            a, b, k = a + step, b + step, k + 1
        return k

    while 0 <= i < n and 0 <= j < m:
        if item[i] == doc[j]:
            out.append((i, j))
            i, j = i + step, j + step
            continue
        replaced, inserted, left_out = run(i + step, j + step), run(i, j + step), run(i + step, j)
        best = max(replaced, inserted, left_out)
        if not best:
            break
        if replaced == best:
            out.append((i, j))
            i, j = i + step, j + step
        elif inserted == best:
            out.append((-1, j))
            j += step
        else:
            out.append((i, -1))
            i += step
    return out


def _longest(agree: list[bool], counted: list[int], share: float) -> int:
    """Item words of the longest row of steps that begins and ends with agreement, has no two edits in a row and enough agreement."""
    best, start, runs = 0, None, []
    for k, same in enumerate([*agree, False, False]):
        if same:
            start = k if start is None else start
            end = k + 1
        elif start is not None and k > end:
            runs.append((start, end))
            start = None
    for a, b in runs:
        sums = np.concatenate([[0], np.cumsum(agree[a:b])])
        words = np.concatenate([[0], np.cumsum(counted[a:b])])
        for length in range(b - a, 0, -1):
            if length <= best:
                break
            fits = sums[length:] - sums[: b - a - length + 1] >= share * length
            if fits.any():
                best = max(best, int((words[length:] - words[: b - a - length + 1])[fits].max()))
                break
    return best


def aligned(item: list[str], item_forms: list[str], doc: list[str], doc_forms: list[str], seeds: list[tuple[int, int]], least: int = STRETCH) -> int:
    """Words of the longest stretch of an item that a document holds, through one of the ``seeds`` (agreeing places); of an item shorter than ``least`` only all of it counts, else 0.

    A place agrees if the words are equal, or if both are the same kind of placeholder and the pair of values is the one that the item's value most often has in this
    pairing (slot consistency).
    """
    whole = len(item) < least
    share = 1 - 1 / SHORT_REPLACED if whole else LEAST_AGREEING
    best, covered = 0, set()
    for i, j in seeds:
        if (i, j) in covered or item_forms[i] != doc_forms[j]:
            continue
        path = [*reversed(_path(item_forms, doc_forms, i, j, -1)), (i, j), *_path(item_forms, doc_forms, i, j, 1)]
        covered.update(path)
        if whole:
            # the ends of a short item may be replaced too, where the document has a word in their place
            (a, b), (c, d) = next(p for p in path if min(p) >= 0), next(p for p in reversed(path) if min(p) >= 0)
            path = [*((k, b - a + k) for k in range(a) if b - a + k >= 0), *path, *((k, d - c + k) for k in range(c + 1, len(item)) if d - c + k < len(doc))]
        filled: dict[str, dict[str, int]] = {}
        for a, b in path:
            if a >= 0 and b >= 0 and item[a] != doc[b] and item_forms[a] == doc_forms[b]:
                values = filled.setdefault(item[a], {})
                values[doc[b]] = values.get(doc[b], 0) + 1
        slot = {value: max(sorted(others), key=others.__getitem__) for value, others in filled.items()}
        agree = [a >= 0 and b >= 0 and (item[a] == doc[b] or item_forms[a] == doc_forms[b] and slot.get(item[a]) == doc[b]) for a, b in path]
        counted = [int(a >= 0) for a, _ in path]
        if whole:
            best = max(best, len(item) if sum(counted) == len(item) and sum(agree) >= share * len(path) else 0)
        else:
            best = max(best, _longest(agree, counted, share))
        if best >= min(len(item), len(doc)):
            break
    return best if best >= min(least, len(item)) else 0


def _before(h: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The hash of the window one place before each, 0 where there is none."""
    out = np.zeros(len(h), np.uint64)
    follows = places[1:] == places[:-1] + 1
    out[1:][follows] = h[:-1][follows]
    return out


def seeds_of(item: tuple[np.ndarray, np.ndarray], doc: tuple[np.ndarray, np.ndarray], kinds: list[tuple[int, ...]]) -> list[tuple[int, int]]:
    """(place in item, place in document) where runs of windows begin that both have, by place in the item.

    A pair of places whose predecessors agree as well begins no run. In texts that repeat themselves places are told by what stands before them, so their pairs are not all written out.
    """
    found: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    for kind in kinds:
        h_item, p_item = windows_of(*item, [kind])
        h_doc, p_doc = windows_of(*doc, [kind])
        b_item, b_doc = _before(h_item, p_item), _before(h_doc, p_doc)
        order = np.argsort(h_item, kind="stable")
        h_item, p_item, b_item = h_item[order], p_item[order], b_item[order]
        left, right = np.searchsorted(h_item, h_doc, "left"), np.searchsorted(h_item, h_doc, "right")
        n = right - left
        # few places in the item: all pairs
        few = np.flatnonzero((n > 0) & (n <= 16))
        at = np.repeat(left[few], n[few]) + np.arange(n[few].sum()) - np.repeat(np.cumsum(n[few]) - n[few], n[few])
        mine = np.repeat(few, n[few])
        begins = (b_item[at] != b_doc[mine]) | (b_doc[mine] == 0)
        found.append(np.stack([p_item[at][begins], p_doc[mine][begins]], axis=1))
        # many: by what stands before
        many = np.flatnonzero(n > 16)
        for h in np.unique(h_doc[many]):
            a, b = np.searchsorted(h_item, h, "left"), np.searchsorted(h_item, h, "right")
            mine = many[h_doc[many] == h]
            for before in np.unique(b_doc[mine]):
                some = p_doc[mine[b_doc[mine] == before]]
                other = p_item[a:b][(b_item[a:b] != before) | (before == 0)]
                found.append(np.stack([np.tile(other, len(some)), np.repeat(some, len(other))], axis=1))
    pairs = np.concatenate(found)
    return [(int(i), int(j)) for i, j in pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]]


# --- plans


def _word_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lower-case words of items, whether they stand capitalised inside a sentence, and whether in lower case."""
    for batch in batches:
        seen: dict[str, list[bool]] = {}
        for text in batch["text"]:
            text = unescaped(text)
            for m in _WORD.finditer(text):
                word = m.group()
                said = seen.setdefault(word.lower(), [False, False])
                before = text[: m.start()].rstrip(" \t\"'`([") if _capital(word) else ""
                said[0] |= bool(before) and before[-1] not in ".!?:\n"
                said[1] |= word == word.lower()
        yield pd.DataFrame({"word": list(seen), "capital": [s[0] for s in seen.values()], "lower": [s[1] for s in seen.values()]})


def _vocabulary(items: DataFrame) -> tuple[set[str], set[str]]:
    """The items' names (capitalised inside a sentence, nowhere in lower case) and their other words. At most MOST_WORDS words reach the driver."""
    rows = items.select("text").mapInPandas(_word_rows, "word STRING, capital BOOLEAN, lower BOOLEAN").groupBy("word").agg((F.max("capital") & ~F.max("lower")).alias("name")).limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"the items have more than {MOST_WORDS} different words")
    return {r["word"] for r in rows if r["name"]}, {r["word"] for r in rows if not r["name"]}


def _filters_of(windows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bloom filters of the windows' hashes and of the pairs', two bits each; at most twice MOST_BITS bits reach the driver."""
    bits = SEGMENT
    while bits < min(MOST_BITS, BITS_PER_WINDOW * n):
        bits *= 2

    def segment(rows: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(SEGMENT, bool)
        held[(rows["bit"] % SEGMENT).to_numpy(np.int64)] = True
        return pd.DataFrame({"pair": [rows["pair"].iloc[0]], "segment": [rows["segment"].iloc[0]], "held": [np.packbits(held).tobytes()]})

    each = windows.select("pair", F.explode(F.array(F.expr(f"pmod(hash, {bits})"), F.expr(f"pmod(shiftright(hash, 32), {bits})"))).alias("bit")).distinct()
    parts = each.select("pair", "bit", F.expr(f"bit div {SEGMENT}").alias("segment")).groupBy("pair", "segment").applyInPandas(segment, "pair BOOLEAN, segment BIGINT, held BINARY").collect()
    out = (np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8))
    for r in parts:
        out[r["pair"]][r["segment"] * SEGMENT // 8 : (r["segment"] + 1) * SEGMENT // 8] = np.frombuffer(r["held"], np.uint8)
    return out


def _held(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = len(bitmap) * 8
    signed = hashes.view(np.int64)
    yes = np.ones(len(hashes), bool)
    for at in (signed % bits, (signed >> np.int64(32)) % bits):
        yes &= (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return yes


def _parts(places: np.ndarray, n_words: int) -> list[tuple[int, int]]:
    """The parts of a document around its hits."""
    places = np.sort(places)
    breaks = np.flatnonzero(np.diff(places) > GAP)
    out = []
    for a, b in zip(np.append(0, breaks + 1), np.append(breaks, len(places) - 1), strict=True):
        start, end = max(0, int(places[a]) - GAP), min(n_words, int(places[b]) + GAP + 6)
        while end - start > PART:
            out.append((start, start + PART))
            start += PART - OVERLAP
        out.append((start, end))
    return out


LEAKS = "doc_id BIGINT, item_id BIGINT, stretch BIGINT, item_words BIGINT"


def _salted(left: DataFrame, right: DataFrame, key: str, spread: str, broadcast: bool) -> DataFrame:
    """Joins rows to a table of the items: by broadcast where it is small, else by shuffle with each row of the table repeated per salt, so that a hot key spreads over as many tasks."""
    if broadcast:
        return left.join(F.broadcast(right), key)
    salts = min(64, max(8, slots(left.sparkSession)))
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(many, [key, "_salt"]).drop("_salt")


def leaks(documents: DataFrame, items: DataFrame, least: int = STRETCH) -> DataFrame:
    """``doc_id, item_id, stretch, item_words``: each document that holds at least ``least`` (18 or more) consecutive words of an item's text, or all of a shorter one.

    One row per document and item; a document may hold several items. Null and empty texts, on either side, leak nothing. An item whose text equals another's is found under both ids. Whole texts are read
    whatever their length. ``doc_id`` may repeat or be null; each row is looked at for itself, equal result rows are given once. ``stretch`` is the longest one found inside a part of a
    document: one of more than OVERLAP words may be given shorter.

    Only words and a filter of the items reach the driver, both of bounded size. Items that are many are joined by salted shuffles, so neither a window nor an item that very many
    documents hold makes a large task.
    """
    rows = written(items.where(F.col("text").isNotNull() & (F.col("text") != "")).select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "leak-items")
    names, plain = _vocabulary(rows)
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((names, plain))

    def item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _Ids(*shared.value)
        for batch in batches:
            out = []
            for item, text in zip(batch["item"], batch["text"], strict=True):
                words = words_of(text)
                forms, values = ids.arrays(words)
                for pair, h in ((False, windows_of(forms, values, _kinds(len(words)))[0]), (True, pairs_of(forms))):
                    out.append(pd.DataFrame({"item": item, "n_words": len(words), "pair": pair, "hash": np.unique(h).view(np.int64)}))
            yield pd.concat(out) if out else pd.DataFrame({"item": [], "n_words": [], "pair": [], "hash": []})

    windows = written(rows.mapInPandas(item_windows, "item BIGINT, n_words BIGINT, pair BOOLEAN, hash BIGINT"), "leak-windows")
    told = windows.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("n_words") < len(WINDOWS[0]), F.col("n_words"))).alias("short")).first()
    kinds = [*WINDOWS, *(tuple(range(n)) for n in sorted(told["short"]))]
    bitmaps = spark.sparkContext.broadcast(_filters_of(windows, told["n"]))

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, (held, neighbours) = _Ids(*shared.value), bitmaps.value
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = words_of(text)
                if not words:
                    continue
                forms, values = ids.arrays(words)
                h, places = windows_of(forms, values, kinds, _held(neighbours, pairs_of(forms)))
                yes = _held(held, h)
                if yes.any():
                    h, places = h[yes].view(np.int64), places[yes]
                    out += [(doc, " ".join(words[a:b]), np.unique(h[(places >= a) & (places < b)])) for a, b in _parts(places, len(words))]
            yield pd.DataFrame(out, columns=["doc_id", "words", "hashes"])

    found = documents.where(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "text").mapInPandas(parts, "doc_id BIGINT, words STRING, hashes ARRAY<BIGINT>")
    found = written(found.withColumn("part", F.monotonically_increasing_id()), "leak-parts")
    hashes = found.select("part", F.explode("hashes").alias("hash"))
    pairs = _salted(hashes, windows.where("NOT pair").select("hash", "item"), "hash", "part", told["n"] <= MOST_BROADCAST_ROWS).select("part", "item").distinct()
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    both = _salted(pairs.join(found.select("part", "doc_id", "words"), "part"), rows, "item", "part", size <= MOST_BROADCAST_CHARACTERS)

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, plain = shared.value
        ids = _Ids(names, plain)
        known: dict[str, tuple] = {}
        for batch in batches:
            out = []
            for doc, item, text, words in zip(batch["doc_id"], batch["item_id"], batch["text"], batch["words"], strict=True):
                mine = known.get(text)
                if mine is None:
                    if len(known) > 1000:
                        known.clear()
                    said = words_of(text)
                    mine = known[text] = ([w.lower() for w in said], [typed(w, names, plain) for w in said], ids.arrays(said))
                said = words.split(" ")
                seeds = seeds_of(mine[2], ids.arrays(said), _kinds(len(mine[0])))
                n = aligned(mine[0], mine[1], [w.lower() for w in said], [typed(w, names, plain) for w in said], seeds, least) if seeds else 0
                if n:
                    out.append((doc, item, n, len(mine[0])))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "stretch", "item_words"])

    result = both.select("doc_id", "item_id", "text", "words").mapInPandas(align, LEAKS)
    return result.groupBy("doc_id", "item_id").agg(F.max("stretch").alias("stretch"), F.max("item_words").alias("item_words"))


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: in how many documents it leaked and the longest stretch; items that leaked nowhere have 0."""
    by_item = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("stretch").alias("longest"))
    return items.select("item_id").distinct().join(by_item, "item_id", "left").select("item_id", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("longest", F.lit(0)).alias("longest"))
