"""Filling containers of fixed capacity with texts: a grouping genetic algorithm.

A solution is a set of bins. Crossover injects whole well-filled bins of one parent into the other, drops the other's bins that share a text with them (so no text is there twice) and puts the
displaced texts back: bin by bin the largest with the one to three others that fill it best, or by best fit. Texts are hashed to blocks of bounded size; each block is evolved on several
islands in parallel tasks. After every epoch each island sends its elite to the next one of the ring. A block whose number of bins has come near the lower bound (NEAR) is not searched any further.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.common import slots, written

#: Files of a public tokenizer.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's tokenizer cuts a text before it merges bytes (fixed value, from its publication).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of a block, islands per block, solutions per island, epochs (with a migration after each), generations of an epoch, children of a generation.
BLOCK, ISLANDS, POPULATION, EPOCHS, GENERATIONS, CHILDREN = 16_000, 3, 8, 3, 8, 4
#: Generations without a better solution after which an island rests until the next migration.
PATIENCE = 3
#: A block needs no search where its bins exceed the lower bound by no more than this share.
NEAR = 0.0005
#: Texts that are put back bin by bin, and how many of them a bin may hold on average; more or smaller ones are put back by best fit.
MOST_COMPLETED, MOST_IN_BIN = 1500, 6

#: Every text is placed once per window; a table of more windows is taken for a mistake.
MOST_WINDOWS = 1000


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):  # noqa: ANN202
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: str, vocabulary: str = VOCABULARY) -> int:
    return len(_encoding(vocabulary).encode_ordinary(text))


def token_sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens`` of each text that is not null or blank. The vocabulary's path must be readable on every executor."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t and not t.isspace() else 0 for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": sizes})

    return documents.where(F.col("text").isNotNull()).select("doc_id", "text").mapInPandas(measure, "doc_id BIGINT, n_tokens BIGINT").where("n_tokens > 0")


class _Room:
    """Bins by free room: the fullest bin that still takes an item is found by bisection."""

    def __init__(self, bins: list[list[int]], fills: list[int], capacity: int) -> None:
        self.bins, self.fills, self.capacity = bins, fills, capacity
        self.by: dict[int, list[int]] = {}
        for k, f in enumerate(fills):
            if f < capacity:
                self.by.setdefault(capacity - f, []).append(k)
        self.rooms = sorted(self.by)

    def put(self, item: int, size: int) -> None:
        at = bisect_left(self.rooms, size)
        if at == len(self.rooms):
            k, left = len(self.bins), self.capacity - size
            self.bins.append([item])
            self.fills.append(size)
        else:
            room = self.rooms[at]
            same = self.by[room]
            k = same.pop()
            if not same:
                del self.by[room]
                del self.rooms[at]
            self.bins[k].append(item)
            self.fills[k] += size
            left = room - size
        if left:
            same = self.by.get(left)
            if same is None:
                self.by[left] = [k]
                insort(self.rooms, left)
            else:
                same.append(k)


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: list[list[int]] | None = None, fills: list[int] | None = None) -> tuple[list[list[int]], list[int]]:
    """Puts items, in the order given, each into the fullest bin that takes it."""
    bins, fills = bins if bins is not None else [], fills if fills is not None else []
    room = _Room(bins, fills, capacity)
    for i in items:
        room.put(i, sizes[i])
    return bins, fills


def fitness(fills: list[int], capacity: int) -> float:
    """Mean squared fill: of two solutions with as many bins the one with fuller full bins is better."""
    f = np.asarray(fills, float) / capacity
    return float((f * f).mean()) if len(f) else 1.0


def completed(items: list[int], sizes: list[int], capacity: int, bins: list[list[int]], fills: list[int], rng: np.random.Generator) -> tuple[list[list[int]], list[int]]:
    """Puts items into new bins one after the other: the largest that is left, and with it the one, two or three others that fill the bin best."""
    order = sorted(items, key=lambda i: (sizes[i], i))
    size = np.array([sizes[i] for i in order], np.int64)
    while len(size):
        room = capacity - int(size[-1])
        left = size[:-1]
        best, chosen = 0, ()
        if len(left) and room >= left[0]:
            k = int(np.searchsorted(left, room, "right")) - 1
            best, chosen = int(left[k]), (k,)
            if best < room and len(left) > 1:
                pair = _pair(left, room)
                if pair is not None and pair[0] > best:
                    best, chosen = pair[0], pair[1]
                if best < room and len(left) > 2 and int(left[:3].sum()) <= room:
                    for third in rng.integers(0, min(len(left), int(np.searchsorted(left, room, "right"))), 4):
                        third = int(third)
                        pair = _pair(np.delete(left, third), room - int(left[third]))
                        if pair is not None and pair[0] + int(left[third]) > best:
                            best, chosen = pair[0] + int(left[third]), (third, *(k if k < third else k + 1 for k in pair[1]))
        taken = [len(size) - 1, *chosen]
        bins.append([order[k] for k in taken])
        fills.append(int(size[-1]) + best)
        gone = set(taken)
        order = [i for k, i in enumerate(order) if k not in gone]
        size = np.delete(size, taken)
    # small texts may still go into bins that were closed
    return _emptied(bins, fills, sizes, capacity)


def _pair(left: np.ndarray, room: int) -> tuple[int, tuple[int, int]] | None:
    """The two of sorted sizes that fill the room best."""
    k = np.searchsorted(left, room - left, "right") - 1
    k = np.minimum(k, np.arange(len(left)) - 1)
    ok = k >= 0
    if not ok.any():
        return None
    sums = np.where(ok, left + left[np.maximum(k, 0)], -1)
    a = int(sums.argmax())
    return int(sums[a]), (a, int(k[a]))


def _emptied(bins: list[list[int]], fills: list[int], sizes: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Tries to dissolve the emptiest bins into the room that the others leave."""
    for _ in range(3):
        if len(bins) < 2:
            break
        k = int(np.argmin(fills))
        rest, held = [b[:] for j, b in enumerate(bins) if j != k], [f for j, f in enumerate(fills) if j != k]
        n = len(rest)
        best_fit(sorted(bins[k], key=sizes.__getitem__, reverse=True), sizes, capacity, rest, held)
        if len(rest) > n:
            break
        bins, fills = rest, held
    return bins, fills


def _put_back(items: list[int], sizes: list[int], capacity: int, bins: list[list[int]], fills: list[int], rng: np.random.Generator) -> tuple[list[list[int]], list[int]]:
    items.sort(key=sizes.__getitem__, reverse=True)
    if 0 < len(items) <= MOST_COMPLETED and sum(sizes[i] for i in items) * MOST_IN_BIN >= capacity * len(items) and rng.random() < 0.7:
        return completed(items, sizes, capacity, bins, fills, rng)
    return best_fit(items, sizes, capacity, bins, fills)


def crossover(a: tuple, b: tuple, sizes: list[int], capacity: int, rng: np.random.Generator) -> tuple[list[list[int]], list[int]]:
    """Injects a random half of a's well-filled bins into b."""
    (bins_a, fills_a), (bins_b, fills_b) = a, b
    well = float(np.quantile(fills_a, 0.5)) if fills_a else 0.0
    good = [k for k, f in enumerate(fills_a) if f >= well]
    chosen = [k for k, keep in zip(good, rng.random(len(good)) < 0.5, strict=True) if keep]
    taken = set().union(*(bins_a[k] for k in chosen)) if chosen else set()
    bins, fills, displaced = [bins_a[k][:] for k in chosen], [fills_a[k] for k in chosen], []
    for members, fill in zip(bins_b, fills_b, strict=True):
        if taken.isdisjoint(members):
            bins.append(members[:])
            fills.append(fill)
        else:
            displaced.extend(i for i in members if i not in taken)
    return _put_back(displaced, sizes, capacity, bins, fills, rng)


def mutated(a: tuple, sizes: list[int], capacity: int, rng: np.random.Generator) -> tuple[list[list[int]], list[int]]:
    """Empties the worst bins and some others and puts their items back."""
    bins, fills = a
    n = max(2, len(fills) // 12)
    worst = set(np.argsort(fills)[:n].tolist()) | set(rng.integers(0, len(fills), n).tolist())
    kept = [k for k in range(len(bins)) if k not in worst]
    return _put_back([i for k in sorted(worst) for i in bins[k]], sizes, capacity, [bins[k][:] for k in kept], [fills[k] for k in kept], rng)


def least_bins(sizes: list[int], capacity: int) -> int:
    """A lower bound: what the sum needs, or what the items that can't share a bin need, with the rest in the room that these leave."""
    s = np.sort(np.asarray(sizes, np.int64))
    if not len(s):
        return 0
    sums = np.concatenate([[0], np.cumsum(s)])
    best = -(-int(sums[-1]) // capacity)
    for a in np.unique(s[s <= capacity // 2]).tolist() or [0]:
        big, half, small = np.searchsorted(s, capacity - a, "right"), np.searchsorted(s, capacity // 2, "right"), np.searchsorted(s, a, "left")
        room = (big - half) * capacity - int(sums[big] - sums[half])
        more = max(0, -(-(int(sums[half] - sums[small]) - room) // capacity)) if half > small else 0
        best = max(best, int(len(s) - half) + more)
    return best


def _score(solution: tuple, capacity: int) -> tuple[int, float]:
    return -len(solution[1]), fitness(solution[1], capacity)


def _enough(sizes: list[int], capacity: int) -> int:
    """So few bins that no search is worth while."""
    return int(least_bins(sizes, capacity) * (1 + NEAR))


def evolve(sizes: list[int], capacity: int, population: list[tuple], generations: int, rng: np.random.Generator, least: int | None = None) -> list[tuple]:
    """The population after some generations, best first; ends early where the number of bins can't fall any more, or nothing better came for PATIENCE generations."""
    least = least_bins(sizes, capacity) if least is None else least
    scored = sorted(((_score(s, capacity), k, s) for k, s in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)
    waited, born = 0, len(scored)
    for _ in range(generations):
        if len(scored[0][2][1]) <= least or waited >= PATIENCE:
            break
        before = scored[0][0]
        for c in range(CHILDREN):
            # tournaments of two; a partner is another solution
            a = int(rng.integers(0, len(scored), 2).min())
            if c % 2 and len(scored) > 1:
                b = int(rng.integers(0, len(scored) - 1))
                child = crossover(scored[a][2], scored[b + (b >= a)][2], sizes, capacity, rng)
            else:
                child = mutated(scored[a][2], sizes, capacity, rng)
            scored.append((_score(child, capacity), born, child))
            born += 1
        # of equal solutions the younger one stays
        scored = sorted({x[0]: x for x in scored}.values(), key=lambda x: x[0], reverse=True)[: max(POPULATION, 2)]
        waited = 0 if scored[0][0] > before else waited + 1
    return [x[2] for x in scored]


def founders(sizes: list[int], capacity: int, n: int, rng: np.random.Generator, least: int | None = None) -> list[tuple]:
    """Best fit by falling size, the same in disturbed orders, and one put together bin by bin; the exact order alone if that is already optimal."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    out = [best_fit(order, sizes, capacity)]
    least = least_bins(sizes, capacity) if least is None else least
    if n > 1 and len(out[0][1]) > least and sum(sizes) * MOST_IN_BIN >= capacity * len(sizes):
        out.append(completed(order, sizes, capacity, [], [], rng))
    while len(out) < n and min(len(f) for _, f in out) > least:
        noise = 0.9 + 0.2 * rng.random(len(sizes))
        out.append(best_fit(sorted(order, key=lambda i: -sizes[i] * noise[i]), sizes, capacity))
    return out


#: A population: per solution the bin of each item, items in order of their number. The best stands first.
ISLAND = "window_id BIGINT, capacity BIGINT, block BIGINT, island INT, settled BOOLEAN, items ARRAY<BIGINT>, sizes ARRAY<BIGINT>, population ARRAY<ARRAY<INT>>"
PACKED = "window_id BIGINT, block BIGINT, item BIGINT, size BIGINT, bin INT"


def _bins(numbers: np.ndarray, sizes: list[int]) -> tuple[list[list[int]], list[int]]:
    bins: list[list[int]] = [[] for _ in range(int(numbers.max()) + 1)]
    for i, k in enumerate(numbers.tolist()):
        bins[k].append(i)
    return bins, [sum(sizes[i] for i in members) for members in bins]


def _numbers(bins: list[list[int]], n: int) -> np.ndarray:
    at = np.zeros(n, np.int32)
    for k, members in enumerate(bins):
        at[members] = k
    return at


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """The founders of a block: one row per island, a single one where best fit cannot be beaten."""
    rows = rows.sort_values("item", ignore_index=True)
    sizes, capacity, block = rows["size"].tolist(), int(rows["capacity"].iloc[0]), int(rows["block"].iloc[0])
    least = _enough(sizes, capacity)
    first = founders(sizes, capacity, 1, np.random.default_rng(0), least)
    settled = len(first[0][1]) <= least
    islands = [first] if settled else [[first[0], *founders(sizes, capacity, POPULATION, np.random.default_rng([k, block & 0xFFFFFFFF]), least)[1:]] for k in range(ISLANDS)]
    n = len(islands)
    return pd.DataFrame({
        "window_id": [rows["window_id"].iloc[0]] * n, "capacity": [capacity] * n, "block": [block] * n, "island": range(n), "settled": [settled] * n, "items": [rows["item"].to_numpy()] * n, "sizes": [rows["size"].to_numpy()] * n,
        "population": [[_numbers(b, len(sizes)) for b, _ in solutions] for solutions in islands],
    })


def _epoch(rows: pd.DataFrame) -> pd.DataFrame:
    """An island with the elite that came from its neighbour."""
    own = rows[rows["items"].notna()].iloc[0]
    sizes, capacity = own["sizes"].tolist(), int(own["capacity"])
    numbers = [x for _, r in rows.sort_values("items", key=lambda c: c.isna(), kind="stable").iterrows() for x in r["population"]]
    rng = np.random.default_rng([int(own["island"]), int(own["block"]) & 0xFFFFFFFF, len(numbers), int(sum(int(x.max()) for x in numbers))])
    least = _enough(sizes, capacity)
    solutions = evolve(sizes, capacity, [_bins(np.asarray(x), sizes) for x in numbers], GENERATIONS, rng, least)
    return pd.DataFrame({
        "window_id": [own["window_id"]], "capacity": [capacity], "block": [own["block"]], "island": [own["island"]], "settled": [len(solutions[0][1]) <= least], "items": [own["items"]], "sizes": [own["sizes"]],
        "population": [[_numbers(b, len(sizes)) for b, _ in solutions]],
    })


def _best(rows: pd.DataFrame) -> pd.DataFrame:
    """The best solution of all islands of a block."""
    best, row = None, None
    for _, r in rows.sort_values("island").iterrows():
        sizes = r["sizes"].tolist()
        solution = _bins(np.asarray(r["population"][0]), sizes)
        if best is None or _score(solution, int(r["capacity"])) > best:
            best, row = _score(solution, int(r["capacity"])), r
    return pd.DataFrame({"window_id": row["window_id"], "block": row["block"], "item": row["items"], "size": row["sizes"], "bin": np.asarray(row["population"][0], np.int32)})


def _evolved(rests: DataFrame, groups: int) -> DataFrame:
    """``window_id, block, item, size, bin``: founders, epochs with a ring of migrations, the best of each block."""
    # so many tasks that each has a few islands; set by number, as their time does not go by bytes
    tasks = max(slots(rests.sparkSession), min(100_000, -(-groups * ISLANDS // 4)))
    islands = written(rests.repartition(tasks, "window_id", "block").groupBy("window_id", "block").applyInPandas(_settle, ISLAND), "islands")
    done, going = islands.where("settled"), islands.where("NOT settled")
    for _ in range(EPOCHS):
        elite = going.select("window_id", "capacity", "block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.lit(False).alias("settled"), F.lit(None).cast("array<bigint>").alias("items"), F.lit(None).cast("array<bigint>").alias("sizes"), F.slice("population", 1, 1).alias("population"))
        going = written(going.unionByName(elite).repartition(tasks, "window_id", "block", "island").groupBy("window_id", "block", "island").applyInPandas(_epoch, ISLAND), "islands")
    return done.unionByName(going).groupBy("window_id", "block").applyInPandas(_best, PACKED)


def packed(documents: DataFrame, windows: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """``window_id, doc_id, piece, n_tokens, container``: for each window every text that is not blank, in a container of at most ``capacity_tokens`` tokens.

    A text longer than the capacity is cut into full pieces, each a container of its own, and a rest that is packed like any other text; no other text is split. Containers are
    named; a name belongs to one window. Windows of null or non-positive capacity hold nothing. Equal windows are packed each for itself. Null and repeated
    ``doc_id`` are separate texts. An empty table gives an empty result.

    Blocks hold about ``block`` pieces, whatever the number of texts: each block's last containers alone stay partly empty. Only the number of pieces per window reaches
    the driver.
    """
    sizes = written(token_sizes(documents, vocabulary).withColumn("item", F.monotonically_increasing_id()), "token-sizes")
    wanted = windows.where("capacity_tokens > 0 AND window_id IS NOT NULL").select("window_id", F.col("capacity_tokens").cast("bigint").alias("capacity")).orderBy("window_id", "capacity").limit(MOST_WINDOWS + 1).collect()
    if len(wanted) > MOST_WINDOWS:
        raise ValueError(f"more than {MOST_WINDOWS} windows")
    each = F.array(*[F.struct(F.lit(w["window_id"]).cast("bigint").alias("window_id"), F.lit(w["capacity"]).cast("bigint").alias("capacity")) for w in wanted]) if wanted else F.array().cast("array<struct<window_id:bigint,capacity:bigint>>")
    pieces = sizes.select("item", "doc_id", "n_tokens", F.explode(each).alias("w")).select("w.window_id", "w.capacity", "item", "doc_id", "n_tokens").select("window_id", "capacity", "item", "doc_id", F.expr("n_tokens div capacity").alias("full"), F.expr("n_tokens % capacity").alias("rest"))
    whole = pieces.where("full > 0").select("window_id", "doc_id", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece"), F.col("capacity").alias("n_tokens"), "item")
    whole = whole.select("window_id", "doc_id", "piece", "n_tokens", F.concat_ws("-", F.lit("full"), "item", "piece").alias("container"))
    total = sizes.count()
    blocks = max(1, -(-total // block))
    rests = pieces.where("rest > 0").select("window_id", "capacity", F.expr(f"pmod(xxhash64(item), {blocks})").alias("block"), "item", F.col("rest").alias("size"))
    final = _evolved(rests, blocks * max(1, len(wanted)))
    named = final.select("window_id", "item", F.col("size").alias("n_tokens"), F.concat_ws("-", F.lit("bin"), "block", "bin").alias("container"))
    placed = named.join(pieces.where("rest > 0").select("window_id", "item", "doc_id", F.col("full").cast("int").alias("piece")), ["window_id", "item"]).select("window_id", "doc_id", "piece", "n_tokens", "container")
    return whole.unionByName(placed)


def unused(arrangement: DataFrame, windows: DataFrame) -> DataFrame:
    """``window_id, capacity_tokens, n_containers, n_tokens, unused_share`` per window; a window without texts has no containers and a null share."""
    per_container = arrangement.groupBy("window_id", "container").agg(F.sum("n_tokens").alias("n"))
    per_window = per_container.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"))
    both = windows.select("window_id", "capacity_tokens").join(per_window, "window_id", "left")
    n, used = F.coalesce("n_containers", F.lit(0)), F.coalesce("n_tokens", F.lit(0))
    return both.select("window_id", "capacity_tokens", n.alias("n_containers"), used.alias("n_tokens"), F.when(n > 0, F.round(1 - used / (n * F.col("capacity_tokens")), 6)).alias("unused_share"))
