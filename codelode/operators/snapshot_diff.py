"""What changed between consecutive full snapshots.

Each key gets an ordinal in a dictionary that only ever grows: it is kept in the store, and a key keeps its ordinal in all snapshots and all later runs. A snapshot is one compressed bitmap over
those ordinals and a vector of digest numbers aligned with its members. AND-NOT of two bitmaps gives additions and removals; the vectors, laid on the ordinals that both have, expose
changes. A new snapshot is compared with its neighbours alone, whatever the number of snapshots in the store.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.common import made, shared_dir, written

#: Rows of one bucket of a group, roughly, at its first load. A bucket is what one task holds at a time.
BUCKET_ROWS = 200_000

_BLOCK = 1 << 16


class Bitmap:
    """A set of ordinals, in blocks of 65536; a block without members is not kept. Stored, a block is the shortest of a list of members, runs, and plain bits."""

    __slots__ = ("blocks",)

    def __init__(self, blocks: dict[int, np.ndarray] | None = None) -> None:
        self.blocks = {k: b for k, b in (blocks or {}).items() if b.any()}

    @classmethod
    def of(cls, ordinals: np.ndarray) -> Bitmap:
        ordinals = np.unique(ordinals)
        high = ordinals >> 16
        blocks = {}
        for k in np.unique(high).tolist():
            held = np.zeros(_BLOCK, bool)
            held[ordinals[high == k] & 0xFFFF] = True
            blocks[k] = np.packbits(held, bitorder="little")
        return cls(blocks)

    def and_not(self, other: Bitmap) -> Bitmap:
        return Bitmap({k: b & ~other.blocks[k] if k in other.blocks else b for k, b in self.blocks.items()})

    def and_(self, other: Bitmap) -> Bitmap:
        return Bitmap({k: b & other.blocks[k] for k, b in self.blocks.items() if k in other.blocks})

    def ordinals(self) -> np.ndarray:
        parts = [np.flatnonzero(np.unpackbits(self.blocks[k], bitorder="little")) + (k << 16) for k in sorted(self.blocks)]
        return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)

    def to_bytes(self) -> bytes:
        out = [struct.pack("<I", len(self.blocks))]
        for k in sorted(self.blocks):
            members = np.flatnonzero(np.unpackbits(self.blocks[k], bitorder="little"))
            starts = members[np.append(True, np.diff(members) > 1)]
            ends = members[np.append(np.diff(members) > 1, True)]
            forms = {0: members.astype("<u2").tobytes(), 1: np.stack([starts, ends], axis=1).astype("<u2").tobytes(), 2: self.blocks[k].tobytes()}
            kind = min(forms, key=lambda f: (len(forms[f]), f))
            out += [struct.pack("<IBI", k, kind, len(forms[kind])), forms[kind]]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, stored: bytes) -> Bitmap:
        (n,), at, blocks = struct.unpack_from("<I", stored), 4, {}
        for _ in range(n):
            k, kind, length = struct.unpack_from("<IBI", stored, at)
            body = stored[at + 9 : at + 9 + length]
            at += 9 + length
            if kind == 2:
                blocks[k] = np.frombuffer(body, np.uint8)
                continue
            held = np.zeros(_BLOCK + 1, np.int32)
            places = np.frombuffer(body, "<u2").astype(np.int64)
            if kind == 0:
                held[places] = 1
            else:
                np.add.at(held, places[0::2], 1)
                np.add.at(held, places[1::2] + 1, -1)
                held = np.cumsum(held)
            blocks[k] = np.packbits(held[:_BLOCK] > 0, bitorder="little")
        return cls(blocks)


#: What an update writes. ``dictionary``: new keys of a bucket from ordinal ``first`` on, and new digests; ``listing``: a snapshot's bitmap and digest numbers; ``change``: the result.
STORED = "grp STRING, bucket BIGINT, snapshot_no BIGINT, before_no BIGINT, first BIGINT, first_digest BIGINT, items ARRAY<STRING>, digests ARRAY<STRING>, bitmap BINARY, codes BINARY, item STRING, change_kind STRING, kind STRING"
_ARROW = {
    "grp": pa.string(), "bucket": pa.int64(), "snapshot_no": pa.int64(), "before_no": pa.int64(), "first": pa.int64(), "first_digest": pa.int64(), "items": pa.list_(pa.string()), "digests": pa.list_(pa.string()),
    "bitmap": pa.binary(), "codes": pa.binary(), "item": pa.string(), "change_kind": pa.string(), "kind": pa.string(),
}
_STATE = [c.split()[0] for c in STORED.split(", ")][:10]


def _stored(n: int, **columns: pa.Array | list) -> pa.Table:
    return pa.table({c: columns[c].cast(t) if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _ARROW.items()})


def _strings(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([c.cast(pa.string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.string())


def _bucket_update(key: tuple, rows: pa.Table, state: pa.Table) -> pa.Table:
    """One bucket: the dictionary grows by unknown keys, each new snapshot gets bitmap and vector, and is compared with the ones before and after it."""
    grp, bucket = key[0].as_py(), key[1].as_py()
    known = sorted((r for r in state.to_pylist() if r["kind"] == "dictionary"), key=lambda r: r["first"])
    items = pa.array([x for r in known for x in r["items"]], pa.string())
    digests = pa.array([x for r in sorted(known, key=lambda r: r["first_digest"]) for x in r["digests"]], pa.string())
    rows = rows.sort_by([("snapshot_no", "ascending"), ("item", "ascending")])
    all_items = pa.concat_arrays([items, _strings(rows["item"])]).dictionary_encode()
    all_digests = pa.concat_arrays([digests, _strings(rows["digest"])]).dictionary_encode()
    ordinals = all_items.indices.to_numpy()[len(items) :].astype(np.int64)
    codes = all_digests.indices.to_numpy()[len(digests) :].astype(np.int32)
    number = rows["snapshot_no"].to_numpy()
    out = []
    if len(all_items.dictionary) > len(items) or len(all_digests.dictionary) > len(digests):
        out.append(_stored(1, grp=[grp], bucket=[bucket], first=[len(items)], first_digest=[len(digests)], items=[all_items.dictionary[len(items) :].to_pylist()], digests=[all_digests.dictionary[len(digests) :].to_pylist()], kind=["dictionary"]))
    listings: dict[int, tuple[Bitmap, np.ndarray]] = {}
    for r in state.to_pylist():
        if r["kind"] == "listing":
            bitmap = Bitmap.from_bytes(r["bitmap"])
            listings[r["snapshot_no"]] = (bitmap, np.frombuffer(zlib.decompress(r["codes"]), np.int32))
    todo = next(r for r in state.to_pylist() if r["kind"] == "todo")["pairs"]
    for no in sorted({p["snapshot_no"] for p in todo if p["new"]}):
        a, b = np.searchsorted(number, no, "left"), np.searchsorted(number, no, "right")
        bitmap = Bitmap.of(ordinals[a:b])
        order = np.argsort(ordinals[a:b], kind="stable")
        listings[no] = (bitmap, codes[a:b][order])
        out.append(_stored(1, grp=[grp], bucket=[bucket], snapshot_no=[no], bitmap=[bitmap.to_bytes()], codes=[zlib.compress(listings[no][1].tobytes(), 1)], kind=["listing"]))
    nothing = (Bitmap(), np.zeros(0, np.int32))

    def vector(listing: tuple[Bitmap, np.ndarray]) -> np.ndarray:
        laid = np.full(len(all_items.dictionary), -1, np.int32)
        laid[listing[0].ordinals()] = listing[1]
        return laid

    for p in todo:
        if p["before_no"] is None:
            continue
        new, old = listings.get(p["snapshot_no"], nothing), listings.get(p["before_no"], nothing)
        both = new[0].and_(old[0]).ordinals()
        differ = both[vector(new)[both] != vector(old)[both]] if len(both) else both
        for change, found in (("added", new[0].and_not(old[0]).ordinals()), ("removed", old[0].and_not(new[0]).ordinals()), ("changed", differ)):
            n = len(found)
            if n:
                out.append(_stored(n, grp=[grp] * n, bucket=[bucket] * n, snapshot_no=[p["snapshot_no"]] * n, before_no=[p["before_no"]] * n, item=all_items.dictionary.take(pa.array(found)), change_kind=[change] * n, kind=["change"] * n))
    return pa.concat_tables(out) if out else _stored(0)


class SnapshotStore:
    """Dictionaries, bitmaps and vectors of all snapshots of all groups under ``path``, in folders ``v=<number>``, one per update. One writer at a time.

    Nothing that is stored is ever rewritten: an update adds new keys, the new snapshots and their changes. A snapshot that is delivered again replaces the stored one as a whole.
    The number of buckets of a group is fixed by its size at its first load. An update that was broken off left no ``_SUCCESS`` and is not read.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, bucket_rows: int = BUCKET_ROWS) -> None:
        self.spark, self.bucket_rows = spark, bucket_rows
        self.path = path or made(f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}")

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def stored(self) -> DataFrame:
        """All rows of the store, with the update ``v`` that wrote them."""
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], f"{STORED}, v INT")
        return self.spark.read.schema(f"{STORED}, v INT").option("basePath", self.path).parquet(*[f"{self.path}/v={v}" for v in versions])

    def _numbers(self, stored: DataFrame) -> DataFrame:
        """``grp, buckets, numbers``: per group the number of buckets and all snapshots, in order."""
        return stored.where("kind = 'group'").groupBy("grp").agg(F.max("bucket").alias("buckets"), F.sort_array(F.collect_set("snapshot_no")).alias("numbers"))

    def update(self, held: DataFrame) -> DataFrame:
        """Adds snapshots: ``grp, snapshot_no, item, digest``, one row per key and snapshot, nothing null. Result: their changes, those against a later snapshot included (``grp, snapshot_no, before_no, item, change_kind``).

        The numbers of the snapshots of a group are held in one row.
        """
        versions, stored = self._versions(), self.stored()
        # of a snapshot delivered again the last delivery holds
        latest = Window.partitionBy("grp", "bucket", "snapshot_no").orderBy(F.desc("v"))
        sizes = held.groupBy("grp", "snapshot_no").agg(F.count(F.lit(1)).alias("n"))
        arrived = sizes.groupBy("grp").agg(F.collect_set("snapshot_no").alias("new"), F.greatest(F.lit(1), F.ceil(F.sum("n") / F.lit(self.bucket_rows))).alias("wanted"))
        groups = arrived.join(self._numbers(stored), "grp", "left") if versions else arrived.withColumns({"buckets": F.lit(None).cast("bigint"), "numbers": F.array().cast("array<bigint>")})
        groups = groups.select("grp", F.coalesce("buckets", "wanted").cast("bigint").alias("buckets"), "new", F.array_sort(F.array_union(F.coalesce("numbers", F.array().cast("array<bigint>")), "new")).alias("numbers"))
        pair = lambda n, k: F.struct(n.alias("snapshot_no"), F.when(k > 0, F.get("numbers", k - 1)).alias("before_no"), F.array_contains("new", n).alias("new"))
        # the new snapshots, and those right after one
        wanted = F.filter(F.transform("numbers", pair), lambda p: p["new"] | F.coalesce(F.array_contains("new", p["before_no"]), F.lit(False)))
        groups = written(groups.select("grp", "buckets", "new", wanted.alias("pairs")), "snapshot-groups")
        todo = groups.select("grp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("buckets") - 1)).alias("bucket"), "pairs", F.lit("todo").alias("kind"))
        state = todo
        if versions:
            near = groups.select("grp", F.explode(F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.array(p["snapshot_no"], p["before_no"]))))).alias("snapshot_no"), F.lit(True).alias("near"))
            fresh = groups.select("grp", F.explode("new").alias("snapshot_no"))
            listings = stored.where("kind = 'listing'").join(near, ["grp", "snapshot_no"], "left_semi").join(fresh, ["grp", "snapshot_no"], "left_anti")
            listings = listings.withColumn("k", F.row_number().over(latest)).where("k = 1")
            dictionaries = stored.where("kind = 'dictionary'").join(groups.select("grp"), "grp", "left_semi")
            state = dictionaries.select(*_STATE, "kind").unionByName(listings.select(*_STATE, "kind")).unionByName(todo, allowMissingColumns=True)
        else:
            state = state.select("grp", "bucket", *[F.lit(None).cast(t).alias(c) for c, t in (("snapshot_no", "bigint"), ("before_no", "bigint"), ("first", "bigint"), ("first_digest", "bigint"), ("items", "array<string>"), ("digests", "array<string>"), ("bitmap", "binary"), ("codes", "binary"))], "kind", "pairs")
        rows = held.join(groups.select("grp", "buckets"), "grp").select("grp", F.expr("pmod(xxhash64(item), buckets)").alias("bucket"), "snapshot_no", "item", "digest")
        done = rows.groupBy("grp", "bucket").cogroup(state.groupBy("grp", "bucket")).applyInArrow(_bucket_update, STORED)
        told = groups.select("grp", F.col("buckets").alias("bucket"), F.explode("new").alias("snapshot_no"), F.lit("group").alias("kind"))
        v = (versions[-1] if versions else 0) + 1
        done.unionByName(told, allowMissingColumns=True).write.partitionBy("kind").parquet(f"{self.path}/v={v}")
        return self.spark.read.schema(STORED).option("basePath", f"{self.path}/v={v}").parquet(f"{self.path}/v={v}").where("kind = 'change'").select("grp", "snapshot_no", "before_no", "item", "change_kind")

    def changes(self) -> DataFrame:
        """The changes between all snapshots that follow one another: of each pair those that were found last."""
        stored = self.stored()
        numbers = self._numbers(stored).select("grp", F.posexplode("numbers").alias("k", "snapshot_no"), "numbers").where("k > 0").select("grp", "snapshot_no", F.expr("numbers[k - 1]").alias("before_no"))
        # a pair is looked at again when either snapshot comes again
        seen = stored.where("kind = 'group'").groupBy("grp", "snapshot_no").agg(F.max("v").alias("came"))
        last = numbers.join(seen, ["grp", "snapshot_no"]).join(seen.select("grp", F.col("snapshot_no").alias("before_no"), F.col("came").alias("before_came")), ["grp", "before_no"])
        last = last.select("grp", "snapshot_no", "before_no", F.greatest("came", "before_came").alias("v"))
        return stored.where("kind = 'change'").join(last, ["grp", "snapshot_no", "before_no", "v"]).select("grp", "snapshot_no", "before_no", "item", "change_kind")


def listings_of(snapshots: DataFrame, group: str = "repo", number: str = "snapshot_no", key: str = "path", digest: str = "content_hash", received: str = "received_at") -> DataFrame:
    """``grp, snapshot_no, item, digest`` without nulls: of several rows for one key in one snapshot the one received last, see ``snapshot_changes``."""
    rows = snapshots.where(F.col(number).isNotNull() & F.col(key).isNotNull()).select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"), F.col(number).cast("bigint").alias("snapshot_no"), F.col(key).cast("string").alias("item"),
        F.coalesce(F.concat(F.lit("="), F.lower(digest)), F.lit("")).alias("digest"), F.col(received).alias("received"),
    )
    return rows.groupBy("grp", "snapshot_no", "item").agg(F.max(F.struct("received", "digest"))["digest"].alias("digest"))


def snapshot_changes(
    snapshots: DataFrame, group: str = "repo", number: str = "snapshot_no", key: str = "path", digest: str = "content_hash", received: str = "received_at", bucket_rows: int = BUCKET_ROWS, store: SnapshotStore | None = None
) -> DataFrame:
    """Records added, removed or changed between each pair of consecutive delivered snapshots of a group.

    Result: ``group``, ``number`` (the later snapshot of the pair), ``key``, ``change_kind`` (``added``, ``removed``, ``changed``). Of several rows for one key in
    one snapshot the one received last holds (a null ``received`` counts as earliest; rows that tie agree by contract, else the greater digest holds). The case of
    hex digits means nothing. A null digest is a value of its own: null to null is no change. A null group is a group
    of its own. Rows without snapshot number or key name no record and are left out, but no column needs to be free of nulls. A group's first
    snapshot yields nothing; an empty table yields nothing. With a ``store`` that holds earlier snapshots the new ones are compared with their neighbours there.

    Rows are first reduced to one per key and snapshot by an aggregate with map-side combine. A group is then cut into as many hash buckets as
    its rows need, so that a group with a third of all rows spreads over many tasks; a key always falls into the same bucket. Only the list of snapshots per group is looked at across buckets.
    """
    store = store or SnapshotStore(snapshots.sparkSession, bucket_rows=bucket_rows)
    changes = store.update(listings_of(snapshots, group, number, key, digest, received))
    return changes.select(F.expr("CASE WHEN grp = '' THEN NULL ELSE substring(grp, 2) END").alias(group), F.col("snapshot_no").alias(number), F.col("item").alias(key), "change_kind")


def change_totals(changes: DataFrame, group: str = "repo", number: str = "snapshot_no") -> DataFrame:
    """How many records were added, removed and changed per group and snapshot."""
    kinds = [F.count_if(F.col("change_kind") == kind).alias(f"n_{kind}") for kind in ("added", "removed", "changed")]
    return changes.groupBy(group, number).agg(*kinds)
