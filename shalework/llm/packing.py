"""Items of varying size into containers of fixed capacity, alike items together, with little space unused.

Lexical retrieval packing. The items of one group (here file, kind and folder) form a shard with an inverted index of its own:
BM25 over the words of name, path, kind and folder. The largest unused item is the seed of a container; the index returns its
unused neighbours, the most alike first, and those that fit fill the window, until none fits. If that takes more containers than
the sizes alone would need, the shard is filled again with the neighbours in decreasing size, and then by the subset of
neighbours that fills each window best.

Groups beyond ``SHARD`` items are cut into several shards that are packed apart, so no group has to fit into a task; what lies in
their poorly filled containers is pooled by group and packed once more.

Defined results. An item larger than the capacity is divided into parts, all but the last as large as the capacity; no other
item is. A null or negative size counts as 0 lines. A path that was delivered more than once counts once, by the row received
last (then the greater hash). Rows without file, path or snapshot are left out; a null kind or folder is a group of its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalework.functions.text import path_key
from shalework.session import cut

CAPACITY = 6000
#: Items in a shard, and the fill below which a container of a divided group is packed again.
SHARD, POOR = 4096, 0.97
K1, B = 1.2, 0.75

_TERM = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\d_]+")


class Index:
    """BM25 over the items of one shard."""

    def __init__(self, texts: list[str]) -> None:
        docs = [Counter(t.lower() for t in _TERM.findall(x)) for x in texts]
        size = np.array([sum(d.values()) for d in docs], float)
        norm = K1 * (1 - B + B * size / max(size.mean(), 1e-9)) if len(docs) else size
        places: dict[str, tuple[list[int], list[int]]] = {}
        for i, d in enumerate(docs):
            for term, n in d.items():
                at = places.setdefault(term, ([], []))
                at[0].append(i)
                at[1].append(n)
        self.terms = docs
        self.n = len(docs)
        self.postings: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for term, (i, n) in places.items():
            at, tf = np.array(i), np.array(n, float)
            idf = math.log(1 + (self.n - len(i) + 0.5) / (len(i) + 0.5))
            self.postings[term] = (at, idf * tf * (K1 + 1) / (tf + norm[at]))

    def scores(self, seed: int) -> np.ndarray:
        """How alike every item is to the seed."""
        out = np.zeros(self.n)
        for term in self.terms[seed]:
            at, weight = self.postings[term]
            if len(at) > 1:
                out[at] += weight
        return out


def _fill(sizes: np.ndarray, capacity: int, ranked) -> list[list[int]]:
    """Containers seeded by the largest unused item; ``ranked(seed, unused)`` gives the order in which neighbours are tried."""
    unused = np.ones(len(sizes), bool)
    out = []
    for seed in np.argsort(-sizes, kind="stable"):
        if not unused[seed]:
            continue
        unused[seed] = False
        window, room = [int(seed)], capacity - int(sizes[seed])
        free = np.flatnonzero(unused & (sizes <= room))
        for i in ranked(seed, free):
            if sizes[i] <= room:
                window.append(int(i))
                room -= int(sizes[i])
                unused[i] = False
                if room == 0:
                    break
        out.append(window)
    return out


def _best_subset(sizes: np.ndarray, capacity: int):
    """Neighbours whose sizes fill the room best: subset sums as bits of one number."""

    def ranked(seed: int, free: np.ndarray) -> list[int]:
        room = capacity - int(sizes[seed])
        free = free[sizes[free] > 0]
        mask, sums, steps = (1 << (room + 1)) - 1, 1, []
        for i in free:
            after = (sums | (sums << int(sizes[i]))) & mask
            if after != sums:
                steps.append((int(i), sums))
                sums = after
            if sums >> room & 1:
                break
        at, chosen = sums.bit_length() - 1, []
        for i, before in reversed(steps):
            if not before >> at & 1:
                chosen.append(i)
                at -= int(sizes[i])
        return chosen

    return ranked


def pack_shard(texts: list[str], sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Places of the items in each container."""
    index = Index(texts)
    least = max(1, -(-int(sizes.sum()) // capacity))

    def alike(seed: int, free: np.ndarray) -> np.ndarray:
        return free[np.lexsort((free, -sizes[free], -index.scores(seed)[free]))]

    best = _fill(sizes, capacity, alike)
    if len(best) > least:
        by_size = _fill(sizes, capacity, lambda seed, free: free[np.lexsort((-index.scores(seed)[free], -sizes[free]))])
        best = by_size if len(by_size) < len(best) else best
    if len(best) > least:
        # items of no size follow at the end of the last container
        exact = _fill(sizes[sizes > 0], capacity, _best_subset(sizes[sizes > 0], capacity))
        if len(exact) < len(best):
            place = np.flatnonzero(sizes > 0)
            best = [[int(place[i]) for i in w] for w in exact]
            best[-1] += [int(i) for i in np.flatnonzero(sizes == 0)]
    return best


def _pack(capacity: int, names: list[str]):
    """Streams shards (sorted by their number) and numbers the containers of each."""
    cols = [*names, "container", "fill"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def shards(t: pa.Table) -> Iterator[pa.Table]:
            key = np.asarray(t["shard_key"])
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
            for a, z in zip(starts, [*starts[1:], len(key)]):
                yield t.slice(a, z - a)

        def packed(t: pa.Table) -> list[pa.RecordBatch]:
            sizes = np.asarray(t["lines"]).astype(np.int64)
            windows = pack_shard(t["terms"].to_pylist(), sizes, capacity)
            number, fill = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int64)
            for k, w in enumerate(windows):
                number[w], fill[w] = k, sizes[w].sum()
            return t.append_column("container", pa.array(number)).append_column("fill", pa.array(fill)).select(cols).combine_chunks().to_batches()

        for b in batches:
            t = pa.Table.from_batches([b])
            parts = list(shards(t if held is None else pa.concat_tables([held, t])))
            for p in parts[:-1]:
                yield from packed(p)
            held = parts[-1] if parts else held
        if held is not None and held.num_rows:
            yield from packed(held)

    return run


def pack(items: DataFrame, within: list[str], capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``items`` (path, part, lines, terms, the columns of ``within`` and any others), lines at most ``capacity`` -> with batch and fill.

    A batch is named by its group's hash, the round, the shard and a number; it never holds items of two groups.
    """
    names = items.columns
    group = F.xxhash64(*within) if within else F.lit(0).cast("bigint")
    items = items.withColumn("group", group)
    kind = lambda d: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields)

    def once(rows: DataFrame, round_no: int) -> DataFrame:
        n = rows.groupBy("group").agg(F.count("*").alias("_n")).where(F.col("_n") > shard)
        # a group in several shards; few groups are that large
        cut_up = rows.join(n, "group", "left").withColumn("shard", F.coalesce(F.pmod(F.xxhash64("path", "part"), F.ceil(F.col("_n") / shard)).cast("int"), F.lit(0))).drop("_n")
        keyed = cut_up.withColumn("shard_key", F.xxhash64("group", "shard", *within))
        cols = [*names, "group", "shard", "shard_key"]
        ordered = keyed.select(cols).repartition("shard_key").sortWithinPartitions("shard_key", "path", "part")
        out = ordered.mapInArrow(_pack(capacity, cols), kind(ordered) + ", container int, fill bigint")
        name = F.format_string(f"%016x-{round_no}-%d-%03d", "group", "shard", "container")
        return out.withColumn("batch", name)

    many = items.groupBy("group").agg(F.count("*").alias("_n")).where(F.col("_n") > shard).select("group")
    if not many.take(1):
        return once(items, 0).select(*names, "batch", "fill")
    first = cut(once(items, 0))
    poor = F.col("fill") < F.lit(POOR * capacity)
    again = once(first.join(many, "group", "left_semi").where(poor).select(*names, "group"), 1)
    kept = first.join(many.withColumn("_many", F.lit(True)), "group", "left").where(F.col("_many").isNull() | ~poor)
    return kept.select(*names, "batch", "fill").unionByName(again.select(*names, "batch", "fill"))


def pack_snapshot(index: DataFrame, snapshot: int | None = None, within: tuple[str, ...] = ("file", "kind", "folder"), capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """The objects of a snapshot of the object index (the last one) in batches ->
    (snapshot_no, file, kind, folder, path, part, parts, lines, batch)."""
    rows = index.where(F.col("file").isNotNull() & F.col("path").isNotNull() & F.col("snapshot_no").isNotNull())
    number = F.lit(snapshot).cast("int") if snapshot is not None else rows.agg(F.max("snapshot_no")).scalar()
    rows = rows.where(F.col("snapshot_no") == number)
    seen = F.struct(F.col("received_at").isNotNull(), "received_at", "sha256", "kind", "folder", "name", "lines", "snapshot_no")
    once = rows.select("file", path_key(F.col("path")).alias("path"), seen.alias("s")).groupBy("file", "path").agg(F.max("s").alias("s"))
    size = F.greatest(F.coalesce("s.lines", F.lit(0)), F.lit(0)).cast("bigint")
    parts = F.greatest(F.ceil(size / capacity), F.lit(1)).cast("int")
    one = once.select("file", "path", F.col("s.kind").alias("kind"), F.col("s.folder").alias("folder"), "s.snapshot_no", size.alias("size"), parts.alias("parts"), F.concat_ws(" ", "s.name", "s.kind", "s.folder", "path").alias("terms"))
    split = one.withColumn("part", F.explode(F.sequence(F.lit(1), "parts"))).withColumn("lines", F.least(F.lit(capacity), F.col("size") - (F.col("part") - 1) * capacity))
    packed = pack(split, list(within), capacity, shard)
    return packed.select("snapshot_no", "file", "kind", "folder", "path", "part", "parts", "lines", "batch")
