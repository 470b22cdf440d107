"""Near-duplicate texts: all pairs whose word-triple sets are similar enough, and the groups they form.

A binary trie self-join with an exact error budget. Each text has a signature of 256 bits: every distinct triple of words flips
one bit. Two sets that differ in k elements have signatures that differ in at most k bits, and similar sets of a and b elements
differ in at most ``budget = (a + b) (1 - t) / (1 + t)`` of them; so a pair of trie nodes that already differs in more bits holds no
pair of records, and pruning it loses nothing.

The trie's first levels are a routing token, on which the budget is zero: similar sets share one of the first
``n - ceil(t n) + 1`` triples of either, whatever the order, so each text enters the trie once for each of those. The order is by
rarity in the corpus; triples that occur once can have no partner and enter nothing. Each task holds a range of routing tokens
and traverses all their subtries at once, level by level, on arrays. Tokens that very many texts carry are split into blocks,
and the blocks' pairs go to different tasks. The pairs that survive are verified on the whole sets.

Texts with equal sets form one class and enter once; classes are expanded at the end.

Defined results. A word is a maximal run of letters, digits and underscores in lower case. Null texts and texts of fewer than
``min_words`` words are in no pair. A record that was delivered more than once is one record. Ids are unique in a table only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shalework.session import cut, written

WORD = re.compile(r"\w+")
#: The similarity as a fraction, and the least number of words.
NUM, DEN, MIN_WORDS = 6, 10, 25
#: Occurrences from which a triple counts as rarer or more common when triples are ordered; the first is what can have a partner.
LEVELS = (2, 8, 64, 1024, 16384, 1 << 20)
#: Blocks that the texts of a routing token of each level are split into.
BLOCKS = (1, 1, 1, 1, 4, 32, 256)
#: Bits of the maps that tell the levels: 16 MB for the first, 2 MB for each further one, at any corpus size.
MAP_BITS = (27, 24, 24, 24, 24, 24)
#: Pairs of nodes with at most so many pairs of records are compared directly.
DIRECT = 32
CHUNK_ROWS = 60_000
BROADCAST_KEYS = 200_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _M1
        h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def triples(texts: list[str | None], seeds: np.ndarray, min_words: int = MIN_WORDS) -> list[np.ndarray | None]:
    """The sorted distinct triples of each text as 64-bit hashes; None where it has too few words."""
    words, sizes = [], []
    for t in texts:
        w = WORD.findall(t.lower()) if t else []
        sizes.append(len(w) if len(w) >= max(3, min_words) else 0)
        if sizes[-1]:
            words += w
    if not words:
        return [None] * len(texts)
    codes, distinct = pd.factorize(np.array(words, object))
    h = pd.util.hash_array(np.asarray(distinct, object), categorize=False)[codes]
    with np.errstate(over="ignore"):
        t = h[:-2] * _A + np.roll(h, -1)[:-2] * _B + np.roll(h, -2)[:-2] * _C if len(h) > 2 else h[:0]
    t = _mix(t)
    out, at = [], 0
    for n, seed in zip(sizes, seeds):
        out.append(np.unique(_mix(t[at : at + n - 2] ^ seed)) if n else None)
        at += n
    return out


def fingerprints(texts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(tab, id, text) -> (tab, id, key, grams): grams the sorted triples as 8 bytes each, key 16 bytes that stand for the set."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tabs = b.column(0).to_pylist()
            seed_of = {t: pd.util.hash_array(np.array([t], object), categorize=False)[0] for t in set(tabs)}
            sets = triples(b.column(2).to_pylist(), np.array([seed_of[t] for t in tabs], np.uint64), min_words)
            keep = [i for i, s in enumerate(sets) if s is not None]
            keys, grams = [], []
            for i in keep:
                s = sets[i]
                with np.errstate(over="ignore"):
                    k = np.array([np.bitwise_xor.reduce(s), (s * _A).sum()], np.uint64)
                keys.append(_mix(k ^ np.uint64(len(s))).tobytes())
                grams.append(s.tobytes())
            rows = b.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([rows.column(0), rows.column(1), pa.array(keys, pa.binary()), pa.array(grams, pa.binary())], ["tab", "id", "key", "grams"])

    shortest = 2 * min_words - 1  # a character a word, and what parts them
    return texts.where(F.length("text") >= shortest).select("tab", "id", "text").mapInArrow(run, f"tab string, id {kind}, key binary, grams binary")


def _sets(b: pa.RecordBatch, col: int) -> tuple[np.ndarray, np.ndarray]:
    """(all values, offsets) of a binary column of 8-byte values."""
    c = b.column(col)
    if c.offset:
        c = pa.concat_arrays([c])
    wide = pa.types.is_large_binary(c.type)
    offsets = np.frombuffer(c.buffers()[1], np.int64 if wide else np.int32)[: len(c) + 1].astype(np.int64)
    data = c.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.uint64) if data is not None else np.zeros(0, np.uint64)
    return values, (offsets - offsets[0]) // 8


def _distinct(b: pa.RecordBatch, key: int) -> np.ndarray:
    """Places of the first row of each class in a batch."""
    first: dict[bytes, int] = {}
    for i, k in enumerate(b.column(key).to_pylist()):
        first.setdefault(k, i)
    return np.fromiter(first.values(), np.int64, len(first))


# --- rarity -------------------------------------------------------------------------------------------------------


def rarity_maps(prints: DataFrame) -> list:
    """For each level a bitmap (broadcast) of the triples that reach it. A clash only makes a triple look more common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offsets = _sets(b, 1)
            one = np.zeros(len(offsets) - 1, bool)
            one[_distinct(b, 0)] = True
            kept = values[np.repeat(one, np.diff(offsets))]
            g, n = np.unique((kept >> np.uint64(32)).astype(np.uint32).view(np.int32), return_counts=True)
            yield pa.record_batch([pa.array(g), pa.array(n.astype(np.int32))], ["g", "n"])

    counts = prints.select("key", "grams").mapInArrow(run, "g int, n int").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= LEVELS[0])
    words = []
    for least, bits in zip(LEVELS, MAP_BITS):
        # the map's index is the upper bits of the 32
        at = F.shiftrightunsigned("g", 32 - bits)
        words.append(F.when(F.col("n") >= least, F.struct((at / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63))).alias("m"))))
    maps = (
        counts.select(F.posexplode(F.array(*words)).alias("level", "x")).where(F.col("x").isNotNull())
        .groupBy("level", F.col("x.w").alias("w")).agg(F.bit_or("x.m").alias("m")).toArrow()
    )
    sc = prints.sparkSession.sparkContext
    level, w, m = (np.asarray(maps[c]) for c in ("level", "w", "m"))
    out = []
    for i, bits in enumerate(MAP_BITS):
        bitmap = np.zeros(1 << (bits - 6), np.uint64)
        bitmap[w[level == i]] = m[level == i].view(np.uint64)
        out.append(sc.broadcast(bitmap))
    return out


def _level(grams: np.ndarray, maps: list[np.ndarray]) -> np.ndarray:
    """0 for a triple that occurs once, else how many levels it reaches."""
    out = np.zeros(len(grams), np.int8)
    left = np.arange(len(grams))
    for i, (bits, bitmap) in enumerate(zip(MAP_BITS, maps)):
        at = (grams[left] >> np.uint64(64 - bits)).astype(np.int64)
        hit = (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        left = left[hit]
        out[left] = i + 1
    return out


# --- routing ------------------------------------------------------------------------------------------------------


def signature(grams: np.ndarray) -> np.ndarray:
    """32 bytes: each triple flips one bit."""
    return np.packbits((np.bincount((grams >> np.uint64(24)).astype(np.uint8), minlength=256) & 1).astype(np.uint8))


def routed(prints: DataFrame, maps: list, num: int = NUM, den: int = DEN) -> DataFrame:
    """(route, rec): rec is key (16 bytes), size (4), side (1) and signature (32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = [m.value for m in maps]
        for b in batches:
            values, offsets = _sets(b, 1)
            keys = b.column(0).to_pylist()
            levels = _level(values, bitmaps)
            routes, recs = [], []
            for i in _distinct(b, 0):
                g, lv = values[offsets[i] : offsets[i + 1]], levels[offsets[i] : offsets[i + 1]]
                n = len(g)
                prefix = n - (num * n + den - 1) // den + 1
                if np.count_nonzero(lv == 0) >= prefix:
                    continue
                first = np.lexsort((g, lv))[:prefix]
                first = first[lv[first] > 0]
                head, sig = keys[i] + np.int32(n).tobytes(), signature(g).tobytes()
                for t, level in zip(g[first], lv[first]):
                    k = BLOCKS[level]
                    if k == 1:
                        routes.append(t)
                        recs.append(head + b"\0" + sig)
                    else:
                        own = keys[i][0] % k
                        for other in range(k):
                            lo, hi = min(own, other), max(own, other)
                            with np.errstate(over="ignore"):
                                routes.append(t + _A * np.uint64(lo * k + hi + 1))
                            recs.append(head + (b"\0" if own == other else b"\1" if own < other else b"\2") + sig)
            yield pa.record_batch([pa.array(np.array(routes, np.uint64).view(np.int64)), pa.array(recs, pa.binary())], ["route", "rec"])

    return prints.select("key", "grams").mapInArrow(run, "route long, rec binary")


# --- the trie -----------------------------------------------------------------------------------------------------

_REC = np.dtype([("key", "V16"), ("n", "<i4"), ("side", "u1"), ("sig", ">u8", 4)])


def _spread(a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of each pair of node ranges; of a node with itself each pair once."""
    nb = b_hi - b_lo
    area = (a_hi - a_lo) * nb
    which = np.repeat(np.arange(len(area)), area)
    inner = np.arange(int(area.sum())) - np.repeat(np.cumsum(area) - area, area)
    i, j = a_lo[which] + inner // nb[which], b_lo[which] + inner % nb[which]
    once = (a_lo[which] != b_lo[which]) | (i < j)
    return i[once], j[once]


def trie_join(route: np.ndarray, rec: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in ``rec`` with a common route, sizes that allow the similarity, and signatures within the budget."""
    sig = rec["sig"].astype(np.uint64)
    order = np.lexsort((sig[:, 3], sig[:, 2], sig[:, 1], sig[:, 0], rec["side"], route))
    route, sig, size, side = route[order], sig[order], rec["n"][order].astype(np.int64), rec["side"][order]
    head = np.flatnonzero(np.concatenate([[True], (route[1:] != route[:-1]) | (side[1:] != side[:-1])]))
    tail = np.append(head[1:], len(route))
    group_side = side[head]
    own = group_side == 0
    # subtries joined with themselves, and those of one block with those of another
    lo, hi = head[own], tail[own]
    cross = np.flatnonzero((group_side[:-1] == 1) & (group_side[1:] == 2) & (route[head[:-1]] == route[head[1:]])) if len(head) > 1 else np.zeros(0, int)
    a_lo, a_hi = np.append(lo, head[cross]), np.append(hi, tail[cross])
    b_lo, b_hi = np.append(lo, head[cross + 1]), np.append(hi, tail[cross + 1])
    some = (a_hi - a_lo > 1) | (a_lo != b_lo)
    a_lo, a_hi, b_lo, b_hi = a_lo[some], a_hi[some], b_lo[some], b_hi[some]
    most = np.maximum.reduceat(size, head) if len(head) else size
    top = np.repeat(most, tail - head)
    err = np.zeros(len(a_lo), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(x: np.ndarray) -> None:
        for part in np.array_split(np.flatnonzero(x), max(1, int(((a_hi - a_lo) * (b_hi - b_lo))[x].sum()) // 4_000_000)):
            i, j = _spread(a_lo[part], a_hi[part], b_lo[part], b_hi[part])
            fits = np.minimum(size[i], size[j]) * den >= np.maximum(size[i], size[j]) * num
            i, j = i[fits], j[fits]
            bits = np.bitwise_count(sig[i] ^ sig[j]).sum(axis=1, dtype=np.int64)
            close = bits * (den + num) <= (size[i] + size[j]) * (den - num)
            found.append((order[i[close]], order[j[close]]))

    for depth in range(257):
        small = (a_hi - a_lo) * (b_hi - b_lo) <= (DIRECT if depth < 256 else np.iinfo(np.int64).max)
        if small.any():
            compare(small)
            a_lo, a_hi, b_lo, b_hi, err = (x[~small] for x in (a_lo, a_hi, b_lo, b_hi, err))
        if not len(a_lo):
            break
        ones = np.concatenate([[0], np.cumsum((sig[:, depth >> 6] >> np.uint64(63 - (depth & 63))) & np.uint64(1))]).astype(np.int64)
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        same = a_lo == b_lo
        parts = [
            (a_lo, a_mid, b_lo, b_mid, err), (a_mid, a_hi, b_mid, b_hi, err), (a_lo, a_mid, b_mid, b_hi, err + 1),
            tuple(x[~same] for x in (a_mid, a_hi, b_lo, b_mid, err + 1)),
        ]
        a_lo, a_hi, b_lo, b_hi, err = (np.concatenate(x) for x in zip(*parts))
        live = (a_hi > a_lo) & (b_hi > b_lo) & ((a_lo != b_lo) | (a_hi - a_lo > 1))
        live[live] &= err[live] * (den + num) <= (top[a_lo[live]] + top[b_lo[live]]) * (den - num)
        a_lo, a_hi, b_lo, b_hi, err = (x[live] for x in (a_lo, a_hi, b_lo, b_hi, err))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def candidates(rows: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(a, b): keys of the pairs that survive the trie, a < b, each once."""

    def pairs(route: np.ndarray, rec: np.ndarray) -> pa.RecordBatch:
        # a class that several tasks sent is one record
        both = np.rec.fromarrays([route, rec])
        _, first = np.unique(both.view(f"V{both.itemsize}"), return_index=True)
        route, rec = route[first], rec[first]
        i, j = trie_join(route, rec, num, den)
        keys = rec["key"]
        distinct, code = np.unique(keys, return_inverse=True)
        a, b = np.minimum(code[i], code[j]), np.maximum(code[i], code[j])
        once = np.unique(a[a != b] * np.int64(len(distinct)) + b[a != b])
        raw = [x.tobytes() for x in distinct]
        return pa.record_batch([pa.array([raw[x] for x in once // len(distinct)], pa.binary()), pa.array([raw[x] for x in once % len(distinct)], pa.binary())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes, recs, held, goal = [], [], 0, CHUNK_ROWS
        for b in batches:
            if not b.num_rows:
                continue
            routes.append(np.asarray(b.column(0)))
            recs.append(np.frombuffer(b"".join(b.column(1).to_pylist()), _REC))
            held += b.num_rows
            if held >= goal:
                route, rec = np.concatenate(routes), np.concatenate(recs)
                whole = int(np.searchsorted(route, route[-1], "left"))  # the last route may go on
                if whole:
                    yield pairs(route[:whole], rec[:whole])
                routes, recs, held = [route[whole:]], [rec[whole:]], len(route) - whole
                goal = held + CHUNK_ROWS if whole else 2 * held  # a route longer than a chunk is put together a few times only
        if held:
            yield pairs(np.concatenate(routes), np.concatenate(recs))

    ordered = rows.repartition("route").sortWithinPartitions("route")
    return ordered.mapInArrow(run, "a binary, b binary").distinct()


# --- results ------------------------------------------------------------------------------------------------------


def verified(pairs: DataFrame, prints: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """The pairs whose whole sets are similar enough -> (a, b, shared, total)."""
    needed = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    if needed.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        needed = F.broadcast(needed)
    sets = prints.select("key", "grams").join(needed, "key", "left_semi").groupBy("key").agg(F.first("grams").alias("grams"))
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("key").alias("b"), F.col("grams").alias("gb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared, total = [], []
            for x, y in zip(b.column(2), b.column(3)):
                g, h = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                n = len(g) + len(h) - len(np.union1d(g, h))
                shared.append(n)
                total.append(len(g) + len(h) - n)
            s, t = np.array(shared, np.int32), np.array(total, np.int32)
            ok = s.astype(np.int64) * den >= t.astype(np.int64) * num
            rows = b.filter(pa.array(ok))
            yield pa.record_batch([rows.column(0), rows.column(1), pa.array(s[ok]), pa.array(t[ok])], ["a", "b", "shared", "total"])

    return both.select("a", "b", "ga", "gb").mapInArrow(run, "a binary, b binary, shared int, total int")


def links(texts: DataFrame, num: int = NUM, den: int = DEN, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (tab, id, key) of every text long enough, links (a, b, shared, total) between different sets."""
    prints = written(fingerprints(texts, min_words), "prints")
    maps = rarity_maps(prints)
    pairs = cut(candidates(routed(prints, maps, num, den), num, den))
    return prints.select("tab", "id", "key").distinct(), verified(pairs, prints, num, den)


def similar_pairs(texts: DataFrame, **options: int) -> DataFrame:
    """(tab, id_a, id_b) of every two records of one table that are similar enough, id_a < id_b."""
    members, found = links(texts, **options)
    left, right = (members.select("tab", F.col("key").alias(k), F.col("id").alias(i)) for k, i in (("a", "ia"), ("b", "ib")))
    between = found.select("a", "b").join(left, "a").join(right.drop("tab"), "b")
    within = members.select("tab", F.col("key").alias("a"), F.col("id").alias("ia")).join(right.drop("tab"), F.col("a") == F.col("b")).where(F.col("ia") < F.col("ib"))
    out = between.select("tab", "ia", "ib").unionByName(within.select("tab", "ia", "ib"))
    return out.select("tab", F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).where(F.col("id_a") < F.col("id_b")).distinct()


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the least node each one is connected with. ``edges`` (x, y), ``nodes`` (node).

    Alternates between linking every node to the least neighbour of its neighbourhood for the larger and for the smaller
    neighbours; each round is cut, and only counts reach the driver."""
    e = cut(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct())
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
    before = mark(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        e = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        least = e.groupBy("x").agg(F.min("y").alias("m"))
        e = e.join(least, "x")
        e = e.select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").unionByName(e.select("x", F.col("m").alias("y"))).distinct()
        e = cut(e)
        after = mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    root = e.groupBy("x").agg(F.min("y").alias("root"))
    return nodes.join(root, nodes["node"] == root["x"], "left").select("node", F.coalesce("root", "node").alias("root"))


def groups(texts: DataFrame, **options: int) -> DataFrame:
    """One row per record: (tab, id, class_id, group_id, links). class_id is the least id with the same set, group_id the least
    class of the connected group, links the number of other classes the record's class is similar to."""
    members, found = links(texts, **options)
    members, found = cut(members), cut(found)
    classes = members.groupBy("tab", "key").agg(F.min("id").alias("class_id"))
    ends = found.select(F.col("a").alias("key")).unionByName(found.select(F.col("b").alias("key")))
    degree = ends.groupBy("key").agg(F.count("*").alias("links"))
    name = F.struct("tab", "class_id")
    x, y = (classes.select(F.col("key").alias(k), name.alias(n)) for k, n in (("a", "x"), ("b", "y")))
    edges = found.select("a", "b").join(x, "a").join(y, "b").select("x", "y")
    roots = components(edges, classes.select(name.alias("node")))
    of_class = classes.join(degree, "key", "left").withColumn("node", name).join(roots, "node")
    return members.join(of_class.select("key", "class_id", F.col("root.class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links")), "key").drop("key")


def texts_of(steps: DataFrame, calculations: DataFrame) -> DataFrame:
    """Step texts and calculations as (tab, id, text)."""
    part = lambda d, tab, i, t: d.where(F.col(i).isNotNull()).select(F.lit(tab).alias("tab"), F.col(i).alias("id"), F.col(t).alias("text"))
    return part(steps, "steps", "step_uid", "step_text").unionByName(part(calculations, "calculations", "calc_id", "calculation"))
