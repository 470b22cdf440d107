"""Evaluation texts that leak into a corpus: documents that share a long run of characters with a held-out item.

A prefix-filtered set join. Both sides are reduced to letters and digits in lower case; a *shingle* is a run of ``q`` of those
characters. A case is a run of at least ``run`` characters, hence a window of an item all of whose shingles lie in the
document in order. The join needs one shingle of each window: the rarest in the corpus. So

1. the items' shingles are counted over the whole corpus: documents are scanned through a Bloom filter of them, and what passes is
   joined to the shingles by hash;
2. each window of each item keeps its rarest shingle as its prefix token (ties by hash, so windows that overlap share it);
3. documents are scanned once more. A long enough run has that many shingles of items one after the other, so stretches in which fewer pass the
   filter are ruled out; in the others a prefix token travels with the letters round it, as many as
   a run through it could need, is joined to the items' tokens by hash, and the run of equal characters round it is measured exactly.

Items are a table like the documents: their shingles, counts and tokens never come together in one place. What is sent to every task is a filter
of bounded size.

Defined results. Null texts, and texts with fewer than ``run`` letters and digits, are in no case. Items with equal texts are
each reported. A document that was delivered more than once is reported once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalework.llm import bitmap
from shalework.session import cut

#: Shingle length and shared run in letters and digits.
Q, RUN = 20, 60
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    """True for each code point that is a letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def letters_and_digits(text: str) -> np.ndarray:
    """Code points of the letters and digits, in lower case."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return points[_alnum()[points]]


_powers: dict[int, np.ndarray] = {}


def _power(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the longest text so far."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        p = np.full(size, base, np.uint64)
        p[0] = 1
        have = _powers[base] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def shingle_hashes(points: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of each run of q code points: a polynomial by prefix sums, then mixed."""
    n = len(points)
    if n < q:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(points.astype(np.uint64) * _power(n, int(_BASE)), out=sums[1:])
        h = (sums[q:] - sums[:-q]) * _power(n - q + 1, int(_INVERSE))
        h ^= h >> np.uint64(32)
        h *= _MIX
    return h ^ (h >> np.uint64(29))


def _shingles(items: DataFrame, item_id: str, text_col: str, q: int, run: int) -> DataFrame:
    """(item, h, letters): each item that is long enough, with the hashes of its shingles in order."""
    kind = items.schema[item_id].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, hashes, letters = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                points = letters_and_digits(text)
                if len(points) >= run:
                    keep.append(i)
                    hashes.append(shingle_hashes(points, q).view(np.int64))
                    letters.append(points.tobytes().decode("utf-32-le", "surrogatepass"))
            yield pa.record_batch([b.column(0).take(pa.array(keep, pa.int64())), pa.array(hashes, pa.list_(pa.int64())), pa.array(letters, pa.string())], ["item", "h", "letters"])

    return items.where(F.length(text_col) >= run).select(F.col(item_id), F.col(text_col)).distinct().mapInArrow(make, f"item {kind}, h array<bigint>, letters string")


#: Hashes that are looked up at once.
TOGETHER = 400_000


def _chunks(texts: pa.Array, q: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Texts in chunks of about ``TOGETHER`` shingles: (letters of each, where its shingles begin and the number of all, hashes one after the other)."""
    letters: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    size = 0
    for i, text in enumerate(texts):
        letters.append(letters_and_digits(text.as_py()))
        hashes.append(shingle_hashes(letters[-1], q))
        size += len(hashes[-1])
        if size >= TOGETHER or i == len(texts) - 1:
            yield letters, np.concatenate([[0], np.cumsum([len(h) for h in hashes])]), np.concatenate(hashes)
            letters, hashes, size = [], [], 0


def _corpus_counts(documents: DataFrame, text_col: str, words, q: int, min_chars: int) -> DataFrame:
    """(h, n): in how many places of the corpus each shingle occurs that the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = bitmap.Map(words.value)
        for b in batches:
            some = [h[filled.passes(h)] for _, _, h in _chunks(b.column(0), q)]
            h, n = np.unique(np.concatenate(some), return_counts=True) if some else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    texts = documents.where(F.length(text_col) >= min_chars).select(text_col)
    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def prefix_tokens(points: np.ndarray, counts: dict[int, int], q: int, run: int) -> np.ndarray:
    """Places of the item's necessary shingles: the rarest of each window of ``run`` characters."""
    h = shingle_hashes(points, q)
    return _rarest(h, np.array([counts.get(int(x), 0) for x in h.view(np.int64)], np.int64), q, run)


def _rarest(h: np.ndarray, rank: np.ndarray, q: int, run: int) -> np.ndarray:
    order = np.lexsort((h, rank))
    place = np.empty(len(h), np.int64)
    place[order] = np.arange(len(h))
    # equal shingles share the rank of their first place
    windows = np.lib.stride_tricks.sliding_window_view(place, run - q + 1)
    return np.unique(windows.argmin(axis=1) + np.arange(len(windows)))


def _tokens(items: DataFrame, counts: DataFrame, q: int, run: int) -> DataFrame:
    """(h, item, back, around): the prefix tokens of every item with the letters round each, ``back`` of them in front of it."""
    one = items.select("item", "letters", F.posexplode("h").alias("at", "h")).join(counts, "h", "left")
    # an item is one text: the places of its shingles fit where the text did
    per = one.groupBy("item", "letters").agg(F.sort_array(F.collect_list(F.struct("at", "h", F.coalesce("n", F.lit(0)).alias("n")))).alias("s")).select("item", "letters", F.col("s.h").alias("h"), F.col("s.n").alias("n"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, tokens, back, around = [], [], [], []
            for i, (text, h, n) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)))):
                hashes = np.array(h, np.int64)
                for at in _rarest(hashes.view(np.uint64), np.array(n, np.int64), q, run).tolist():
                    of.append(i)
                    tokens.append(h[at])
                    back.append(min(at, run - q))
                    around.append(text[max(0, at - run + q) : at + run])
            yield pa.record_batch([pa.array(tokens, pa.int64()), b.column(0).take(pa.array(of, pa.int64())), pa.array(back, pa.int32()), pa.array(around, pa.string())], ["h", "item", "back", "around"])

    return per.mapInArrow(choose, f"h long, item {items.schema['item'].dataType.simpleString()}, back int, around string")


def _stretches(hit: np.ndarray, least: int) -> np.ndarray:
    """The places that lie in a stretch of at least so many hits."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    starts, stops = edges[::2], edges[1::2]
    long = stops - starts >= least
    return np.concatenate([np.arange(a, z) for a, z in zip(starts[long], stops[long])]) if long.any() else np.zeros(0, np.int64)


def _runs(a: list[str], a_back: np.ndarray, b: list[str], b_back: np.ndarray, q: int, run: int) -> np.ndarray:
    """How many characters are equal round the token in each pair of neighbourhoods; 0 where the token differs."""
    wide = 2 * run - q

    def rows(texts: list[str], back: np.ndarray, fill: int) -> np.ndarray:
        out = np.full((len(texts), wide), fill, np.uint32)
        for i, (t, k) in enumerate(zip(texts, back.tolist())):
            points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            out[i, run - q - k : run - q - k + len(points)] = points
        return out

    same = rows(a, a_back, 0) == rows(b, b_back, 0xFFFFFFFF)
    ahead = np.cumprod(same[:, run - q :], axis=1).sum(axis=1)
    behind = np.cumprod(same[:, : run - q][:, ::-1], axis=1).sum(axis=1)
    return np.where(ahead >= q, ahead + behind, 0)


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", q: int = Q, run: int = RUN, max_bits: int = bitmap.MAX_BITS) -> DataFrame:
    """(doc_id, item_id) of every document and the items it shares a run of at least ``run`` letters and digits with."""
    sc = documents.sparkSession.sparkContext
    kind = documents.schema[doc_id].dataType.simpleString()
    shingled = cut(_shingles(items, item_id, text_col, q, run))
    keys = cut(shingled.select(F.explode("h").alias("h")).distinct())
    first = sc.broadcast(bitmap.build(keys, keys.count(), max_bits))
    counts = _corpus_counts(documents, text_col, first, q, run).join(keys, "h", "left_semi")
    tokens = cut(_tokens(shingled, counts, q, run))
    needed = tokens.select("h").distinct()
    second = sc.broadcast(bitmap.build(needed, needed.count(), max_bits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, filled = bitmap.Map(first.value), bitmap.Map(second.value)
        for b in batches:
            of, tokens, back, around = [], [], [], []
            done = 0
            for letters, begins, h in _chunks(b.column(1), q):
                # a stretch may run on into the next text, which only lets more pass
                places = _stretches(whole.passes(h), run - q + 1)
                places = places[filled.passes(h[places])]
                owner = np.searchsorted(begins, places, "right") - 1
                for place, i in zip(places.tolist(), owner.tolist()):
                    at = place - int(begins[i])
                    of.append(done + i)
                    tokens.append(int(h[place].view(np.int64)))
                    back.append(min(at, run - q))
                    around.append(letters[i][max(0, at - run + q) : at + run].tobytes().decode("utf-32-le", "surrogatepass"))
                done += len(letters)
            rows = b.column(0).take(pa.array(of, pa.int64()))
            yield pa.record_batch([pa.array(tokens, pa.int64()), rows, pa.array(back, pa.int32()), pa.array(around, pa.string())], ["h", "doc", "doc_back", "doc_around"])

    hits = documents.where(F.length(text_col) >= run).select(doc_id, text_col).mapInArrow(scan, f"h long, doc {kind}, doc_back int, doc_around string")
    # copies of a passage are compared once for each document only; both ends must leave room for the run
    pairs = hits.where(F.length("doc_around") >= run).distinct().join(tokens.where(F.length("around") >= run), "h")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            long = _runs(b.column(2).to_pylist(), np.asarray(b.column(3)), b.column(4).to_pylist(), np.asarray(b.column(5)), q, run) >= run
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(long)) for c in b.columns[:2]], [doc_id, item_id])

    found = pairs.select("doc", "item", "doc_around", "doc_back", "around", "back").mapInArrow(verify, f"{doc_id} {kind}, {item_id} {items.schema[item_id].dataType.simpleString()}")
    return found.distinct()
