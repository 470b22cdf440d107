"""Near duplicates against a comparison of all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shalework.llm import neardup


def by_hand(rows, least=25):
    sets = {}
    for tab, i, text in rows:
        w = re.findall(r"\w+", (text or "").lower())
        if len(w) >= least and i is not None:
            sets[tab, i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    keys = sorted(sets)
    return {(a[0], a[1], b[1]) for n, a in enumerate(keys) for b in keys[n + 1 :] if a[0] == b[0] and 10 * len(sets[a] & sets[b]) >= 6 * len(sets[a] | sets[b])}


def sample(n, seed, vocabulary=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    rows, i = [], 0
    while len(rows) < n:
        base = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        for _ in range(rnd.choice([1, 1, 2, 5, 12])):
            t = list(base)
            for _ in range(rnd.randint(0, 14)):
                k = rnd.randrange(len(t))
                rnd.choice([lambda: t.__setitem__(k, rnd.choice(words)), lambda: t.insert(k, rnd.choice(words)), lambda: t.pop(k) if len(t) > 5 else None])()
            if rnd.random() < 0.2:
                k = rnd.randrange(len(t))
                t = t[k:] + t[:k]
            rows.append((rnd.choice(["steps", "calculations"]), i, rnd.choice([" ", "; ", "\n"]).join(t).upper() if rnd.random() < 0.3 else " ".join(t)))
            i += 1
    return rows


@pytest.mark.parametrize("seed,blocks", [(1, None), (2, 3)])
def test_pairs_equal_brute_force(spark, seed, blocks, monkeypatch):
    if blocks:  # every token counts as a hot one, whose texts are split between tasks
        monkeypatch.setattr(neardup, "BLOCKS", (1, blocks, blocks, blocks, blocks, blocks, blocks))
        monkeypatch.setattr(neardup, "BROADCAST_KEYS", 1)
        monkeypatch.setattr(neardup, "DIRECT", 2)
        monkeypatch.setattr(neardup, "CHUNK_ROWS", 300)
    rows = sample(400, seed)
    rows += [("steps", 9000, None), ("steps", 9001, ""), ("steps", 9002, "short text"), ("steps", 9003, "x " * 4000), ("steps", 9004, "x " * 4000), (rows[0])] + rows[5:25]
    rows += [("steps", 9100 + k, "same words again " * 9) for k in range(12)]
    df = spark.createDataFrame(rows, "tab string, id long, text string").withColumn("key", F.lit("clash")).withColumn("grams", F.lit(1))
    got = [tuple(r) for r in neardup.similar_pairs(df).collect()]
    want = by_hand(rows)
    assert len(want) > 100 and set(got) == want and len(got) == len(want)


def test_trie_loses_nothing():
    rnd = np.random.default_rng(5)
    n = 300
    rec = np.zeros(n, neardup._REC)
    sets = []
    for i in range(n):
        base = sets[rnd.integers(i)] if i and rnd.random() < 0.6 else rnd.integers(0, 2**63, 60, dtype=np.uint64)
        s = np.unique(np.concatenate([base[rnd.random(len(base)) > 0.15], rnd.integers(0, 2**63, rnd.integers(1, 10), dtype=np.uint64)]))
        sets.append(s)
        rec[i]["key"], rec[i]["n"] = np.void(i.to_bytes(16, "big")), len(s)
        rec[i]["sig"] = np.frombuffer(neardup.signature(s).tobytes(), ">u8")
    i, j = neardup.trie_join(np.zeros(n, np.uint64), rec)
    found = {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist())}
    close = {(a, b) for a in range(n) for b in range(a + 1, n) if 10 * len(np.intersect1d(sets[a], sets[b])) >= 6 * len(np.union1d(sets[a], sets[b]))}
    assert close and close <= found and len(found) < n * n / 4


def test_groups_are_connected_components(spark):
    rows = sample(300, 7)
    got = {(r.tab, r.id): r for r in neardup.groups(spark.createDataFrame(rows, "tab string, id long, text string")).collect()}
    parent = {k: k for k in got}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for tab, a, b in by_hand(rows):
        x, y = sorted([root((tab, a)), root((tab, b))])
        parent[y] = x
    by_class = {}
    for k, r in got.items():
        by_class.setdefault((k[0], r.group_id), set()).add(k)
    want = {}
    for k in got:
        want.setdefault(root(k), set()).add(k)
    assert sorted(map(sorted, by_class.values())) == sorted(map(sorted, want.values()))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "tab string, id long, text string")
    assert neardup.similar_pairs(empty).collect() == [] and neardup.groups(empty).collect() == []
