"""Leaked items and frequencies against brute force, with odd inputs."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shalework.llm import contamination, frequency


def squeezed(t):
    return "".join(c for c in (t or "").lower() if c.isalnum())


def leaks_by_hand(docs, items, run=60):
    out = set()
    for i, t in items:
        x = squeezed(t)
        windows = {x[k : k + run] for k in range(len(x) - run + 1)}
        out |= {(d, i) for d, u in docs if any(w in squeezed(u) for w in windows)}
    return out


@pytest.mark.parametrize("bits", [6, 10, 28])
def test_leaks_equal_brute_force(spark, bits):
    rnd = random.Random(2)
    text = lambda n: "".join(rnd.choice("abcdeé日本 語,.-1 2\n") for _ in range(n))
    items = [(i, text(rnd.randint(20, 400))) for i in range(40)] + [(100, None), (101, ""), (102, "x" * 300), (103, "ab" * 200)]
    items.append((200, items[3][1]))  # a repeated question
    docs = [(k, text(rnd.randint(0, 300))) for k in range(60)] + [(500, None), (501, ""), (502, "x" * 5000), (503, "ab" * 40), (504, "x" * 59)]
    for k in range(120):
        i, t = rnd.choice(items[:40])
        n = rnd.randint(40, 200)
        a = rnd.randrange(max(1, len(t) - n))
        docs.append((1000 + k, text(rnd.randint(0, 90)) + t[a : a + n].upper().replace(" ", "  ") + text(rnd.randint(0, 50))))
    docs.append(docs[-1])
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = [tuple(r) for r in contamination.leaks(d, i, max_bits=bits).collect()]
    want = leaks_by_hand(docs, items)
    assert len(want) > 40 and set(got) == want and len(got) == len(want)


def test_leaks_of_very_many_items(spark):
    """The items are a table: 100,000 of them, each document quotes one."""
    text = lambda c, n: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.sha1(F.concat_ws("-", c.cast("string"), k.cast("string")))), " ")
    items = spark.range(100_000).select(F.col("id").alias("item_id"), text(F.col("id"), 3).alias("text"))
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("So: "), F.upper(F.substring(text(F.col("id") * 33, 3), 20, 70)), F.lit(" ends.")).alias("text"))
    got = contamination.leaks(docs, items)
    assert got.where("item_id = 33 * doc_id").count() == got.count() == 3_000


def test_leaks_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert contamination.leaks(none, items).collect() == []
    assert contamination.leaks(none, spark.createDataFrame([(1, "a" * 100)], "item_id long, text string")).collect() == []


def test_one_prefix_token_in_every_window():
    points = contamination.letters_and_digits("abcdefghij" * 30)
    at = contamination.prefix_tokens(points, {}, 20, 60)
    assert all(any(w <= a <= w + 40 for a in at) for w in range(len(points) - 59))


def test_burst_trie_counts():
    rnd = random.Random(1)
    terms = ["".join(rnd.choice("ab0é日") for _ in range(rnd.randint(0, 9))) for _ in range(5000)]
    t = frequency.BurstTrie(limit=4)
    for x in terms:
        t.add(x, 2, 1)
    n = Counter(terms)
    assert {term: (o, r) for term, o, r in t.leaves()} == {x: (2 * k, k) for x, k in n.items()} and t.size == len(n)


@pytest.mark.parametrize("subtree", [1, 7, 10**6])
def test_subtrees_of_many_tries_are_merged(spark, subtree):
    rnd = random.Random(9)
    rows = [(rnd.choice("fg"), "aaaa" + "".join(rnd.choice("ab0é日") for _ in range(rnd.randint(0, 5))), rnd.randint(1, 3)) for _ in range(3000)] + [("f", "", 1), ("f", None, 1), ("f", None, 1)]
    terms = spark.createDataFrame(rows, "field string, term string, n int").repartition(5)
    want = Counter()
    for f, t, n in rows:
        want[f, t] += n
    got = frequency.term_counts(terms, container=4, trie_terms=50, subtree=subtree).collect()
    assert {(r.field, r.term): r.occurrences for r in got} == want and len(got) == len(want)
    assert sum(r.records for r in got) == len(rows)
    nodes = frequency.split_prefixes(terms.where("term is not null"), subtree)
    assert bool(nodes) == (subtree < 10**6) and (subtree > 1 or ("f", "aaaa") in nodes)


OBJECTS = "obj_id long, flags string, display_type string, button_flags string, cond_ops array<string>, received_at timestamp_ntz, field string, term string, n int"


@pytest.mark.parametrize("bound", [3, 200_000])
def test_code_frequencies(spark, bound, monkeypatch):
    monkeypatch.setattr(frequency, "TRIE_TERMS", bound)
    at = lambda k: dt.datetime(2024, 1, 1 + k)
    rnd = random.Random(4)
    rows = []
    for i in range(200):
        code = lambda: rnd.choice([None, "", "  ", "0", " 0\t", "07", "7", str(rnd.randint(0, 30)), "\u3000x"])
        for k in range(rnd.choice([1, 1, 2])):
            rows.append((i, code(), code(), code(), rnd.choice([None, [], ["1", " 1", None, ""], ["2", "2", "3"]]), rnd.choice([None, at(k)]), "f", "t", 1))
    rows += rows[:10] + [(None, "9", None, None, None, at(1), "", "", 0)]
    best = {}
    order = lambda v: (v is not None, [order(x) for x in v] if isinstance(v, list) else v) if v is not None else (False,)
    for r in rows:
        if r[0] is not None:
            key = (order(r[5]), *(order(x) for x in r[1:5]))
            if r[0] not in best or key > best[r[0]][0]:
                best[r[0]] = (key, r)
    occ, obj, holders = Counter(), Counter(), Counter()
    for _, r in best.values():
        for name, values in (("Object.flags", [r[1]]), ("FieldObj.displayType", [r[2]]), ("ButtonObj.buttonFlags", [r[3]]), ("Condition.op", r[4] or [])):
            codes = [v.strip() for v in values if v is not None and v.strip()]
            occ.update((name, c) for c in codes)
            obj.update((name, c) for c in set(codes))
            holders.update([name] * bool(codes))
    want = {(f, v, occ[f, v], k, holders[f], "rare" if k < 5 else "common" if k > 0.4 * holders[f] else None) for (f, v), k in obj.items()}
    got = [tuple(r) for r in frequency.code_frequencies(spark.createDataFrame(rows, OBJECTS)).collect()]
    assert set(got) == want and len(got) == len(want)


def test_frequencies_of_an_empty_table(spark):
    assert frequency.code_frequencies(spark.createDataFrame([], OBJECTS)).collect() == []
