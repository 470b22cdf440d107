"""Orphan references, snapshot changes, nested reports: brute force and odd inputs."""

import datetime as dt
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from shalework.operators import bloom, nested, orphans, snapshots
from shalework.plans import general
from shalework.session import table

T = lambda day: dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bits, n = bloom.build(keys, 5000)
    other = spark.range(5000, 25000).select(F.xxhash64("id").alias("h"))
    assert keys.where(~bloom.might_contain(bits, n, F.col("h"))).count() == 0
    assert other.where(bloom.might_contain(bits, n, F.col("h"))).count() < 20000 * 0.02


def test_bloom_of_nothing(spark):
    bits, n = bloom.build(spark.createDataFrame([], "h long"), 0)
    assert spark.range(100).select(F.xxhash64("id").alias("h")).where(bloom.might_contain(bits, n, F.col("h"))).count() == 0


@pytest.mark.parametrize("broadcast_rows,max_words", [(10**6, 1 << 20), (0, 1 << 20), (0, 2)])
def test_orphans_equal_brute_force(spark, broadcast_rows, max_words):
    rnd = random.Random(3)
    parents = [(rnd.choice(["Script", "ValueList"]), rnd.choice(["a", "b"]), str(rnd.randint(1, 20)), T(rnd.randint(0, 200)), rnd.choice([None, T(rnd.randint(100, 300))])) for _ in range(60)]
    refs = [("steps", i, rnd.choice(["Script", "ValueList"]), rnd.choice(["a", "b", "zz"]), rnd.choice([None, "", "0", *map(str, range(1, 25))]), rnd.choice([None, *map(T, range(0, 300, 7))])) for i in range(800)]
    want = set()
    for tab, i, tag, f, ref, at in refs:
        if ref in (None, "", "0") or f == "zz":
            continue
        alive = at is not None and any(p[:3] == (tag, f, ref) and p[3] <= at and (p[4] is None or p[4] > at) for p in parents)
        if not alive:
            want.add((tab, i, tag, at.strftime("%Y-%m") if at else None))
    r = spark.createDataFrame(refs + refs[:50], "tab string, row_id long, tag string, file string, ref string, at timestamp_ntz")
    p = spark.createDataFrame(parents, "tag string, file string, id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    files = spark.createDataFrame([("a",), ("b",), (None,)], "file string")
    got = orphans.find_orphans(r, p, files, broadcast_rows=broadcast_rows, max_words=max_words).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_orphans_of_empty_tables(spark):
    r = spark.createDataFrame([], "tab string, row_id long, tag string, file string, ref string, at timestamp_ntz")
    p = spark.createDataFrame([], "tag string, file string, id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    assert orphans.find_orphans(r, p, spark.createDataFrame([], "file string")).count() == 0


def test_orphan_report_counts(spark, sf):
    found = general.p1_found(spark, sf)
    assert general.p1_report(spark, sf).agg(F.sum("orphans")).first()[0] == found.count()


def test_file_names_are_compared_loosely(spark):
    steps = spark.createDataFrame(
        [(1, " Ledger.FMP12\t", "  7 ", None, T(1)), (2, "x", "7", "  ", T(1))], "step_uid long, called_file string, called_script string, file string, scanned_at timestamp_ntz"
    ).withColumn("file", F.lit("own.fmp12"))
    rows = {r.row_id: (r.file, r.ref) for r in orphans.step_references(steps).collect()}
    assert rows == {1: ("ledger", "7"), 2: ("x", "7")}


# --- snapshots ----------------------------------------------------------------------------------------------------

INDEX = "snapshot_no int, file string, path string, sha256 string, received_at timestamp_ntz, delta string, next int"


def changes_by_hand(rows):
    cur = {}
    for s, f, p, h, at, *_ in rows:
        if None in (s, f, p):
            continue
        p = p.replace("\\", "/")
        k = (f, s)
        old = cur.setdefault(k, {}).get(p)
        rank = (at is not None, at or T(0), h is not None, h or "")
        if old is None or rank > old[0]:
            cur[k][p] = (rank, None if h is None else h.strip().lower())
    out = []
    for f in {f for f, _ in cur}:
        ss = sorted(s for g, s in cur if g == f)
        for a, b in zip(ss, ss[1:]):
            x, y = cur[f, a], cur[f, b]
            out += [(b, p, "added") for p in y.keys() - x.keys()] + [(b, p, "removed") for p in x.keys() - y.keys()]
            out += [(b, p, "changed") for p in x.keys() & y.keys() if x[p][1] != y[p][1]]
    return sorted(out)


@pytest.mark.parametrize("batch", [1, 7, 10000])
def test_snapshot_changes_equal_brute_force(spark, batch):
    rnd = random.Random(batch)
    rows = []
    for s in range(1, 6):
        for f in "abc":
            if f == "b" and s == 3:
                continue  # a file that is missing from a whole snapshot
            for i in range(12):
                if rnd.random() < 0.8:
                    rows.append((s, f, f"{f}\\k/{i}" if rnd.random() < 0.3 else f"{f}/k/{i}", rnd.choice(["AA", "aa ", "bb", None]), rnd.choice([None, T(1), T(2)]), "x", 9))
    rows += [(None, "a", "p", "h", T(1), "x", 1), (1, None, "p", "h", T(1), "x", 1), (1, "a", None, "h", T(1), "x", 1)] + rows[:20]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(tuple(r) for r in snapshots.changes(spark.createDataFrame(rows, INDEX)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == changes_by_hand(rows)


def test_snapshots_of_an_empty_table(spark):
    assert snapshots.changes(spark.createDataFrame([], INDEX)).collect() == []


def test_paths_are_composed(spark):
    rows = [(1, "f", "f/é", "a", T(1), "", 0), (2, "f", "f/é", "a", T(1), "", 0), (3, "f", "f/é", "b", T(1), "", 0)]
    assert [tuple(r) for r in snapshots.changes(spark.createDataFrame(rows, INDEX)).collect()] == [(3, "f/é", "changed")]


# --- nested reports -----------------------------------------------------------------------------------------------


def records_by_hand(body):
    """By walking the tree."""
    root = ET.fromstring(nested.clean_xml(body))
    rows = []

    def walk(el, up, near):
        tags = [u.tag for u in up]
        parent = tags[-1] if tags else ""
        groupless = [t for t in tags if t != "Group"] if parent == "Group" else tags
        record = {
            "BaseTable": parent == "BaseTableCatalog", "Table": parent == "TableList", "Relationship": parent == "RelationshipList", "JoinPredicate": parent == "JoinPredicateList",
            "Field": (parent == "BaseTable" and tags[-2:-1] == ["BaseTableCatalog"]) or tags[-3:] == ["BaseTableCatalog", "BaseTable", "FieldCatalog"],
            "Layout": bool(groupless) and groupless[-1] == "LayoutCatalog" and el.get("name") != "-", "Script": bool(groupless) and groupless[-1] == "ScriptCatalog" and el.get("name") != "-",
            "Object": True, "Step": True,
        }.get(el.tag, False)
        if record:
            rows.append((el.tag, len(rows) + 1, near))
            near = len(rows)
        for c in el:
            walk(c, [*up, el], near)

    walk(root, [], 0)
    return rows


def test_records_equal_a_tree_walk(spark, sf):
    want = []
    for r in nested.latest(table(spark, sf, "reports")).collect():
        try:
            want += [(r.report_id, *x) for x in records_by_hand(r.body)] if r.body else []
        except ET.ParseError:
            pass
    got = [tuple(r) for r in general.p6_found(spark, sf).collect()]
    assert sorted(got) == sorted(want) and len(got) > 100


BODY = """\ufeff \n<?xml version="1.0" encoding="UTF-16"?><FMPReport type="Report"><File name="a"><LayoutCatalog><Group><Layout id="1" name="x">
<Object key="1"><Object key="2"><ButtonObj><Step id="1"/></ButtonObj></Object><Object key="3"/></Object></Layout><Layout name="-"><Object key="9"/></Layout></Group></LayoutCatalog>
<ScriptCatalog><Script id="1" name="s"><StepList><Step id="5"><Script id="2" name="called"/></Step></StepList></Script><Script name="-"/></ScriptCatalog></File></FMPReport>"""


def test_shredding_round_trip():
    columns = nested.shred(BODY, values=True)
    assert columns[("Layout", "Object", "Object")]["@pos"].v == [3, 5]
    assert columns[("Layout", "Object", "Object")]["@pos"].r == [0, 3]
    assert columns[("Layout", "Object", "Object", "Step")]["@pos"].d == [4, 3]
    rows = nested.assemble(columns)
    assert [r[:3] for r in rows] == [("Layout", 1, 0), ("Object", 2, 1), ("Object", 3, 2), ("Step", 4, 3), ("Object", 5, 2), ("Object", 6, 0), ("Script", 7, 0), ("Step", 8, 7)]
    assert [r[:3] for r in rows] == records_by_hand(BODY)


def test_reports_with_odd_bodies(spark):
    deep = "<FMPReport>" + "<Object>" * 300 + "</Object>" * 300 + "</FMPReport>"
    rows = [(1, None, T(1)), (2, "", T(1)), (3, "<a", T(1)), (4, "<a\x01b/>", T(1)), (5, BODY, T(1)), (5, BODY, T(2)), (6, deep, None), (7, "<a>&nope;</a>", T(1)), (8, "<FMPReport><Step/>\x00</FMPReport>", T(1)), (None, BODY, T(1))]
    df = spark.createDataFrame(rows, "report_id long, body string, received_at timestamp_ntz").withColumn("entity", F.lit("clash")).withColumn("_last", F.lit(1))
    got = nested.records(df).groupBy("report_id").count().collect()
    assert {r.report_id: r["count"] for r in got} == {5: 8, 6: 300, 8: 1}
    assert {r.report_id for r in nested.failures(df).collect()} == {1, 2, 3, 7}


def test_reports_of_an_empty_table(spark):
    df = spark.createDataFrame([], "report_id long, body string, received_at timestamp_ntz")
    assert nested.records(df, values=True).collect() == []
