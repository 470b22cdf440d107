"""Deeply nested reports into flat related tables, by columnar shredding.

A report is a tree whose *records* (tables, fields, layouts, objects, steps ...) repeat at every depth. Each chain of record
names is a repeated path, for example ``Layout/Object/Object``. :func:`columns` turns reports into a table with a row for each leaf
column of a report: repetition levels, definition levels and values. Leaves are a record's place in the document (``@pos``), its attributes
(``@id``), and texts and attributes of the elements in it that are no records (``Comment``, ``Storage@index``), which may be missing or repeat.
The repetition level says at which depth of the path a value starts a new instance, the definition level how deep the path is present;
where an ancestor has no such descendant the column holds a null entry that keeps the ancestor's place.

:func:`assembled` makes the records of that table from the columns alone: the number of an ancestor instance is the count of entries that
repeat at or above its depth and are defined to it, which links each record to its parent and each value to its record without ever looking at
the tree again. The place is a leaf because level sequences order values within a path but not between paths. Whoever needs no values reads no
other column.

Defined results. Characters that XML forbids are dropped, as are white space and byte order marks in front of the
declaration. A body that is null, empty or still not well-formed gives no rows (:func:`failures` lists it). A report that was
delivered more than once counts once, by the row received last (then the longer, then the greater body).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalework.operators import bloom
from shalework.session import cut
from shalework.sources.xml_text import TreeError, clean_xml, walk

#: Where an element of a name is a record. Parents given by name; None is any place.
RECORDS: dict[str, tuple[str, ...] | None] = {
    "BaseTable": ("BaseTableCatalog",),
    "Field": ("FieldCatalog", "BaseTable"),
    "Table": ("TableList",),
    "Relationship": ("RelationshipList",),
    "JoinPredicate": ("JoinPredicateList",),
    "Layout": ("LayoutCatalog",),
    "Script": ("ScriptCatalog",),
    "Object": None,
    "Step": None,
}

RESULT = "report_id long, entity string, rec_no int, parent_no int"
WIDE = RESULT + ", path string, leaves map<string,array<string>>"
COLUMNS = "report_id long, path string, leaf string, r array<int>, d array<int>, v array<string>"
POS = "@pos"
#: Rows of a table of results that are sent on at once.
EMIT = 50_000


@dataclass
class Leaf:
    """A column: levels and values of one leaf path, in document order."""

    r: list[int] = field(default_factory=list)
    d: list[int] = field(default_factory=list)
    v: list[object] = field(default_factory=list)

    def add(self, r: int, d: int, v: object) -> None:
        self.r.append(r)
        self.d.append(d)
        self.v.append(v)


@dataclass
class _Node:
    """A record while its report is read: place, values by leaf, child records by name."""

    pos: int
    inner: dict[str, list[str]]
    children: dict[str, list[_Node]] = field(default_factory=dict)


def _is_record(tag: str, attrs: dict[str, str], stack: list[tuple[str, object, bool]]) -> bool:
    parents = RECORDS.get(tag, ())
    if parents == ():
        return False
    if parents is None:
        return True
    above = stack[-1] if stack else ("", None, False)
    if tag in ("Layout", "Script"):
        i = len(stack) - 1
        while i >= 0 and stack[i][0] == "Group":
            i -= 1
        return i >= 0 and stack[i][0] == parents[0] and attrs.get("name") != "-"
    if tag == "Field":
        if above[0] == "BaseTable":
            return above[2]
        return above[0] == "FieldCatalog" and len(stack) > 1 and stack[-2][0] == "BaseTable" and stack[-2][2]
    return above[0] in parents


def _records(body: str, values: bool) -> _Node:
    """The tree of records below a root that is no record itself; with their values."""
    root = _Node(0, {})
    stack: list[tuple[str, _Node, bool]] = []  # (tag, nearest record at or above, is it this element)
    inside: list[tuple[str, list[str]]] = []  # of each element of the stack its path in the record and its text so far
    pos = 0
    for tag, data in walk(clean_xml(body), with_text=values):
        if tag is None:
            _, near, _ = stack.pop()
            if values:
                at, text = inside.pop()
                if (whole := "".join(text).strip()) != "":
                    near.inner.setdefault(at or "#text", []).append(whole)
            continue
        if tag == "":
            inside[-1][1].append(data)
            continue
        near = stack[-1][1] if stack else root
        if _is_record(tag, data, stack):
            pos += 1
            near.children.setdefault(tag, []).append(node := _Node(pos, {}))
            near, at = node, ""
            stack.append((tag, node, True))
        else:
            at = (f"{inside[-1][0]}/{tag}" if inside and inside[-1][0] else tag) if values else ""
            stack.append((tag, near, False))
        if values:
            inside.append((at, []))
            for k, v in data.items():
                near.inner.setdefault(f"{at}@{k}", []).append(v)
    return root


_Entries = list[tuple[int, int, "_Node | None"]]


def _leaves(entries: _Entries, depth: int) -> dict[str, Leaf]:
    """The columns of the values in the instances of a path; a value is one level deeper than its record."""
    out: dict[str, Leaf] = {n: Leaf() for n in dict.fromkeys(n for _, _, node in entries if node is not None for n in node.inner)}
    for name, leaf in out.items():
        for r, d, node in entries:
            values = node.inner.get(name, ()) if node is not None else ()
            if not values:
                leaf.add(r, d, None)
            for i, v in enumerate(values):
                leaf.add(r if i == 0 else depth + 1, depth + 1, v)
    return out


def shred(body: str, values: bool = False) -> dict[tuple[str, ...], dict[str, Leaf]]:
    """The columns of a report: by repeated path, then by leaf; without ``values`` the places only."""
    root = _records(body, values)
    out: dict[tuple[str, ...], dict[str, Leaf]] = {}
    # level by level: the instances of a path, each with the repetition level its first descendant starts at
    level: dict[tuple[str, ...], _Entries] = {(): [(0, 0, root)]}
    if values:
        out[()] = _leaves(level[()], 0)
    while level:
        deeper: dict[tuple[str, ...], _Entries] = {}
        for path, entries in level.items():
            depth = len(path)
            for name in dict.fromkeys(n for _, _, node in entries if node is not None for n in node.children):
                column: _Entries = []
                for r, d, node in entries:
                    kids = node.children.get(name, ()) if node is not None else ()
                    if not kids:
                        column.append((r, d, None))
                    for i, kid in enumerate(kids):
                        column.append((r if i == 0 else depth + 1, depth + 1, kid))
                deeper[(*path, name)] = column
                leaves = out[(*path, name)] = {POS: Leaf()}
                for r, d, node in column:
                    leaves[POS].add(r, d, node.pos if node is not None else None)
                if values:
                    leaves |= _leaves(column, depth + 1)
        level = deeper
    return out


def assemble(columns: dict[tuple[str, ...], dict[str, Leaf]]) -> list[tuple[str, int, int, tuple[str, ...], dict[str, list[str]]]]:
    """(entity, number, parent's number, path, values by leaf) of every record in document order, from the levels alone."""
    held: dict[tuple[str, ...], np.ndarray] = {}  # record number of each instance of a path
    rows: list[tuple[str, int, int, tuple[str, ...], dict[str, list[str]]]] = []
    for path in sorted(columns, key=len):
        leaf = columns[path].get(POS)
        if leaf is None:
            continue
        r, d = np.asarray(leaf.r), np.asarray(leaf.d)
        depth = len(path)
        present = d == depth
        number = held[path] = np.asarray([x for x in leaf.v if x is not None], np.int64)
        if depth == 1:
            parent = np.zeros(len(number), np.int64)
        else:  # an entry opens a new instance of the parent path if it repeats at or above it and reaches it
            opens = (r <= depth - 1) & (d >= depth - 1)
            parent = held[path[:-1]][np.cumsum(opens)[present] - 1]
        values: list[dict[str, list[str]]] = [{} for _ in number]
        for name, leaf in columns[path].items():
            if name == POS:
                continue
            r, d = np.asarray(leaf.r), np.asarray(leaf.d)
            of = np.cumsum((r <= depth) & (d >= depth)) - 1
            for i in np.flatnonzero(d == depth + 1).tolist():
                values[of[i]].setdefault(name, []).append(leaf.v[i])
        rows += [(path[-1], int(n), int(p), path, v) for n, p, v in zip(number, parent, values)]
    rows.sort(key=lambda x: x[1])
    return rows


def latest(reports: DataFrame) -> DataFrame:
    """One row per report. Only the ids are counted over all rows; the body of a report that was delivered once, which is to say of
    nearly every one, stays where it is. A Bloom filter names the others, and only those are shuffled and compared."""
    last = F.struct(F.coalesce("received_at", F.lit("0001-01-01").cast("timestamp_ntz")), F.coalesce(F.length("body"), F.lit(-1)), F.coalesce(F.xxhash64("body"), F.lit(0)))
    rows = reports.where(F.col("report_id").isNotNull()).select("report_id", "body", "received_at")
    repeated = cut(rows.groupBy("report_id").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("report_id").alias("h")))
    bits, words = bloom.build(repeated, repeated.count())
    maybe = bloom.might_contain(bits, words, F.xxhash64("report_id"))
    again = rows.where(maybe).groupBy("report_id").agg(F.max_by("body", last).alias("body"))
    return rows.where(~maybe).select("report_id", "body").unionByName(again)


def columns(reports: DataFrame, values: bool = True) -> DataFrame:
    """A row for each leaf column of each report: (report_id, path, leaf, r, d, v). Rows of one report lie side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = pa.list_(pa.int32())
        for b in batches:
            rows: list[tuple] = []
            size = 0

            def out() -> pa.RecordBatch:
                cols = list(zip(*rows)) if rows else [[]] * 6
                kinds = (pa.int64(), pa.string(), pa.string(), levels, levels, pa.list_(pa.string()))
                return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], ["report_id", "path", "leaf", "r", "d", "v"])

            for rid, body in zip(b.column(0).to_pylist(), b.column(1)):
                text = body.as_py()
                if not text:
                    continue
                try:
                    found = shred(text, values)
                except TreeError:
                    continue
                for path, leaves in found.items():
                    for name, x in leaves.items():
                        rows.append((rid, "/".join(path), name, x.r, x.d, list(map(str, x.v)) if name == POS and None not in x.v else [None if v is None else str(v) for v in x.v]))
                        size += len(x.v)
                if size > EMIT:
                    yield out()
                    rows, size = [], 0
            yield out()

    return latest(reports).mapInArrow(run, COLUMNS)


def _assembled(values: bool):
    """Streams the columns of reports, which lie side by side, and gives the rows of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, held = None, {}
        rows: list[tuple] = []

        def done() -> None:
            for e, n, p, path, v in assemble(held):
                rows.append((report, e, n, p, "/".join(path), list(v.items())) if values else (report, e, n, p))
            held.clear()

        def out() -> pa.RecordBatch:
            names = ["report_id", "entity", "rec_no", "parent_no", "path", "leaves"]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.list_(pa.string())))
            n = 6 if values else 4
            cols = list(zip(*rows)) if rows else [[]] * n
            rows.clear()
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds[:n])], names[:n])

        for b in batches:
            for rid, path, leaf, r, d, v in zip(*(b.column(i).to_pylist() for i in range(6))):
                if rid != report:
                    done()
                    report = rid
                    if len(rows) > EMIT:
                        yield out()
                held.setdefault(tuple(path.split("/")) if path else (), {})[leaf] = Leaf(r, d, [None if x is None else int(x) for x in v] if leaf == POS else v)
        done()
        yield out()

    return run


def assembled(table: DataFrame, values: bool = False, together: bool = False) -> DataFrame:
    """The records of a table of columns -> (report_id, entity, rec_no, parent_no) and with ``values`` (path, leaves). Columns that are not read from
    a report's own task (``together``) are brought together by report first."""
    rows = table if values else table.where(F.col("leaf") == POS)
    rows = rows if together else rows.repartition("report_id").sortWithinPartitions("report_id")
    return rows.select("report_id", "path", "leaf", "r", "d", "v").mapInArrow(_assembled(values), WIDE if values else RESULT)


def records(reports: DataFrame, values: bool = False) -> DataFrame:
    """Every record of every report with the number of its parent; with ``values`` also its path and the values of its leaves."""
    return assembled(columns(reports, values), values, together=True)


def entity_table(table: DataFrame, entity: str, leaves: dict[str, str], together: bool = False) -> DataFrame:
    """The table of one repeated ancestor: (report_id, rec_no, parent_no) and a column for each leaf of ``leaves`` (leaf -> name), its first value.
    Of the columns only places and these leaves are read."""
    last = F.element_at(F.split("path", "/"), -1) == entity
    needed = table.where((F.col("leaf") == POS) | (last & F.col("leaf").isin(*leaves)))
    rows = assembled(needed, True, together).where(F.col("entity") == entity)
    return rows.select("report_id", "rec_no", "parent_no", *(F.try_element_at("leaves", F.lit(x))[0].alias(name) for x, name in leaves.items()))


def failures(reports: DataFrame) -> DataFrame:
    """(report_id, reason) of the bodies that give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for rid, body in zip(b.column(0).to_pylist(), b.column(1)):
                text = body.as_py()
                if not text:
                    rows.append((rid, "null" if text is None else "empty"))
                    continue
                try:
                    for _ in walk(clean_xml(text)):
                        pass
                except TreeError as e:
                    rows.append((rid, re.sub(r": line.*", "", str(e))))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["report_id", "reason"])

    return latest(reports).mapInArrow(run, "report_id long, reason string")
