"""Frequency of every distinct code or term, in how many records, and marks for the too rare and the too common.

Each task counts into a burst trie: terms are routed through nodes by their next character to small hash containers; a
container that outgrows its limit bursts into a node with a container for each next character, so hot prefixes get deep
routes and cold ones stay shallow. Every leaf holds two counters, occurrences and records. A trie that reaches its memory
bound is handed on and a new one begun, so a task's memory does not grow with the data.

Matching subtrees of all tasks are then merged. Which prefix names a subtree follows from the tries: a prefix below which more than its share
of all leaves lies is a node, and its children are routed apart; the list of such nodes is bounded by the share. Leaves travel by (field,
prefix), once for each task however often the term occurs there, and the task that owns a subtree adds the leaves into one compact trie. So
a code that a third of all records hold is a few leaves, and no task holds more than one subtree at a time.

Defined results. Outer white space does not belong to a term; null and blank terms are none. A record that was delivered more
than once counts once, by the row received last (then by the greater content). A term occurs in a record once, however
often it is repeated there; its occurrences count every time. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shalework.functions.text import strip
from shalework.operators import bloom
from shalework.session import cut

#: Terms in a container before it bursts, and terms in a trie before it is handed on.
CONTAINER = 64
TRIE_TERMS = 200_000

#: Leaves below a prefix from which its children are routed apart: at least so many, and one of so many parts of all leaves.
SUBTREE, PARTS, LEVELS = 50_000, 1_000, 12

COUNTS = "field string, term string, occurrences long, records long"


class BurstTrie:
    """term -> [occurrences, records]."""

    __slots__ = ("limit", "root", "size")

    def __init__(self, limit: int = CONTAINER) -> None:
        self.limit = limit
        self.root: tuple[dict, dict] = ({}, {})  # a node: (child by character, container of what ends here or is unburst)
        self.size = 0

    def add(self, term: str, occurrences: int = 1, records: int = 1) -> None:
        node, at = self.root, 0
        while at < len(term) and (child := node[0].get(term[at])) is not None:
            node, at = child, at + 1
        held = node[1]
        rest = term[at:]
        counters = held.get(rest)
        if counters is None:
            held[rest] = [occurrences, records]
            self.size += 1
            if len(held) > self.limit:
                self._burst(node)
        else:
            counters[0] += occurrences
            counters[1] += records

    def _burst(self, node: tuple[dict, dict]) -> None:
        """Routes the container's terms by their next character; what ends here stays."""
        children, held = node
        for rest in [r for r in held if r]:
            child = children.setdefault(rest[0], ({}, {}))
            child[1][rest[1:]] = held.pop(rest)
        for child in children.values():
            if len(child[1]) > self.limit:
                self._burst(child)

    def leaves(self) -> Iterator[tuple[str, int, int]]:
        """Every term with its counters, subtree by subtree."""
        stack = [("", self.root)]
        while stack:
            prefix, (children, held) = stack.pop()
            for rest, (o, r) in held.items():
                yield prefix + rest, o, r
            stack += [(prefix + c, child) for c, child in children.items()]


def _count(limit: int, bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, BurstTrie] = {}
        bare: dict[str, list[int]] = {}  # rows without a term

        def out() -> pa.RecordBatch:
            rows = [(f, *leaf) for f, t in tries.items() for leaf in t.leaves()] + [(f, None, *n) for f, n in bare.items()]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            tries.clear()
            bare.clear()
            return pa.record_batch(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                ["field", "term", "occurrences", "records"],
            )

        for b in batches:
            counted = pa.Table.from_batches([b]).group_by(["field", "term"]).aggregate([("n", "sum"), ("n", "count")])
            for f, term, o, r in zip(*(counted[c].to_pylist() for c in ("field", "term", "n_sum", "n_count"))):
                if term is None:
                    n = bare.setdefault(f, [0, 0])
                    n[0], n[1] = n[0] + o, n[1] + r
                else:
                    tries.setdefault(f, BurstTrie(limit)).add(term, o, r)
            if sum(t.size for t in tries.values()) > bound:
                yield out()
        yield out()

    return run


def split_prefixes(leaves: DataFrame, subtree: int = SUBTREE, parts: int = PARTS) -> list[tuple[str, str]]:
    """The nodes (field, prefix) whose children are routed apart. On each of ``LEVELS`` levels no more than ``parts`` prefixes can have more
    than one of so many parts of all leaves, so the list is bounded."""
    most = max(subtree, leaves.count() // parts)
    levels = F.sequence(F.lit(0), F.least(F.length("term"), F.lit(LEVELS)))
    heads = leaves.select("field", F.explode(F.transform(levels, lambda d: F.substring("term", F.lit(1), d))).alias("prefix"))
    return [tuple(r) for r in heads.groupBy("field", "prefix").agg(F.count("*").alias("n")).where(F.col("n") > most).select("field", "prefix").collect()]


def _route(nodes: list[tuple[str, str]]):
    inner = frozenset(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            routes = []
            for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                d = 0
                while d < len(t) and (f, t[:d]) in inner:
                    d += 1
                routes.append(t[:d])
            yield pa.RecordBatch.from_arrays([pa.array(routes, pa.string()), *b.columns], ["route", *b.schema.names])

    return run


def _merge(limit: int):
    """Streams leaves sorted by subtree; each subtree is one trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, trie = None, BurstTrie(limit)

        def out() -> pa.RecordBatch:
            cols = list(zip(*trie.leaves())) or [[]] * 3
            field = [key[1] if key else ""] * trie.size
            return pa.record_batch([pa.array(field, pa.string()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["field", "term", "occurrences", "records"])

        for b in batches:
            for route, f, term, o, r in zip(*(c.to_pylist() for c in b.columns)):
                if (route, f) != key:
                    if trie.size:
                        yield out()
                    key, trie = (route, f), BurstTrie(limit)
                trie.add(term, o, r)
        yield out()

    return run


def merged(leaves: DataFrame, container: int = CONTAINER, subtree: int = SUBTREE) -> DataFrame:
    """The leaves of many tries as those of one."""
    routed = leaves.mapInArrow(_route(split_prefixes(leaves, subtree)), f"route string, {COUNTS}")
    return routed.repartition("route", "field").sortWithinPartitions("route", "field").mapInArrow(_merge(container), COUNTS)


def term_counts(terms: DataFrame, container: int = CONTAINER, trie_terms: int = TRIE_TERMS, subtree: int = SUBTREE) -> DataFrame:
    """``terms`` has a row (field, term, n) for each term of each record, n its occurrences there. Rows without a term are counted by field."""
    partial = cut(terms.select("field", "term", F.col("n").cast("long").alias("n")).mapInArrow(_count(container, trie_terms), COUNTS))
    fields = partial.where("term is null").groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return merged(partial.where("term is not null"), container, subtree).unionByName(fields)


def marked(counts: DataFrame, holders: DataFrame, rare: int = 5, common: float = 0.4) -> DataFrame:
    """Adds mark: ``rare`` below ``rare`` records, ``common`` above that share of the field's ``holders``, else null.

    ``holders`` (field, holders) has one row for each field, so it is as small as the list of fields.
    """
    both = counts.join(holders, "field")
    mark = F.when(F.col("records") < rare, "rare").when(F.col("records") > F.lit(common) * F.col("holders"), "common")
    return both.withColumn("mark", mark)


# --- layout objects ----------------------------------------------------------------------------------------------

#: Report attribute of each column of layout objects.
FIELDS = {"flags": "Object.flags", "display_type": "FieldObj.displayType", "button_flags": "ButtonObj.buttonFlags"}
LISTED = {"cond_ops": "Condition.op"}


def _terms_of(values: Column, field: str) -> Column:
    """(field, term, n) of each distinct code, and a row without a term if there is any."""
    codes = F.filter(F.transform(values, strip), lambda x: x.isNotNull() & (x != ""))
    times = lambda x: F.size(F.filter(codes, lambda y: y == x))
    row = lambda term, n: F.struct(F.lit(field).alias("field"), term.alias("term"), n.alias("n"))
    holder = F.when(F.size(codes) > 0, F.array(row(F.lit(None).cast("string"), F.lit(1)))).otherwise(F.array().cast("array<struct<field:string,term:string,n:int>>"))
    return F.concat(F.transform(F.array_distinct(codes), lambda x: row(x, times(x))), holder)


def _term_of(value: Column, field: str) -> Column:
    """As ``_terms_of`` for a column of one code."""
    code = F.nullif(strip(value), F.lit(""))
    rows = F.array(*(F.struct(F.lit(field).alias("field"), c.alias("term"), F.lit(1).alias("n")) for c in (code, F.lit(None).cast("string"))))
    return F.when(code.isNotNull(), rows).otherwise(F.array().cast("array<struct<field:string,term:string,n:int>>"))


def current_objects(objects: DataFrame) -> DataFrame:
    """Each object once, by the row received last; its codes as one array of (field, term, n).

    Only ids are counted over all rows; objects delivered once stay where they are, the others are named by a Bloom filter and compared."""
    cols = [*FIELDS, *LISTED]
    rows = objects.where(F.col("obj_id").isNotNull()).select("obj_id", "received_at", *cols)
    repeated = cut(rows.groupBy("obj_id").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("obj_id").alias("h")))
    bits, words = bloom.build(repeated, repeated.count())
    maybe = bloom.might_contain(bits, words, F.xxhash64("obj_id"))
    seen = F.struct(F.col("received_at").isNotNull(), "received_at", *(F.col(c) for c in cols))
    again = rows.where(maybe).groupBy("obj_id").agg(F.max(seen).alias("o")).select("obj_id", *(F.col(f"o.{c}").alias(c) for c in cols))
    one = rows.where(~maybe).select("obj_id", *cols).unionByName(again)
    parts = [_term_of(F.col(c), name) for c, name in FIELDS.items()] + [_terms_of(F.coalesce(F.col(c), F.array().cast("array<string>")), name) for c, name in LISTED.items()]
    return one.select("obj_id", F.concat(*parts).alias("terms"))


def code_frequencies(objects: DataFrame, rare: int = 5, common: float = 0.4) -> DataFrame:
    """(field, val, occurrences, objects, holders, mark) of every distinct code of layout objects."""
    counts = cut(term_counts(current_objects(objects).select(F.inline("terms"))))
    holders = counts.where("term is null").select("field", F.col("records").alias("holders"))
    return marked(counts.where("term is not null"), F.broadcast(holders), rare, common).select("field", F.col("term").alias("val"), "occurrences", F.col("records").alias("objects"), "holders", "mark")
