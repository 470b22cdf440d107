"""Batches of objects for review, their distribution, and the proof that each object was reviewed exactly once."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shalework.functions.text import short_hash, slug
from shalework.sources.exchange import ContractError

BATCH_SIZE, BATCH_LINES = 50, 6000


def absent_kinds(index: DataFrame, kinds: list[str]) -> list[str]:
    """Kinds the index does not have, in the order asked for; an error if it has none of them."""
    have = {r[0] for r in index.select("kind").distinct().where(F.col("kind").isin(*kinds)).collect()}
    if not have:
        raise ContractError(f"no kind in index: {', '.join(kinds)}")
    return [k for k in kinds if k not in have]


def group_name(kind: Column, file: Column, folder: Column) -> Column:
    """Folder of an object's batches: kind, file and folder, with hashes so that equal slugs stay apart."""
    tagged = lambda c: F.concat(slug(c), F.lit("--"), short_hash(c))
    group = F.when(F.coalesce(folder, F.lit("")) == "", F.lit("_root")).otherwise(tagged(folder))
    return F.concat_ws("/", kind, tagged(file), group)


def number_batches(items: DataFrame, base: str, order: list[str], lines: str, batch_size: int = BATCH_SIZE, batch_lines: int = BATCH_LINES) -> DataFrame:
    """``items`` with ``batch``: in the order given, a batch closes when it holds ``batch_size`` items or the next would pass
    ``batch_lines``; a larger item is a batch by itself. Each group is streamed: the state is two counters and its name."""
    names = items.columns
    at, size = names.index(base), names.index(lines)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, number, held, total = object(), 0, 0, 0
        for b in batches:
            out = np.empty(b.num_rows, np.int32)
            for i, (g, n) in enumerate(zip(b.column(at).to_pylist(), b.column(size).to_pylist())):
                n = n or 0
                if g != group:
                    group, number, held, total = g, 1, 0, 0
                if held and (held >= batch_size or total + n > batch_lines):
                    number, held, total = number + 1, 0, 0
                held += 1
                total += n
                out[i] = number
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*names, "batch"])

    return items.repartition(base).sortWithinPartitions(base, *order).mapInArrow(run, f"{kinds}, batch int")


def build_entries(index: DataFrame, kinds: list[str], batch_size: int = BATCH_SIZE, batch_lines: int = BATCH_LINES) -> DataFrame:
    """Catalog entries of the index rows (with ``ord``) of these kinds."""
    rows = index.where(F.col("kind").isin(*kinds)).withColumn("base", group_name(F.col("kind"), F.col("file"), F.col("folder")))
    rows = rows.withColumn("lines", F.coalesce(F.col("lines").try_cast("bigint"), F.lit(0)))
    done = number_batches(rows, "base", ["ord"], "lines", batch_size, batch_lines)
    name = F.concat(F.col("base"), F.lit("-"), F.when(F.col("batch") < 1000, F.lpad(F.col("batch").cast("string"), 3, "0")).otherwise(F.col("batch").cast("string")), F.lit(".csv"))
    return done.select("ord", F.col("path").alias("source_id"), F.col("sha256").alias("source_hash"), "file", "kind", "id", "name", "lines", name.alias("output_file"))


def listed_twice(entries: DataFrame) -> DataFrame:
    return entries.groupBy("source_id").agg(F.count("*").alias("n")).where("n > 1")


def check_unique(entries: DataFrame) -> None:
    n, first = listed_twice(entries).agg(F.count("*"), F.min("source_id")).first()
    if n:
        raise ContractError(f"index lists {n} path(s) more than once, e.g. {first}")


def same_entries(a: DataFrame, b: DataFrame) -> bool:
    """Equal as ordered lists: same rows in the same places."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("output_file").orderBy("ord"))
    flat = lambda d: d.withColumn("_at", place).select("_at", *[c for c in d.columns if c != "ord"])
    x, y = flat(a), flat(b)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def check_fresh(stored: DataFrame, rebuilt: DataFrame) -> None:
    if not same_entries(stored, rebuilt):
        raise ContractError("stale catalog: the index no longer matches it; take the snapshot again and classify what changed")


def coverage(entries: DataFrame, observed: DataFrame, output_files: DataFrame | None = None) -> DataFrame:
    """(bucket, source_id) of everything that breaks exact-once coverage: missing, extra, duplicates, wrong_hash, wrong_file.

    ``observed`` has (source_id, source_hash, output_file); ``output_files`` limits the check to one share. The last two buckets
    count rows and known ids only. One full join on the id after counting, so repeated rows of one id stay few."""
    if output_files is not None:
        mine = output_files.select("output_file").distinct()
        entries, observed = entries.join(mine, "output_file", "left_semi"), observed.join(mine, "output_file", "left_semi")
    o = observed.groupBy("source_id", "source_hash", "output_file").agg(F.count("*").alias("n"))
    e = entries.select(F.col("source_id").alias("_id"), F.col("source_hash").alias("_hash"), F.col("output_file").alias("_file"))
    both = o.join(e, F.col("source_id").eqNullSafe(F.col("_id")), "full")
    known, seen = F.col("_id").isNotNull(), F.col("n").isNotNull()
    rows = both.select(
        F.coalesce("source_id", "_id").alias("source_id"), F.coalesce("n", F.lit(0)).alias("n"), known.alias("known"),
        F.when(known & seen & ~F.col("source_hash").eqNullSafe(F.col("_hash")), F.col("n")).otherwise(0).alias("h"),
        F.when(known & seen & ~F.col("output_file").eqNullSafe(F.col("_file")), F.col("n")).otherwise(0).alias("f"),
    )
    per = rows.groupBy("source_id").agg(F.sum("n").alias("n"), F.max("known").alias("known"), F.sum("h").alias("h"), F.sum("f").alias("f"))
    buckets = F.array(
        F.when(F.col("known") & (F.col("n") == 0), F.struct(F.lit("missing").alias("bucket"), F.lit(1).cast("bigint").alias("times"))),
        F.when(~F.col("known") & (F.col("n") > 0), F.struct(F.lit("extra").alias("bucket"), F.lit(1).cast("bigint").alias("times"))),
        F.when(F.col("n") > 1, F.struct(F.lit("duplicates").alias("bucket"), F.lit(1).cast("bigint").alias("times"))),
        F.when(F.col("h") > 0, F.struct(F.lit("wrong_hash").alias("bucket"), F.col("h").alias("times"))),
        F.when(F.col("f") > 0, F.struct(F.lit("wrong_file").alias("bucket"), F.col("f").alias("times"))),
    )
    return per.select("source_id", F.explode(F.filter(buckets, lambda b: b.isNotNull())).alias("b")).select("b.bucket", "source_id", "b.times")


BUCKETS = ("missing", "extra", "duplicates", "wrong_hash", "wrong_file")


def check_coverage(entries: DataFrame, observed: DataFrame, output_files: DataFrame | None = None) -> int:
    """The number of objects proven to be covered exactly once; an error with the counts and a first sample otherwise."""
    if observed.isEmpty() and not entries.isEmpty():
        raise ContractError("there are no classification rows to hold against the catalog (no classification)")
    found = {r["bucket"]: r for r in coverage(entries, observed, output_files).groupBy("bucket").agg(F.sum("times").alias("n"), F.min("source_id").alias("first")).collect()}
    if found:
        counts = ", ".join(f"{b}={found[b]['n'] if b in found else 0}" for b in BUCKETS)
        raise ContractError(f"objects are not covered exactly once; rows by problem: {counts}; for example {next(found[b]['first'] for b in BUCKETS if b in found)}")
    return (entries if output_files is None else entries.join(output_files.select("output_file").distinct(), "output_file", "left_semi")).count()


def batches_of(entries: DataFrame, catalog: str) -> DataFrame:
    """(catalog, output_file, lines, objects, ord) of each batch."""
    return entries.groupBy("output_file").agg(F.sum("lines").alias("lines"), F.count("*").alias("objects"), F.min("ord").alias("ord")).select(F.lit(catalog).alias("catalog"), "*")


def spread(batches: DataFrame, agents: int) -> DataFrame:
    """``batches`` (catalog, output_file, lines, ord) with ``agent`` 1..n: in decreasing lines each goes to the agent with the
    least load, the first of several. The stream of batches is sorted by Spark; only the agents' loads are held."""
    if agents < 1:
        raise ContractError("at least one agent is needed")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batches.schema.fields)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = [(0, i) for i in range(agents)]
        for b in parts:
            out = []
            for n in b.column("lines").to_pylist():
                load, i = heapq.heappop(loads)
                heapq.heappush(loads, (load + (n or 0), i))
                out.append(i + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], [*b.schema.names, "agent"])

    return batches.repartition(1).sortWithinPartitions(F.desc("lines"), "catalog", "ord", "output_file").mapInArrow(run, f"{kinds}, agent int")


def assign(catalogs: dict[str, DataFrame], agents: int) -> DataFrame:
    """(agent, catalog, output_file, source_id, lines): whole batches of all catalogs for agents of near-equal load."""
    rows = parts = None
    for name, entries in catalogs.items():
        b, r = batches_of(entries, name), entries.select(F.lit(name).alias("catalog"), "output_file", "source_id", "lines", "ord")
        rows, parts = (r, b) if rows is None else (rows.unionByName(r), parts.unionByName(b))
    share = spread(parts, agents).select("catalog", "output_file", "agent")
    return rows.join(share, ["catalog", "output_file"]).select("agent", "catalog", "output_file", "source_id", "lines", "ord")


def share_of(assignment: DataFrame, kinds: list[str]) -> DataFrame:
    """The batches of one agent's share that belong to a catalog of these kinds."""
    return assignment.where(F.substring_index("output_file", "/", 1).isin(*kinds)).select("output_file").distinct()
