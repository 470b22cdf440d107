"""Profiles of loaded data: counts, columns, checksums, keys, references, and what differs between two loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_counts(df: DataFrame, *scope: str) -> DataFrame:
    return df.groupBy(*scope).agg(F.count("*").alias("n"))


def profile_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, rows, nulls, distinct, least, greatest, longest) of each column.

    One scan: the columns become rows, so the exact distinct counts share one shuffle in which every value is sent once a task."""
    columns = columns or df.columns
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x")).select("x.*")
    each = long.groupBy("column", "v").agg(F.count("*").alias("n"))
    stats = each.groupBy("column").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("v").alias("distinct"), F.max(F.length("v")).alias("longest"))
    ends = df.agg(*(F.min(c).cast("string").alias(f"lo_{c}") for c in columns), *(F.max(c).cast("string").alias(f"hi_{c}") for c in columns))
    ends = ends.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"lo_{c}").alias("least"), F.col(f"hi_{c}").alias("greatest")) for c in columns))).alias("x")).select("x.*")
    return stats.join(F.broadcast(ends), "column").select("column", "rows", "nulls", "distinct", "least", "greatest", "longest")


def row_hash(columns: list[str]) -> Column:
    """A stable hash of a row: values are length-prefixed, so neither nulls nor separators can make two rows equal."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat(*(part(c) for c in columns)), 256)


def checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, checksum): independent of order; the sum of the first 15 hex digits of each row's hash."""
    h = F.conv(F.substring(row_hash(columns), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("checksum"))


def key_duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key is set and has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def binary_profile(df: DataFrame, column: str) -> DataFrame:
    """(n, bytes, digest) of a binary column; the digest does not depend on order."""
    h = F.conv(F.substring(F.sha2(F.col(column), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.where(F.col(column).isNotNull()).agg(F.count("*").alias("n"), F.sum(F.octet_length(column)).alias("bytes"), F.sum(h).cast("string").alias("digest"))


def edge_values(df: DataFrame, texts: list[str], numbers: list[str], times: list[str]) -> DataFrame:
    """(column, edge, n): values that often break in a transfer."""
    tests = [(c, "replacement character", F.contains(F.col(c), F.lit("�"))) for c in texts]
    tests += [(c, "control character", F.col(c).rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")) for c in texts]
    tests += [(c, "outer white space", F.col(c) != F.trim(F.col(c))) for c in texts]
    tests += [(c, "beyond ASCII", F.col(c).rlike(r"[^\x00-\x7f]")) for c in texts]
    tests += [(c, "not a number", F.isnan(c)) for c in numbers]
    tests += [(c, "more than two decimals", F.abs(F.col(c) * 100 - F.round(F.col(c) * 100)) > 1e-6) for c in numbers]
    tests += [(c, "midnight", (F.hour(c) + F.minute(c) + F.second(c)) == 0) for c in times]
    tests += [(c, "before 1970", F.year(c) < 1970) for c in times]
    one = df.agg(*(F.coalesce(F.sum(F.when(t, 1)), F.lit(0)).alias(f"t{i}") for i, (_, _, t) in enumerate(tests)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(e).alias("edge"), F.col(f"t{i}").cast("bigint").alias("n")) for i, (c, e, _) in enumerate(tests)))).alias("x")).select("x.*")


def totals_differ(a: DataFrame, b: DataFrame, scope: list[str], value: str) -> DataFrame:
    """(scope..., a, b) where the totals of two loads differ or one lacks the scope."""
    x, y = (d.groupBy(*scope).agg(F.sum(value).alias(n)) for d, n in ((a, "a"), (b, "b")))
    return x.join(y, scope, "full").where(~F.col("a").eqNullSafe(F.col("b")))


def changed_rows(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key..., reason): rejected (only in old), unexpected (only in new), or the columns that changed."""
    o = old.select(*key, F.struct(*columns).alias("o"))
    n = new.select(*key, F.struct(*columns).alias("n"))
    both = o.join(n, key, "full")
    diff = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in columns))), ",")
    reason = F.when(F.col("n").isNull(), "rejected").when(F.col("o").isNull(), "unexpected").otherwise(F.nullif(diff, F.lit("")))
    return both.select(*key, reason.alias("reason")).where("reason is not null")
