"""What the modelled application computes, as transformations of data frames.

Relationships become joins of aliased occurrences, found sets an algebra of predicates, summary fields aggregates over a break,
access rules filters and masks. Each function declares a plan; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The comparisons a join predicate can ask for.
OPERATORS = {
    "Equal": lambda a, b: a == b, "NotEqual": lambda a, b: a != b, "GreaterThan": lambda a, b: a > b, "GreaterThanOrEqualTo": lambda a, b: a >= b,
    "LessThan": lambda a, b: a < b, "LessThanOrEqualTo": lambda a, b: a <= b, "CartesianProduct": lambda a, b: F.lit(True),
}


def related(left: DataFrame, right: DataFrame, predicates: list[tuple[str, str, str]], how: str = "inner", names: tuple[str, str] = ("l", "r")) -> DataFrame:
    """Rows of two occurrences that fulfil all predicates (left field, operator, right field). Fields of the result are
    reached as ``l.field`` and ``r.field``. With an equality among them Spark joins by hash and tests the rest."""
    a, b = names
    cond = reduce(lambda x, y: x & y, (OPERATORS[op](F.col(f"{a}.{x}"), F.col(f"{b}.{y}")) for x, op, y in predicates))
    return left.alias(a).join(right.alias(b), cond, how)


def portal(parents: DataFrame, children: DataFrame, on: list[tuple[str, str]], sort: list[Column], where: Column | None = None, rows: int | None = None) -> DataFrame:
    """Related rows of each parent, filtered and sorted, with ``portal_row`` 1..n; ``rows`` limits it as a portal's size does."""
    kept = children if where is None else children.where(where)
    cond = reduce(lambda x, y: x & y, (F.col(f"p.{a}") == F.col(f"c.{b}") for a, b in on))
    joined = parents.alias("p").join(kept.alias("c"), cond)
    n = F.row_number().over(Window.partitionBy(*(F.col(f"p.{a}") for a, _ in on)).orderBy(*sort))
    out = joined.withColumn("portal_row", n)
    return out if rows is None else out.where(F.col("portal_row") <= rows)


def first_related(children: DataFrame, key: str, sort: list[str], value: str) -> DataFrame:
    """(key, value) of the first related row by the relationship's sort: an aggregate, not a window."""
    return children.groupBy(key).agg(F.min_by(value, F.struct(*sort)).alias(value))


@dataclass(frozen=True)
class FoundSet:
    """Rows found by requests. Each request is a set of criteria that must all hold; requests are alternatives; a request that
    omits takes its rows away from what the requests before it found."""

    table: DataFrame
    found: Column | None = None
    order: tuple[Column, ...] = field(default=())

    def find(self, *requests: list[Column]) -> FoundSet:
        return replace(self, found=reduce(lambda a, b: a | b, (_all(r) for r in requests)))

    def extend(self, *requests: list[Column]) -> FoundSet:
        more = reduce(lambda a, b: a | b, (_all(r) for r in requests))
        return replace(self, found=more if self.found is None else self.found | more)

    def constrain(self, *requests: list[Column]) -> FoundSet:
        only = reduce(lambda a, b: a | b, (_all(r) for r in requests))
        return replace(self, found=only if self.found is None else self.found & only)

    def omit(self, *criteria: Column) -> FoundSet:
        gone = ~_all(list(criteria))
        return replace(self, found=gone if self.found is None else self.found & gone)

    def show_omitted(self) -> FoundSet:
        return replace(self, found=F.lit(False) if self.found is None else ~F.coalesce(self.found, F.lit(False)))

    def show_all(self) -> FoundSet:
        return replace(self, found=None)

    def sort(self, *columns: Column) -> FoundSet:
        return replace(self, order=columns)

    def rows(self) -> DataFrame:
        out = self.table if self.found is None else self.table.where(self.found)
        return out.orderBy(*self.order) if self.order else out

    def replace_contents(self, column: str, value: Column) -> DataFrame:
        """The whole table with the column replaced in the found set."""
        hit = F.lit(True) if self.found is None else F.coalesce(self.found, F.lit(False))
        return self.table.withColumn(column, F.when(hit, value).otherwise(F.col(column)))


def _all(criteria: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in criteria), F.lit(True))


def summary_at_break(df: DataFrame, breaks: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """A summary field's value at each sort break; with no break over the whole found set."""
    return df.groupBy(*breaks).agg(*(c.alias(n) for n, c in aggregates.items()))


def running_summary(df: DataFrame, breaks: list[str], order: list[str], name: str, value: Column) -> DataFrame:
    w = Window.partitionBy(*breaks).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(w))


def lookup(df: DataFrame, source: DataFrame, on: list[tuple[str, str]], take: str, into: str, order: list[str]) -> DataFrame:
    """Copies a value from the first related row as it is now. A lookup is a snapshot: write the result, do not keep the join."""
    first = source.groupBy(*(b for _, b in on)).agg(F.min_by(take, F.struct(*order)).alias("_v"))
    first = first.withColumnsRenamed({b: f"_k{i}" for i, (_, b) in enumerate(on)})
    cond = reduce(lambda x, y: x & y, (df[a] == F.col(f"_k{i}") for i, (a, _) in enumerate(on)))
    return df.join(first, cond, "left").withColumn(into, F.col("_v")).drop("_v", *(f"_k{i}" for i in range(len(on))))


def value_list(df: DataFrame, stored: str, shown: str | None = None, related_to: tuple[DataFrame, str, str] | None = None) -> DataFrame:
    """Distinct (stored, shown) values; with ``related_to`` (parents, key, own key) only of rows related to them."""
    if related_to is not None:
        parents, key, own = related_to
        df = df.join(parents.select(F.col(key).alias("_k")).distinct(), F.col(own) == F.col("_k"), "left_semi")
    cols = [F.col(stored).alias("stored"), F.col(shown or stored).alias("shown")]
    return df.where(F.col(stored).isNotNull()).select(*cols).distinct()


def restrict(df: DataFrame, view: Column | None = None, hidden: list[str] = (), masked: dict[str, Column] | None = None) -> DataFrame:
    """Record-level access: rows the formula lets through, without hidden columns, others masked where their condition fails."""
    out = df if view is None else df.where(F.coalesce(view, F.lit(False)))
    for c, allowed in (masked or {}).items():
        out = out.withColumn(c, F.when(F.coalesce(allowed, F.lit(False)), F.col(c)))
    return out.drop(*hidden)


@dataclass(frozen=True)
class Rule:
    """A validation rule; ``kind`` is not_empty, range, member, type, length or formula."""

    column: str
    kind: str
    args: tuple = ()

    def broken(self) -> Column:
        c = F.col(self.column)
        text = c.cast("string")
        empty = c.isNull() | (F.trim(text) == "")
        match self.kind:
            case "not_empty":
                return empty
            case "range":
                return ~empty & ~c.between(*self.args)
            case "member":
                return ~empty & ~c.isin(*self.args)
            case "type":
                return ~empty & text.try_cast(self.args[0]).isNull()
            case "length":
                return ~empty & (F.length(text) > self.args[0])
            case "formula":
                return ~F.coalesce(self.args[0], F.lit(False))
        raise ValueError(self.kind)


def violations(df: DataFrame, rules: list[Rule], key: list[str]) -> DataFrame:
    """(key..., column, rule) of every broken rule: all rules in one pass."""
    hits = F.array_compact(F.array(*(F.when(r.broken(), F.struct(F.lit(r.column).alias("column"), F.lit(r.kind).alias("rule"))) for r in rules)))
    return df.select(*key, F.explode(hits).alias("x")).select(*key, "x.*")


def not_unique(df: DataFrame, column: str) -> DataFrame:
    """(column, n) of values that a uniqueness rule forbids."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def multikey(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, value): the join table of a field that lists several keys, one a line."""
    values = F.filter(F.transform(F.split(column, r"\r\n?|\n|¶"), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(key, F.explode(F.array_distinct(values)).alias("value"))


def globals_of(spark, values: dict[str, str]) -> None:
    """Global fields live as long as the session and belong to it: session variables, no shared table."""
    for name, value in values.items():
        spark.sql(f"DECLARE OR REPLACE VARIABLE `{name}` STRING DEFAULT :v", args={"v": value})


def spark_type(data_type: str, repetitions: int = 1, zoned: bool = False, number: str = "decimal(38,10)") -> str:
    """The Spark type of a field type; a repeating field is an array. Unknown types are an error."""
    kinds = {"Text": "string", "Number": number, "Date": "date", "Time": "interval day to second", "TimeStamp": "timestamp" if zoned else "timestamp_ntz", "Binary": "binary"}
    if data_type not in kinds:
        raise ValueError(f"unknown field type {data_type!r}")
    return f"array<{kinds[data_type]}>" if repetitions > 1 else kinds[data_type]
