"""Calculations of every element: text and references.

The text is the trimmed direct text of the element's ``Calculation``; where that is blank it is put together from the chunks of
``DisplayCalculation``, in which a field stands as an element and not as text, so that no operand is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalework.functions.text import one_line, strip
from shalework.operators.nodes import attr, parent_pre, parent_tag


def _blank(c):
    return F.coalesce(strip(c), F.lit("")) == ""


def chunk_parts(nodes: DataFrame) -> DataFrame:
    """(doc, owner, display, at, sub, part) in the order in which the parts are read."""
    table_field = F.when(F.coalesce(attr("table"), F.lit("")) != "", F.concat(attr("table"), F.lit("::"), F.coalesce(attr("name"), F.lit("None")))).otherwise(F.coalesce(attr("name"), F.lit("")))
    chunk = nodes.where((F.col("tag") == "Chunk") & (parent_tag() == "DisplayCalculation"))
    field = F.coalesce(attr("type"), F.lit("")) == "FieldRef"
    own = chunk.where(F.col("text").isNotNull() & (~_blank(F.col("text")) | ~field)).select(
        "doc", parent_pre(2).alias("owner"), parent_pre(1).alias("display"), F.col("pre").alias("at"), F.lit(0).alias("sub"), F.col("text").alias("part")
    )
    kinds = chunk.select(F.col("doc").alias("_d"), F.col("pre").alias("_c"), field.alias("_field"))
    kid = nodes.where((parent_tag() == "Chunk") & (parent_tag(2) == "DisplayCalculation"))
    kid = kid.join(kinds, (F.col("doc") == F.col("_d")) & (F.col("parent") == F.col("_c")))
    where = [F.col("doc"), parent_pre(3).alias("owner"), parent_pre(2).alias("display")]
    inner = kid.select(*where, F.col("pre").alias("at"), F.lit(0).alias("sub"), F.when(F.col("tag") == "Field", table_field).otherwise(F.col("text")).alias("part")).where("part is not null")
    tail = kid.where(F.col("tail").isNotNull() & (~_blank(F.col("tail")) | ~F.col("_field"))).select(*where, F.col("post").alias("at"), F.lit(1).alias("sub"), F.col("tail").alias("part"))
    return own.unionByName(inner).unionByName(tail)


def references(nodes: DataFrame) -> DataFrame:
    """(doc, owner, refs): ``TO::field#id``, ``cf:function``, ``fn:builtin``, ``kind:text``, in order, each once."""
    chunk = nodes.where((F.col("tag") == "Chunk") & (parent_tag() == "DisplayCalculation"))
    field = nodes.where((F.col("tag") == "Field") & (parent_tag() == "Chunk")).select(
        F.col("doc").alias("_d"), F.col("parent").alias("_c"), F.col("pos").alias("_pos"),
        F.concat(F.when(F.coalesce(attr("table"), F.lit("")) != "", F.concat(attr("table"), F.lit("::"))).otherwise(""), F.coalesce(attr("name"), F.lit("None")), F.lit("#"), F.coalesce(attr("id"), F.lit("None"))).alias("_ref"),
    )
    first = field.groupBy("_d", "_c").agg(F.min_by("_ref", "_pos").alias("_ref"))
    both = chunk.join(first, (F.col("doc") == F.col("_d")) & (F.col("pre") == F.col("_c")), "left")
    text, kind = F.coalesce(strip(F.col("text")), F.lit("")), attr("type")
    ref = (
        F.when(kind == "FieldRef", F.col("_ref"))
        .when(kind == "CustomFunctionRef", F.concat(F.lit("cf:"), text))
        .when(kind == "FunctionRef", F.when(text.rlike(r"^[A-Za-z_][\w.]*$"), F.concat(F.lit("fn:"), text)))
        .when(kind.isNotNull() & (kind != "NoRef"), F.concat(kind, F.lit(":"), one_line(text)))
    )
    rows = both.select("doc", parent_pre(2).alias("owner"), "pre", ref.alias("ref")).where("ref is not null")
    return rows.groupBy("doc", "owner").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pre", "ref"))), lambda x: x["ref"])).alias("refs"))


def calculations(nodes: DataFrame) -> DataFrame:
    """(doc, owner, calculation, refs) of every element with a calculation; owner is the element's ``pre``."""
    direct = nodes.where(F.col("tag") == "Calculation").groupBy("doc", F.col("parent").alias("owner")).agg(F.min_by(strip(F.col("text")), "pos").alias("direct"))
    parts = chunk_parts(nodes)
    shown = parts.groupBy("doc", "owner", "display").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "sub", "part"))), lambda x: x["part"]), "").alias("shown"))
    shown = shown.groupBy("doc", "owner").agg(F.min_by("shown", "display").alias("shown"))
    both = direct.join(shown, ["doc", "owner"], "full").join(references(nodes), ["doc", "owner"], "full")
    text = F.coalesce(F.when(F.col("direct") != "", F.col("direct")), F.nullif(strip(F.col("shown")), F.lit("")))
    return both.select("doc", "owner", text.alias("calculation"), F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))
