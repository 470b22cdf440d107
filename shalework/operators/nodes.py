"""Navigation in the node table.

Every row carries its ancestors, so steps up the tree and subtree tests are column expressions and need no join; steps down
are equi-joins on (doc, parent) or aggregations by an ancestor. Nothing here compares intervals across documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def parent_tag(levels: int = 1) -> Column:
    """The tag of the ancestor so many levels up; null above the root."""
    return F.try_element_at("anc", F.lit(-levels))["tag"]


def parent_pre(levels: int = 1) -> Column:
    return F.try_element_at("anc", F.lit(-levels))["pre"]


def has_ancestor(*tags: str) -> Column:
    return F.exists("anc", lambda x: x["tag"].isin(*tags))


def nearest(*tags: str) -> Column:
    """``pre`` of the innermost ancestor with one of the tags."""
    return F.try_element_at(F.filter("anc", lambda x: x["tag"].isin(*tags)), F.lit(-1))["pre"]


def outermost(*tags: str) -> Column:
    return F.try_element_at(F.filter("anc", lambda x: x["tag"].isin(*tags)), F.lit(1))["pre"]


def path_is(*tags: str) -> Column:
    """Whether the element's nearest ancestors are these, outermost first."""
    up = list(reversed(tags))
    return reduce(lambda a, b: a & b, (F.coalesce(parent_tag(i + 1) == t, F.lit(False)) for i, t in enumerate(up)))


def within(catalog: str, through: tuple[str, ...] = ("Group",)) -> Column:
    """Whether the element lies in the catalog directly or through ``through`` elements only (its definition, not a mention)."""
    above = F.filter(F.transform("anc", lambda x, i: F.struct(x["tag"].alias("tag"), i.alias("i"))), lambda x: ~x["tag"].isin(*through))
    return F.coalesce(F.try_element_at(above, F.lit(-1))["tag"] == catalog, F.lit(False))


def children(nodes: DataFrame, of: DataFrame, tag: str | None = None) -> DataFrame:
    """The child elements of the rows of ``of`` (doc, pre), with the parent's number as ``of_pre``."""
    kids = nodes if tag is None else nodes.where(F.col("tag") == tag)
    above = of.select(F.col("doc").alias("_doc"), F.col("pre").alias("of_pre"))
    return kids.join(above, (F.col("doc") == F.col("_doc")) & (F.col("parent") == F.col("of_pre"))).drop("_doc")


def descendants(nodes: DataFrame, of: DataFrame, tag: str | None = None) -> DataFrame:
    """All elements below the rows of ``of``; each element once for each of them above it."""
    below = nodes if tag is None else nodes.where(F.col("tag") == tag)
    above = of.select(F.col("doc").alias("_doc"), F.col("pre").alias("of_pre"))
    one = below.withColumn("_up", F.explode(F.transform("anc", lambda x: x["pre"])))
    return one.join(above, (F.col("doc") == F.col("_doc")) & (F.col("_up") == F.col("of_pre"))).drop("_doc", "_up")


def subtree(nodes: DataFrame, doc: str, pre: int) -> DataFrame:
    """One element with everything below it."""
    top = (F.col("pre") == pre) | F.exists("anc", lambda x: x["pre"] == pre)
    return nodes.where((F.col("doc") == doc) & top)


def folder_of(nodes: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(doc, pre, folder): names of the groups round each element of ``tags``, outermost first."""
    items = nodes.where(F.col("tag").isin(*tags))
    groups = nodes.where(F.col("tag") == "Group").select(F.col("doc").alias("_doc"), F.col("pre").alias("_g"), F.coalesce(attr("name"), F.lit("")).alias("_name"))
    up = items.select("doc", "pre", F.explode_outer(F.filter("anc", lambda x: x["tag"] == "Group")).alias("g"))
    named = up.join(groups, (F.col("doc") == F.col("_doc")) & (F.col("g.pre") == F.col("_g")), "left")
    pairs = F.sort_array(F.collect_list(F.when(F.col("_g").isNotNull(), F.struct("_g", "_name"))))
    return named.groupBy("doc", "pre").agg(F.transform(pairs, lambda x: x["_name"]).alias("folder"))
