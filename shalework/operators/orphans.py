"""References to records that do not exist.

A Bloom filter over the keys of all parents goes to every task. A reference whose key is not in the filter has no parent at
any time: it is an orphan, and nothing more is asked about it. Only the references that pass the filter are joined, exactly and with the
time condition, to the parents; those that find no parent alive at their time are orphans too. The plan is the same at every size: the filter
has 16 bits for each key up to 16 million keys, beyond that it lets more references into the join and never decides a case by itself.

Defined results. A reference whose id is null, blank or ``0`` is none. One whose target file no parent table knows is out of
scope. One without a time is never covered by a parent, so it is an orphan with a null period. A record that is delivered
more than once counts once. A parent without ``loaded_at`` is never alive; ``deleted_at`` null means that it still lives.
Empty inputs give an empty result. Columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shalework.functions.text import blank, file_key, strip
from shalework.operators import bloom
from shalework.session import cut

#: Lives of parents up to this many (about 64 bytes each) are broadcast to the join of what passes the filter; more are shuffled by key.
BROADCAST_ROWS = 250_000
#: Files are known by name only; up to this many distinct ones are broadcast.
BROADCAST_FILES = 100_000


def step_references(steps: DataFrame) -> DataFrame:
    """Script calls in steps as references (tab, row_id, tag, file, ref, at)."""
    return steps.where(F.col("called_script").isNotNull()).select(
        F.lit("steps").alias("tab"), F.col("step_uid").alias("row_id"), F.lit("Script").alias("tag"),
        file_key(F.when(blank(F.col("called_file")), F.col("file")).otherwise(F.col("called_file"))).alias("file"),
        strip(F.col("called_script")).alias("ref"), F.col("scanned_at").alias("at"),
    )


def listed_references(unresolved: DataFrame) -> DataFrame:
    """Rows of the unresolved list whose kind of target has a table here."""
    return unresolved.where(F.col("tag").isin("Script", "ValueList", "FileReference") & F.col("ref").isNotNull()).select(
        F.lit("unresolved").alias("tab"), "row_id", "tag",
        file_key(F.when(blank(F.col("target_file")), F.col("file")).otherwise(F.col("target_file"))).alias("file"),
        strip(F.col("ref")).alias("ref"), F.col("seen_at").alias("at"),
    )


def parent(df: DataFrame, tag: str) -> DataFrame:
    """The lives of the records of one parent table (tag, file, id, loaded_at, deleted_at)."""
    return df.select(F.lit(tag).alias("tag"), file_key(F.col("file")).alias("file"), strip(F.col("id")).alias("id"), "loaded_at", "deleted_at")


def _key(last: str) -> Column:
    return F.xxhash64("tag", "file", last)


def filtered(refs: DataFrame, parents: DataFrame, files: DataFrame, max_words: int = bloom.MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """(references with ``maybe``: whether the filter lets them pass, the lives of all parents, each once)."""
    refs = refs.where(F.col("ref").isNotNull() & ~F.col("ref").isin("", "0"))
    known = files.select("file").where(F.col("file").isNotNull()).distinct()
    if known.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES:
        known = F.broadcast(known)
    lives = cut(parents.where(F.col("id").isNotNull() & F.col("file").isNotNull()).distinct())
    bits, n_words = bloom.build(lives.select(_key("id").alias("h")), lives.count(), max_words)
    return refs.join(known, "file", "left_semi").withColumn("maybe", bloom.might_contain(bits, n_words, _key("ref"))), lives


def find_orphans(refs: DataFrame, parents: DataFrame, files: DataFrame, period: str = "yyyy-MM", max_words: int = bloom.MAX_WORDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The references in ``refs`` without a living record in ``parents`` -> (tab, row_id, tag, period).

    ``files`` has the known target files in a column ``file``; it counts rows of parents of every kind.
    """
    refs, lives = filtered(refs, parents, files, max_words)
    small = lives.limit(broadcast_rows + 1).count() <= broadcast_rows
    r, p = refs.where("maybe").alias("r"), (F.broadcast(lives) if small else lives).alias("p")
    alive = (
        (F.col("r.tag") == F.col("p.tag")) & (F.col("r.file") == F.col("p.file")) & (F.col("r.ref") == F.col("p.id"))
        & (F.col("p.loaded_at") <= F.col("r.at")) & (F.col("p.deleted_at").isNull() | (F.col("p.deleted_at") > F.col("r.at")))
    )
    orphans = refs.where("not maybe").unionByName(r.join(p, alive, "left_anti"))
    return orphans.select("tab", "row_id", "tag", F.date_format("at", period).alias("period")).distinct()


def filter_report(refs: DataFrame, parents: DataFrame, files: DataFrame, max_words: int = bloom.MAX_WORDS) -> DataFrame:
    """What the filter does: (tab, tag, refs, definite, joined, false_positives), the last those that pass although no parent has their key."""
    refs, lives = filtered(refs, parents, files, max_words)
    keys = lives.select("tag", "file", F.col("id").alias("ref")).distinct().withColumn("known", F.lit(True))
    n = lambda c: F.count_if(c).alias
    both = refs.join(keys, ["tag", "file", "ref"], "left")
    return both.groupBy("tab", "tag").agg(F.count("*").alias("refs"), n(~F.col("maybe"))("definite"), n(F.col("maybe"))("joined"), n(F.col("maybe") & F.col("known").isNull())("false_positives"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts by table, kind of target and period."""
    return orphans.groupBy("tab", "tag", "period").agg(F.count("*").alias("orphans"))
