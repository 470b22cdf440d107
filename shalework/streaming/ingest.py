"""Reports and references as streams: ingest without re-reading, and orphans as they arrive.

The modelled system has no streams; these run the same operators incrementally. Every sink is idempotent by batch id, so a restarted
query neither loses nor repeats rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shalework.sources import reports as R

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def report_stream(spark: SparkSession, folder: str, encoding: str = "UTF-16", files_per_batch: int = 100) -> DataFrame:
    """New XML files of a folder as (doc, text)."""
    raw = spark.readStream.schema(BINARY).format("binaryFile").option("pathGlobFilter", "*.[xX][mM][lL]").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return raw.select(F.col("path").alias("doc"), R.decoded(F.col("content"), encoding).alias("text"))


def ingest(docs: DataFrame, out: str, state: str) -> StreamingQuery:
    """Appends the nodes of new documents to ``out``/nodes and the unreadable ones to ``out``/errors, a folder for each batch."""

    def batch(df: DataFrame, n: int) -> None:
        df = df.persist()
        try:
            R.shred(df).write.mode("overwrite").parquet(f"{out}/nodes/batch={n}")
            R.ingest_errors(df).write.mode("overwrite").parquet(f"{out}/errors/batch={n}")
        finally:
            df.unpersist()

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()


def orphan_stream(refs: DataFrame, parents: DataFrame, files: DataFrame | None = None, late: str = "30 days") -> DataFrame:
    """(period, tab, tag, orphans) by calendar month over a stream of references (tab, row_id, tag, file, ref, at), by the rules of
    :func:`shalework.operators.orphans.find_orphans`: no blank references, none to files that ``files`` does not know, and a reference without a
    time is an orphan with a null period.

    Each reference is joined to the parents as they are when its batch runs. Deliveries of one record within ``late`` count once, those without
    a time every time, since no watermark passes them. Counts are complete when the stream ends or its output mode says so."""
    live = parents.select(F.col("tag").alias("_t"), F.col("file").alias("_f"), F.col("id").alias("_i"), "loaded_at", "deleted_at")
    r = refs.where(F.col("ref").isNotNull() & ~F.col("ref").isin("", "0"))
    if files is not None:
        r = r.join(files.select("file").distinct(), "file", "left_semi")
    r = r.withWatermark("at", late).dropDuplicatesWithinWatermark(["tab", "row_id"])
    lives = live.groupBy("_t", "_f", "_i").agg(F.collect_list(F.struct("loaded_at", "deleted_at")).alias("lives"))
    joined = r.join(lives, (F.col("tag") == F.col("_t")) & (F.col("file") == F.col("_f")) & (F.col("ref") == F.col("_i")), "left")
    covered = F.exists(F.coalesce("lives", F.array().cast(lives.schema["lives"].dataType)), lambda x: (x["loaded_at"] <= F.col("at")) & (x["deleted_at"].isNull() | (x["deleted_at"] > F.col("at"))))
    return joined.where(~F.coalesce(covered, F.lit(False))).groupBy(F.date_format("at", "yyyy-MM").alias("period"), "tab", "tag").agg(F.count("*").alias("orphans"))


def windowed_counts(events: DataFrame, time: str, size: str, slide: str | None, late: str, *keys: str) -> DataFrame:
    """Rows per sliding or tumbling window and keys; later than ``late`` behind the newest are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, size, slide), *keys).agg(F.count("*").alias("n"))
