"""Incremental ingest equals a read at once; windows and orphans over a stream."""

import datetime as dt

from pyspark.sql import functions as F

from shalework.sources import reports as R
from shalework.streaming import ingest

XML = '<FMPReport type="Report"><File name="{0}"><ScriptCatalog><Script id="1" name="{0}"/></ScriptCatalog></File></FMPReport>'


def test_ingest_in_two_runs(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for names in (["a", "b"], ["c"]):
        for n in names:
            (tmp_path / "in" / f"{n}.xml").write_bytes(XML.format(n).encode("utf-16"))
        if "c" in names:
            (tmp_path / "in" / "bad.xml").write_bytes("<x".encode("utf-16"))
        assert ingest.ingest(ingest.report_stream(spark, src), out, state).awaitTermination(120)
    got = spark.read.parquet(f"{out}/nodes")
    whole = R.shred(R.raw_documents(spark, src))
    assert got.count() == whole.count() and {r.file for r in got.where("tag = 'Script'").collect()} == {"a", "b", "c"}
    assert spark.read.parquet(f"{out}/errors").count() == 1


def test_orphans_and_windows(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    refs = [("steps", 1, "Script", "a", "1", at(5)), ("steps", 1, "Script", "a", "1", at(5)), ("steps", 2, "Script", "a", "9", at(6)), ("steps", 3, "Script", "a", "0", at(6)), ("steps", 4, "Script", "a", "1", at(1))]
    spark.createDataFrame(refs, "tab string, row_id long, tag string, file string, ref string, at timestamp").write.parquet(str(tmp_path / "refs"))
    parents = spark.createDataFrame([("Script", "a", "1", at(3), None)], "tag string, file string, id string, loaded_at timestamp, deleted_at timestamp")
    stream = spark.readStream.schema("tab string, row_id long, tag string, file string, ref string, at timestamp").parquet(str(tmp_path / "refs"))
    q = ingest.orphan_stream(stream, parents).writeStream.outputMode("complete").format("memory").queryName("orphans").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("orphans").agg(F.sum("orphans")).first()[0] == 2
    q = ingest.windowed_counts(stream, "at", "2 days", None, "1 day", "tag").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 5
