"""Command line: python -m shalework explode RAW OUT | specs RAW OUT | snapshot | verify | assign."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shalework.operators import census, contract, rendering, status
from shalework.session import local_session, written
from shalework.sources import exchange, reports, specs


def _nodes(spark: SparkSession, raw: str) -> DataFrame:
    docs = reports.discover(reports.raw_documents(spark, raw))
    for r in reports.ingest_errors(reports.raw_documents(spark, raw)).collect():
        print(f"warning: {r.doc}: {r.reason}", file=sys.stderr)
    for r in reports.dropped_characters(docs).collect():
        print(f"warning: {r.doc}: dropped {r.dropped} forbidden characters", file=sys.stderr)
    nodes = written(reports.shred(docs), "nodes")
    reports.check_sources(reports.files_of(nodes))
    return nodes


def explode(spark: SparkSession, a: argparse.Namespace) -> int:
    """Objects as text files, the index, what does not resolve, and a legend; 1 if anything was lost."""
    if Path(a.out).exists() and any(Path(a.out).iterdir()):
        raise exchange.ContractError(f"{a.out} is not empty")
    nodes = _nodes(spark, a.raw)
    objs, lost = written(rendering.objects(nodes), "objects"), status.unresolved(nodes)
    rendering.export(objs, a.out)
    exchange.write_index(objs, f"{a.out}/index")
    place = objs.select(F.col("doc").alias("_d"), F.col("pre").alias("_p"), "path")
    up = lost.join(nodes.select(F.col("doc").alias("_nd"), F.col("pre").alias("_np"), "anc"), (F.col("doc") == F.col("_nd")) & (F.col("pre") == F.col("_np")))
    rows = up.withColumn("_up", F.explode(F.array_append(F.transform("anc", lambda x: x["pre"]), F.col("pre")))).join(place, (F.col("doc") == F.col("_d")) & (F.col("_up") == F.col("_p")))
    exchange.write_unresolved(rows, f"{a.out}/unresolved")
    (Path(a.out) / "LEGEND.md").write_text(census.legend(nodes, lost), encoding="utf-8")
    bad = [f"{r.file}: {r.raw - r.shown} calculation(s) not shown" for r in census.calculation_coverage(nodes).where("shown < raw").collect()]
    reached = census.reached_classes(nodes, rendering.items(nodes))
    bad += [f"{r.file}: {r['class']} reached no object" for r in census.uncovered_classes(nodes, reached).collect()]
    bad += [f"odd line break in {r.path}" for r in rendering.odd_line_breaks(objs).collect()]
    for r in objs.groupBy("kind").count().orderBy("kind").collect():
        print(f"{r['kind']}: {r['count']}")
    for x in bad:
        print(f"error: {x}", file=sys.stderr)
    return int(bool(bad))


def write_specs(spark: SparkSession, a: argparse.Namespace) -> int:
    nodes = _nodes(spark, a.raw)
    print("\n".join(specs.write_specs(nodes, a.out or f"{a.raw}/specs")))
    diff = census.reconcile(nodes).collect()
    for r in diff:
        print(f"error: {r.file}: {r.what}: {r.raw} in the report, {r.emitted} emitted", file=sys.stderr)
    return int(bool(diff))


def snapshot(spark: SparkSession, a: argparse.Namespace) -> int:
    index = exchange.read_index(spark, a.index)
    for k in contract.absent_kinds(index, a.kind):
        print(f"note: no {k} objects")
    entries = contract.build_entries(index, sorted(set(a.kind)), a.batch_size, a.batch_lines)
    contract.check_unique(entries)
    print(exchange.write_catalog(entries, {"kinds": sorted(set(a.kind)), "batch_size": a.batch_size, "batch_lines": a.batch_lines}, a.output, a.force))
    return 0


def verify(spark: SparkSession, a: argparse.Namespace) -> int:
    head, stored = exchange.read_catalog(spark, a.catalog)
    m = head.first()
    contract.check_fresh(stored, contract.build_entries(exchange.read_index(spark, a.index), m["kinds"], m["batch_size"], m["batch_lines"]))
    share = contract.share_of(exchange.read_assignment(spark, a.assignment), m["kinds"]) if a.assignment else None
    print(f"{contract.check_coverage(stored, exchange.read_classifications(spark, a.csv_root), share)} objects exactly once")
    return 0


def assign(spark: SparkSession, a: argparse.Namespace) -> int:
    shares = contract.assign({c: exchange.read_catalog(spark, c)[1] for c in a.catalog}, a.agents)
    exchange.write_assignments(shares, a.output)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shalework", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(name: str, run, *args: tuple[str, dict]) -> None:
        c = sub.add_parser(name)
        for flag, options in args:
            c.add_argument(flag, **options)
        c.set_defaults(run=run)

    need = {"required": True}
    command("explode", explode, ("raw", {}), ("out", {}))
    command("specs", write_specs, ("raw", {}), ("out", {"nargs": "?"}))
    command("snapshot", snapshot, ("--index", need), ("--kind", need | {"nargs": "+"}), ("--output", need), ("--batch-size", {"type": int, "default": contract.BATCH_SIZE}), ("--batch-lines", {"type": int, "default": contract.BATCH_LINES}), ("--force", {"action": "store_true"}))
    command("verify", verify, ("--index", need), ("--catalog", need), ("--csv-root", need), ("--assignment", {}))
    command("assign", assign, ("--catalog", need | {"nargs": "+"}), ("--agents", need | {"type": int}), ("--output", need))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.getActiveSession() or local_session()
    try:
        return a.run(spark, a)
    except (exchange.ContractError, reports.DuplicateSource, AnalysisException, FileExistsError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
