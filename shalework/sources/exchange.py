"""The exchange files of the review contract: object index, classification rows, catalog snapshots, shares."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shalework.functions.text import one_line
from shalework.session import written

INDEX = "file string, kind string, id string, name string, folder string, path string, sha256 string, lines string"
UNRESOLVED = "path string, tag string, id string, name string, status string"
ASSIGNMENT = ("catalog", "output_file", "source_id", "lines")
FORMAT_VERSION = 2


class ContractError(ValueError):
    """The files break the contract."""


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    first = spark.read.option("wholetext", "false").text(path).limit(1).collect()
    return first[0][0].lstrip("\ufeff").rstrip("\r").split(sep) if first else []


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """index.tsv: tab-separated, nothing is quoted; ``ord`` is the row's place. All columns are required."""
    names = [c.split(" ")[0] for c in INDEX.split(", ")]
    lacking = [c for c in names if c not in _header(spark, path, "\t")]
    if lacking:
        raise ContractError(f"{path} lacks required columns: {', '.join(lacking)}")
    df = spark.read.option("sep", "\t").option("header", "true").option("quote", "").option("inferSchema", "false").csv(path)
    return df.select(*names).withColumn("ord", F.monotonically_increasing_id())


def write_index(objects: DataFrame, path: str) -> None:
    """Sorted by file, kind and numeric id; line breaks as pilcrows, tabs as blanks."""
    flat = [F.translate(one_line(F.col(c).cast("string")), "\t", " ").alias(c) for c in (x.split(" ")[0] for x in INDEX.split(", "))]
    index_order(objects).select(*flat).coalesce(1).write.mode("errorifexists").option("sep", "\t").option("header", "true").option("quote", "").option("emptyValue", "").csv(path)


def write_unresolved(rows: DataFrame, path: str) -> None:
    """(path, tag, id, name, status) in the order of the documents; line breaks as pilcrows, tabs as blanks."""
    flat = [F.translate(one_line(F.col(c.split(" ")[0])), "\t", " ").alias(c.split(" ")[0]) for c in UNRESOLVED.split(", ")]
    rows.orderBy("doc", "pre", "tag").select(*flat).coalesce(1).write.mode("errorifexists").option("sep", "\t").option("header", "true").option("quote", "").option("emptyValue", "").csv(path)


def index_order(objects: DataFrame) -> DataFrame:
    """File, kind, then id as a number (0 for what is none); ties keep the order of ``emit_seq`` where there is one."""
    number = F.when(F.col("id").rlike(r"^[0-9]+$"), F.col("id").cast("decimal(38,0)")).otherwise(F.lit(0))
    tie = ["emit_seq"] if "emit_seq" in objects.columns else ["path"]
    return objects.orderBy("file", "kind", number, *tie)


def _csv_files(root: str) -> list[tuple[str, str]]:
    """(path, path below root) of every CSV below ``root``, sorted; works on any file system Arrow knows."""
    system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    scheme = root[: len(root) - len(base)] if "://" in root else ""
    return sorted((scheme + f.path, f.path[len(base.rstrip("/")) + 1 :]) for f in found if f.is_file and f.path.endswith(".csv"))


def read_classifications(spark: SparkSession, root: str) -> DataFrame:
    """Every row of every CSV below ``root`` -> (source_id, source_hash, output_file); quoted by RFC 4180.

    Batches of a file's root folder are named ``_root-...``, and Spark's own readers skip names that begin with an underscore; so
    the executors read the files themselves. Each file's header is checked, since a read over all would mix their columns."""
    files = _csv_files(root)
    if not files:
        return spark.createDataFrame([], "source_id string, source_hash string, output_file string")
    paths = spark.createDataFrame(files, "path string, output_file string").repartition(min(len(files), 4 * spark.sparkContext.defaultParallelism))

    def rows(path: str) -> Iterator[dict]:
        system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with system.open_input_stream(at) as raw, io.TextIOWrapper(raw, encoding="utf-8-sig", newline="") as text:
            reader = csv.DictReader(text)
            yield {"": set(reader.fieldnames or ())}
            yield from reader

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = [p for p in b.column(0).to_pylist() if not {"source_id", "source_hash"} <= next(rows(p))[""]]
            yield pa.record_batch([pa.array(bad, pa.string())], ["path"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = list(rows(path))[1:]
                yield pa.record_batch([pa.array([r[c] for r in got], pa.string()) for c in ("source_id", "source_hash")] + [pa.array([name] * len(got), pa.string())], ["source_id", "source_hash", "output_file"])

    bad = paths.mapInArrow(heads, "path string").orderBy("path").limit(1).collect()
    if bad:
        raise ContractError(f"{bad[0]['path']} lacks required columns: source_id, source_hash")
    return paths.mapInArrow(read, "source_id string, source_hash string, output_file string")


def write_catalog(catalog: DataFrame, meta: dict, path: str, force: bool = False) -> str:
    """A snapshot as Parquet with its settings. An equal one is left alone; a different one needs ``force``."""
    from shalework.operators.contract import same_entries

    spark = catalog.sparkSession
    head = spark.createDataFrame([(FORMAT_VERSION, meta["kinds"], meta["batch_size"], meta["batch_lines"])], "format_version int, kinds array<string>, batch_size int, batch_lines int")
    try:
        old_head, old = read_catalog(spark, path)
    except AnalysisException:  # nothing there yet
        old = None
    if old is not None and not force:
        if not head.exceptAll(old_head).isEmpty() or not same_entries(old, catalog):
            raise ContractError("another catalog is stored here and its entries have changed; use force to replace it, then review what differs")
        return "unchanged"
    if old is not None:
        catalog = written(catalog, "catalog")  # it may read what is overwritten
    head.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    catalog.write.mode("overwrite").parquet(f"{path}/entries")
    return "written"


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    head = spark.read.parquet(f"{path}/meta")
    if head.first()["format_version"] != FORMAT_VERSION:
        raise ContractError("unsupported catalog format; take the snapshot again")
    return head, spark.read.parquet(f"{path}/entries")


def catalog_json(catalog: DataFrame, meta: dict) -> DataFrame:
    """The snapshot as lines of JSON: the settings first, then an entry a line. Members that are null are left out."""
    spark = catalog.sparkSession
    head = spark.createDataFrame([(FORMAT_VERSION, meta["kinds"], meta["batch_size"], meta["batch_lines"])], "format_version int, kinds array<string>, batch_size int, batch_lines int")
    return head.select(F.to_json(F.struct("*")).alias("value")).unionByName(catalog.orderBy("ord").select(F.to_json(F.struct(*[c for c in catalog.columns if c != "ord"])).alias("value")))


def write_assignments(shares: DataFrame, path: str) -> None:
    """A folder of TSV files for each agent."""
    shares.select("agent", *ASSIGNMENT).write.mode("errorifexists").partitionBy("agent").option("sep", "\t").option("header", "true").option("lineSep", "\n").csv(path)


def read_assignment(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", "true").option("escape", '"').csv(path).select(*ASSIGNMENT)
