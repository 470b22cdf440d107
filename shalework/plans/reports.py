"""Queries over the design reports of the ``reports`` table: XML, so there is no SQL to hold them against (see the tests)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shalework.operators import census, graph, nested, rendering, resolution, status
from shalework.operators import entities as E
from shalework.operators.calculations import calculations
from shalework.session import table, written
from shalework.sources import reports as R


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Each report once, as (doc, text)."""
    return nested.latest(table(spark, d, "reports")).select(F.col("report_id").cast("string").alias("doc"), F.col("body").alias("text"))


def delivered(nodes: DataFrame, received: DataFrame | None = None) -> DataFrame:
    """The nodes of the file elements that were delivered last, one for each file name: the set in which references are resolved.

    ``received`` (doc, at) are the times of the documents; among equal ones the greater document counts, then the later element. What lies outside
    of files is left out, except for the roots of documents."""
    own = nodes.where((F.col("tag") == "File") & (F.col("depth") == 1)).select("doc", F.col("pre").alias("file_pre"), "file")
    if received is not None:
        own = own.join(received.select("doc", F.col("at").alias("_at")), "doc", "left")
    else:
        own = own.withColumn("_at", F.lit(None).cast("timestamp_ntz"))
    number = F.col("doc").try_cast("bigint")
    best = own.groupBy("file").agg(F.max(F.struct(F.col("_at").isNotNull(), "_at", number.alias("n"), "doc", "file_pre")).alias("b")).select(F.col("b.doc").alias("_doc"), F.col("b.file_pre").alias("_file"))
    at = F.when(F.col("depth") == 1, F.col("pre")).otherwise(F.try_element_at("anc", F.lit(2))["pre"])
    return nodes.join(best, (F.col("doc") == F.col("_doc")) & (at == F.col("_file")), "left").where("_file is not null or depth = 0").drop("_doc", "_file")


_written: dict[tuple, DataFrame] = {}


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """The node table of the delivered files. It is written once for a session and a state of the table's files: a query reads the columns and
    elements it needs from it as often as it likes."""
    reports = table(spark, d, "reports")
    files = reports.select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size").distinct().agg(F.sum(F.xxhash64("file_path", "file_modification_time", "file_size").cast("decimal(38,0)"))).first()[0]
    key = (spark.sparkContext.applicationId, d, files)
    if key not in _written:
        times = reports.groupBy(F.col("report_id").cast("string").alias("doc")).agg(F.max("received_at").alias("at"))
        _written[key] = written(delivered(written(R.shred(documents(spark, d)), "nodes"), times), "delivered")
    return _written[key]


def _flat(df: DataFrame) -> DataFrame:
    """Maps as JSON: a result must be comparable."""
    for f in df.schema.fields:
        if "map<" in f.dataType.simpleString():
            df = df.withColumn(f.name, F.to_json(f.name))
    return df


def _of(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _flat(f(nodes(spark, d)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "s2_ingest_errors": lambda spark, d: R.ingest_errors(documents(spark, d)),
    "s1_dropped_characters": lambda spark, d: R.dropped_characters(documents(spark, d)),
    "s3_nodes": lambda spark, d: _flat(R.shred(documents(spark, d))),
    "s4_files": _of(R.files_of), "s5_duplicate_sources": lambda spark, d: R.duplicate_sources(R.files_of(written(R.shred(documents(spark, d)), "nodes"))), "s9_id_catalog": _of(status.id_catalog),
    "x_tables": _of(E.tables), "x_fields": _of(E.fields), "x_occurrences": _of(E.occurrences), "x_predicates": _of(E.predicates), "x_relationships": _of(E.relationships), "x_layouts": _of(E.layouts),
    "x_layout_objects": _of(E.layout_objects), "x_layout_fields": _of(E.layout_fields), "x_portals": _of(E.portals), "x_buttons": _of(E.buttons), "x_conditional_formats": _of(E.conditional_formats),
    "x_hide_rules": _of(E.hide_rules), "x_scripts": _of(E.scripts), "x_script_steps": _of(E.script_steps), "x_calculations": _of(calculations), "x_value_lists": _of(E.value_lists), "x_accounts": _of(E.accounts),
    "x_privilege_sets": _of(E.privilege_sets), "x_record_grants": _of(E.record_grants), "x_custom_functions": _of(E.custom_functions), "x_data_sources": _of(E.data_sources),
    "x_reference_status": _of(status.reference_rows), "x_unresolved": _of(status.unresolved), "x_topology": _of(resolution.topology), "x_merged_occurrences": _of(resolution.merged_occurrences),
    "x_objects": lambda spark, d: rendering.objects(nodes(spark, d)).select("doc", "file", "kind", "id", "name", "folder", "path", "sha256", "lines"),
    "x_code_census": _of(census.code_census), "x_reconcile": _of(census.reconcile), "x_calculation_coverage": _of(census.calculation_coverage),
    "x_field_uses": _of(graph.field_uses), "x_script_callers": _of(graph.script_callers), "x_layout_openers": _of(graph.layout_openers), "x_occurrence_use": _of(graph.occurrence_use),
    "x_relationship_meaning": _of(graph.relationship_meaning), "x_table_census": _of(graph.table_census), "x_layout_census": _of(graph.layout_census), "x_format_effects": _of(graph.format_effects),
    "x_unreachable_steps": _of(graph.unreachable_steps), "x_read_write_sets": _of(graph.read_write_sets), "x_external_effects": _of(graph.external_effects),
}
