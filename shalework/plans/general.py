"""Queries on references, snapshots and nested reports, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shalework.functions.text import file_key
from shalework.operators import nested, orphans, snapshots
from shalework.plans import xml_sql
from shalework.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """References of steps and of the unresolved list without a living target -> tab, row_id, tag, period."""
    t = lambda n: table(spark, d, n)
    refs = orphans.step_references(t("steps")).unionByName(orphans.listed_references(t("unresolved")))
    sources = t("data_sources")
    parents = (
        orphans.parent(t("scripts"), "Script")
        .unionByName(orphans.parent(t("value_lists"), "ValueList"))
        .unionByName(orphans.parent(sources.where(F.col("source_kind") == "FileReference"), "FileReference"))
    )
    files = t("scripts").select("file").unionByName(t("value_lists").select("file")).unionByName(sources.select("file"))
    return orphans.find_orphans(refs, parents, files.select(file_key(F.col("file")).alias("file")))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans counted per table, kind of target and month."""
    return orphans.orphan_report(p1_found(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Paths added, removed or changed since their file's snapshot before -> snapshot_no, path, delta."""
    return snapshots.changes(table(spark, d, "object_index"))


def p2_summary(spark: SparkSession, d: str) -> DataFrame:
    return p2_found(spark, d).groupBy("snapshot_no", "delta").agg(F.count("*").alias("paths"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per record of a report with its parent's number -> report_id, entity, rec_no, parent_no."""
    return nested.records(table(spark, d, "reports"))


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    """As p6_found with the record's path and its id and name."""
    r = nested.records(table(spark, d, "reports"), values=True)
    return r.select("report_id", "entity", "rec_no", "parent_no", "path", F.col("leaves")["@id"][0].alias("id"), F.col("leaves")["@name"][0].alias("name"))


#: The tables of the repeated ancestors: entity, and the leaves that become columns.
TABLES = {
    "p6_tables": ("BaseTable", {"@id": "id", "@name": "name", "@records": "records"}),
    "p6_fields": ("Field", {"@id": "id", "@name": "name", "@dataType": "data_type", "@fieldType": "field_type", "Comment": "comment", "Calculation": "calculation", "Storage@index": "storage_index", "AutoEnter@lookup": "lookup", "AutoEnter/Lookup/Field@name": "lookup_field"}),
    "p6_occurrences": ("Table", {"@id": "id", "@name": "name", "@baseTable": "base_table", "BaseTable@name": "base_table_element", "FileReference@name": "external_file"}),
    "p6_relationships": ("Relationship", {"@id": "id", "LeftTable@name": "left_table", "LeftTable@cascadeDelete": "left_delete", "RightTable@name": "right_table", "RightTable@cascadeDelete": "right_delete"}),
    "p6_predicates": ("JoinPredicate", {"@type": "type", "LeftField/Field@table": "left_table", "LeftField/Field@name": "left_field", "RightField/Field@table": "right_table", "RightField/Field@name": "right_field"}),
    "p6_layouts": ("Layout", {"@id": "id", "@name": "name", "@includeInMenu": "in_menu", "Table@name": "table_name"}),
    "p6_objects": ("Object", {"@key": "key", "@type": "type", "@name": "name", "@flags": "flags", "FieldObj@displayType": "display_type", "FieldObj/DDRInfo/Field@table": "field_table", "FieldObj/DDRInfo/Field@name": "field_name", "ConditionalFormatting/Item/Condition/Calculation": "condition"}),
    "p6_scripts": ("Script", {"@id": "id", "@name": "name", "@includeInMenu": "in_menu", "@runFullAccess": "full_access"}),
    "p6_steps": ("Step", {"@id": "type_id", "@name": "name", "@enable": "enable", "StepText": "step_text", "Calculation": "calculation", "Script@id": "script_id", "Script@name": "script_name", "FileReference@name": "file_name"}),
}


def _table(entity: str, leaves: dict[str, str]):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return nested.entity_table(nested.columns(table(spark, d, "reports")), entity, leaves, together=True)

    query.__doc__ = f"The records of {entity} with the link to their parents and their values."
    return query


def p6_failures(spark: SparkSession, d: str) -> DataFrame:
    return nested.failures(table(spark, d, "reports"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_summary, p6_found, p6_records, p6_failures)}
QUERIES |= {name: _table(*x) for name, x in TABLES.items()}

_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = lambda c: rf"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
_FILE = lambda c: rf"regexp_replace(lower({_STRIP(c)}), '\.fmp12$', '')"
_OR_OWN = lambda c: f"CASE WHEN {c} IS NULL OR {_STRIP(c)} = '' THEN file ELSE {c} END"

_P1 = f"""
WITH refs AS (
  SELECT 'steps' AS tab, step_uid AS row_id, 'Script' AS tag, {_FILE(_OR_OWN('called_file'))} AS f, {_STRIP('called_script')} AS ref, scanned_at AS t FROM steps
  UNION SELECT 'unresolved', row_id, tag, {_FILE(_OR_OWN('target_file'))}, {_STRIP('ref')}, seen_at FROM unresolved
  WHERE tag IN ('Script', 'ValueList', 'FileReference')),
parents AS (
  SELECT 'Script' AS tag, {_FILE('file')} AS f, {_STRIP('id')} AS id, loaded_at, deleted_at FROM scripts
  UNION SELECT 'ValueList', {_FILE('file')}, {_STRIP('id')}, loaded_at, deleted_at FROM value_lists
  UNION SELECT 'FileReference', {_FILE('file')}, {_STRIP('id')}, loaded_at, deleted_at FROM data_sources WHERE source_kind = 'FileReference'),
known AS (SELECT {_FILE('file')} AS f FROM scripts UNION SELECT {_FILE('file')} FROM value_lists UNION SELECT {_FILE('file')} FROM data_sources)
SELECT DISTINCT tab, row_id, tag, strftime(t, '%Y-%m') AS period FROM refs r
WHERE ref IS NOT NULL AND ref NOT IN ('', '0') AND f IN (SELECT f FROM known)
AND NOT EXISTS (SELECT 1 FROM parents p WHERE p.tag = r.tag AND p.f = r.f AND p.id = r.ref AND p.loaded_at <= r.t AND (p.deleted_at IS NULL OR p.deleted_at > r.t))"""

_P2 = f"""
WITH rows AS (
  SELECT file, nfc_normalize(replace(path, '\\', '/')) AS path, snapshot_no AS s, lower({_STRIP('sha256')}) AS h, received_at FROM object_index),
cur AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY file, path, s ORDER BY received_at DESC NULLS LAST, h DESC NULLS LAST) = 1),
snaps AS (SELECT file, s, lag(s) OVER (PARTITION BY file ORDER BY s) AS prev FROM (SELECT DISTINCT file, s FROM cur)),
pairs AS (SELECT * FROM snaps WHERE prev IS NOT NULL),
later AS (SELECT p.file, p.s, c.path, c.h FROM pairs p JOIN cur c ON c.file = p.file AND c.s = p.s),
earlier AS (SELECT p.file, p.s, c.path, c.h FROM pairs p JOIN cur c ON c.file = p.file AND c.s = p.prev)
SELECT coalesce(l.s, e.s) AS snapshot_no, coalesce(l.path, e.path) AS path,
  CASE WHEN e.path IS NULL THEN 'added' WHEN l.path IS NULL THEN 'removed' ELSE 'changed' END AS delta
FROM later l FULL JOIN earlier e ON l.file = e.file AND l.s = e.s AND l.path = e.path
WHERE e.path IS NULL OR l.path IS NULL OR l.h IS DISTINCT FROM e.h"""

SQL = {
    "p1_found": _P1,
    "p1_report": f"SELECT tab, tag, period, count(*) AS orphans FROM ({_P1}) GROUP BY ALL",
    "p2_found": _P2,
    "p6_found": xml_sql.records("SELECT CAST(doc AS BIGINT) AS report_id, tag AS entity, rec_no, parent_no FROM rc"),
    "p6_records": xml_sql.records(f"""SELECT CAST(doc AS BIGINT) AS report_id, tag AS entity, rec_no, parent_no, coalesce((SELECT string_agg(p.tag, '/' ORDER BY p.pre) FROM rec p WHERE p.doc = rc.doc AND list_contains(rc.pres, p.pre)) || '/', '') || tag AS path, {xml_sql.attr("id")} AS id, {xml_sql.attr("name")} AS name FROM rc"""),
    **{name: xml_sql.entity_table(*x) for name, x in TABLES.items()},
    "p2_summary": f"SELECT snapshot_no, delta, count(*) AS paths FROM ({_P2}) GROUP BY ALL",
}
