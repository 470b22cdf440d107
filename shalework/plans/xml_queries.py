"""Relations and questions over reports, each with its SQL: over the ``reports`` table as ``x_...``, over our own sample as ``sample_...``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shalework.functions.text import one_line
from shalework.operators import graph, resolution, status
from shalework.operators import entities as E
from shalework.operators import nodes as N
from shalework.operators.calculations import calculations
from shalework.plans import reports, sample, xml_sql
from shalework.plans.xml_sql import attr
from shalework.sources import reports as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def both(name: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """The query over the table and over the sample."""
    QUERIES[f"x_{name}"] = lambda spark, d: make(reports.nodes(spark, d))
    SQL[f"x_{name}"] = xml_sql.delivered(sql, more=_MORE)
    only_sample(name, make, sql)


def only_sample(name: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A query on catalogs that the table lacks: there it would give no rows and prove nothing."""
    QUERIES[f"sample_{name}"] = lambda spark, d: make(sample.nodes(spark))
    SQL[f"sample_{name}"] = xml_sql.delivered(sql, sample.SQL, _MORE)


# --- fragments of SQL ---------------------------------------------------------------------------------------------

_T = "chr(10) || chr(9) || ' '"
_A = lambda n, t="m.t": attr(n, t)
_TRIM = lambda x: f"trim({x}, {_T})"
_NE = lambda x: f"nullif({x}, '')"
_IN = lambda c: f"list_filter(m.path, lambda g: g <> 'Group')[-1] = '{c}'"
_HAS = lambda tag, x="m": f"list_contains({x}.path, '{tag}')"
_NEAR = lambda tag, x="m": f"{x}.pres[len({x}.path) - list_position(list_reverse({x}.path), '{tag}') + 1]"
_OUTER = lambda tag, x="m": f"{x}.pres[list_position({x}.path, '{tag}')]"


def _kid(value: str, tag: str, of: str = "m", where: str = "") -> str:
    """A value of the first child with a tag (``x`` in the value)."""
    return f"(SELECT arg_min({value}, x.pre) FROM m x WHERE x.doc = {of}.doc AND x.parent = {of}.pre AND x.tag = '{tag}'{where})"


def _at(value: str, steps: str, of: str = "m") -> str:
    """A value of the first element at a path below, ``A/B/C``."""
    *up, tag = steps.split("/")
    k = len(up) + 1
    path = f" AND x.path[-{len(up)}:] = [{', '.join(repr(u) for u in up)}]" if up else ""
    return f"(SELECT arg_min({value}, x.pre) FROM m x WHERE x.doc = {of}.doc AND x.pres[-{k}] = {of}.pre AND x.tag = '{tag}'{path})"


_TRUE = lambda x: f"CASE WHEN {x} = 'True' THEN true END"

#: Calculations by owner (``ca``: doc, owner, calculation), names of definitions, and definitions of fields.
_MORE = f""",
dc AS (SELECT m.doc, m.pres[-1] AS owner, min(m.pre) AS pre FROM m WHERE m.tag = 'DisplayCalculation' GROUP BY ALL),
ck AS (SELECT m.doc, m.pres[-2] AS owner, m.pres[-1] AS display, m.pre, {_A("type")} AS kind, m.text, {_kid("coalesce(nullif(" + _A("table", "x.t") + ", '') || '::', '') || coalesce(" + _A("name", "x.t") + ", '')", "Field")} AS field,
  {_kid("coalesce(nullif(" + _A("table", "x.t") + ", '') || '::', '') || coalesce(" + _A("name", "x.t") + ", 'None') || '#' || coalesce(" + _A("id", "x.t") + ", 'None')", "Field")} AS ref FROM m WHERE m.tag = 'Chunk' AND m.path[-1] = 'DisplayCalculation'),
cs AS (SELECT ck.doc, ck.owner, string_agg(CASE WHEN kind = 'FieldRef' AND {_TRIM("coalesce(ck.text, '')")} = '' THEN '' ELSE coalesce(ck.text, '') END || coalesce(field, ''), '' ORDER BY ck.pre) AS shown FROM ck JOIN dc ON dc.doc = ck.doc AND dc.pre = ck.display GROUP BY ALL),
cd AS (SELECT m.doc, m.pres[-1] AS owner, arg_min({_TRIM("coalesce(m.text, '')")}, m.pre) AS direct FROM m WHERE m.tag = 'Calculation' GROUP BY ALL),
rr AS (SELECT doc, owner, pre, CASE WHEN kind = 'FieldRef' THEN ref WHEN kind = 'CustomFunctionRef' THEN 'cf:' || {_TRIM("coalesce(text, '')")} WHEN kind = 'FunctionRef' THEN CASE WHEN regexp_matches({_TRIM("coalesce(text, '')")}, '^[A-Za-z_][A-Za-z0-9_.]*$') THEN 'fn:' || {_TRIM("text")} END WHEN kind <> 'NoRef' THEN kind || ':' || {_TRIM("coalesce(text, '')")} END AS ref FROM ck),
rf AS (SELECT doc, owner, string_agg(ref, ' | ' ORDER BY p) AS refs FROM (SELECT doc, owner, ref, min(pre) AS p FROM rr WHERE ref IS NOT NULL GROUP BY ALL) GROUP BY ALL),
ca AS (SELECT coalesce(cd.doc, cs.doc) AS doc, coalesce(cd.owner, cs.owner) AS owner, coalesce(nullif(direct, ''), nullif({_TRIM("shown")}, '')) AS calculation FROM cd FULL JOIN cs ON cs.doc = cd.doc AND cs.owner = cd.owner),
fd0 AS (SELECT m.*, CASE WHEN m.path[-1] = 'FieldCatalog' THEN m.pres[-2] ELSE m.pres[-1] END AS table_pre, m.path[-1] = 'FieldCatalog' AS listed FROM m WHERE m.tag = 'Field' AND (m.path[-3:] = ['BaseTableCatalog', 'BaseTable', 'FieldCatalog'] OR m.path[-2:] = ['BaseTableCatalog', 'BaseTable'])),
fd AS (SELECT * FROM fd0 QUALIFY listed OR NOT max(listed) OVER (PARTITION BY doc, table_pre)),
fx AS (SELECT fd.doc, fd.file, fd.pre, fd.table_pre, {attr("id", "b.t")} AS table_id, {attr("name", "b.t")} AS table_name, {attr("id", "fd.t")} AS id, {attr("name", "fd.t")} AS name, {attr("dataType", "fd.t")} AS data_type, {attr("fieldType", "fd.t")} AS field_type,
  {_NE(_kid(_TRIM("coalesce(x.text, '')"), "Comment", "fd"))} AS comment, {_NE(_kid(attr("value", "x.t"), "AutoEnter", "fd"))} AS auto_value, {_at(attr("nextValue", "x.t"), "AutoEnter/Serial", "fd")} AS serial_next, ca.calculation, ac.calculation AS auto_calculation,
  {_TRUE(_at(attr("value", "x.t"), "Validation/NotEmpty", "fd"))} AS not_empty, {_TRUE(_at(attr("value", "x.t"), "Validation/Unique", "fd"))} AS "unique", {_TRUE(_kid(attr("global", "x.t"), "Storage", "fd"))} AS "global",
  {_kid("CASE WHEN " + attr("index", "x.t") + " NOT IN ('', 'None') THEN " + attr("index", "x.t") + " END", "Storage", "fd")} AS "index", {_kid("CASE WHEN " + attr("maxRepetition", "x.t") + " NOT IN ('', '1') THEN CAST(" + attr("maxRepetition", "x.t") + " AS INT) END", "Storage", "fd")} AS repetitions
  FROM fd JOIN m b ON b.doc = fd.doc AND b.pre = fd.table_pre LEFT JOIN ca ON ca.doc = fd.doc AND ca.owner = fd.pre LEFT JOIN (SELECT doc, parent, min(pre) AS pre FROM m WHERE tag = 'AutoEnter' GROUP BY ALL) ae ON ae.doc = fd.doc AND ae.parent = fd.pre LEFT JOIN ca ac ON ac.doc = ae.doc AND ac.owner = ae.pre
  WHERE NOT (starts_with(coalesce({attr("name", "fd.t")}, ''), '===') AND ends_with(coalesce({attr("name", "fd.t")}, ''), '==='))),
fb AS (SELECT *, CASE WHEN "global" THEN 'globals' WHEN field_type = 'Summary' THEN 'summary' WHEN field_type = 'Calculated' THEN 'calculated' ELSE 'fields' END AS bucket FROM fx),
lo AS (SELECT m.*, coalesce({_A("name")}, '') AS name FROM m WHERE m.tag = 'Layout' AND {_IN("LayoutCatalog")}),
sr AS (SELECT m.*, coalesce({_A("name")}, '') AS name, {_A("id")} AS id FROM m WHERE m.tag = 'Script' AND {_IN("ScriptCatalog")}),
ob AS (SELECT m.*, {_NEAR("Layout")} AS layout_pre, coalesce({_A("name")}, '') AS name, coalesce({_A("type")}, '') AS type FROM m WHERE m.tag = 'Object' AND {_HAS("LayoutCatalog")}),
st AS (SELECT m.*, m.pres[-2] AS script_pre, CAST(row_number() OVER (PARTITION BY m.doc, m.pres[-2] ORDER BY m.pre) AS INT) AS step_line, coalesce({_A("name")}, '') AS name, coalesce({_A("enable")}, 'True') AS enable FROM m WHERE m.tag = 'Step' AND m.path[-2:] = ['Script', 'StepList'] AND {_HAS("ScriptCatalog")}),
toc AS (SELECT m.doc, m.file, m.pre, {_A("id")} AS id, {_A("name")} AS name, CASE WHEN {_A("baseTable")} IS NOT NULL THEN {_A("baseTable")} ELSE {_kid(attr("name", "x.t"), "BaseTable")} END AS base_table,
  CASE WHEN {_A("baseTable")} IS NOT NULL THEN {_A("baseTableId")} ELSE coalesce({_kid(attr("id", "x.t"), "BaseTable")}, {_A("baseTableId")}) END AS base_table_id, {_kid("coalesce(" + attr("name", "x.t") + ", '')", "FileReference")} AS external_file FROM m WHERE m.tag = 'Table' AND m.path[-2:] = ['RelationshipGraph', 'TableList']),
rl AS (SELECT m.doc, m.file, m.pre, {_A("id")} AS id, {_kid(attr("name", "x.t"), "LeftTable")} AS left_table, {_kid(attr("name", "x.t"), "RightTable")} AS right_table FROM m WHERE m.tag = 'Relationship' AND m.path[-2:] = ['RelationshipGraph', 'RelationshipList']),
jp AS (SELECT m.doc, m.file, m.pres[-2] AS rel_pre, CAST(row_number() OVER (PARTITION BY m.doc, m.pres[-2] ORDER BY m.pre) AS INT) AS ord, coalesce({_A("type")}, 'equal') AS operator, {_at(attr("name", "x.t"), "LeftField/Field")} AS left_field, {_at(attr("name", "x.t"), "RightField/Field")} AS right_field FROM m WHERE m.tag = 'JoinPredicate' AND m.path[-2:] = ['Relationship', 'JoinPredicateList'])"""


# --- sources and navigation (S, P1-P5) ----------------------------------------------------------------------------

QUERIES["s3_tree"] = lambda spark, d: R.shred(reports.documents(spark, d)).select("doc", "pre", "parent", "depth", "tag", F.array_join(F.transform("anc", lambda x: x["tag"]), "/").alias("path"))
SQL["s3_tree"] = xml_sql.query("SELECT doc, pre, parent, depth, tag, array_to_string(path, '/') AS path FROM n", texts=False)


def _unread(docs: DataFrame) -> DataFrame:
    reason = F.when(F.col("reason").isin("empty", "not a report"), F.col("reason")).otherwise("malformed")
    return R.ingest_errors(docs).select("doc", reason.alias("reason"))


_UNREAD = f"""SELECT src.doc, CASE WHEN coalesce(body, '') = '' THEN 'empty' WHEN r.t IS NULL THEN 'malformed' ELSE 'not a report' END AS reason FROM src LEFT JOIN n r ON r.doc = src.doc AND r.depth = 0
WHERE r.t IS NULL OR r.tag <> 'FMPReport' OR coalesce({attr("type", "r.t")}, '') <> 'Report'"""
QUERIES["s2_unread"] = lambda spark, d: _unread(reports.documents(spark, d))
QUERIES["sample_unread"] = lambda spark, d: _unread(sample.documents(spark))
SQL["s2_unread"], SQL["sample_unread"] = xml_sql.query(_UNREAD, texts=False), xml_sql.query(_UNREAD, sample.SQL, False)

_ODD = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]"
SQL["s1_dropped_characters"] = f"SELECT * FROM (SELECT doc, CAST(length(body) - length(regexp_replace(body, '{_ODD}', '', 'g')) AS INT) AS dropped FROM ({xml_sql.REPORTS})) WHERE dropped > 0"

both("files", lambda n: R.files_of(n).select("doc", "file", "pre", "host_path", "version"),
     f"SELECT fl.doc, fl.file, fl.pre, {attr('path', 'e.t')} AS host_path, {attr('version', 'r.t')} AS version FROM fl JOIN n e ON e.doc = fl.doc AND e.pre = fl.pre JOIN n r ON r.doc = fl.doc AND r.depth = 0")
QUERIES["s5_described_twice"] = lambda spark, d: R.duplicate_sources(R.files_of(R.shred(reports.documents(spark, d)))).select("file", F.array_join("docs", ",").alias("docs"))
SQL["s5_described_twice"] = xml_sql.query(f"SELECT file, string_agg(doc, ',' ORDER BY doc) AS docs FROM (SELECT file, doc, count(*) AS k FROM (SELECT coalesce({attr('name')}, '') AS file, doc FROM n WHERE depth = 1 AND tag = 'File') GROUP BY ALL) GROUP BY file HAVING sum(k) > 1", texts=False)
both("child_step", lambda n: N.children(n, n.where("tag = 'TableList'"), "Table").select("doc", "pre", "of_pre"), "SELECT m.doc, m.pre, m.parent AS of_pre FROM m WHERE m.tag = 'Table' AND m.path[-1] = 'TableList'")
both("descendant_step", lambda n: N.descendants(n, n.where("tag = 'Object'"), "Field").select("doc", "pre", "of_pre"), "SELECT doc, pre, of_pre FROM (SELECT m.doc, m.pre, unnest(m.path) AS g, unnest(m.pres) AS of_pre FROM m WHERE m.tag = 'Field') WHERE g = 'Object'")
both("ancestor_test", lambda n: n.where((F.col("tag") == "Field") & N.has_ancestor("PortalObj", "PrivilegeSet")).select("doc", "pre"), f"SELECT m.doc, m.pre FROM m WHERE m.tag = 'Field' AND ({_HAS('PortalObj')} OR {_HAS('PrivilegeSet')})")
both("group_paths", lambda n: N.folder_of(n, ("Layout", "Script")).select("doc", "pre", F.array_join("folder", "/").alias("folder")),
     f"SELECT m.doc, m.pre, coalesce((SELECT string_agg(coalesce({attr('name', 'x.t')}, ''), '/' ORDER BY x.pre) FROM m x WHERE x.doc = m.doc AND x.tag = 'Group' AND list_contains(m.pres, x.pre)), '') AS folder FROM m WHERE m.tag IN ('Layout', 'Script')")
_LISTED = " UNION ALL ".join(f"SELECT m.file, '{k}', {_A('id')}, true, false, false FROM m WHERE m.tag = '{t}' AND m.path[-1] = '{c}'" for k, t, c in (
    ("FileReference", "FileReference", "ExternalDataSourcesCatalog"), ("FileReference", "OdbcDataSource", "ExternalDataSourcesCatalog"), ("ValueList", "ValueList", "ValueListCatalog"), ("CustomMenu", "CustomMenu", "CustomMenuCatalog"),
    ("CustomMenuSet", "CustomMenuSet", "CustomMenuSetCatalog"), ("PrivilegeSet", "PrivilegeSet", "PrivilegesCatalog"), ("BaseTable", "BaseTable", "BaseTableCatalog")))
_SEP_S = f"{_TRIM('sr.name')} = '-' AND NOT EXISTS (SELECT 1 FROM m x WHERE x.doc = sr.doc AND x.tag = 'Step' AND x.path[-1] = 'StepList' AND x.pres[-2] = sr.pre)"
_SEP_L = "lo.name = '-' AND NOT EXISTS (SELECT 1 FROM ob WHERE ob.doc = lo.doc AND ob.layout_pre = lo.pre)"
_IDS = f"""WITH ids(file, kind, id, is_id, is_separator, is_folder) AS (SELECT sr.file, 'Script', sr.id, NOT ({_SEP_S}), {_SEP_S}, false FROM sr UNION ALL SELECT lo.file, 'Layout', {attr("id", "lo.t")}, NOT ({_SEP_L}), {_SEP_L}, false FROM lo
UNION ALL SELECT m.file, CASE WHEN {_HAS("ScriptCatalog")} THEN 'Script' ELSE 'Layout' END, {_A("id")}, false, false, true FROM m WHERE m.tag = 'Group' AND ({_IN("ScriptCatalog")} OR {_IN("LayoutCatalog")})
UNION ALL SELECT file, unnest(['Table', 'TableOccurrenceReference']), id, true, false, false FROM toc UNION ALL {_LISTED})
SELECT file, kind, id, bool_or(is_id) AS is_id, bool_or(is_separator) AS is_separator, bool_or(is_folder) AS is_folder FROM ids WHERE id IS NOT NULL GROUP BY ALL"""
both("id_catalog", status.id_catalog, _IDS)

# --- projections (P6-P28) -----------------------------------------------------------------------------------------

both("tables", E.tables, f"SELECT m.doc, m.file, m.pre, {_A('id')} AS id, {_A('name')} AS name, CAST(coalesce({_A('records')}, '0') AS BIGINT) AS records, {_A('comment')} AS comment FROM m WHERE m.tag = 'BaseTable' AND m.path[-1] = 'BaseTableCatalog'")
both("field_definitions", lambda n: E.field_definitions(n).select("doc", "pre", "table_pre"), "SELECT doc, pre, table_pre FROM fd")
both("field_values", lambda n: E.fields(n).select("doc", "file", "pre", "table_pre", "table_id", "table_name", "id", "name", "data_type", "field_type", "comment", F.col("auto_enter.value").alias("auto_value"), F.col("auto_enter.serial.next").alias("serial_next"), F.col("auto_enter.calculation").alias("auto_calculation"), "calculation", "not_empty", "unique", "global", "index", "repetitions", "bucket"),
     'SELECT doc, file, pre, table_pre, table_id, table_name, id, name, data_type, field_type, comment, auto_value, serial_next, auto_calculation, calculation, not_empty, "unique", "global", "index", repetitions, bucket FROM fb')
both("field_buckets", lambda n: E.fields(n).groupBy("file", "bucket").agg(F.count("*").alias("n")), "SELECT file, bucket, count(*) AS n FROM fb GROUP BY ALL")
both("occurrence_bases", lambda n: E.occurrences(n).select("doc", "file", "pre", "id", "name", "base_table", "base_table_id", F.col("external_file.name").alias("external_file")), "SELECT * FROM toc")
both("predicates", E.predicates, "SELECT * FROM jp")
_FLAG = lambda side, a: _kid(attr(a, "x.t"), f"{side}Table", "rl", f" AND ({attr('cascadeCreate', 'x.t')} IS NOT NULL OR {attr('cascadeDelete', 'x.t')} IS NOT NULL)")
_ANY = lambda side: f"(SELECT count(*) > 0 FROM m x WHERE x.doc = rl.doc AND x.parent = rl.pre AND x.tag = '{side}Table' AND ({attr('cascadeCreate', 'x.t')} IS NOT NULL OR {attr('cascadeDelete', 'x.t')} IS NOT NULL))"
_OPT = lambda side, new, old: _TRUE(f"(CASE WHEN {_ANY(side)} THEN {_FLAG(side, new)} ELSE {_kid(attr(old, 'x.t'), f'{side}Options', 'rl')} END)")
both("side_options", lambda n: E.relationships(n).select("doc", "file", "pre", "id", "left_table", "right_table", *(F.col(f"{s}_options.{o}").alias(f"{s}_{o}") for s in ("left", "right") for o in ("delete_related", "allow_create"))),
     "SELECT doc, file, pre, id, left_table, right_table, " + ", ".join(f"{_OPT(s, new, old)} AS {s.lower()}_{o}" for s in ("Left", "Right") for o, new, old in (("delete_related", "cascadeDelete", "deleteRelated"), ("allow_create", "cascadeCreate", "createRelated"))) + " FROM rl")
both("layout_rows", lambda n: E.layouts(n, dashes=True).select("doc", "file", "pre", "id", "name", "width", "in_menu", "table", "is_dash_named", "is_separator"),
     f"SELECT lo.doc, lo.file, lo.pre, {attr('id', 'lo.t')} AS id, lo.name, {attr('width', 'lo.t')} AS width, coalesce({attr('includeInMenu', 'lo.t')}, '') = 'True' AS in_menu, {_kid(attr('name', 'x.t'), 'Table', 'lo')} AS \"table\", lo.name = '-' AS is_dash_named, ({_SEP_L}) AS is_separator FROM lo")
both("layout_objects", E.layout_objects, f"SELECT ob.doc, ob.file, ob.pre, ob.layout_pre, {_NEAR('Object', 'ob')} AS parent_object, {attr('key', 'ob.t')} AS key, ob.name, ob.type, {attr('flags', 'ob.t')} AS flags FROM ob")
_FIELD = f"""SELECT doc, file, layout_pre, pre, f[1] AS "table", f[2] AS field FROM (SELECT ob.doc, ob.file, ob.layout_pre, ob.pre, coalesce({_at("[coalesce(" + attr("table", "x.t") + ", ''), coalesce(" + attr("name", "x.t") + ", '')]", "FieldObj/DDRInfo/Field", "ob")},
  {_at("CASE WHEN contains(x.text, '::') THEN [split_part(x.text, '::', 1), x.text[instr(x.text, '::') + 2:]] END", "FieldObj/Name", "ob")}) AS f FROM ob WHERE ob.type = 'Field') WHERE f IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc, layout_pre, f ORDER BY pre) = 1"""
both("layout_fields", E.layout_fields, _FIELD)
both("portal_fields", lambda n: E.portals(n).select("doc", "file", "layout_pre", "pre", "table", F.array_join(F.transform("fields", lambda x: F.concat(x["table"], F.lit("::"), x["field"])), ",").alias("fields")),
     f"""SELECT ob.doc, ob.file, ob.layout_pre, ob.pre, coalesce({_at(_TRIM("x.text"), "PortalObj/TableAliasKey", "ob")}, '') AS "table", coalesce((SELECT string_agg(coalesce({attr('table', 'x.t')}, '') || '::' || coalesce({attr('name', 'x.t')}, ''), ',' ORDER BY x.pre) FROM m x WHERE x.doc = ob.doc AND x.tag = 'Field' AND x.path[-3:] = ['Object', 'PortalObj', 'FieldList'] AND x.pres[-3] = ob.pre), '') AS fields
     FROM ob WHERE ob.type = 'Portal' AND EXISTS (SELECT 1 FROM m x WHERE x.doc = ob.doc AND x.parent = ob.pre AND x.tag = 'PortalObj')""")  # fmt: skip
_CONTAINERS = "['GroupButtonObj', 'ButtonObj', 'PopoverButtonObj', 'ButtonBarObj']"
_BTN = f"""WITH b0 AS (SELECT m.*, list_filter(range(1, len(m.path) + 1), lambda i: list_contains({_CONTAINERS}, m.path[i])) AS ix FROM m WHERE m.tag = 'Step' AND {_HAS("LayoutCatalog")} AND coalesce({_A("name")}, '') <> ''),
b1 AS (SELECT b0.doc, b0.file, b0.pre, {attr("name", "b0.t")} AS action, path[ix[1]] AS button_type, path[ix[-1]] AS inner_type, pres[list_filter(range(1, len(path) + 1), lambda i: path[i] = 'Object' AND pres[i] < pres[ix[1]])[-1]] AS holder, {_NEAR("Layout", "b0")} AS layout_pre,
  {_kid("coalesce(" + attr("name", "x.t") + ", '')", "Script", "b0")} AS script, {_NE(_kid(attr("id", "x.t"), "Script", "b0"))} AS script_id, {_kid("coalesce(" + attr("name", "x.t") + ", '')", "FileReference", "b0")} AS external_file, {_kid(_TRIM("coalesce(x.text, '')"), "StepText", "b0")} AS description FROM b0 WHERE len(ix) > 0)
SELECT b1.doc, b1.file, b1.layout_pre, b1.pre, action, button_type, inner_type, {_NE(attr("key", "o.t"))} AS object_key, nullif(o.name, '') AS object_name, script, script_id, external_file, description FROM b1 LEFT JOIN ob o ON o.doc = b1.doc AND o.pre = b1.holder
QUALIFY row_number() OVER (PARTITION BY b1.doc, b1.layout_pre, action, coalesce(script, ''), coalesce(script_id, ''), coalesce(external_file, '') ORDER BY b1.pre) = 1"""
both("buttons", E.buttons, _BTN)
_CF = f"""SELECT m.doc, m.file, lo.name AS layout, {attr("id", "lo.t")} AS layout_id, m.pre, o.name AS object_name, o.type AS object_type, coalesce({_A("op")}, '') AS condition_type, coalesce({attr("flags", "i.t")}, '') AS flags, ca.calculation AS formula,
coalesce((SELECT arg_min({_TRIM("coalesce(x.text, '')")}, x.pre) FROM m x WHERE x.doc = m.doc AND x.tag = 'LocalCSS' AND x.path[-3:] = ['Item', 'Format', 'Styles'] AND x.pres[-3] = m.pres[-1]), '') AS format_css
FROM m JOIN ca ON ca.doc = m.doc AND ca.owner = m.pre AND ca.calculation IS NOT NULL JOIN m i ON i.doc = m.doc AND i.pre = m.pres[-1] JOIN ob o ON o.doc = m.doc AND o.pre = m.pres[-3] JOIN lo ON lo.doc = m.doc AND lo.pre = {_NEAR("Layout")} AND lo.name <> '-'
WHERE m.tag = 'Condition' AND m.path[-3:] = ['Object', 'ConditionalFormatting', 'Item'] AND {_HAS("LayoutCatalog")}"""
both("conditional_formats", E.conditional_formats, _CF)
_EFFECT = f"""SELECT doc, pre, CASE WHEN TRY_CAST(flags AS INT) & 1 = 0 THEN 'disabled' WHEN coalesce(TRY_CAST(regexp_extract(format_css, 'font-size:\\s*([0-9.]+)pt', 1) AS DOUBLE), 0) >= 400 OR regexp_matches(format_css, 'rgba\\([^)]*,\\s*0(\\.0+)?\\s*\\)') THEN 'hide' WHEN format_css = '' THEN 'none' ELSE 'style' END AS effect FROM ({_CF})"""
both("format_effect", lambda n: graph.format_effects(n).select("doc", "pre", "effect"), _EFFECT)
only_sample("hide_rules", E.hide_rules, f"""SELECT m.doc, m.file, lo.name AS layout, {attr("id", "lo.t")} AS layout_id, m.pre, o.name AS object_name, o.type AS object_type, ca.calculation AS formula FROM m JOIN ca ON ca.doc = m.doc AND ca.owner = m.pre AND ca.calculation IS NOT NULL
JOIN ob o ON o.doc = m.doc AND o.pre = m.parent JOIN lo ON lo.doc = m.doc AND lo.pre = {_NEAR("Layout")} AND lo.name <> '-' WHERE m.tag = 'HideCondition' AND m.path[-1] = 'Object' AND {_HAS("LayoutCatalog")}""")  # fmt: skip
both("script_rows", lambda n: E.scripts(n, dashes=True).select("doc", "file", "pre", "id", "name", "in_menu", "run_full_access", "is_dash_named", "is_separator"),
     f"SELECT doc, file, pre, id, name, coalesce({attr('includeInMenu', 'sr.t')}, '') = 'True' AS in_menu, {attr('runFullAccess', 'sr.t')} = 'True' AS run_full_access, {_TRIM('name')} = '-' AS is_dash_named, ({_SEP_S}) AS is_separator FROM sr")
_STEP_VALUES = f"""{_NE(_kid(_TRIM("coalesce(x.text, '')"), "StepText", "st"))} AS step_text, {_kid("coalesce(" + attr("name", "x.t") + ", '')", "Script", "st")} AS script, {_NE(_kid(attr("id", "x.t"), "Script", "st"))} AS script_id, {_kid("coalesce(" + attr("name", "x.t") + ", '')", "FileReference", "st")} AS external_file, {_kid("coalesce(" + attr("name", "x.t") + ", '')", "Layout", "st")} AS layout"""
both("step_rows", lambda n: E.script_steps(n).select("doc", "file", "script_pre", F.col("of_script_id").alias("of_script"), "pre", "step_line", "type_id", "name", "enable", "step_text", *(F.col(f"params.{c}").alias(c) for c in ("script", "script_id", "external_file", "layout", "calculation"))),
     f"SELECT st.doc, st.file, st.script_pre, sr.id AS of_script, st.pre, step_line, {attr('id', 'st.t')} AS type_id, st.name, enable, {_STEP_VALUES}, ca.calculation FROM st JOIN sr ON sr.doc = st.doc AND sr.pre = st.script_pre LEFT JOIN ca ON ca.doc = st.doc AND ca.owner = st.pre")
both("calculation_texts", lambda n: calculations(n).select("doc", "owner", "calculation", F.nullif(F.array_join("refs", " | "), F.lit("")).alias("refs")),
     "SELECT coalesce(ca.doc, rf.doc) AS doc, coalesce(ca.owner, rf.owner) AS owner, calculation, refs FROM ca FULL JOIN rf ON rf.doc = ca.doc AND rf.owner = ca.owner")
_VL = f"""SELECT m.doc, m.file, m.pre, {_A("id")} AS id, {_A("name")} AS name, coalesce(nullif(lower({_kid(attr("value", "x.t"), "Source")}), ''), 'unknown') AS type,
CASE WHEN {_kid(attr("value", "x.t"), "Source")} = 'Custom' THEN array_to_string(list_filter(list_transform(string_split({_at("x.text", "CustomValues/Text")}, chr(10)), lambda v: {_TRIM("v")}), lambda v: v <> ''), '|') END AS "values",
CASE WHEN {_kid(attr("value", "x.t"), "Source")} = 'Field' THEN {_at(attr("name", "x.t"), "PrimaryField/Field")} END AS primary_field, CASE WHEN {_kid(attr("value", "x.t"), "Source")} = 'Field' AND {_kid(attr("value", "x.t"), "ShowRelated")} = 'True' THEN {_at(attr("name", "x.t"), "ShowRelated/Table")} END AS show_related_from,
(SELECT arg_min(coalesce({attr("name", "x.t")}, ''), x.pre) FROM m x WHERE x.doc = m.doc AND x.tag = 'FileReference' AND list_contains(x.pres, m.pre)) AS external_file, {_TRUE(f"CASE WHEN coalesce({_kid(attr('value', 'x.t'), 'Source')}, '') NOT IN ('Custom', 'Field', 'External') THEN 'True' END")} AS unparsed
FROM m WHERE m.tag = 'ValueList' AND m.path[-1] = 'ValueListCatalog'"""
only_sample("value_list_rows", lambda n: E.value_lists(n).select("doc", "file", "pre", "id", "name", "type", F.array_join("values", "|").alias("values"), "primary_field", "show_related_from", "external_file", "unparsed"), _VL)
only_sample("accounts", E.accounts, f"SELECT m.doc, m.file, m.pre, {_A('id')} AS id, {_A('name')} AS name, {_A('status')} AS status, {_A('privilegeSet')} AS privilege_set, {_A('emptyPassword')} AS empty_password FROM m WHERE m.tag = 'Account' AND m.path[-1] = 'AccountCatalog'")
only_sample("set_flags", lambda n: E.privilege_sets(n).select("doc", "file", "pre", "id", "name", F.col("flags")["menu"].alias("menu"), F.col("flags")["printing"].alias("printing"), "records", F.col("layouts.value").alias("layouts"), F.col("layouts.allow_creation").alias("may_create")),
     f"SELECT m.doc, m.file, m.pre, {_A('id')} AS id, {_A('name')} AS name, {_A('menu')} AS menu, {_A('printing')} AS printing, {_kid('coalesce(' + attr('value', 'x.t') + ', ' + repr('') + ')', 'Records')} AS records, {_kid('coalesce(' + attr('value', 'x.t') + ', ' + repr('') + ')', 'Layouts')} AS layouts, {_kid('coalesce(' + attr('allowCreation', 'x.t') + ', ' + repr('') + ')', 'Layouts')} AS may_create FROM m WHERE m.tag = 'PrivilegeSet' AND m.path[-1] = 'PrivilegesCatalog'")
_V = "coalesce(" + attr("value", "x.t") + ", '')"
_GRANTS = f"""SELECT m.doc, m.file, m.pres[-3] AS set_pre, m.pre, coalesce({_A("name")}, '') AS "table", {", ".join(f"coalesce({_kid(_V, t)}, '') AS {c}" for t, c in (("Create", '"create"'), ("View", '"view"'), ("Edit", "edit"), ("Delete", '"delete"'), ("FieldAccess", "field_access")))},
(SELECT ca.calculation FROM ca JOIN m x ON x.doc = ca.doc AND x.pre = ca.owner WHERE x.doc = m.doc AND x.parent = m.pre AND x.tag = 'View') AS view_calculation FROM m WHERE m.tag = 'BaseTable' AND m.path[-3:] = ['PrivilegeSet', 'Records', 'TableList']"""
only_sample("grants", lambda n: E.record_grants(n).select("doc", "file", "set_pre", "pre", "table", "create", "view", "edit", "delete", "field_access", "view_calculation"), _GRANTS)
only_sample("field_grants", lambda n: E.field_grants(n).select("doc", "set_pre", "grant_pre", "pre", "field", "restriction"), f"SELECT m.doc, {_NEAR('PrivilegeSet')} AS set_pre, {_NEAR('BaseTable')} AS grant_pre, m.pre, coalesce({_A('name')}, '') AS field, coalesce({_A('accessRestriction')}, '') AS restriction FROM m WHERE m.tag = 'Field' AND m.path[-4:] = ['TableList', 'BaseTable', 'FieldAccess', 'FieldList'] AND {_HAS('PrivilegeSet')}")
only_sample("layout_grants", lambda n: E.layout_grants(n).select("doc", "set_pre", "pre", "id", "layout", "access", "data_access"), f"SELECT m.doc, {_NEAR('PrivilegeSet')} AS set_pre, m.pre, coalesce({_A('id')}, '') AS id, coalesce({_A('name')}, '') AS layout, coalesce({_kid(_V, 'LayoutAccess')}, '') AS access, coalesce({_kid(_V, 'DataAccess')}, '') AS data_access FROM m WHERE m.tag = 'Layout' AND m.path[-3:] = ['PrivilegeSet', 'Layouts', 'LayoutList']")
only_sample("functions", lambda n: E.custom_functions(n).select("doc", "file", "pre", "id", "name", "parameters", "visible", "calculation", F.nullif(F.array_join("refs", " | "), F.lit("")).alias("refs")),
     f"SELECT m.doc, m.file, m.pre, {_A('id')} AS id, {_A('name')} AS name, coalesce({_A('parameters')}, '') AS parameters, coalesce({_A('visible')}, 'True') AS visible, ca.calculation, refs FROM m LEFT JOIN ca ON ca.doc = m.doc AND ca.owner = m.pre LEFT JOIN rf ON rf.doc = m.doc AND rf.owner = m.pre WHERE m.tag = 'CustomFunction' AND m.path[-1] = 'CustomFunctionCatalog'")
only_sample("sources", lambda n: E.data_sources(n).select("doc", "file", "pre", "type", "id", "name", "link", F.array_join("paths", "|").alias("paths"), "dsn"),
     f"SELECT m.doc, m.file, m.pre, CASE WHEN m.tag = 'FileReference' THEN 'filemaker' ELSE 'odbc' END AS type, coalesce({_A('id')}, '') AS id, coalesce({_A('name')}, '') AS name, CASE WHEN m.tag = 'FileReference' THEN {_A('link')} END AS link, CASE WHEN m.tag = 'FileReference' THEN regexp_replace({_A('pathList')}, '\\s+([A-Za-z][A-Za-z0-9]*:)', '|\\1', 'g') END AS paths, CASE WHEN m.tag <> 'FileReference' THEN coalesce({_A('DSN')}, '') END AS dsn FROM m WHERE m.tag IN ('FileReference', 'OdbcDataSource') AND m.path[-1] = 'ExternalDataSourcesCatalog'")

# --- questions (Q) ------------------------------------------------------------------------------------------------

both("table_counts", graph.table_census, """SELECT file, table_id, table_name AS "table", count(*) AS fields, count(*) FILTER (WHERE field_type = 'Normal' AND "global" IS NULL) AS regular, count(*) FILTER (WHERE field_type = 'Calculated') AS calculated, count(*) FILTER (WHERE field_type = 'Summary') AS summary, count("global") AS "global",
count(*) FILTER (WHERE data_type = 'Binary') AS container, count(*) FILTER (WHERE repetitions > 1) AS repeating, count(*) FILTER (WHERE calculation IS NOT NULL OR auto_value IS NOT NULL OR serial_next IS NOT NULL OR auto_calculation IS NOT NULL OR not_empty IS NOT NULL OR "unique" IS NOT NULL OR field_type = 'Summary') AS logic FROM fb GROUP BY ALL""")
both("layout_counts", graph.layout_census, f"""SELECT lo.file, {attr("id", "lo.t")} AS layout_id, CASE m.tag WHEN 'HideCondition' THEN 'hide_rules' WHEN 'Item' THEN 'conditional_formats' WHEN 'Trigger' THEN 'triggers' WHEN 'ToolTip' THEN 'tooltips' WHEN 'PortalObj' THEN 'portals' ELSE 'buttons' END AS what, count(*) AS n FROM m JOIN lo ON lo.doc = m.doc AND lo.pre = {_NEAR("Layout")} AND lo.name <> '-'
WHERE m.tag IN ('HideCondition', 'Item', 'Trigger', 'ToolTip', 'PortalObj', 'GroupButtonObj', 'ButtonObj', 'PopoverButtonObj', 'ButtonBarObj') AND (m.tag <> 'Item' OR m.path[-1] = 'ConditionalFormatting') GROUP BY ALL""")
only_sample("key_evidence", graph.key_evidence, """SELECT DISTINCT file, table_name AS "table", name AS field, unnest(list_filter([CASE WHEN serial_next IS NOT NULL THEN 'serial' END, CASE WHEN regexp_matches(lower(regexp_replace(coalesce(auto_calculation, ''), '\\s', '', 'g')), 'get\\(uuid(number)?\\)') THEN 'uuid' END, CASE WHEN "unique" THEN 'unique' END], lambda e: e IS NOT NULL)) AS evidence FROM fb WHERE "global" IS NULL""")
_SIDES = "SELECT file, id, pre, unnest(list_filter([left_table, right_table], lambda v: v IS NOT NULL)) AS name FROM rl"
both("occurrence_relationships", lambda n: graph.occurrence_relationships(n).select("file", "name", F.array_join("relationships", ",").alias("relationships")), f"SELECT file, name, string_agg(id, ',' ORDER BY pre, id) AS relationships FROM ({_SIDES}) GROUP BY ALL")
only_sample("recursive", graph.recursive_functions, f"""WITH RECURSIVE fu AS (SELECT m.doc, m.file, m.pre, {_A("name")} AS name FROM m WHERE m.tag = 'CustomFunction' AND m.path[-1] = 'CustomFunctionCatalog'),
ed AS (SELECT DISTINCT fu.file, fu.name AS a, substr(rr.ref, 4) AS b FROM fu JOIN rr ON rr.doc = fu.doc AND rr.owner = fu.pre WHERE starts_with(rr.ref, 'cf:')), tc AS (SELECT file, a, b FROM ed UNION SELECT tc.file, tc.a, ed.b FROM tc JOIN ed ON ed.file = tc.file AND ed.a = tc.b) SELECT file, a AS name FROM tc WHERE a = b""")
only_sample("function_clashes", lambda n: graph.function_collisions(n), f"""WITH fu AS (SELECT m.doc, m.file, m.pre, {_A("name")} AS name, coalesce({_A("parameters")}, '') AS p FROM m WHERE m.tag = 'CustomFunction' AND m.path[-1] = 'CustomFunctionCatalog'),
us AS (SELECT m.file, lower(substr(rr.ref, 4)) AS k, 'builtin' AS w FROM rr JOIN m ON m.doc = rr.doc AND m.pre = rr.owner WHERE starts_with(rr.ref, 'fn:') UNION SELECT file, lower(trim(unnest(string_split(p, ';')))), 'parameter' FROM fu) SELECT DISTINCT fu.file, fu.name, us.w AS "with" FROM fu JOIN us ON us.file = fu.file AND us.k = lower(fu.name)""")
only_sample("same_functions", lambda n: graph.duplicate_functions(n).select("body", F.array_join(F.transform("functions", lambda x: F.concat(x["file"], F.lit("/"), x["name"])), ",").alias("functions")), f"""SELECT sha256(calculation) AS body, string_agg(f, ',' ORDER BY f) AS functions FROM (SELECT DISTINCT ca.calculation, m.file || '/' || {_A("name")} AS f FROM m JOIN ca ON ca.doc = m.doc AND ca.owner = m.pre WHERE m.tag = 'CustomFunction' AND m.path[-1] = 'CustomFunctionCatalog' AND calculation IS NOT NULL) GROUP BY ALL HAVING count(*) > 1""")
only_sample("channels", graph.channels, f"""SELECT m.file, {_A("id")} AS id, {_A("name")} AS name, CASE WHEN lower({_A("name")}) = 'fmrest' THEN 'rest-api' WHEN lower({_A("name")}) = 'fmapp' THEN 'desktop' WHEN lower({_A("name")}) IN ('fmwebdirect', 'fmiwp') THEN 'web' WHEN regexp_matches(lower({_A("name")}), '^fmreauthenticate[0-9]*$') THEN 'session-rule' ELSE 'custom' END AS channel FROM m WHERE m.path[-1] = 'ExtendedPrivilegeCatalog'""")
_LETTER = lambda c, x: f"CASE WHEN {c} = 'Limited' THEN '{x}*' WHEN lower({c}) IN ('true', 'yes', 'modifiable', 'full') THEN '{x}' ELSE '-' END"
only_sample("crud", graph.crud_matrix, f"""WITH g AS ({_GRANTS}), r AS (SELECT g.file, {attr("name", "s.t")} AS privilege_set, g."table", {_LETTER('"create"', "C")} || CASE WHEN view_calculation IS NOT NULL THEN 'V*' ELSE {_LETTER('"view"', "V")} END || {_LETTER("edit", "E")} || {_LETTER('"delete"', "D")} AS letters FROM g JOIN m s ON s.doc = g.doc AND s.pre = g.set_pre),
k AS (SELECT file, privilege_set, letters, count(*) AS n FROM r GROUP BY ALL), u AS (SELECT file, privilege_set, arg_max(letters, struct_pack(n := n, l := letters)) AS usual, max(n) AS times FROM k GROUP BY ALL)
SELECT r.file, r.privilege_set, "table", letters FROM r JOIN u ON u.file = r.file AND u.privilege_set = r.privilege_set WHERE letters <> usual OR times = 1 UNION ALL SELECT file, privilege_set, '*', usual FROM u WHERE times > 1""")
only_sample("gaps", graph.authorization_gaps, f"""WITH lf AS ({_FIELD}), hid AS (SELECT DISTINCT doc, parent AS pre FROM m WHERE tag = 'HideCondition' AND path[-1] = 'Object'), g AS ({_GRANTS})
SELECT DISTINCT lf.file, lo.name AS layout, lf."table", lf.field FROM lf JOIN hid ON hid.doc = lf.doc AND hid.pre = lf.pre JOIN lo ON lo.doc = lf.doc AND lo.pre = lf.layout_pre AND lo.name <> '-' LEFT JOIN toc ON toc.file = lf.file AND toc.name = lf."table"
WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.file = lf.file AND g."table" = coalesce((SELECT {attr("name", "b.t")} FROM m b WHERE b.file = lf.file AND b.tag = 'BaseTable' AND b.path[-1] = 'BaseTableCatalog' AND {attr("id", "b.t")} = toc.base_table_id AND toc.external_file IS NULL), lf."table") AND (view_calculation IS NOT NULL OR lower("view") IN ('false', 'limited') OR field_access = 'Limited'))""")
only_sample("bypass", graph.privilege_bypass, f"""SELECT file, 'scripts' AS kind, 'full access' AS what, name FROM sr WHERE {attr("runFullAccess", "sr.t")} = 'True' AND {_TRIM("name")} <> '-' UNION ALL SELECT m.file, 'custom-menus', 'removed command', coalesce({_A("name")}, '') FROM m WHERE {_HAS("CustomMenuCatalog")} AND coalesce({_A("enable")}, {_A("enabled")}, 'True') = 'False'
UNION ALL SELECT m.file, 'auth-files', 'authorization', coalesce({_A("name")}, '') FROM m WHERE m.path[-1] = 'AuthFileCatalog' OR ({_HAS("AuthFileCatalog")} AND {_A("id")} IS NOT NULL) UNION ALL SELECT file, 'tables', 'flag in data', table_name || '::' || name FROM fb WHERE regexp_matches(lower(name), '(^|_)(is_?admin|can_|may_|allow|permission|privilege|role)')""")
only_sample("menus", graph.menu_summary, f"""SELECT m.file, {_A("id")} AS id, {_A("name")} AS name, (SELECT count(*) FROM m x WHERE x.doc = m.doc AND regexp_matches(x.tag, 'MenuItem$') AND list_contains(x.pres, m.pre)) AS items, (SELECT count(*) FROM m x WHERE x.doc = m.doc AND regexp_matches(x.tag, 'MenuItem$') AND list_contains(x.pres, m.pre) AND EXISTS (SELECT 1 FROM m y WHERE y.doc = x.doc AND y.tag = 'Step' AND list_contains(y.pres, x.pre))) AS overrides FROM m WHERE m.path[-1] = 'CustomMenuCatalog'""")
_ON = "st.enable = 'True'"
both("background_jobs", graph.background_candidates, f"""WITH s AS (SELECT st.*, {_STEP_VALUES} FROM st WHERE {_ON}) SELECT DISTINCT file, script_id AS id, script AS name, CASE WHEN name = 'Install OnTimer Script' THEN 'timer' ELSE 'server call' END AS why FROM s WHERE (name = 'Install OnTimer Script' OR starts_with(name, 'Perform Script on Server')) AND script IS NOT NULL
UNION SELECT file, id, name, 'name' FROM sr WHERE {_TRIM("name")} <> '-' AND regexp_matches(lower(name), 'schedul|nightly|daily|hourly|weekly|server|robot|batch|cron')""")
_BLOCKS = f"""SELECT st.doc, st.file, sr.id AS script_id, st.script_pre, st.step_line, st.name, coalesce(sum(CASE WHEN st.name IN ('If', 'Loop') THEN 1 WHEN st.name IN ('End If', 'End Loop') THEN -1 ELSE 0 END) OVER (PARTITION BY st.doc, st.script_pre ORDER BY st.step_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM st JOIN sr ON sr.doc = st.doc AND sr.pre = st.script_pre WHERE {_ON}"""
both("dead_steps", graph.unreachable_steps, f"""SELECT file, script_id, step_line, "after" FROM (SELECT *, min(CASE WHEN name IN ('Exit Script', 'Halt Script') AND depth = 0 THEN step_line END) OVER (PARTITION BY doc, script_pre) AS "after" FROM ({_BLOCKS})) WHERE step_line > "after\"""")
only_sample("effects", lambda n: graph.external_effects(n).where(F.col("effect").isin("Send Mail", "Open URL", "Insert from URL", "Export Records")), f"SELECT DISTINCT st.file, sr.id AS script_id, step_line, st.name AS effect FROM st JOIN sr ON sr.doc = st.doc AND sr.pre = st.script_pre WHERE {_ON} AND st.name IN ('Send Mail', 'Open URL', 'Insert from URL', 'Export Records')")

# --- resolution within the set (J) --------------------------------------------------------------------------------

_STEM = lambda x: f"lower(regexp_replace({x}, '([^.])\\.(fmp12|fp7|fp5|fp3|fmp)$', '\\1', 'i'))"
_EDS = f"""WITH ds AS (SELECT m.doc, m.file, {_A("id")} AS id, {_A("name")} AS name, {_A("pathList")} AS p FROM m WHERE m.tag = 'FileReference' AND m.path[-1] = 'ExternalDataSourcesCatalog'),
pp AS (SELECT file, id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT *, string_split(regexp_replace(trim(p), '\\s+([A-Za-z][A-Za-z0-9]*:)', chr(10) || '\\1', 'g'), chr(10)) AS l FROM ds)),
hit AS (SELECT pp.file, pp.id, arg_min(fl.file, i) AS target FROM pp JOIN fl ON {_STEM("fl.file")} = {_STEM("trim(regexp_extract(regexp_replace(trim(p), '^[A-Za-z][A-Za-z0-9]*:', ''), '([^/]*)/*$', 1))")} GROUP BY ALL)"""
only_sample("source_files", lambda n: resolution.resolve_sources(E.data_sources(n).where("type = 'filemaker'").select("file", "id", "name", "paths"), n.where("tag = 'File' and depth = 1").select("file").distinct()).select("file", "id", F.col("to.resolved_to").alias("target")),
     f"{_EDS} SELECT ds.file, ds.id, coalesce(hit.target, CASE WHEN ds.p IS NULL THEN fl.file END) AS target FROM ds LEFT JOIN hit ON hit.file = ds.file AND hit.id = ds.id LEFT JOIN fl ON {_STEM('fl.file')} = {_STEM('ds.name')}")
_OFID = f"(SELECT arg_min({attr('id', 'x.t')}, x.pre) FROM m x WHERE x.doc = toc.doc AND x.parent = toc.pre AND x.tag = 'FileReference')"
_BASES = f"{_EDS}, ba AS (SELECT toc.file, toc.name AS to_name, toc.id AS to_id, CASE WHEN toc.external_file IS NULL THEN toc.file ELSE hit.target END AS base_file, toc.base_table_id FROM toc LEFT JOIN hit ON hit.file = toc.file AND hit.id = {_OFID})"
both("base_tables", status.base_tables, f"{_BASES} SELECT * FROM ba")
both("calls", lambda n: graph.script_calls(n).where("h_kind = 'scripts' and live").select("from_file", F.col("h_id").alias("from_id"), "to_file", "to_id").distinct(),
     f"""{_EDS} SELECT DISTINCT st.file AS from_file, sr.id AS from_id, CASE WHEN fr.id IS NULL THEN st.file ELSE hit.target END AS to_file, {attr("id", "c.t")} AS to_id FROM m c JOIN st ON st.doc = c.doc AND st.pre = c.parent JOIN sr ON sr.doc = st.doc AND sr.pre = st.script_pre AND NOT ({_SEP_S})
     LEFT JOIN (SELECT doc, parent, arg_min(coalesce({_A("id")}, ''), pre) AS id FROM m WHERE tag = 'FileReference' GROUP BY ALL) fr ON fr.doc = c.doc AND fr.parent = c.parent LEFT JOIN hit ON hit.file = st.file AND hit.id = fr.id WHERE c.tag = 'Script' AND {_ON}""")  # fmt: skip
_CAT = {"Script": "Script", "Layout": "Layout", "ValueList": "ValueList", "CustomMenuSet": "CustomMenuSet"}
both("script_status", lambda n: status.reference_rows(n).where("tag in ('Script', 'Layout') and step_pre is not null").select("doc", "pre", "tag", "id", "status"),
     f"""{_EDS}, {_IDS[5:].replace(")\nSELECT file, kind, id, bool_or", "),\nic AS (SELECT file, kind, id, bool_or", 1)})
     SELECT c.doc, c.pre, c.tag, {attr("id", "c.t")} AS id, CASE WHEN fr.id IS NOT NULL AND hit.target IS NULL THEN 'external' WHEN {attr("id", "c.t")} IS NULL THEN NULL WHEN {attr("id", "c.t")} = '0' THEN 'none' WHEN coalesce(ic.is_separator, false) AND NOT coalesce(ic.is_id, false) THEN 'separator' WHEN coalesce(ic.is_id, false) THEN NULL WHEN coalesce(ic.is_folder, false) THEN 'folder' ELSE 'missing' END AS status
     FROM m c LEFT JOIN (SELECT doc, parent, arg_min(coalesce({_A("id")}, ''), pre) AS id FROM m WHERE tag = 'FileReference' GROUP BY ALL) fr ON fr.doc = c.doc AND fr.parent = c.parent LEFT JOIN hit ON hit.file = c.file AND hit.id = fr.id
     LEFT JOIN ic ON ic.kind = c.tag AND ic.id = {attr("id", "c.t")} AND ic.file = CASE WHEN fr.id IS NULL THEN c.file ELSE hit.target END WHERE c.tag IN ('Script', 'Layout') AND {_HAS("Step", "c")}""")  # fmt: skip
both("field_status", lambda n: status.reference_rows(n).where("tag = 'Field' and step_pre is not null").select("doc", "pre", "id", "status"),
     f"""{_BASES} SELECT c.doc, c.pre, {attr("id", "c.t")} AS id, CASE WHEN {attr("id", "c.t")} = '0' THEN 'none' WHEN {attr("table", "c.t")} = '' THEN CASE WHEN coalesce({attr("name", "c.t")}, '') = '' THEN 'missing' END WHEN ba.to_name IS NULL THEN 'missing' WHEN ba.base_file IS NULL THEN 'external'
     WHEN EXISTS (SELECT 1 FROM fd JOIN m b ON b.doc = fd.doc AND b.pre = fd.table_pre WHERE fd.file = ba.base_file AND {attr("id", "b.t")} = ba.base_table_id AND {attr("id", "fd.t")} = {attr("id", "c.t")}) THEN NULL ELSE 'missing' END AS status
     FROM m c LEFT JOIN ba ON ba.file = c.file AND ba.to_name = {attr("table", "c.t")} WHERE c.tag = 'Field' AND {attr("table", "c.t")} IS NOT NULL AND {_HAS("Step", "c")} AND NOT {_HAS("DisplayCalculation", "c")} AND NOT {_HAS("DDRInfo", "c")}""")  # fmt: skip
