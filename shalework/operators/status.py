"""The status of every reference inside the files of a set.

NULL where it resolves, else ``none`` (an empty slot), ``missing``, ``separator``, ``folder`` or ``external`` (its file is not in the
set). Definitions are not references. Every check is an equi-join on (file, kind, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shalework.functions.text import live_markers, strip
from shalework.operators import entities as E
from shalework.operators.nodes import attr, has_ancestor, nearest, parent_pre, parent_tag, path_is, within
from shalework.operators.resolution import resolve_sources

#: Fixed value: what the name of a reference without a target looks like.
MARKER_NAME = r"^<(?:[A-Z][a-z]+ Missing|unknown)>$"
#: Subtrees that are presentation or are read elsewhere.
SKIPPED = (
    "Styles", "LocalCSS", "FullCSS", "ExtendedAttributes", "NumFormat", "DateFormat", "TimeFormat", "CharacterStyleVector", "ParagraphStyleVector", "CharacterStyle",
    "ParagraphStyle", "Theme", "LocalTheme", "CustomStyles", "RenderFormat", "ThemeCatalog", "DisplayCalculation",
)
#: What a deleted target of each kind prints as, closest first.
PRINTS_AS = {
    "Field": ["<Field Missing>", "<Table Missing>"], "FieldReference": ["<Field Missing>"], "Table": ["<Table Missing>"], "TableOccurrenceReference": ["<Table Missing>"],
    "FileReference": ["<File Missing>"], "Layout": ["<unknown>"], "Script": ["<unknown>"], "ValueList": ["<unknown>"],
}


def id_catalog(nodes: DataFrame) -> DataFrame:
    """(file, kind, id, is_id, is_separator, is_folder) of everything that can be referred to by id."""
    row = lambda d, kind, sep=None: d.select("file", F.lit(kind).alias("kind"), "id", F.lit(True).alias("is_id") if sep is None else (~F.col(sep)).alias("is_id"), F.lit(False).alias("is_separator") if sep is None else F.col(sep).alias("is_separator"), F.lit(False).alias("is_folder"))
    listed = lambda cat, tag: nodes.where((F.col("tag") == tag) & (parent_tag() == cat)).select("file", attr("id").alias("id"))
    folders = nodes.where((F.col("tag") == "Group") & (within("ScriptCatalog") | within("LayoutCatalog"))).select("file", F.when(has_ancestor("ScriptCatalog"), "Script").otherwise("Layout").alias("kind"), attr("id").alias("id"), F.lit(False).alias("is_id"), F.lit(False).alias("is_separator"), F.lit(True).alias("is_folder"))
    parts = [
        row(E.scripts(nodes, dashes=True), "Script", "is_separator"), row(E.layouts(nodes, dashes=True), "Layout", "is_separator"), folders,
        row(E.occurrences(nodes), "Table"), row(E.occurrences(nodes), "TableOccurrenceReference"), row(listed("ExternalDataSourcesCatalog", "FileReference"), "FileReference"),
        row(listed("ExternalDataSourcesCatalog", "OdbcDataSource"), "FileReference"), row(listed("ValueListCatalog", "ValueList"), "ValueList"), row(listed("CustomMenuCatalog", "CustomMenu"), "CustomMenu"),
        row(listed("CustomMenuSetCatalog", "CustomMenuSet"), "CustomMenuSet"), row(listed("PrivilegesCatalog", "PrivilegeSet"), "PrivilegeSet"), row(E.tables(nodes), "BaseTable"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("id is not null").groupBy("file", "kind", "id").agg(F.max("is_id").alias("is_id"), F.max("is_separator").alias("is_separator"), F.max("is_folder").alias("is_folder"))


def _definition():
    """Elements that define what others refer to."""
    return (
        path_is("BaseTableCatalog") | (path_is("BaseTableCatalog", "BaseTable", "FieldCatalog") & (F.col("tag") == "Field")) | (path_is("BaseTableCatalog", "BaseTable") & (F.col("tag") == "Field"))
        | path_is("TableList") & ~has_ancestor("PrivilegeSet") | path_is("RelationshipList") | (within("LayoutCatalog") & (F.col("tag") == "Layout")) | (within("ScriptCatalog") & (F.col("tag") == "Script"))
        | parent_tag().isin("ValueListCatalog", "AccountCatalog", "PrivilegesCatalog", "CustomFunctionCatalog", "ExternalDataSourcesCatalog", "CustomMenuCatalog", "CustomMenuSetCatalog", "AuthFileCatalog", "ExtendedPrivilegeCatalog", "BaseDirectoryCatalog")
    )


def base_tables(nodes: DataFrame) -> DataFrame:
    """(file, to_name, to_id, base_file, base_table_id): base_file null where the occurrence's file is not in the set."""
    known = nodes.where((F.col("tag") == "File") & (F.col("depth") == 1)).select("file").distinct()
    sources = resolve_sources(E.data_sources(nodes).where("type = 'filemaker'").select("file", "id", "name", "paths"), known)
    s = sources.groupBy(F.col("file").alias("_f"), F.col("id").alias("_i")).agg(F.min("to.resolved_to").alias("target"))
    o = E.occurrences(nodes).join(s, (F.col("file") == F.col("_f")) & (F.col("external_file.id") == F.col("_i")), "left")
    return o.select("file", F.col("name").alias("to_name"), F.col("id").alias("to_id"), F.when(F.col("external_file").isNull(), F.col("file")).otherwise(F.col("target")).alias("base_file"), "base_table_id")


def reference_rows(nodes: DataFrame) -> DataFrame:
    """(doc, file, pre, tag, id, name, status, step_pre, target_file) of every element that is a reference."""
    catalogued = ("Script", "Layout", "ValueList", "Table", "TableOccurrenceReference", "FileReference", "CustomMenu", "CustomMenuSet", "PrivilegeSet", "BaseTable")
    name, oid = attr("name"), attr("id")
    gone = F.coalesce(name.rlike(MARKER_NAME), F.lit(False))
    shown = ~F.exists("anc", lambda x: x["tag"].isin(*SKIPPED)) & ~F.col("tag").isin(*SKIPPED) & (~has_ancestor("DDRInfo") | ((parent_tag() == "DDRInfo") & F.col("tag").isin("Field", "ValueList")))
    kind = F.col("tag").isin(*catalogued, "LeftTable", "RightTable", "FieldReference") | ((F.col("tag") == "Field") & F.map_contains_key("attrs", "table")) | gone
    c = nodes.where(shown & kind & ~_definition() & (F.col("depth") > 1))
    c = c.select("doc", "file", "pre", "parent", "tag", oid.alias("id"), name.alias("name"), attr("table").alias("table"), gone.alias("gone"), parent_tag().alias("up"), has_ancestor("PrivilegeSet").alias("in_set"), nearest("Step").alias("step_pre"))

    known = nodes.where((F.col("tag") == "File") & (F.col("depth") == 1)).select("file").distinct()
    sources = resolve_sources(E.data_sources(nodes).where("type = 'filemaker'").select("file", "id", "name", "paths"), known)
    eds = sources.groupBy(F.col("file").alias("_f"), F.col("id").alias("_i")).agg(F.min("to.resolved_to").alias("target"))
    beside = nodes.where(F.col("tag") == "FileReference").groupBy(F.col("doc").alias("_d"), F.col("parent").alias("_p")).agg(F.min_by(F.struct(F.coalesce(oid, F.lit("")).alias("id")), "pos").alias("fr"))
    elsewhere = F.col("tag").isin("Script", "Layout", "ValueList")
    c = c.join(beside, elsewhere & (F.col("doc") == F.col("_d")) & (F.col("parent") == F.col("_p")), "left").drop("_d", "_p")
    c = c.join(eds, (F.col("file") == F.col("_f")) & (F.col("fr.id") == F.col("_i")), "left").drop("_f", "_i")
    c = c.withColumn("target_file", F.when(F.col("fr").isNull(), F.col("file")).otherwise(F.col("target")))

    ids = id_catalog(nodes).select(F.col("file").alias("_f"), F.col("kind").alias("_k"), F.col("id").alias("_i"), "is_id", "is_separator", "is_folder")
    c = c.join(ids, (F.col("target_file") == F.col("_f")) & (F.col("tag") == F.col("_k")) & (F.col("id") == F.col("_i")), "left").drop("_f", "_k", "_i")
    tos = base_tables(nodes)
    by_name = tos.groupBy(F.col("file").alias("_f"), F.col("to_name").alias("_t")).agg(F.min(F.struct("base_file", "base_table_id")).alias("to"))
    c = c.join(by_name, (F.col("file") == F.col("_f")) & (F.when(F.col("tag") == "Field", F.col("table")).when(F.col("tag").isin("LeftTable", "RightTable"), F.col("name")) == F.col("_t")), "left").drop("_f", "_t")
    # a field reference names its occurrence by an element of its own
    inner = nodes.where((F.col("tag") == "TableOccurrenceReference") & (parent_tag() == "FieldReference")).groupBy(F.col("doc").alias("_d"), F.col("parent").alias("_p")).agg(F.min_by(oid, "pos").alias("to_ref"))
    by_id = tos.groupBy(F.col("file").alias("_f"), F.col("to_id").alias("_t")).agg(F.min(F.struct("base_file", "base_table_id")).alias("to2"))
    c = c.join(inner, (F.col("tag") == "FieldReference") & (F.col("doc") == F.col("_d")) & (F.col("pre") == F.col("_p")), "left").drop("_d", "_p")
    c = c.join(by_id, (F.col("file") == F.col("_f")) & (F.col("to_ref") == F.col("_t")), "left").drop("_f", "_t").withColumn("base", F.coalesce("to", "to2"))
    f = E.field_definitions(nodes).select("doc", "file", "table_pre", attr("id").alias("fid"))
    t = E.tables(nodes).select(F.col("doc").alias("_d"), F.col("pre").alias("_p"), F.col("id").alias("tid"))
    defined = f.join(t, (F.col("doc") == F.col("_d")) & (F.col("table_pre") == F.col("_p"))).select(F.col("file").alias("_f"), "tid", "fid").distinct().withColumn("has_field", F.lit(True))
    c = c.join(defined, (F.col("base.base_file") == F.col("_f")) & (F.col("base.base_table_id") == F.col("tid")) & (F.col("id") == F.col("fid")), "left").drop("_f", "tid", "fid")

    nil = F.lit(None).cast("string")
    tag = F.col("tag")
    marked = F.when(F.col("gone"), "missing")
    in_base = F.when(F.col("base.base_file").isNull(), "external").when(F.col("has_field"), nil).otherwise("missing")
    is_field = (tag == "Field") & F.col("table").isNotNull()
    checked = tag.isin("Script", "Layout", "TableOccurrenceReference", "FileReference", "ValueList", "CustomMenu", "CustomMenuSet", "PrivilegeSet", "BaseTable") | ((tag == "Table") & (F.coalesce(F.col("up"), F.lit("")) != "TableList"))
    status = (
        F.when(tag.isin("LeftTable", "RightTable"), F.when(F.col("name").isNotNull() & F.col("to").isNull(), "missing"))
        .when(elsewhere & F.col("fr").isNotNull() & F.col("target").isNull(), "external")
        .when(is_field & (F.col("id") == "0"), "none")
        .when(is_field & (F.col("table") == ""), F.when(F.coalesce(F.col("name"), F.lit("")) == "", "missing"))
        .when(is_field, F.when(F.col("to").isNull(), "missing").otherwise(in_base))
        .when((tag == "FieldReference") & F.col("id").isNotNull() & (F.col("id") != "0"), F.when(F.col("to2").isNotNull(), in_base))
        .when(F.col("id").isNull(), marked)
        .when((F.col("id") == "-1") & (F.col("name") == "<Current Table>"), nil)
        .when((tag == "CustomMenuSet") & (F.col("id") == "0") & (F.coalesce(F.col("name"), F.lit("")) == ""), nil)
        .when(~checked, marked)
        .when(F.col("id") == "0", "none")
        .when(F.coalesce("is_separator", F.lit(False)) & ~F.coalesce("is_id", F.lit(False)), "separator")
        .when(tag.isin("Script", "Layout") & (F.col("name") == "--") & (F.col("up") != "Step"), nil)
        .when(F.coalesce("is_id", F.lit(False)), nil)
        .when(F.coalesce("is_folder", F.lit(False)), F.when(~F.col("in_set"), "folder"))
        .otherwise("missing")
    )
    return c.select("doc", "file", "pre", "tag", "id", "name", status.alias("status"), "step_pre", "target_file")


# --- markers in printed text --------------------------------------------------------------------------------------


def calculation_markers(nodes: DataFrame) -> DataFrame:
    """(doc, file, pre, step_pre, marker): markers of deleted targets in the live code of calculations."""
    c = nodes.where((F.col("tag") == "Calculation") & ~has_ancestor(*SKIPPED) & F.contains("text", F.lit("<")))
    return c.select("doc", "file", "pre", nearest("Step").alias("step_pre"), F.explode(live_markers(F.col("text"))).alias("marker"))


def _kind() -> Column:
    """What a marker says is missing, without the occurrence in front."""
    return F.regexp_extract("marker", r"(<[^<]*)$", 1).alias("kind")


def unexplained(shown: DataFrame, calc: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc, step, at, marker): the markers of step texts that nothing explains.

    ``shown`` (doc, step, at, marker) are the markers of a step's text in order, ``calc`` (doc, step, marker) those of its calculations, ``gone``
    (doc, step, pre, tag) its references that lead nowhere. All is counted by step and kind: whatever explains a kind is numbered, calculations
    first; up to the number shown each takes one marker away, the first ones of that kind. What comes too late for the closest kind its tag
    prints as is numbered again for the next one."""
    key = ["doc", "step", "kind"]
    shown = shown.select("doc", "step", "at", "marker", _kind())
    have = shown.groupBy(*key).agg(F.count("*").alias("have"))
    second = F.create_map(*(F.lit(x) for tag, kinds in PRINTS_AS.items() if len(kinds) > 1 for x in (tag, kinds[1])))
    closest = F.create_map(*(F.lit(x) for tag, kinds in PRINTS_AS.items() for x in (tag, kinds[0])))
    by_calc = calc.select("doc", "step", _kind(), F.lit(0).alias("turn"), F.lit(0).alias("pre"), F.lit(None).cast("string").alias("tag"))
    by_ref = gone.where(F.col("tag").isin(*PRINTS_AS)).select("doc", "step", closest[F.col("tag")].alias("kind"), F.lit(1).alias("turn"), "pre", "tag")
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("turn", "pre"))
    first = by_calc.unionByName(by_ref).withColumn("n", turn).join(have, key, "left")
    late = first.where((F.col("n") > F.coalesce("have", F.lit(0))) & F.col("tag").isNotNull()).select("doc", "step", second[F.col("tag")].alias("kind")).where("kind is not null")
    taken = first.select(*key).unionByName(late).groupBy(*key).agg(F.count("*").alias("taken"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("at"))
    return shown.withColumn("n", place).join(taken, key, "left").where(F.col("n") > F.coalesce("taken", F.lit(0))).select("doc", "step", "at", "marker")


def step_markers(nodes: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """(doc, file, pre, marker): markers of step texts that neither a calculation nor a reference of the step explains.

    Comment steps (type 89) are the author's words."""
    refs = reference_rows(nodes) if refs is None else refs
    text = nodes.where((F.col("tag") == "StepText") & (parent_tag() == "Step") & F.contains("text", F.lit("<"))).select("doc", F.col("parent").alias("step"), strip(F.col("text")).alias("raw"))
    steps = nodes.where((F.col("tag") == "Step") & (F.coalesce(attr("id"), F.lit("")) != "89")).select("doc", "file", F.col("pre").alias("step"), (F.coalesce(attr("enable"), F.lit("True")) == "True").alias("on"))
    raw = F.when(~F.col("on") & F.startswith("raw", F.lit("//")), F.substring("raw", F.lit(3), F.length("raw"))).otherwise(F.col("raw"))
    shown = text.join(steps, ["doc", "step"]).select("doc", "file", "step", F.posexplode(live_markers(raw)).alias("at", "marker"))
    calc = calculation_markers(nodes).where("step_pre is not null").select("doc", F.col("step_pre").alias("step"), "marker")
    gone = refs.where("status in ('missing', 'folder') and step_pre is not null").select("doc", F.col("step_pre").alias("step"), "pre", "tag")
    left = unexplained(shown, calc, gone)
    return left.join(steps, ["doc", "step"]).select("doc", "file", F.col("step").alias("pre"), "marker")


def unresolved(nodes: DataFrame) -> DataFrame:
    """(doc, file, pre, tag, id, name, status) of everything that does not resolve, markers included."""
    refs = reference_rows(nodes)
    rows = refs.where("status is not null").select("doc", "file", "pre", "tag", F.coalesce("id", F.lit("")).alias("id"), F.coalesce("name", F.lit("")).alias("name"), "status")
    mark = lambda d, tag: d.select("doc", "file", "pre", F.lit(tag).alias("tag"), F.lit("").alias("id"), F.col("marker").alias("name"), F.lit("marker").alias("status"))
    return rows.unionByName(mark(calculation_markers(nodes), "Calculation")).unionByName(mark(step_markers(nodes, refs), "StepText"))
