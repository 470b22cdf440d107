"""Typed relations projected from the node table.

Each entity is a filter on the node table for its definitions (by the tags above them, so that mentions elsewhere do not count)
and, where it has parts, one conditional aggregation of the elements below by their owner. All ids are strings. Options that are
absent are NULL, not false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shalework.functions.text import path_list, strip
from shalework.operators.calculations import calculations
from shalework.operators.nodes import attr, folder_of, has_ancestor, nearest, outermost, parent_pre, parent_tag, path_is, within

BUTTONS = ("GroupButtonObj", "ButtonObj", "PopoverButtonObj", "ButtonBarObj")


def _true(c: Column) -> Column:
    return F.when(c == "True", F.lit(True))


def _or_empty(name: str) -> Column:
    return F.coalesce(attr(name), F.lit(""))


def _first(value: Column, when: Column) -> Column:
    """The value of the first element in document order for which ``when`` holds."""
    return F.min_by(F.struct(value.alias("v")), F.when(when, F.col("pre")))["v"]


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def _with(items: DataFrame, parts: DataFrame) -> DataFrame:
    """``parts`` (doc, owner, ...) beside their owners."""
    p = parts.withColumnsRenamed({"doc": "_doc", "owner": "_owner"})
    return items.join(p, (F.col("doc") == F.col("_doc")) & (F.col("pre") == F.col("_owner")), "left").drop("_doc", "_owner")


def _calcs(nodes: DataFrame, *names: str) -> DataFrame:
    return calculations(nodes).select("doc", "owner", F.col("calculation").alias(names[0] if names else "calculation"))


# --- tables -------------------------------------------------------------------------------------------------------


def tables(nodes: DataFrame) -> DataFrame:
    t = nodes.where((F.col("tag") == "BaseTable") & (parent_tag() == "BaseTableCatalog"))
    return t.select("doc", "file", "pre", attr("id").alias("id"), attr("name").alias("name"), F.coalesce(attr("records"), F.lit("0")).cast("bigint").alias("records"), attr("comment").alias("comment"))


def field_definitions(nodes: DataFrame) -> DataFrame:
    """Fields of base tables: those of the field catalog, else direct children; a field any deeper is a mention."""
    f = nodes.where((F.col("tag") == "Field") & (path_is("BaseTableCatalog", "BaseTable", "FieldCatalog") | path_is("BaseTableCatalog", "BaseTable")))
    in_catalog = parent_tag() == "FieldCatalog"
    f = f.withColumn("table_pre", F.when(in_catalog, parent_pre(2)).otherwise(parent_pre(1))).withColumn("_listed", in_catalog)
    of_table = Window.partitionBy("doc", "table_pre")
    return f.withColumn("_any", F.max("_listed").over(of_table)).where("_listed or not _any").drop("_listed", "_any")


def fields(nodes: DataFrame) -> DataFrame:
    """One row per field with its bucket: globals, summary, calculated or fields, in this order of precedence."""
    f = field_definitions(nodes).where(~(_or_empty("name").startswith("===") & _or_empty("name").endswith("===")))
    below = nodes.where(has_ancestor("BaseTableCatalog") & has_ancestor("Field")).withColumn("owner", outermost("Field"))
    up = parent_tag()
    parts = below.groupBy("doc", "owner").agg(
        _first(strip(F.col("text")), (F.col("tag") == "Comment") & (up == "Field")).alias("comment"),
        _first(_nonempty(attr("value")), (F.col("tag") == "AutoEnter") & (up == "Field")).alias("ae_value"),
        _first(F.struct(attr("nextValue").alias("next"), attr("increment").alias("increment"), attr("generate").alias("generate")), (F.col("tag") == "Serial") & (up == "AutoEnter")).alias("ae_serial"),
        F.min(F.when((F.col("tag") == "AutoEnter") & (up == "Field"), F.col("pre"))).alias("ae_pre"),
        _first(_true(attr("value")), (F.col("tag") == "NotEmpty") & (up == "Validation")).alias("not_empty"),
        _first(_true(attr("value")), (F.col("tag") == "Unique") & (up == "Validation")).alias("unique"),
        _first(_true(attr("global")), (F.col("tag") == "Storage") & (up == "Field")).alias("global"),
        _first(F.when(~attr("index").isin("", "None"), attr("index")), (F.col("tag") == "Storage") & (up == "Field")).alias("index"),
        _first(F.when(~attr("maxRepetition").isin("", "1"), attr("maxRepetition")).cast("int"), (F.col("tag") == "Storage") & (up == "Field")).alias("repetitions"),
    )
    calc = _calcs(nodes)
    one = _with(_with(f, parts), calc)
    ae = calc.select(F.col("doc").alias("_d"), F.col("owner").alias("_o"), F.col("calculation").alias("ae_calculation"))
    one = one.join(ae, (F.col("doc") == F.col("_d")) & (F.col("ae_pre") == F.col("_o")), "left")
    t = tables(nodes).select(F.col("doc").alias("_td"), F.col("pre").alias("_tp"), F.col("id").alias("table_id"), F.col("name").alias("table_name"))
    one = one.join(t, (F.col("doc") == F.col("_td")) & (F.col("table_pre") == F.col("_tp")))
    bucket = F.when(F.col("global"), "globals").when(attr("fieldType") == "Summary", "summary").when(attr("fieldType") == "Calculated", "calculated").otherwise("fields")
    some_auto = F.col("ae_value").isNotNull() | F.col("ae_serial").isNotNull() | F.col("ae_calculation").isNotNull()
    return one.select(
        "doc", "file", "pre", "table_pre", "table_id", "table_name", attr("id").alias("id"), attr("name").alias("name"), attr("dataType").alias("data_type"), attr("fieldType").alias("field_type"),
        _nonempty(F.col("comment")).alias("comment"), F.when(some_auto, F.struct(F.col("ae_value").alias("value"), F.col("ae_serial").alias("serial"), F.col("ae_calculation").alias("calculation"))).alias("auto_enter"),
        "calculation", "not_empty", "unique", "global", "index", "repetitions", bucket.alias("bucket"),
    )


# --- relationship graph -------------------------------------------------------------------------------------------


def occurrences(nodes: DataFrame) -> DataFrame:
    """Table occurrences; the base table is the attribute, or the child element where the attribute is absent."""
    t = nodes.where((F.col("tag") == "Table") & path_is("RelationshipGraph", "TableList"))
    below = nodes.where((parent_tag() == "Table") & (parent_tag(2) == "TableList")).withColumn("owner", F.col("parent"))
    parts = below.groupBy("doc", "owner").agg(
        _first(F.struct(attr("id").alias("id"), attr("name").alias("name")), F.col("tag") == "BaseTable").alias("base"),
        _first(F.struct(_or_empty("name").alias("name"), _or_empty("id").alias("id")), F.col("tag") == "FileReference").alias("external_file"),
    )
    one = _with(t, parts)
    listed = attr("baseTable").isNotNull()
    return one.select(
        "doc", "file", "pre", attr("id").alias("id"), attr("name").alias("name"),
        F.when(listed, attr("baseTable")).otherwise(F.col("base.name")).alias("base_table"),
        F.when(listed, attr("baseTableId")).otherwise(F.coalesce(F.col("base.id"), attr("baseTableId"))).alias("base_table_id"), "external_file",
    )


def predicates(nodes: DataFrame) -> DataFrame:
    """(doc, file, rel_pre, ord, operator, left_field, right_field), in document order."""
    p = nodes.where((F.col("tag") == "JoinPredicate") & path_is("Relationship", "JoinPredicateList"))
    side = nodes.where((F.col("tag") == "Field") & parent_tag().isin("LeftField", "RightField") & (parent_tag(2) == "JoinPredicate")).withColumn("owner", parent_pre(2))
    parts = side.groupBy("doc", "owner").agg(_first(attr("name"), parent_tag() == "LeftField").alias("left_field"), _first(attr("name"), parent_tag() == "RightField").alias("right_field"))
    order = F.row_number().over(Window.partitionBy("doc", parent_pre(2)).orderBy("pre"))
    return _with(p, parts).select("doc", "file", parent_pre(2).alias("rel_pre"), order.alias("ord"), F.coalesce(attr("type"), F.lit("equal")).alias("operator"), "left_field", "right_field")


def _side(nodes: DataFrame, side: str) -> DataFrame:
    """Options of one side: from the table element if it has a cascade flag, else from the older options element."""
    e = nodes.where(F.col("tag").isin(f"{side}Table", f"{side}Options") & (parent_tag() == "Relationship"))
    table = F.col("tag") == f"{side}Table"
    flagged = table & (attr("cascadeCreate").isNotNull() | attr("cascadeDelete").isNotNull())
    e = e.withColumn("_rank", F.when(flagged, 0).when(~table, 1)).where("_rank is not null")
    best = e.groupBy("doc", F.col("parent").alias("rel")).agg(F.min_by(F.struct("pre", "attrs", "_rank"), F.struct("_rank", "pre")).alias("s"))
    best = best.select("doc", "rel", F.col("s.pre").alias("src"), *(F.when(F.col("s._rank") == 0, F.col("s.attrs")[a]).otherwise(F.col("s.attrs")[b]).alias(n) for n, a, b in (("del", "cascadeDelete", "deleteRelated"), ("cre", "cascadeCreate", "createRelated"))))
    lists = nodes.where((F.col("tag") == "SortList") & parent_tag().isin(f"{side}Table", f"{side}Options"))
    lists = lists.groupBy("doc", F.col("parent").alias("src")).agg(F.min_by(F.struct("pre", F.coalesce(attr("value"), F.lit("True")).alias("on")), "pre").alias("l")).where("l.on = 'True'").select(F.col("doc").alias("_ld"), F.col("src").alias("_src"), F.col("l.pre").alias("list"))
    sort = nodes.where((F.col("tag") == "Sort") & (parent_tag() == "SortList"))
    name = nodes.where((F.col("tag") == "Field") & ((parent_tag() == "Sort") | path_is("Sort", "PrimaryField"))).withColumn("owner", F.when(parent_tag() == "Sort", parent_pre()).otherwise(parent_pre(2)))
    name = name.groupBy("doc", "owner").agg(F.min_by(attr("name"), F.struct(F.when(parent_tag() == "PrimaryField", 0).otherwise(1), F.col("pre"))).alias("field"))
    keys = _with(sort, name.withColumn("has", F.lit(True))).where("has")
    keys = keys.groupBy(F.col("doc").alias("_kd"), F.col("parent").alias("_list")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pre", "field", F.coalesce(attr("type"), F.lit("Ascending")).alias("order")))), lambda x: F.struct(x["field"].alias("field"), x["order"].alias("order"))).alias("sort"))
    both = best.join(lists, (F.col("doc") == F.col("_ld")) & (F.col("src") == F.col("_src")), "left").join(keys, (F.col("doc") == F.col("_kd")) & (F.col("list") == F.col("_list")), "left")
    options = F.struct(_true(F.col("del")).alias("delete_related"), _true(F.col("cre")).alias("allow_create"), F.col("sort"))
    some = (F.col("del") == "True") | (F.col("cre") == "True") | F.col("sort").isNotNull()
    return both.select(F.col("doc").alias("_doc"), F.col("rel").alias("_rel"), F.when(F.coalesce(some, F.lit(False)), options).alias(f"{side.lower()}_options"))


def relationships(nodes: DataFrame) -> DataFrame:
    """Relationships with their predicates in order and the options of both sides."""
    r = nodes.where((F.col("tag") == "Relationship") & path_is("RelationshipGraph", "RelationshipList"))
    side = nodes.where(F.col("tag").isin("LeftTable", "RightTable") & (parent_tag() == "Relationship")).withColumn("owner", F.col("parent"))
    parts = side.groupBy("doc", "owner").agg(_first(attr("name"), F.col("tag") == "LeftTable").alias("left_table"), _first(attr("name"), F.col("tag") == "RightTable").alias("right_table"))
    p = predicates(nodes).groupBy(F.col("doc").alias("_pd"), F.col("rel_pre").alias("_pr")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "operator", "left_field", "right_field"))), lambda x: F.struct(x["operator"].alias("operator"), x["left_field"].alias("left_field"), x["right_field"].alias("right_field"))).alias("predicates"))
    one = _with(r, parts).join(p, (F.col("doc") == F.col("_pd")) & (F.col("pre") == F.col("_pr")), "left")
    for s in ("Left", "Right"):
        one = one.join(_side(nodes, s), (F.col("doc") == F.col("_doc")) & (F.col("pre") == F.col("_rel")), "left").drop("_doc", "_rel")
    return one.select("doc", "file", "pre", attr("id").alias("id"), "left_table", "right_table", "predicates", "left_options", "right_options")


# --- layouts ------------------------------------------------------------------------------------------------------


def layouts(nodes: DataFrame, dashes: bool = False) -> DataFrame:
    """Layouts of the catalog, at its root and in groups; ``dashes`` also gives the separators, marked."""
    t = nodes.where((F.col("tag") == "Layout") & within("LayoutCatalog"))
    below = nodes.where(parent_tag() == "Layout").withColumn("owner", F.col("parent"))
    table = below.groupBy("doc", "owner").agg(_first(attr("name"), F.col("tag") == "Table").alias("table"))
    content = nodes.where((F.col("tag") == "Object") & has_ancestor("LayoutCatalog")).select("doc", nearest("Layout").alias("owner")).distinct().withColumn("has_objects", F.lit(True))
    folder = folder_of(nodes, ("Layout",)).withColumnRenamed("pre", "owner")
    one = _with(_with(_with(t, table), content), folder)
    dash = _or_empty("name") == "-"
    one = one if dashes else one.where(~dash)
    return one.select(
        "doc", "file", "pre", attr("id").alias("id"), _or_empty("name").alias("name"), attr("width").alias("width"), (_or_empty("includeInMenu") == "True").alias("in_menu"),
        "folder", "table", dash.alias("is_dash_named"), (dash & F.col("has_objects").isNull()).alias("is_separator"),
    )


def layout_objects(nodes: DataFrame) -> DataFrame:
    """Every object of a layout with the number of the object round it, if any."""
    o = nodes.where((F.col("tag") == "Object") & has_ancestor("LayoutCatalog"))
    return o.select("doc", "file", "pre", nearest("Layout").alias("layout_pre"), nearest("Object").alias("parent_object"), attr("key").alias("key"), _or_empty("name").alias("name"), _or_empty("type").alias("type"), attr("flags").alias("flags"))


def layout_fields(nodes: DataFrame) -> DataFrame:
    """Fields shown on each layout in order, each once: from the structured reference, else from the printed name."""
    o = layout_objects(nodes).where("type = 'Field'")
    structured = nodes.where((F.col("tag") == "Field") & path_is("Object", "FieldObj", "DDRInfo")).withColumn("owner", parent_pre(3))
    s = structured.groupBy("doc", "owner").agg(F.min_by(F.struct(_or_empty("table").alias("table"), _or_empty("name").alias("field")), "pre").alias("ref"))
    named = nodes.where((F.col("tag") == "Name") & path_is("Object", "FieldObj")).withColumn("owner", parent_pre(2))
    at = F.instr("text", "::")
    n = named.groupBy("doc", "owner").agg(F.min_by(F.when(at > 0, F.struct(F.substring("text", F.lit(1), at - 1).alias("table"), F.expr("substring(text, instr(text, '::') + 2)").alias("field"))), "pre").alias("by_name"))
    one = _with(_with(o, s), n).withColumn("f", F.coalesce("ref", "by_name")).where("f is not null")
    first = F.row_number().over(Window.partitionBy("doc", "layout_pre", "f").orderBy("pre"))
    return one.withColumn("_n", first).where("_n = 1").select("doc", "file", "layout_pre", "pre", "f.table", "f.field")


def portals(nodes: DataFrame) -> DataFrame:
    o = layout_objects(nodes).where("type = 'Portal'")
    have = nodes.where((F.col("tag") == "PortalObj") & (parent_tag() == "Object")).groupBy("doc", F.col("parent").alias("owner")).agg(F.min("pre").alias("portal"))
    alias = nodes.where((F.col("tag") == "TableAliasKey") & path_is("Object", "PortalObj")).withColumn("owner", parent_pre(2)).groupBy("doc", "owner").agg(F.min_by(strip(F.col("text")), "pre").alias("alias"))
    f = nodes.where((F.col("tag") == "Field") & path_is("Object", "PortalObj", "FieldList")).withColumn("owner", parent_pre(3))
    listed = f.groupBy("doc", "owner").agg(F.transform(F.sort_array(F.collect_list(F.struct("pre", _or_empty("table").alias("table"), _or_empty("name").alias("field")))), lambda x: F.struct(x["table"].alias("table"), x["field"].alias("field"))).alias("fields"))
    one = _with(_with(_with(o, have), alias), listed).where("portal is not null")
    return one.select("doc", "file", "layout_pre", "pre", F.coalesce("alias", F.lit("")).alias("table"), F.coalesce("fields", F.array().cast("array<struct<table:string,field:string>>")).alias("fields"))


def buttons(nodes: DataFrame) -> DataFrame:
    """Actions of the four button containers, each once per layout by (action, script, script id, file).

    A step inside nested buttons belongs to the outermost one; ``inner_type`` names the innermost."""
    s = nodes.where((F.col("tag") == "Step") & has_ancestor("LayoutCatalog") & has_ancestor(*BUTTONS) & (_or_empty("name") != ""))
    outer = F.try_element_at(F.filter("anc", lambda x: x["tag"].isin(*BUTTONS)), F.lit(1))
    inner = F.try_element_at(F.filter("anc", lambda x: x["tag"].isin(*BUTTONS)), F.lit(-1))
    # the object round the outermost button
    holder = F.try_element_at(F.filter("anc", lambda x: (x["tag"] == "Object") & (x["pre"] < outer["pre"])), F.lit(-1))["pre"]
    s = s.select("doc", "file", "pre", "attrs", outer["tag"].alias("button_type"), inner["tag"].alias("inner_type"), holder.alias("holder"), nearest("Layout").alias("layout_pre"))
    kid = nodes.where((parent_tag() == "Step") & has_ancestor("LayoutCatalog")).withColumn("owner", F.col("parent"))
    parts = kid.groupBy("doc", "owner").agg(
        _first(_or_empty("name"), F.col("tag") == "Script").alias("script"), _first(_nonempty(attr("id")), F.col("tag") == "Script").alias("script_id"),
        _first(_or_empty("name"), F.col("tag") == "FileReference").alias("external_file"), _first(strip(F.col("text")), F.col("tag") == "StepText").alias("description"),
    )
    o = layout_objects(nodes).select(F.col("doc").alias("_od"), F.col("pre").alias("_op"), _nonempty(F.col("key")).alias("object_key"), _nonempty(F.col("name")).alias("object_name"))
    one = _with(s, parts).join(o, (F.col("doc") == F.col("_od")) & (F.col("holder") == F.col("_op")), "left").withColumn("action", attr("name"))
    key = [F.coalesce(c, F.lit("")) for c in ("script", "script_id", "external_file")]
    first = F.row_number().over(Window.partitionBy("doc", "layout_pre", "action", *key).orderBy("pre"))
    return one.withColumn("_n", first).where("_n = 1").select("doc", "file", "layout_pre", "pre", "action", "button_type", "inner_type", "object_key", "object_name", "script", "script_id", "external_file", "description")


def conditional_formats(nodes: DataFrame) -> DataFrame:
    """Conditional formats of objects that have a formula, with layout name and id."""
    c = nodes.where((F.col("tag") == "Condition") & path_is("Object", "ConditionalFormatting", "Item") & has_ancestor("LayoutCatalog"))
    item = nodes.where((F.col("tag") == "Item") & path_is("Object", "ConditionalFormatting")).select(F.col("doc").alias("_id"), F.col("pre").alias("_ip"), _or_empty("flags").alias("item_flags"))
    css = nodes.where((F.col("tag") == "LocalCSS") & path_is("Item", "Format", "Styles")).groupBy(F.col("doc").alias("_cd"), parent_pre(3).alias("_ci")).agg(F.min_by(strip(F.col("text")), "pre").alias("css"))
    one = _with(c.withColumn("object_pre", parent_pre(3)).withColumn("layout_pre", nearest("Layout")), _calcs(nodes)).where("calculation is not null")
    one = one.join(item, (F.col("doc") == F.col("_id")) & (F.col("parent") == F.col("_ip"))).join(css, (F.col("doc") == F.col("_cd")) & (F.col("parent") == F.col("_ci")), "left")
    return _lifted(nodes, one).select("doc", "file", "layout", "layout_id", "pre", "object_name", "object_type", _or_empty("op").alias("condition_type"), F.col("item_flags").alias("flags"), F.col("calculation").alias("formula"), F.coalesce("css", F.lit("")).alias("format_css"))


def hide_rules(nodes: DataFrame) -> DataFrame:
    h = nodes.where((F.col("tag") == "HideCondition") & (parent_tag() == "Object") & has_ancestor("LayoutCatalog"))
    one = _with(h.withColumn("object_pre", parent_pre()).withColumn("layout_pre", nearest("Layout")), _calcs(nodes)).where("calculation is not null")
    return _lifted(nodes, one).select("doc", "file", "layout", "layout_id", "pre", "object_name", "object_type", F.col("calculation").alias("formula"))


def _lifted(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds the object's name and type and the layout's name and id."""
    o = layout_objects(nodes).select(F.col("doc").alias("_od"), F.col("pre").alias("_op"), F.col("name").alias("object_name"), F.col("type").alias("object_type"))
    t = layouts(nodes).select(F.col("doc").alias("_ld"), F.col("pre").alias("_lp"), F.col("name").alias("layout"), F.col("id").alias("layout_id"))
    return rows.join(o, (F.col("doc") == F.col("_od")) & (F.col("object_pre") == F.col("_op"))).join(t, (F.col("doc") == F.col("_ld")) & (F.col("layout_pre") == F.col("_lp")))


# --- scripts ------------------------------------------------------------------------------------------------------


def scripts(nodes: DataFrame, dashes: bool = False) -> DataFrame:
    """Scripts of the catalog, at its root and in groups. A script inside a step is a call, not a script."""
    s = nodes.where((F.col("tag") == "Script") & within("ScriptCatalog"))
    content = nodes.where((F.col("tag") == "Step") & path_is("Script", "StepList")).select("doc", parent_pre(2).alias("owner")).distinct().withColumn("has_steps", F.lit(True))
    folder = folder_of(nodes, ("Script",)).withColumnRenamed("pre", "owner")
    dash = strip(_or_empty("name")) == "-"
    one = _with(_with(s, content), folder)
    one = one if dashes else one.where(~dash)
    return one.select(
        "doc", "file", "pre", attr("id").alias("id"), _or_empty("name").alias("name"), "folder", (_or_empty("includeInMenu") == "True").alias("in_menu"), (attr("runFullAccess") == "True").alias("run_full_access"),
        dash.alias("is_dash_named"), (dash & F.col("has_steps").isNull()).alias("is_separator"),
    )


def script_steps(nodes: DataFrame) -> DataFrame:
    """Steps in order with their structured parameters; ``type_id`` is the kind of step, (script, step_line) its identity."""
    s = nodes.where((F.col("tag") == "Step") & path_is("Script", "StepList") & has_ancestor("ScriptCatalog")).withColumn("script_pre", parent_pre(2))
    kid = nodes.where((parent_tag() == "Step") & has_ancestor("ScriptCatalog")).withColumn("owner", F.col("parent"))
    is_ = lambda t: F.col("tag") == t
    parts = kid.groupBy("doc", "owner").agg(
        _first(_nonempty(strip(F.col("text"))), is_("StepText")).alias("step_text"),
        _first(_or_empty("name"), is_("Script")).alias("script"), _first(_nonempty(attr("id")), is_("Script")).alias("script_id"),
        _first(_or_empty("name"), is_("FileReference")).alias("external_file"), _first(_or_empty("name"), is_("Layout")).alias("layout"),
        F.min(F.when(is_("Field"), F.col("pre"))).alias("field_pre"), _first(_or_empty("name"), is_("Field")).alias("field_name"),
        _first(_nonempty(strip(F.col("text"))), is_("Name")).alias("variable"),
        *(_first(_true(attr("state")), is_(t)).alias(t.lower()) for t in ("Select", "Restore", "NoInteract")),
    )
    value = nodes.where((F.col("tag") == "Text") & path_is("Step", "Value")).withColumn("owner", parent_pre(2)).groupBy("doc", "owner").agg(F.min_by(strip(F.col("text")), "pre").alias("value"))
    # a field reference may name its table and field by elements of its own
    inner = nodes.where(F.col("tag").isin("Table", "Field") & path_is("Step", "Field")).groupBy(F.col("doc").alias("_fd"), F.col("parent").alias("_fp")).agg(
        _first(_or_empty("name"), is_("Table")).alias("_table"), _first(_or_empty("name"), is_("Field")).alias("_field")
    )
    one = _with(_with(_with(s, parts), value), _calcs(nodes)).join(inner, (F.col("doc") == F.col("_fd")) & (F.col("field_pre") == F.col("_fp")), "left")
    name = F.coalesce("_field", "field_name")
    field = F.when(name != "", F.when(F.coalesce("_table", F.lit("")) != "", F.concat("_table", F.lit("::"), name)).otherwise(name))
    names = ("script", "script_id", "external_file", "layout", "field", "calculation", "variable", "value", "select", "restore", "nointeract")
    one = one.withColumn("field", field).withColumn("value", _nonempty(F.col("value")))
    some = F.coalesce(*(F.when(F.col(n).isNotNull(), F.lit(True)) for n in names), F.lit(False))
    line = F.row_number().over(Window.partitionBy("doc", "script_pre").orderBy("pos"))
    owner = scripts(nodes, dashes=True).select(F.col("doc").alias("_sd"), F.col("pre").alias("_sp"), F.col("id").alias("of_script_id"), F.col("name").alias("of_script"))
    one = one.withColumn("step_line", line).join(owner, (F.col("doc") == F.col("_sd")) & (F.col("script_pre") == F.col("_sp")))
    return one.select("doc", "file", "script_pre", "of_script_id", "of_script", "pre", "step_line", attr("id").alias("type_id"), _or_empty("name").alias("name"), F.coalesce(attr("enable"), F.lit("True")).alias("enable"), "step_text", F.when(some, F.struct(*names)).alias("params"))


# --- value lists, security, functions, sources --------------------------------------------------------------------


def _paths(nodes: DataFrame) -> DataFrame:
    """(doc, owner, paths) of each file reference: its attribute, then listed paths, then universal ones."""
    own = nodes.where((F.col("tag") == "FileReference") & attr("pathList").isNotNull()).select("doc", F.col("pre").alias("owner"), F.lit(0).alias("k"), "pre", attr("pathList").alias("x"))
    listed = nodes.where((F.col("tag") == "Path") & path_is("FileReference", "PathList")).select("doc", parent_pre(2).alias("owner"), F.lit(1).alias("k"), "pre", F.coalesce("text", attr("value")).alias("x"))
    direct = nodes.where(F.col("tag").isin("PathList", "UniversalPathList") & (parent_tag() == "FileReference") & F.col("text").isNotNull()).select("doc", F.col("parent").alias("owner"), F.when(F.col("tag") == "PathList", 1).otherwise(2).alias("k"), "pre", F.col("text").alias("x"))
    one = own.unionByName(listed).unionByName(direct).withColumn("x", path_list(F.col("x")))
    return one.groupBy("doc", "owner").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "pre", "x"))), lambda s: s["x"])).alias("paths"))


def value_lists(nodes: DataFrame) -> DataFrame:
    """A tagged union: custom, field, external, or what the source is called; a list of unknown source keeps its structure only."""
    v = nodes.where((F.col("tag") == "ValueList") & (parent_tag() == "ValueListCatalog"))
    below = nodes.where(path_is("ValueListCatalog", "ValueList") | has_ancestor("ValueListCatalog")).withColumn("owner", F.try_element_at(F.filter("anc", lambda x: x["tag"] == "ValueList"), F.lit(1))["pre"]).where("owner is not null")
    d2 = lambda *p: path_is("ValueListCatalog", "ValueList", *p)
    t = lambda n: F.col("tag") == n
    pair = F.struct(_or_empty("table").alias("table"), _or_empty("name").alias("field"))
    parts = below.groupBy("doc", "owner").agg(
        _first(_or_empty("value"), t("Source") & d2()).alias("source"), _first(F.col("attrs"), t("Source") & d2()).alias("source_attrs"),
        _first(_or_empty("name"), t("FileReference")).alias("external_file"),
        _first(F.col("text"), t("Text") & d2("CustomValues")).alias("custom"),
        _first(pair, t("Field") & d2("PrimaryField")).alias("primary"), _first(_or_empty("show"), t("PrimaryField") & d2()).alias("primary_show"),
        _first(pair, t("Field") & d2("SecondaryField")).alias("secondary"), _first(_or_empty("show"), t("SecondaryField") & d2()).alias("secondary_show"),
        _first(_or_empty("value"), t("ShowRelated") & d2()).alias("show_related"), _first(_or_empty("name"), t("Table") & d2("ShowRelated")).alias("related_table"),
        _first(F.struct(_or_empty("name").alias("name"), _or_empty("id").alias("id"), F.col("pre").alias("pre")), t("FileReference") & d2("External")).alias("reference"),
        _first(F.struct(attr("id").alias("id"), attr("name").alias("name")), t("ValueList") & d2("External")).alias("external_list"),
        F.transform(F.sort_array(F.collect_list(F.when(d2() & ~t("Source"), F.struct("pre", "tag")))), lambda x: x["tag"]).alias("elements"),
        F.transform(F.sort_array(F.collect_list(F.when(d2("Source"), F.struct("pre", "tag")))), lambda x: x["tag"]).alias("source_children"),
    )
    paths = _paths(nodes).select(F.col("doc").alias("_pd"), F.col("owner").alias("_po"), "paths")
    one = _with(v, parts).join(paths, (F.col("doc") == F.col("_pd")) & (F.col("reference.pre") == F.col("_po")), "left")
    src = F.coalesce("source", F.lit(""))
    field, ext = src == "Field", src == "External"
    values = F.filter(F.transform(F.split(strip(F.col("custom")), "\n"), strip), lambda x: x != "")
    known = src.isin("Custom", "Field", "External")
    return one.select(
        "doc", "file", "pre", attr("id").alias("id"), attr("name").alias("name"), F.when(src != "", F.lower(src)).otherwise("unknown").alias("type"), "external_file",
        F.when(src == "Custom", values).alias("values"),
        F.when(field, F.col("primary.table")).alias("primary_table"), F.when(field, F.col("primary.field")).alias("primary_field"), F.when(field & F.col("primary").isNotNull(), F.col("primary_show")).alias("primary_show"),
        F.when(field, F.col("secondary.table")).alias("secondary_table"), F.when(field, F.col("secondary.field")).alias("secondary_field"), F.when(field & F.col("secondary").isNotNull(), F.col("secondary_show")).alias("secondary_show"),
        F.when(field & (F.col("show_related") == "True"), F.col("related_table")).alias("show_related_from"),
        F.when(ext, F.struct(F.col("reference.name").alias("name"), F.col("reference.id").alias("id"))).alias("external_file_reference"), F.when(ext, F.col("paths")).alias("paths"), F.when(ext, F.col("external_list")).alias("external_value_list"),
        F.when(~known, F.lit(True)).alias("unparsed"), F.when(~known, F.struct(F.coalesce("source_attrs", F.create_map().cast("map<string,string>")).alias("attributes"), F.coalesce("source_children", F.array().cast("array<string>")).alias("children"))).alias("source_shape"),
        F.when(~known, F.coalesce("elements", F.array().cast("array<string>"))).alias("elements"),
    )


def accounts(nodes: DataFrame) -> DataFrame:
    a = nodes.where((F.col("tag") == "Account") & (parent_tag() == "AccountCatalog"))
    return a.select("doc", "file", "pre", attr("id").alias("id"), attr("name").alias("name"), attr("status").alias("status"), attr("privilegeSet").alias("privilege_set"), attr("emptyPassword").alias("empty_password"))


FLAGS = ("menu", "printing", "exporting", "idleDisconnect", "manageAccounts", "managedExtended", "allowModifyPassword", "overrideValidationWarning", "comment")


def privilege_sets(nodes: DataFrame) -> DataFrame:
    """Privilege sets with their flags and coarse grants; finer grants are relations of their own."""
    p = nodes.where((F.col("tag") == "PrivilegeSet") & (parent_tag() == "PrivilegesCatalog"))
    kid = nodes.where(path_is("PrivilegesCatalog", "PrivilegeSet")).withColumn("owner", F.col("parent"))
    grant = F.struct(_or_empty("value").alias("value"), _or_empty("allowCreation").alias("allow_creation"))
    parts = kid.groupBy("doc", "owner").agg(_first(_or_empty("value"), F.col("tag") == "Records").alias("records"), *(_first(grant, F.col("tag") == t).alias(n) for t, n in (("Layouts", "layouts"), ("Scripts", "scripts"), ("ValueLists", "value_lists"))))
    flags = F.map_filter("attrs", lambda k, v: k.isin(*FLAGS))
    return _with(p, parts).select("doc", "file", "pre", attr("id").alias("id"), attr("name").alias("name"), flags.alias("flags"), "records", "layouts", "scripts", "value_lists")


def record_grants(nodes: DataFrame) -> DataFrame:
    """One row per privilege set and table: create, view, edit, delete, field access, and the formulas of limited grants."""
    b = nodes.where((F.col("tag") == "BaseTable") & path_is("PrivilegeSet", "Records", "TableList"))
    kid = nodes.where(path_is("Records", "TableList", "BaseTable")).withColumn("owner", F.col("parent"))
    ops = ("Create", "View", "Edit", "Delete")
    values = [_first(_or_empty("value"), F.col("tag") == t).alias(n) for t, n in zip((*ops, "FieldAccess"), ("create", "view", "edit", "delete", "field_access"))]
    parts = kid.groupBy("doc", "owner").agg(*values)
    calc = calculations(nodes).select(F.col("doc").alias("_d"), F.col("owner").alias("_o"), "calculation")
    limited = kid.where(F.col("tag").isin(*ops)).join(calc, (F.col("doc") == F.col("_d")) & (F.col("pre") == F.col("_o"))).where("calculation is not null")
    formulas = limited.groupBy("doc", "owner").agg(*(_first(F.col("calculation"), F.col("tag") == t).alias(f"{t.lower()}_calculation") for t in ops))
    one = _with(_with(b, parts), formulas)
    order = F.row_number().over(Window.partitionBy("doc", parent_pre(3)).orderBy("pre"))
    return one.select("doc", "file", parent_pre(3).alias("set_pre"), "pre", order.alias("ord"), _or_empty("name").alias("table"), *(F.coalesce(n, F.lit("")).alias(n) for n in ("create", "view", "edit", "delete", "field_access")), *(f"{t.lower()}_calculation" for t in ops))


def field_grants(nodes: DataFrame) -> DataFrame:
    f = nodes.where((F.col("tag") == "Field") & path_is("TableList", "BaseTable", "FieldAccess", "FieldList") & has_ancestor("PrivilegeSet"))
    return f.select("doc", "file", nearest("PrivilegeSet").alias("set_pre"), nearest("BaseTable").alias("grant_pre"), "pre", _or_empty("name").alias("field"), _or_empty("accessRestriction").alias("restriction"))


def layout_grants(nodes: DataFrame) -> DataFrame:
    g = nodes.where((F.col("tag") == "Layout") & path_is("PrivilegeSet", "Layouts", "LayoutList"))
    kid = nodes.where(path_is("Layouts", "LayoutList", "Layout")).withColumn("owner", F.col("parent"))
    parts = kid.groupBy("doc", "owner").agg(_first(_or_empty("value"), F.col("tag") == "LayoutAccess").alias("access"), _first(_or_empty("value"), F.col("tag") == "DataAccess").alias("data_access"))
    return _with(g, parts).select("doc", "file", nearest("PrivilegeSet").alias("set_pre"), "pre", _or_empty("id").alias("id"), _or_empty("name").alias("layout"), F.coalesce("access", F.lit("")).alias("access"), F.coalesce("data_access", F.lit("")).alias("data_access"))


def custom_functions(nodes: DataFrame) -> DataFrame:
    f = nodes.where((F.col("tag") == "CustomFunction") & (parent_tag() == "CustomFunctionCatalog"))
    return _with(f, calculations(nodes)).select("doc", "file", "pre", attr("id").alias("id"), attr("name").alias("name"), _or_empty("parameters").alias("parameters"), F.coalesce(attr("visible"), F.lit("True")).alias("visible"), "calculation", "refs")


def data_sources(nodes: DataFrame) -> DataFrame:
    """File references first, then ODBC sources, each in document order."""
    d = nodes.where(F.col("tag").isin("FileReference", "OdbcDataSource") & (parent_tag() == "ExternalDataSourcesCatalog"))
    file = F.col("tag") == "FileReference"
    return _with(d, _paths(nodes)).select("doc", "file", "pre", F.when(file, "filemaker").otherwise("odbc").alias("type"), _or_empty("id").alias("id"), _or_empty("name").alias("name"), F.when(file, attr("link")).alias("link"), F.when(file, F.col("paths")).alias("paths"), F.when(~file, _or_empty("DSN")).alias("dsn"))


def generic_items(nodes: DataFrame) -> DataFrame:
    """Items of the catalogs that have no relation of their own: every element with an id, through named groups and id-less wrappers.

    (doc, file, catalog, pre, tag, id, name, folder): the folder names those groups and wrappers."""
    own = ("BaseTableCatalog", "RelationshipGraph", "LayoutCatalog", "ScriptCatalog")
    catalog = F.try_element_at("anc", F.lit(3))
    item = nodes.where((F.size("anc") >= 3) & (F.try_element_at("anc", F.lit(2))["tag"] == "File") & ~catalog["tag"].isin(*own))
    ids = nodes.where(attr("id").isNotNull() & (F.col("tag") != "Group")).select(F.col("doc").alias("_d"), F.col("pre").alias("_p"))
    holders = item.where(attr("id").isNotNull() & (F.col("tag") != "Group"))
    # an item inside another item is part of it
    inside = holders.select("doc", "pre", F.explode(F.slice("anc", 4, F.size("anc"))).alias("a")).join(ids, (F.col("doc") == F.col("_d")) & (F.col("a.pre") == F.col("_p"))).select("doc", "pre").distinct()
    out = holders.join(inside, ["doc", "pre"], "left_anti").select("doc", "file", catalog["tag"].alias("catalog"), "pre", "tag", attr("id").alias("id"), attr("name").alias("name"), "anc")
    groups = nodes.where(F.col("tag") == "Group").select(F.col("doc").alias("_gd"), F.col("pre").alias("_gp"), attr("name").alias("_gn"))
    up = out.select("doc", "pre", F.posexplode(F.slice("anc", 4, F.size("anc"))).alias("at", "a")).join(groups, (F.col("doc") == F.col("_gd")) & (F.col("a.pre") == F.col("_gp")), "left")
    folder = up.groupBy(F.col("doc").alias("_fd"), F.col("pre").alias("_fp")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("_gn", "a.tag").alias("n")))), lambda x: x["n"]).alias("folder"))
    both = out.join(folder, (F.col("doc") == F.col("_fd")) & (F.col("pre") == F.col("_fp")), "left")
    return both.select("doc", "file", "catalog", "pre", "tag", "id", "name", F.coalesce("folder", F.array().cast("array<string>")).alias("folder"))
