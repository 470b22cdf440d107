"""Questions about a solution, answered by its relations: who uses what, what calls what, what a relationship is for, who may do what.

Every answer is a union of typed edges or an aggregate over them. Edges are keyed by file and id, since ids repeat between files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shalework.functions.text import live_code
from shalework.operators import entities as E
from shalework.operators import rendering, resolution
from shalework.operators.calculations import calculations
from shalework.operators.nodes import attr, has_ancestor, nearest, parent_pre, parent_tag
from shalework.operators.status import base_tables, reference_rows
from shalework.session import cut


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- holders and uses ---------------------------------------------------------------------------------------------


def holders(nodes: DataFrame) -> DataFrame:
    """(doc, pre, h_kind, h_id, h_name, file, live): the catalog object each element belongs to; live is false in disabled steps."""
    it = rendering.items(nodes).select(F.col("doc").alias("_d"), F.col("pre").alias("_p"), F.col("kind").alias("h_kind"), F.col("id").alias("h_id"), F.col("name").alias("h_name"))
    n = nodes.join(it, (F.col("doc") == F.col("_d")) & (F.col("pre") == F.col("_p")), "left")
    so_far = Window.partitionBy("doc").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_p").isNotNull(), F.struct("post", "h_kind", "h_id", "h_name")), ignorenulls=True).over(so_far)
    off = F.last(F.when((F.col("tag") == "Step") & (F.coalesce(attr("enable"), F.lit("True")) != "True"), F.struct("pre", "post")), ignorenulls=True).over(so_far)
    n = n.withColumn("o", last).withColumn("off", off)
    live = ~F.coalesce((F.col("pre") >= F.col("off.pre")) & (F.col("pre") <= F.col("off.post")), F.lit(False))
    return n.where("o is not null and pre <= o.post").select("doc", "file", "pre", F.col("o.h_kind").alias("h_kind"), F.col("o.h_id").alias("h_id"), F.col("o.h_name").alias("h_name"), live.alias("live"))


def _held(rows: DataFrame, h: DataFrame) -> DataFrame:
    x = h.select(F.col("doc").alias("_d"), F.col("pre").alias("_p"), F.col("file").alias("h_file"), "h_kind", "h_id", "h_name", "live")
    return rows.join(x, (F.col("doc") == F.col("_d")) & (F.col("pre") == F.col("_p"))).drop("_d", "_p")


def field_uses(nodes: DataFrame) -> DataFrame:
    """(file, ref, h_kind, h_id, h_name, live): who uses a field, by ``TO::field#id``, in calculations and as an element."""
    h = holders(nodes)
    in_calc = calculations(nodes).select("doc", F.col("owner").alias("pre"), F.explode("refs").alias("ref")).where("ref like '%#%'")
    element = nodes.where((F.col("tag") == "Field") & (F.coalesce(attr("table"), F.lit("")) != "") & ~has_ancestor("DisplayCalculation"))
    element = element.select("doc", "pre", F.concat(attr("table"), F.lit("::"), F.coalesce(attr("name"), F.lit("None")), F.lit("#"), F.coalesce(attr("id"), F.lit("None"))).alias("ref"))
    return _held(in_calc.unionByName(element), h).select("h_file", "ref", "h_kind", "h_id", "h_name", "live").withColumnRenamed("h_file", "file").distinct()


def inverted_index(uses: DataFrame) -> DataFrame:
    """(file, ref, users, n): the sorted distinct users of each reference."""
    return uses.groupBy("file", "ref").agg(F.sort_array(F.collect_set(F.concat_ws("/", "h_kind", "h_id"))).alias("users"), F.count("*").alias("n"))


# --- calls --------------------------------------------------------------------------------------------------------


def script_calls(nodes: DataFrame) -> DataFrame:
    """(to_file, to_id, to_name, from_file, h_kind, h_id, h_name, origin, live): every structured call of a script, by steps, buttons,
    triggers, menus and options; to_file is null where the called file is not in the set."""
    refs = reference_rows(nodes).where("tag = 'Script'").select("doc", "pre", "id", "name", "target_file", "step_pre")
    tags = nodes.where(F.col("tag") == "Script").select(F.col("doc").alias("_td"), F.col("pre").alias("_tp"), has_ancestor("ScriptCatalog").alias("by_step"), has_ancestor(*E.BUTTONS).alias("by_button"), has_ancestor("PrivilegeSet").alias("in_set"))
    r = refs.join(tags, (F.col("doc") == F.col("_td")) & (F.col("pre") == F.col("_tp"))).where("not in_set")
    origin = F.when(F.col("by_button"), "button").when(F.col("by_step"), "script_step").when(F.col("step_pre").isNotNull(), "step").otherwise("trigger")
    one = _held(r.withColumn("origin", origin), holders(nodes))
    return one.select(F.col("target_file").alias("to_file"), F.col("id").alias("to_id"), F.col("name").alias("to_name"), F.col("h_file").alias("from_file"), "h_kind", "h_id", "h_name", "origin", "live")


def calls_by_name(nodes: DataFrame) -> DataFrame:
    """(file, script_id, name, h_kind, h_id): scripts whose quoted name stands in the text of a calculation or step elsewhere.

    The quoted literals of all texts are taken apart and joined to the names, so there is no test of every name on every text."""
    h = holders(nodes)
    t = nodes.where(F.col("tag").isin("Calculation", "StepText") & F.contains("text", F.lit('"'))).select("doc", "file", "pre", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit('"([^"]+)"'), F.lit(1)))).alias("name"))
    structured = nodes.where((F.col("tag") == "Script") & (parent_tag() == "Step")).select(F.col("doc").alias("_sd"), F.col("parent").alias("_sp"), attr("name").alias("_sn")).distinct()
    t = t.join(structured, (F.col("doc") == F.col("_sd")) & (F.col("name") == F.col("_sn")), "left_anti")
    s = E.scripts(nodes).select(F.col("file").alias("_f"), F.col("id").alias("script_id"), F.col("name").alias("_n"))
    hit = t.join(s, (F.col("file") == F.col("_f")) & (F.col("name") == F.col("_n")))
    return _held(hit, h).where("not (h_kind = 'scripts' and h_id = script_id)").select("file", "script_id", "name", "h_kind", "h_id").distinct()


def script_callers(nodes: DataFrame) -> DataFrame:
    """(file, id, name, callers, reason): callers of each script; where there is none, why one may still exist."""
    calls = script_calls(nodes).where("live").groupBy(F.col("to_file").alias("_f"), F.col("to_id").alias("_i")).agg(F.sort_array(F.collect_set(F.concat_ws("/", "from_file", "h_kind", "h_id"))).alias("callers"))
    named = calls_by_name(nodes).groupBy(F.col("file").alias("_nf"), F.col("script_id").alias("_ni")).agg(F.sort_array(F.collect_set(F.concat(F.concat_ws("/", "h_kind", "h_id"), F.lit(" (by name)")))).alias("named"))
    s = E.scripts(nodes)
    one = s.join(calls, (F.col("file") == F.col("_f")) & (F.col("id") == F.col("_i")), "left").join(named, (F.col("file") == F.col("_nf")) & (F.col("id") == F.col("_ni")), "left")
    nobody = F.array().cast("array<string>")
    callers = F.concat(F.coalesce("callers", nobody), F.coalesce("named", nobody))
    reason = F.when(F.size(callers) > 0, F.lit(None)).when(F.col("in_menu"), "none found (in Scripts menu)").when(F.lower("name").rlike("schedul|nightly|daily|hourly|server|robot|batch"), "none found (name suggests server schedule)").otherwise("none found")
    return one.select("file", "id", "name", callers.alias("callers"), reason.alias("reason"))


def function_calls(nodes: DataFrame) -> DataFrame:
    """(file, function, custom, h_kind, h_id): functions that calculations call."""
    h = holders(nodes)
    c = calculations(nodes).select("doc", F.col("owner").alias("pre"), F.explode("refs").alias("ref")).where("ref like 'cf:%' or ref like 'fn:%'")
    return _held(c, h).select(F.col("h_file").alias("file"), F.substring("ref", 4, 1000).alias("function"), F.startswith("ref", F.lit("cf:")).alias("custom"), "h_kind", "h_id").distinct()


def function_collisions(nodes: DataFrame) -> DataFrame:
    """(file, name, with): custom functions that share their name, in any case, with a builtin in use or a parameter."""
    f = E.custom_functions(nodes)
    used = function_calls(nodes).where("not custom").select("file", F.lower("function").alias("_k"), F.lit("builtin").alias("with"))
    params = f.select("file", F.explode(F.split("parameters", r"\s*;\s*")).alias("p")).where("p <> ''").select("file", F.lower("p").alias("_k"), F.lit("parameter").alias("with"))
    return f.select("file", "name", F.lower("name").alias("_k")).join(used.unionByName(params).distinct(), ["file", "_k"]).select("file", "name", "with").distinct()


def recursive_functions(nodes: DataFrame, rounds: int = 40) -> DataFrame:
    """(file, name): functions that reach themselves. Paths are doubled each round, so ``rounds`` bounds the logarithm of a cycle; an error
    beyond. First only functions stay that are called by and call one that stays: what is on no way from a cycle to a cycle falls away."""
    edge = function_calls(nodes).where("custom and h_kind = 'custom-functions'")
    names = E.custom_functions(nodes).select("file", F.col("id").alias("h_id"), F.col("name").alias("a"))
    e = cut(edge.join(names, ["file", "h_id"]).select("file", "a", F.col("function").alias("b")).distinct())
    n = e.count()
    while n:
        called, calls = e.select("file", F.col("b").alias("a")).distinct(), e.select("file", F.col("a").alias("b")).distinct()
        e = cut(e.join(called, ["file", "a"], "left_semi").join(calls, ["file", "b"], "left_semi").select("file", "a", "b"))
        m = e.count()
        if m == n:
            break
        n = m
    for _ in range(rounds):
        step = e.select("file", F.col("a").alias("b"), F.col("b").alias("c"))
        e = cut(e.unionByName(e.join(step, ["file", "b"]).select("file", "a", F.col("c").alias("b"))).distinct())
        m = e.count()
        if m == n:
            return e.where("a = b").select("file", F.col("a").alias("name"))
        n = m
    raise RuntimeError("the calls of functions did not settle")


def duplicate_functions(nodes: DataFrame) -> DataFrame:
    """(body, functions): equal bodies in several files."""
    f = E.custom_functions(nodes).where("calculation is not null").select(F.sha2("calculation", 256).alias("body"), F.struct("file", "name").alias("f"))
    return f.groupBy("body").agg(F.sort_array(F.collect_set("f")).alias("functions")).where("size(functions) > 1")


def layout_openers(nodes: DataFrame) -> DataFrame:
    """(file, layout_id, h_kind, h_id): live references that open a layout; grants of privilege sets are none."""
    r = reference_rows(nodes).where("tag = 'Layout'").select("doc", "pre", "id", "target_file")
    inside = nodes.where((F.col("tag") == "Layout") & has_ancestor("PrivilegeSet")).select("doc", "pre")
    return _held(r.join(inside, ["doc", "pre"], "left_anti"), holders(nodes)).where("live").select(F.col("target_file").alias("file"), F.col("id").alias("layout_id"), "h_kind", "h_id").distinct()


# --- the relationship graph ---------------------------------------------------------------------------------------


def occurrence_use(nodes: DataFrame) -> DataFrame:
    """(file, name, use): what each table occurrence is used for, several values, ``unused`` if nothing uses it."""
    row = lambda d, use, col="name": d.select("file", F.col(col).alias("name"), F.lit(use).alias("use")).where("name <> ''")
    field = nodes.where((F.col("tag") == "Field") & (F.coalesce(attr("table"), F.lit("")) != "")).withColumn("t", attr("table"))
    calc = has_ancestor("DisplayCalculation")
    parts = [
        row(E.layouts(nodes), "layout-context", "table"), row(E.portals(nodes), "portal", "table"),
        row(field.where(~calc & has_ancestor("LayoutCatalog") & ~has_ancestor("PortalObj", "Step")), "lookup", "t"), row(field.where(~calc & has_ancestor("Lookup")), "lookup", "t"),
        row(field.where(has_ancestor("FilterCalc")), "filter", "t"), row(field.where(calc & ~has_ancestor("FilterCalc")), "calculation", "t"),
        row(field.where(~calc & has_ancestor("Step")), "script-context", "t"), row(field.where(has_ancestor("ValueListCatalog")), "value-list", "t"),
        row(field.where(has_ancestor("PrivilegeSet")), "security", "t"), row(field.where(has_ancestor("CustomMenuCatalog")), "menu", "t"),
    ]
    uses = _union(*parts).distinct()
    return E.occurrences(nodes).select("file", "name").distinct().join(uses, ["file", "name"], "left").select("file", "name", F.coalesce("use", F.lit("unused")).alias("use"))


def occurrence_relationships(nodes: DataFrame) -> DataFrame:
    """(file, name, relationships): ids of the relationships that touch an occurrence; one with itself twice."""
    r = E.relationships(nodes).select("file", "id", "pre", F.explode(F.array_compact(F.array("left_table", "right_table"))).alias("name"))
    return r.groupBy("file", "name").agg(F.transform(F.sort_array(F.collect_list(F.struct("pre", "id"))), lambda x: x["id"]).alias("relationships"))


def key_evidence(nodes: DataFrame) -> DataFrame:
    """(file, table, field, evidence): serial, uuid, unique, or parent (the side of an equality that others match)."""
    f = E.fields(nodes).where("global is null")
    row = lambda d, e: d.select("file", F.col("table_name").alias("table"), F.col("name").alias("field"), F.lit(e).alias("evidence"))
    uuid = F.lower(F.regexp_replace(F.coalesce("auto_enter.calculation", F.lit("")), r"\s", "")).rlike(r"get\(uuid(number)?\)")
    return _union(row(f.where("auto_enter.serial is not null"), "serial"), row(f.where(uuid), "uuid"), row(f.where("unique"), "unique")).distinct()


def relationship_meaning(nodes: DataFrame) -> DataFrame:
    """(file, id, meaning, fk_candidate): the first that fits of cartesian, constant, global-match, self-join, filter, identity; and
    whether the key match may be a foreign key: yes, no or needs-profile."""
    rel = E.relationships(nodes)
    p = E.predicates(nodes).join(rel.select(F.col("doc").alias("_d"), F.col("pre").alias("_p"), "left_table", "right_table", F.col("id").alias("rel_id")), (F.col("doc") == F.col("_d")) & (F.col("rel_pre") == F.col("_p")))
    tos = base_tables(nodes)
    one = tos.groupBy(F.col("file").alias("_f"), F.col("to_name").alias("_t")).agg(F.min(F.struct("base_file", "base_table_id")).alias("base"))
    f = E.fields(nodes)
    fixed = F.coalesce(F.col("auto_enter.value") == "ConstantData", F.lit(False)) | F.coalesce(F.trim("calculation").rlike(r'^(-?\d+(\.\d+)?|"[^"]*")$'), F.lit(False))
    unique = F.coalesce("unique", F.lit(False))
    known = f.groupBy(F.col("file").alias("_ff"), F.col("table_id").alias("_ti"), F.col("name").alias("_fn")).agg(F.min(F.struct(fixed.alias("fixed"), F.coalesce("global", F.lit(False)).alias("global"), unique.alias("unique"))).alias("f"))
    for side in ("left", "right"):
        p = p.join(one.select(F.col("_f"), F.col("_t"), F.col("base").alias(f"{side}_base")), (F.col("file") == F.col("_f")) & (F.col(f"{side}_table") == F.col("_t")), "left").drop("_f", "_t")
        p = p.join(known.withColumnRenamed("f", f"{side}_f"), (F.col(f"{side}_base.base_file") == F.col("_ff")) & (F.col(f"{side}_base.base_table_id") == F.col("_ti")) & (F.col(f"{side}_field") == F.col("_fn")), "left").drop("_ff", "_ti", "_fn")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    g = p.groupBy("file", "doc", "rel_pre", "rel_id").agg(
        F.max(F.col("operator") == "CartesianProduct").alias("cartesian"), F.min(yes("left_f.fixed") & yes("right_f.fixed")).alias("constant"), F.max(yes("left_f.fixed") | yes("right_f.fixed")).alias("half_constant"),
        F.max(yes("left_f.global") | yes("right_f.global")).alias("global"), F.max(F.coalesce(F.col("left_base") == F.col("right_base"), F.lit(False))).alias("self"), F.count("*").alias("n"),
        F.max(~F.lower("operator").isin("equal")).alias("inequality"), F.max(yes("left_f.unique") | yes("right_f.unique")).alias("unique"),
    )
    meaning = F.when(F.col("cartesian"), "cartesian").when(F.col("constant"), "constant").when(F.col("global"), "global-match").when(F.col("self"), "self-join").when(F.col("inequality") | (F.col("n") > 1) | F.col("half_constant"), "filter").otherwise("identity")
    can = (meaning == "identity") | ((meaning == "self-join") & (F.col("n") == 1) & ~F.col("inequality"))
    fk = F.when(~can, "no").when(F.col("unique"), "yes").otherwise("needs-profile")
    return g.select("file", F.col("rel_id").alias("id"), meaning.alias("meaning"), fk.alias("fk_candidate"))


# --- counts -------------------------------------------------------------------------------------------------------


def table_census(nodes: DataFrame) -> DataFrame:
    """(file, table, fields, regular, calculated, summary, global, container, repeating, logic) of each table."""
    f = E.fields(nodes)
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("bigint")
    g = F.coalesce("global", F.lit(False))
    logic = F.col("calculation").isNotNull() | F.col("auto_enter").isNotNull() | F.col("not_empty").isNotNull() | F.col("unique").isNotNull() | (F.col("field_type") == "Summary")
    return f.groupBy("file", F.col("table_id"), F.col("table_name").alias("table")).agg(
        F.count("*").alias("fields"), n((F.col("field_type") == "Normal") & ~g).alias("regular"), n(F.col("field_type") == "Calculated").alias("calculated"), n(F.col("field_type") == "Summary").alias("summary"),
        n(g).alias("global"), n(F.col("data_type") == "Binary").alias("container"), n(F.col("repetitions") > 1).alias("repeating"), n(logic).alias("logic"),
    )


def layout_census(nodes: DataFrame) -> DataFrame:
    """(file, layout_id, what, n): hide rules, conditional formats, triggers, buttons, tooltips and portals on each layout."""
    what = {"HideCondition": "hide_rules", "Item": "conditional_formats", "Trigger": "triggers", "ToolTip": "tooltips", "PortalObj": "portals"} | {b: "buttons" for b in E.BUTTONS}
    pick = F.create_map(*(F.lit(x) for kv in what.items() for x in kv))
    n = nodes.where(F.col("tag").isin(*what) & has_ancestor("LayoutCatalog") & ((F.col("tag") != "Item") | (parent_tag() == "ConditionalFormatting"))).select("doc", nearest("Layout").alias("_p"), pick[F.col("tag")].alias("what"))
    lay = E.layouts(nodes).select("doc", F.col("pre").alias("_p"), "file", F.col("id").alias("layout_id"))
    return n.join(lay, ["doc", "_p"]).groupBy("file", "layout_id", "what").agg(F.count("*").alias("n"))


def format_effects(nodes: DataFrame) -> DataFrame:
    """Conditional formats with their effect: hide (huge text or no opacity), style, none; disabled where the rule is off."""
    css = F.col("format_css")
    huge = F.coalesce(F.regexp_extract(css, r"font-size:\s*([0-9.]+)pt", 1).try_cast("double"), F.lit(0.0)) >= 400
    clear = css.rlike(r"rgba\([^)]*,\s*0(\.0+)?\s*\)")
    off = F.col("flags").try_cast("int").bitwiseAND(F.lit(1)) == 0
    return E.conditional_formats(nodes).withColumn("effect", F.when(F.coalesce(off, F.lit(False)), "disabled").when(huge | clear, "hide").when(css == "", "none").otherwise("style"))


# --- security -----------------------------------------------------------------------------------------------------


def crud_matrix(nodes: DataFrame) -> DataFrame:
    """(file, privilege_set, table, letters): C V E D where allowed, with * where a formula limits it, - where denied; tables that
    share the most common setting are one row ``*``."""
    g = E.record_grants(nodes)
    letter = lambda col, x: F.when(F.col(f"{col}_calculation").isNotNull() | (F.col(col) == "Limited"), f"{x}*").when(F.lower(col).isin("true", "yes", "modifiable", "full"), x).otherwise("-")
    rows = g.withColumn("letters", F.concat(letter("create", "C"), letter("view", "V"), letter("edit", "E"), letter("delete", "D")))
    s = E.privilege_sets(nodes).select(F.col("doc").alias("_d"), F.col("pre").alias("_p"), F.col("name").alias("privilege_set"))
    rows = rows.join(s, (F.col("doc") == F.col("_d")) & (F.col("set_pre") == F.col("_p"))).select("file", "privilege_set", "table", "letters")
    n = rows.groupBy("file", "privilege_set", "letters").agg(F.count("*").alias("n"))
    usual = n.groupBy("file", "privilege_set").agg(F.max_by("letters", F.struct("n", "letters")).alias("usual"), F.max("n").alias("times"))
    both = rows.join(usual, ["file", "privilege_set"])
    rest = both.where("letters <> usual or times = 1").select("file", "privilege_set", "table", "letters")
    return rest.unionByName(usual.where("times > 1").select("file", "privilege_set", F.lit("*").alias("table"), F.col("usual").alias("letters")))


#: The channel an extended privilege opens.
CHANNELS = {
    "fmapp": "desktop", "fmwebdirect": "web", "fmiwp": "web", "fmrest": "rest-api", "fmodata": "odata", "fmxml": "xml-api", "fmphp": "php-api", "fmodbc": "odbc", "fmxdbc": "odbc",
    "fmextscriptaccess": "script-access", "fmurlscript": "url-script",
}


def channels(nodes: DataFrame) -> DataFrame:
    p = nodes.where(parent_tag() == "ExtendedPrivilegeCatalog")
    table = F.create_map(*(F.lit(x) for kv in CHANNELS.items() for x in kv))
    name = F.lower(F.coalesce(attr("name"), F.lit("")))
    return p.select("file", attr("id").alias("id"), attr("name").alias("name"), F.coalesce(table[name], F.when(name.rlike(r"^fmreauthenticate\d*$"), "session-rule"), F.lit("custom")).alias("channel"))


def privilege_bypass(nodes: DataFrame) -> DataFrame:
    """(file, kind, what, name): scripts that run with full access, removed menu commands, file authorizations, fields named as flags."""
    s = E.scripts(nodes).where("run_full_access").select("file", F.lit("scripts").alias("kind"), F.lit("full access").alias("what"), "name")
    m = nodes.where(has_ancestor("CustomMenuCatalog") & (F.coalesce(attr("enable"), attr("enabled"), F.lit("True")) == "False")).select("file", F.lit("custom-menus").alias("kind"), F.lit("removed command").alias("what"), F.coalesce(attr("name"), F.lit("")).alias("name"))
    a = nodes.where((parent_tag() == "AuthFileCatalog") | (has_ancestor("AuthFileCatalog") & attr("id").isNotNull())).select("file", F.lit("auth-files").alias("kind"), F.lit("authorization").alias("what"), F.coalesce(attr("name"), F.lit("")).alias("name"))
    f = E.fields(nodes).where(F.lower("name").rlike(r"(^|_)(is_?admin|can_|may_|allow|permission|privilege|role)")).select("file", F.lit("tables").alias("kind"), F.lit("flag in data").alias("what"), F.concat("table_name", F.lit("::"), "name").alias("name"))
    return _union(s, m, a, f)


def authorization_gaps(nodes: DataFrame) -> DataFrame:
    """(file, layout, table, field): fields that only a hide rule guards, with neither field nor record grant on their table."""
    hid = nodes.where((F.col("tag") == "HideCondition") & (parent_tag() == "Object") & has_ancestor("LayoutCatalog")).select("doc", parent_pre().alias("pre"))
    f = E.layout_fields(nodes).join(hid, ["doc", "pre"], "left_semi")
    base = base_tables(nodes).select(F.col("file").alias("_f"), F.col("to_name").alias("_t"), "base_table_id")
    t = E.tables(nodes).select(F.col("file").alias("_tf"), F.col("id").alias("_ti"), F.col("name").alias("base_name"))
    f = f.join(base, (F.col("file") == F.col("_f")) & (F.col("table") == F.col("_t")), "left").join(t, (F.col("file") == F.col("_tf")) & (F.col("base_table_id") == F.col("_ti")), "left")
    limited = E.record_grants(nodes).where("view_calculation is not null or lower(view) in ('false', 'limited') or field_access = 'Limited'").select(F.col("file").alias("_gf"), F.col("table").alias("_gt")).distinct()
    lay = E.layouts(nodes).select(F.col("doc").alias("_ld"), F.col("pre").alias("_lp"), F.col("name").alias("layout"))
    open_ = f.join(limited, (F.col("file") == F.col("_gf")) & (F.coalesce("base_name", "table") == F.col("_gt")), "left_anti")
    return open_.join(lay, (F.col("doc") == F.col("_ld")) & (F.col("layout_pre") == F.col("_lp"))).select("file", "layout", "table", "field").distinct()


# --- value lists, menus, effects ----------------------------------------------------------------------------------


def value_list_use(nodes: DataFrame) -> DataFrame:
    """(file, id, h_kind, h_id): active uses of value lists; a list that a validation keeps although it is switched off is none."""
    r = reference_rows(nodes).where("tag = 'ValueList'").select("doc", "pre", "id", "target_file")
    off = nodes.where((F.col("tag") == "Validation") & (attr("valuelist") == "False")).select(F.col("doc").alias("_vd"), F.col("pre").alias("_vp"))
    at = nodes.where(F.col("tag") == "ValueList").select(F.col("doc").alias("_d"), F.col("pre").alias("_p"), F.col("parent").alias("_up"))
    inactive = at.join(off, (F.col("_d") == F.col("_vd")) & (F.col("_up") == F.col("_vp"))).select(F.col("_d").alias("doc"), F.col("_p").alias("pre"))
    return _held(r.join(inactive, ["doc", "pre"], "left_anti"), holders(nodes)).where("live").select(F.col("target_file").alias("file"), "id", "h_kind", "h_id").distinct()


def menu_summary(nodes: DataFrame) -> DataFrame:
    """(file, id, name, items, overrides): what a custom menu holds; an item with a step replaces its command."""
    m = nodes.where(parent_tag() == "CustomMenuCatalog").select("doc", F.col("pre").alias("_p"), "file", attr("id").alias("id"), attr("name").alias("name"))
    i = nodes.where(has_ancestor("CustomMenuCatalog") & F.col("tag").rlike("MenuItem$")).select("doc", F.try_element_at("anc", F.lit(4))["pre"].alias("_p"), "pre")
    steps = nodes.where((F.col("tag") == "Step") & has_ancestor("CustomMenuCatalog")).select("doc", F.explode(F.transform("anc", lambda x: x["pre"])).alias("pre")).distinct().withColumn("own", F.lit(1))
    n = i.join(steps, ["doc", "pre"], "left").groupBy("doc", "_p").agg(F.count("*").alias("items"), F.count("own").alias("overrides"))
    return m.join(n, ["doc", "_p"], "left").select("file", "id", "name", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("overrides", F.lit(0)).alias("overrides"))


def menu_set_installers(nodes: DataFrame) -> DataFrame:
    r = reference_rows(nodes).where("tag = 'CustomMenuSet'").select("doc", "pre", "id", "target_file")
    return _held(r, holders(nodes)).where("live").select(F.col("target_file").alias("file"), "id", "h_kind", "h_id").distinct()


def unclaimed_kinds(objects: DataFrame, claimed: list[str]) -> DataFrame:
    return objects.where(~F.col("kind").isin(*claimed)).groupBy("file", "kind").agg(F.count("*").alias("objects"))


#: Steps with an effect outside the file.
EXTERNAL_STEPS = (
    "Insert from URL", "Send Mail", "Export Records", "Import Records", "Save Records as PDF", "Save Records as Excel", "Perform Script on Server", "Execute SQL", "Open URL", "Set Web Viewer",
    "Perform JavaScript in Web Viewer", "Export Field Contents", "Send Event", "Dial Phone", "Create Data File", "Open Data File", "Write to Data File", "Read from Data File", "Delete File", "Rename File", "Print",
)


def external_effects(nodes: DataFrame) -> DataFrame:
    """(file, script_id, step_line, effect): enabled steps and live calculations that reach outside; comments in calculations do not count."""
    s = E.script_steps(nodes).where("enable = 'True'")
    step = s.where(F.col("name").isin(*EXTERNAL_STEPS)).select("file", F.col("of_script_id").alias("script_id"), "step_line", F.col("name").alias("effect"))
    code = live_code(F.coalesce("params.calculation", F.lit("")))
    sql = s.where(code.rlike(r"(?i)\bExecuteSQL\s*\(")).select("file", F.col("of_script_id").alias("script_id"), "step_line", F.lit("ExecuteSQL").alias("effect"))
    plugin = s.where(code.rlike(r"\bMBS\s*\(|<Function Missing>")).select("file", F.col("of_script_id").alias("script_id"), "step_line", F.lit("plugin").alias("effect"))
    return _union(step, sql, plugin).distinct()


#: Steps that open and close a block.
OPENS, CLOSES = ("If", "Loop"), ("End If", "End Loop")


def block_depths(steps: DataFrame, script: list[str], line: str, name: str) -> DataFrame:
    """Adds ``depth``: how many blocks are open before the step (a closing step counts itself out)."""
    change = F.when(F.col(name).isin(*OPENS), 1).when(F.col(name).isin(*CLOSES), -1).otherwise(0)
    before = Window.partitionBy(*script).orderBy(line).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("depth", F.coalesce(F.sum(change).over(before), F.lit(0)) - F.when(F.col(name).isin(*CLOSES), 1).otherwise(0))


def unreachable_steps(nodes: DataFrame) -> DataFrame:
    """(file, script_id, step_line, after): enabled steps behind an unconditional exit of their script."""
    s = E.script_steps(nodes).where("enable = 'True'")
    d = block_depths(s, ["doc", "script_pre"], "step_line", "name")
    ends = F.when(F.col("name").isin("Exit Script", "Halt Script") & (F.col("depth") == 0), F.col("step_line"))
    first = F.min(ends).over(Window.partitionBy("doc", "script_pre"))
    return d.withColumn("after", first).where("step_line > after").select("file", F.col("of_script_id").alias("script_id"), "step_line", "after")


#: Steps that write fields or delete records, and those that find records.
WRITES = ("Set Field", "Set Field By Name", "Insert Text", "Insert Calculated Result", "Replace Field Contents", "Insert from URL", "Relookup Field Contents", "Set Next Serial Value", "Clear")
DELETES = ("Delete Record/Request", "Delete Record", "Delete All Records", "Delete Portal Row", "Truncate Table")
FINDS = ("Perform Find", "Perform Quick Find", "Show All Records", "Go to Related Record", "Constrain Found Set", "Extend Found Set")


def read_write_sets(nodes: DataFrame) -> DataFrame:
    """(file, script_id, step_line, access, target, scope): fields that steps read and write and records they delete.

    The scope is the state the step runs in: find mode (a criterion, hence a read), a record just made, the found set of the last
    find, or the current record; a field of another occurrence than the script's last layout's is related."""
    s = E.script_steps(nodes).where("enable = 'True'")
    w = Window.partitionBy("doc", "script_pre").orderBy("step_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mode = F.when(F.col("name") == "Enter Find Mode", "find").when(F.col("name").isin("Perform Find", "Enter Browse Mode", "Perform Quick Find", "Constrain Found Set", "Extend Found Set"), "browse")
    s = s.withColumn("mode", F.last(mode, ignorenulls=True).over(w)).withColumn("found", F.last(F.when(F.col("name").isin(*FINDS), F.col("step_line")), ignorenulls=True).over(w))
    s = s.withColumn("made", F.last(F.when(F.col("name") == "New Record/Request", F.struct(F.lit(True).alias("new"))).when(F.col("name").isin("Go to Record/Request/Page", *FINDS), F.struct(F.lit(False).alias("new"))), ignorenulls=True).over(w))
    find = F.coalesce(F.col("mode") == "find", F.lit(False))
    scope = F.when(find, "find criterion").when(F.col("name") == "Set Field By Name", "by name").when(F.col("name").isin("Replace Field Contents", "Delete All Records"), F.concat(F.lit("found set"), F.coalesce(F.concat(F.lit(" from step "), F.col("found").cast("string")), F.lit(" on entry")))).when(F.coalesce("made.new", F.lit(False)), "new record").when(F.col("found").isNotNull(), F.concat(F.lit("record found in step "), F.col("found").cast("string"))).otherwise("current record")
    key = ["file", F.col("of_script_id").alias("script_id"), "step_line"]
    write = s.where(F.col("name").isin(*WRITES) & F.col("params.field").isNotNull()).select(*key, F.when(find, "read").otherwise("write").alias("access"), F.col("params.field").alias("target"), scope.alias("scope"))
    delete = s.where(F.col("name").isin(*DELETES)).select(*key, F.lit("delete").alias("access"), F.col("name").alias("target"), scope.alias("scope"))
    refs = calculations(nodes).select(F.col("doc").alias("_d"), F.col("owner").alias("_o"), F.explode("refs").alias("ref")).where("ref like '%::%#%'")
    read = s.join(refs, (F.col("doc") == F.col("_d")) & (F.col("pre") == F.col("_o"))).select(*key, F.lit("read").alias("access"), F.col("ref").alias("target"), F.lit("current record").alias("scope"))
    return _union(write, delete, read).distinct()


def background_candidates(nodes: DataFrame) -> DataFrame:
    """(file, id, name, why): scripts that look like jobs: called on a server, started by a timer, or named so."""
    s = E.script_steps(nodes).where("enable = 'True'")
    row = lambda d, why: d.select("file", F.col("params.script_id").alias("id"), F.col("params.script").alias("name"), F.lit(why).alias("why"))
    named = E.scripts(nodes).where(F.lower("name").rlike("schedul|nightly|daily|hourly|weekly|server|robot|batch|cron")).select("file", "id", "name", F.lit("name").alias("why"))
    return _union(row(s.where("name like 'Perform Script on Server%'"), "server call"), row(s.where("name = 'Install OnTimer Script'"), "timer"), named).where("name is not null").distinct()


def discovery_signals(nodes: DataFrame) -> DataFrame:
    """(file, signal, n): what a reviewer has to ask about, counted."""
    un = reference_rows(nodes).where("status is not null").select("file", F.lit("unresolved").alias("signal"))
    alone = script_callers(nodes).where("reason is not null").select("file", F.lit("none found").alias("signal"))
    unused = occurrence_use(nodes).where("use = 'unused'").select("file", F.lit("unused").alias("signal"))
    dead = unreachable_steps(nodes).select("file", F.lit("unreachable").alias("signal"))
    cross = resolution.topology(nodes).where("resolved_to is null").select("file", F.lit("unresolved file").alias("signal"))
    return _union(un, alone, unused, dead, cross).groupBy("file", "signal").agg(F.count("*").alias("n"))


def traceability(cited: DataFrame, owners: DataFrame, rows: DataFrame) -> DataFrame:
    """(problem, id): ids that are cited (``id``) but exist in no owner, and logic rows (``id``, ``disposition``) without a disposition."""
    lost = cited.select("id").distinct().join(owners.select("id").distinct(), "id", "left_anti").select(F.lit("cited, not found").alias("problem"), "id")
    bare = rows.where("disposition is null or trim(disposition) = ''").select(F.lit("no disposition").alias("problem"), "id")
    return lost.unionByName(bare)
