"""Did everything come through? Counts of codes, raw against emitted counts, and classes of markup that reached no output."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shalework.operators import entities as E
from shalework.operators.nodes import attr, has_ancestor, parent_tag
from shalework.operators.status import SKIPPED

#: Attributes that hold codes.
CODES = (
    "Object@flags", "FieldObj@flags", "FieldObj@inputMode", "FieldObj@keyboardType", "FieldObj@pictFormat", "FieldObj@tableViewVisibility", "FieldObj@displayType", "TextObj@flags",
    "ButtonObj@buttonFlags", "ButtonObj@displayType", "PortalObj@portalFlags", "TabControlObj@tabFlagSet", "TabControlObj@tabJustification", "SlideControlObj@slideFlagSet", "PopoverObj@position",
    "ExternalObj@externalFlagSet", "Condition@op", "Item@flags", "Encryption@type", "Shortcut@key", "Shortcut@modifier", "NewWndStyles@Styles", "NumFormat@flags", "DateFormat@format", "TimeFormat@flags",
    "Trigger@triggerFlags",
)
#: Subtrees and classes that are presentation only.
UNREAD = ("ThemeCatalog", "DisplayCalculation", "CharacterStyle", "ParagraphStyleVector", "LocalTheme", "LocalCSS", "FullCSS", "RenderFormat")
PRESENTATION = (
    "*/CharacterStyleVector@*", "CharacterStyleVector/Style", "CharacterStyleVector/Style@*", "Style/Data@*", "Styles/CustomStyles", "*/Styles", "Layout/Theme@*", "DefaultTheme/Theme*",
    "*/ExtendedAttributes@fontHeight", "*/ExtendedAttributes@graphicFormat", "*/NumFormat@charStyle", "*/DateFormat@charStyle", "*/TimeFormat@charStyle", "FMPReport@*", "/FMPReport",
)


def code_census(nodes: DataFrame, top: int = 20) -> DataFrame:
    """(code, value, n, rest_values, rest_uses): the most common values of each code; one more row sums up the others."""
    names = F.transform(F.map_keys("attrs"), lambda k: F.struct(F.concat(F.col("tag"), F.lit("@"), k).alias("code"), F.col("attrs")[k].alias("value")))
    seen = nodes.select(F.explode(F.filter(names, lambda x: x["code"].isin(*CODES))).alias("x")).groupBy("x.code", "x.value").agg(F.count("*").alias("n"))
    return top_and_rest(seen, "code", "value", "n", top)


def top_and_rest(counts: DataFrame, group: str, value: str, n: str, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(n), value))
    r = counts.withColumn("_r", rank)
    head = r.where(F.col("_r") <= top).select(group, value, n, F.lit(None).cast("bigint").alias("rest_values"), F.lit(None).cast("bigint").alias("rest_uses"))
    rest = r.where(F.col("_r") > top).groupBy(group).agg(F.count("*").alias("rest_values"), F.sum(n).alias("rest_uses"))
    return head.unionByName(rest.select(group, F.lit(None).cast("string").alias(value), F.lit(None).cast("bigint").alias(n), "rest_values", "rest_uses"))


def glob_regex(pattern: str) -> str:
    """A case-sensitive glob whose ``*`` also crosses slashes."""
    special = set(".^$+{}[]()|\\@")
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in pattern) + "$"


def classes(nodes: DataFrame) -> DataFrame:
    """(doc, file, class, seen): every class of markup as ``Parent/Tag``, ``Parent/Tag@attribute`` and ``Parent/Tag#text``."""
    inside = F.exists("anc", lambda x: x["tag"].isin(*UNREAD)) | F.col("tag").isin(*UNREAD)
    key = F.concat(F.coalesce(parent_tag(), F.lit("")), F.lit("/"), F.col("tag"))
    parts = F.concat(F.array(key), F.transform(F.map_keys("attrs"), lambda k: F.concat(key, F.lit("@"), k)), F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.array(F.concat(key, F.lit("#text")))).otherwise(F.array().cast("array<string>")))
    return nodes.where(~inside & (F.col("depth") > 0)).select("doc", "file", F.explode(parts).alias("class")).groupBy("doc", "file", "class").agg(F.count("*").alias("seen"))


def reached_classes(nodes: DataFrame, rendered: DataFrame) -> DataFrame:
    """Classes of the elements that the writer visits: those of ``rendered`` items (doc, pre, post), hidden subtrees apart."""
    top = F.array_append(F.transform("anc", lambda x: x["pre"]), F.col("pre"))
    visible = ~F.exists("anc", lambda x: x["tag"].isin(*SKIPPED)) & ~F.col("tag").isin(*SKIPPED)
    rows = nodes.where(visible).select("*", F.explode(top).alias("_top")).join(rendered.select(F.col("doc").alias("_d"), F.col("pre").alias("_p")), (F.col("doc") == F.col("_d")) & (F.col("_top") == F.col("_p"))).drop("_top", "_d", "_p")
    wrappers = nodes.where(F.col("tag").isin("Group", "File", "TableList", "RelationshipList") | (F.col("depth") <= 2))
    return classes(rows).unionByName(classes(wrappers)).select("doc", "file", "class").distinct()


def uncovered_classes(nodes: DataFrame, reached: DataFrame, excused: tuple[str, ...] = PRESENTATION) -> DataFrame:
    """(file, class, seen) of the classes that no output used and that are not presentation."""
    pardon = F.col("class").rlike("|".join(glob_regex(p) for p in excused)) if excused else F.lit(False)
    return classes(nodes).where(~pardon).join(reached, ["doc", "file", "class"], "left_anti").groupBy("file", "class").agg(F.sum("seen").alias("seen"))


def calculation_coverage(nodes: DataFrame) -> DataFrame:
    """(file, raw, shown): calculations outside themes, and those that an object's text can show."""
    c = nodes.where(F.col("tag") == "Calculation")
    shown = ~F.exists("anc", lambda x: x["tag"].isin(*SKIPPED))
    return c.where(~has_ancestor("ThemeCatalog")).groupBy("file").agg(F.count("*").alias("raw"), F.sum(shown.cast("bigint")).alias("shown"))


def reconcile(nodes: DataFrame) -> DataFrame:
    """(file, what, raw, emitted) where a count of the raw markup differs from the rows of the relation made from it."""
    count = lambda d, what, name: d.groupBy("file").agg(F.count("*").alias(name)).withColumn("what", F.lit(what))
    at = lambda tag, *up: nodes.where((F.col("tag") == tag) & (parent_tag() == up[-1]) & (parent_tag(2) == up[0] if len(up) > 1 else F.lit(True)))
    pairs = [
        ("tables", at("BaseTable", "BaseTableCatalog"), E.tables(nodes)),
        ("table_occurrences", at("Table", "RelationshipGraph", "TableList"), E.occurrences(nodes)),
        ("relationships", at("Relationship", "RelationshipList"), E.relationships(nodes)),
        ("value_lists", at("ValueList", "ValueListCatalog"), E.value_lists(nodes)),
        ("accounts", at("Account", "AccountCatalog"), E.accounts(nodes)),
        ("privilege_sets", at("PrivilegeSet", "PrivilegesCatalog"), E.privilege_sets(nodes)),
        ("custom_functions", at("CustomFunction", "CustomFunctionCatalog"), E.custom_functions(nodes)),
        ("data_sources", nodes.where(F.col("tag").isin("FileReference", "OdbcDataSource") & (parent_tag() == "ExternalDataSourcesCatalog")), E.data_sources(nodes)),
        ("script_steps", at("Step", "StepList").where(has_ancestor("ScriptCatalog") & (parent_tag(2) == "Script")), E.script_steps(nodes)),
    ]
    raw = emitted = None
    for what, r, e in pairs:
        x, y = count(r, what, "raw"), count(e, what, "emitted")
        raw, emitted = (x, y) if raw is None else (raw.unionByName(x), emitted.unionByName(y))
    both = raw.join(emitted, ["file", "what"], "full")
    return both.select("file", "what", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("emitted", F.lit(0)).alias("emitted")).where("raw <> emitted")


def legend(nodes: DataFrame, unresolved: DataFrame) -> str:
    """A short guide to an export: how often each status occurs and which codes, the most common values of each."""
    statuses = {r["status"]: r["count"] for r in unresolved.groupBy("status").count().collect()}
    lines = ["# Legend", "", "Unresolved references by status:", ""] + [f"- {s}: {n}" for s, n in sorted(statuses.items())] + ["", "Codes (value: uses):", ""]
    by: dict[str, list[str]] = {}
    for r in code_census(nodes).orderBy("code", F.desc_nulls_last("n"), "value").collect():
        by.setdefault(r["code"], []).append(f"{r['value']}: {r['n']}" if r["n"] is not None else f"{r['rest_values']} more values, {r['rest_uses']} uses")
    return "\n".join(lines + [f"- {c}: {', '.join(v)}" for c, v in by.items()]) + "\n"


def reports_of_code(nodes: DataFrame, tag: str, name: str) -> DataFrame:
    return nodes.where((F.col("tag") == tag) & attr(name).isNotNull()).select("doc", "file", "pre", attr(name).alias("value"))
