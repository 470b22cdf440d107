"""Which application file a reference means, and what that says about a set of files.

A name is matched in tiers: the exact file name, the name without extension, the same without letter case; only the best tier
counts, and two files in it are an ambiguity that is reported and not guessed. A reference tries its own paths in order, then the
data source of that name; a name alone decides only where there is no path at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shalework.functions.text import path_target, strip_extension
from shalework.operators import entities as E

HIT = "struct<resolved_to:string,resolved_via:string,matched_path:string,candidates:array<string>>"


def match_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, hits): for each distinct name the known files of its best tier, sorted.

    All tiers agree on the lower-case name without extension, so one equi-join finds every candidate."""
    stem = lambda c: F.lower(strip_extension(c))
    a = names.select("name").where("name <> ''").distinct().withColumn("_k", stem(F.col("name")))
    b = known.select(F.col("file").alias("_f")).distinct().withColumn("_k2", stem(F.col("_f")))
    same = F.when(F.col("name") == F.col("_f"), 1).when(strip_extension(F.col("name")) == strip_extension(F.col("_f")), 2).otherwise(3)
    hit = a.join(b, F.col("_k") == F.col("_k2")).withColumn("tier", same)
    best = Window.partitionBy("name")
    return hit.withColumn("_t", F.min("tier").over(best)).where("tier = _t").groupBy("name").agg(F.sort_array(F.collect_set("_f")).alias("hits"))


def _hit(hits: Column, via: str, path: Column | None = None) -> Column:
    one = F.size(hits) == 1
    made = F.struct(F.when(one, hits[0]).alias("resolved_to"), F.lit(via).alias("resolved_via"), (path if path is not None else F.lit(None).cast("string")).alias("matched_path"), F.when(~one, hits).alias("candidates"))
    return F.when(F.size(hits) > 0, made)


def _none() -> Column:
    return F.struct(*(F.lit(None).cast("string").alias(n) for n in ("resolved_to", "resolved_via", "matched_path")), F.lit(None).cast("array<string>").alias("candidates"))


def _by_path(rows: DataFrame, key: list[str], names: DataFrame) -> DataFrame:
    """(key..., by_path): the first path that matches a file decides, also if it is ambiguous."""
    p = rows.select(*key, F.posexplode("paths").alias("pos", "path")).withColumn("name", path_target(F.col("path")))
    hit = p.join(names, "name").withColumn("h", _hit(F.col("hits"), "path", F.col("path")))
    return hit.groupBy(*key).agg(F.min_by("h", "pos").alias("by_path"))


def _names(*columns: DataFrame) -> DataFrame:
    out = columns[0]
    for c in columns[1:]:
        out = out.unionByName(c)
    return out


def _targets(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("paths").alias("p")).select(path_target(F.col("p")).alias("name"))


def resolve_sources(sources: DataFrame, known: DataFrame) -> DataFrame:
    """Each data source (file, id, name, paths) with its resolution (struct ``to``)."""
    hits = match_names(_names(sources.select("name"), _targets(sources)), known)
    named = hits.select(F.col("name").alias("_n"), F.col("hits").alias("_h"))
    one = sources.join(_by_path(sources, ["file", "id"], hits), ["file", "id"], "left").join(named, F.col("name") == F.col("_n"), "left")
    no_path = F.coalesce(F.size("paths"), F.lit(0)) <= 0
    to = F.coalesce(F.col("by_path"), F.when(no_path, _hit(F.col("_h"), "name_fallback")), _none())
    return one.withColumn("to", to).drop("by_path", "_n", "_h")


def resolve(refs: DataFrame, sources: DataFrame, known: DataFrame) -> DataFrame:
    """``refs`` (ref_id, file, name, paths) with resolved_to, resolved_via, matched_path and candidates."""
    by_name = resolve_sources(sources, known)
    first = by_name.withColumn("_n", F.row_number().over(Window.partitionBy("file", "name").orderBy("id"))).where("_n = 1")
    first = first.select(F.col("file").alias("_f"), F.col("name").alias("_sn"), F.col("to").alias("by_source"))
    hits = match_names(_names(refs.select("name"), _targets(refs)), known)
    named = hits.select(F.col("name").alias("_hn"), F.col("hits").alias("_h"))
    one = refs.join(_by_path(refs, ["ref_id"], hits), "ref_id", "left")
    one = one.join(first, (F.col("file") == F.col("_f")) & (F.col("name") == F.col("_sn")), "left").join(named, F.col("name") == F.col("_hn"), "left")
    no_path = F.coalesce(F.size("paths"), F.lit(0)) <= 0
    to = F.coalesce(F.col("by_path"), F.col("by_source"), F.when(no_path, _hit(F.col("_h"), "name_fallback")), _none())
    return one.withColumn("_to", to).select(*refs.columns, "_to.*")


# --- a set of files -----------------------------------------------------------------------------------------------

def file_references(nodes: DataFrame) -> DataFrame:
    """(ref_id, kind, origin, file, name, paths, about): every reference to another file.

    Kinds: table_occurrence, script_call (of a step, or of a button whose action performs a script), value_list and
    external_data_source. A value list's own paths are tried first, here as everywhere."""
    nil = F.lit(None).cast("string")
    to = E.occurrences(nodes).where("external_file is not null").select(
        "file", F.lit("table_occurrence").alias("kind"), nil.alias("origin"), F.col("external_file.name").alias("name"), F.lit(None).cast("array<string>").alias("paths"), "doc", "pre",
        F.to_json(F.struct(F.col("name").alias("to_name"), "base_table")).alias("about"),
    )
    call = E.script_steps(nodes).where("params.external_file is not null").select(
        "file", F.lit("script_call").alias("kind"), F.lit("script_step").alias("origin"), F.col("params.external_file").alias("name"), F.lit(None).cast("array<string>").alias("paths"), "doc", "pre",
        F.to_json(F.struct(F.col("of_script").alias("script"), F.col("of_script_id").alias("script_id"), F.col("name").alias("step"), "step_line", F.coalesce("params.script", F.lit("")).alias("calls_script"), F.col("params.script_id").alias("calls_script_id"))).alias("about"),
    )
    lay = E.layouts(nodes).select(F.col("doc").alias("_d"), F.col("pre").alias("_p"), F.col("name").alias("layout"), F.col("id").alias("layout_id"))
    button = E.buttons(nodes).where("external_file is not null and startswith(action, 'Perform Script')").join(lay, (F.col("doc") == F.col("_d")) & (F.col("layout_pre") == F.col("_p"))).select(
        "file", F.lit("script_call").alias("kind"), F.lit("button").alias("origin"), F.col("external_file").alias("name"), F.lit(None).cast("array<string>").alias("paths"), "doc", "pre",
        F.to_json(F.struct("layout", "layout_id", "button_type", "object_key", "object_name", F.col("action").alias("step"), F.coalesce("script", F.lit("")).alias("calls_script"), F.col("script_id").alias("calls_script_id"))).alias("about"),
    )
    lists = E.value_lists(nodes).where("external_file is not null").select("file", F.lit("value_list").alias("kind"), nil.alias("origin"), F.col("external_file").alias("name"), "paths", "doc", "pre", F.to_json(F.struct(F.col("name").alias("value_list"), "id")).alias("about"))
    eds = E.data_sources(nodes).where("type = 'filemaker'").select("file", F.lit("external_data_source").alias("kind"), nil.alias("origin"), "name", "paths", "doc", "pre", F.to_json(F.struct("id", "link")).alias("about"))
    return to.unionByName(call).unionByName(button).unionByName(lists).unionByName(eds).withColumn("ref_id", F.concat_ws("#", "kind", "doc", F.col("pre").cast("string")))


def topology(nodes: DataFrame) -> DataFrame:
    """Every reference to another file with its resolution; unresolved ones have no ``resolved_to``."""
    known = nodes.where((F.col("tag") == "File") & (F.col("depth") == 1)).select("file").distinct()
    sources = E.data_sources(nodes).where("type = 'filemaker'").select("file", "id", "name", "paths")
    return resolve(file_references(nodes), sources, known)


def file_counts(nodes: DataFrame) -> DataFrame:
    """(file, what, n): how many entities of each kind a file holds."""
    parts = {
        "tables": E.tables(nodes), "table_occurrences": E.occurrences(nodes), "relationships": E.relationships(nodes), "layouts": E.layouts(nodes), "scripts": E.scripts(nodes),
        "value_lists": E.value_lists(nodes), "custom_functions": E.custom_functions(nodes), "conditional_formatting": E.conditional_formats(nodes), "hide_conditions": E.hide_rules(nodes),
    }
    files = nodes.where((F.col("tag") == "File") & (F.col("depth") == 1)).select("file").distinct()
    rows = _names(*(d.select("file", F.lit(k).alias("what")) for k, d in parts.items()))
    n = rows.groupBy("file", "what").agg(F.count("*").alias("n"))
    every = files.select("file", F.explode(F.array(*map(F.lit, parts))).alias("what"))
    return every.join(n, ["file", "what"], "left").select("file", "what", F.coalesce("n", F.lit(0)).alias("n"))


def merged_occurrences(nodes: DataFrame) -> DataFrame:
    """Occurrences of all files; one whose base table lives elsewhere is marked external with the file it resolves to."""
    t = topology(nodes).where("kind = 'table_occurrence'").select(F.col("doc").alias("_d"), F.col("pre").alias("_p"), "resolved_to", "resolved_via", "candidates")
    o = E.occurrences(nodes).join(t, (F.col("doc") == F.col("_d")) & (F.col("pre") == F.col("_p")), "left").drop("_d", "_p")
    external = F.col("external_file").isNotNull()
    return o.withColumn("external", F.when(external, F.lit(True))).withColumn("unresolved", F.when(external & F.col("resolved_to").isNull(), F.lit(True)))


def merged_value_lists(nodes: DataFrame) -> DataFrame:
    """Value lists of all files with the file they resolve to and the base tables behind their occurrences."""
    t = topology(nodes).where("kind = 'value_list'").select(F.col("doc").alias("_d"), F.col("pre").alias("_p"), "resolved_to", "resolved_via", "matched_path", "candidates")
    v = E.value_lists(nodes).join(t, (F.col("doc") == F.col("_d")) & (F.col("pre") == F.col("_p")), "left").drop("_d", "_p")
    o = merged_occurrences(nodes)
    base_file = F.when(F.col("external"), F.col("resolved_to")).otherwise(F.col("file"))
    one = o.groupBy(F.col("file").alias("_f"), F.col("name").alias("_to")).agg(F.max_by(F.struct(F.col("base_table").alias("t"), base_file.alias("f")), F.struct("doc", "pre")).alias("b"))
    for side in ("primary", "secondary"):
        v = v.join(one, (F.col("file") == F.col("_f")) & (F.col(f"{side}_table") == F.col("_to")), "left").withColumn(f"{side}_base_table", F.col("b.t")).withColumn(f"{side}_base_table_file", F.col("b.f")).drop("_f", "_to", "b")
    return v.withColumn("unresolved", F.when(F.col("external_file").isNotNull() & F.col("resolved_to").isNull(), F.lit(True)))


def merged_privilege_sets(nodes: DataFrame) -> DataFrame:
    """One row per privilege-set name. Names are shared between files, contents are not: the top record is one file's whole
    record, that of the file with the most table grants (ties: the first file by document), else the first with any access, else
    the first; all files' records are kept in ``by_file``."""
    p = E.privilege_sets(nodes)
    grants = E.record_grants(nodes).groupBy(F.col("doc").alias("_d"), F.col("set_pre").alias("_s")).agg(F.count("*").alias("grants"))
    p = p.join(grants, (F.col("doc") == F.col("_d")) & (F.col("pre") == F.col("_s")), "left").withColumn("grants", F.coalesce("grants", F.lit(0)))
    access = F.col("records").isNotNull() | F.col("layouts").isNotNull() | F.col("scripts").isNotNull() | F.col("value_lists").isNotNull()
    record = F.struct("file", "id", "flags", "records", "layouts", "scripts", "value_lists", "grants")
    order = F.struct("doc", "pre")
    # the least of (fewest grants first negated, access, document order)
    rank = F.struct((-F.col("grants")).alias("g"), (~access).cast("int").alias("a"), order.alias("o"))
    earlier = lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0)
    return p.groupBy("name").agg(F.min_by(record, rank).alias("top"), F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), record.alias("r"))), earlier), lambda x: x["r"]).alias("by_file")).select("name", F.col("top.file").alias("access_source_file"), "top", "by_file")
