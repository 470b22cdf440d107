"""The relations of a set of files as nested JSON documents, one line each; members without a value are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shalework.operators import entities as E
from shalework.operators import resolution


def _json(df: DataFrame, *columns: Column | str, order: tuple[str, ...] = ("doc", "pre")) -> DataFrame:
    return df.select(*order, F.to_json(F.struct(*columns)).alias("value")).orderBy(*order).select("value")


def _many(df: DataFrame, key: list[str], order: str, name: str, item: Column) -> DataFrame:
    """The rows of each key as one ordered array, under key names that start with an underscore."""
    earlier = lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0)
    out = df.groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("v"))), earlier), lambda x: x["v"]).alias(name))
    return out


def _beside(items: DataFrame, parts: DataFrame, own: list[str], theirs: list[str]) -> DataFrame:
    cond = F.lit(True)
    for a, b in zip(own, theirs):
        cond = cond & (items[a] == parts[f"_{b}"])
    return items.join(parts, cond, "left").drop(*(f"_{b}" for b in theirs))


def specs(nodes: DataFrame) -> dict[str, DataFrame]:
    """Eleven documents by name, each a frame of JSON lines (``value``)."""
    src = F.col("file").alias("source_file")
    f = E.fields(nodes)
    field = F.struct("id", "name", "data_type", "field_type", "comment", "auto_enter", "calculation", F.when(F.col("not_empty").isNotNull() | F.col("unique").isNotNull(), F.struct("not_empty", "unique")).alias("validation"), "global", "index", "repetitions")
    tables = E.tables(nodes)
    for bucket in ("fields", "calculated", "summary", "globals"):
        tables = _beside(tables, _many(f.where(F.col("bucket") == bucket), ["doc", "table_pre"], "pre", bucket, field), ["doc", "pre"], ["doc", "table_pre"])
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(tables.schema[c].dataType)).alias(c)

    layouts = E.layouts(nodes)
    for name, rows, item in (
        ("fields", E.layout_fields(nodes), F.struct("table", "field")), ("portals", E.portals(nodes), F.struct("table", "fields")),
        ("buttons", E.buttons(nodes), F.struct("action", "button_type", "object_key", "object_name", "script", "script_id", "external_file", "description")),
    ):
        layouts = _beside(layouts, _many(rows, ["doc", "layout_pre"], "pre", name, item), ["doc", "pre"], ["doc", "layout_pre"])
    group = lambda c: F.nullif(F.array_join(c, "/"), F.lit(""))
    steps = _many(E.script_steps(nodes), ["doc", "script_pre"], "step_line", "steps", F.struct(F.col("type_id").alias("id"), "name", "enable", "step_text", "params"))
    scripts = _beside(E.scripts(nodes), steps, ["doc", "pre"], ["doc", "script_pre"])

    to, lists = resolution.topology(nodes), resolution.merged_value_lists(nodes)
    counts = resolution.file_counts(nodes).groupBy("file").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("what", "n")))).alias("counts"))
    files = _json(counts.withColumn("kind", F.lit("file")), "kind", F.col("file").alias("name"), "counts", order=("file",))
    refs = _json(to, "kind", "origin", F.col("file").alias("from_file"), F.col("name").alias("reference"), "about", "resolved_to", "resolved_via", "matched_path", F.col("candidates").alias("ambiguous_candidates"), F.when(F.col("resolved_to").isNull(), F.lit(True)).alias("unresolved"))
    security = _json(E.accounts(nodes), F.lit("account").alias("kind"), "id", "name", "status", "privilege_set", "empty_password", src).unionByName(
        _json(resolution.merged_privilege_sets(nodes), F.lit("privilege_set").alias("kind"), "name", "access_source_file", "top", "by_file", order=("name",))
    )
    return {
        "00_topology": files.unionByName(refs),
        "01_tables": _json(tables, "id", "name", "records", *(empty(b) for b in ("fields", "calculated", "summary", "globals")), src),
        "02_table_occurrences": _json(resolution.merged_occurrences(nodes), "id", "name", "base_table", "base_table_id", F.col("external_file").alias("external_file_reference"), "external", F.col("resolved_to").alias("resolved_source_file"), "resolved_via", "unresolved", F.col("candidates").alias("ambiguous_candidates"), src),
        "03_relationships": _json(E.relationships(nodes), "id", "left_table", "right_table", "predicates", "left_options", "right_options", src),
        "04_layouts": _json(layouts, "id", "name", "width", "in_menu", group(F.col("folder")).alias("group"), "table", "fields", "portals", "buttons", src),
        "05_scripts": _json(scripts, "id", "name", F.array_join("folder", "/").alias("group"), "in_menu", "steps", src),
        "06_value_lists": _json(lists, *[c for c in lists.columns if c not in ("doc", "pre", "file")], src),
        "07_security": security,
        "08_custom_functions": _json(E.custom_functions(nodes), "id", "name", "parameters", "visible", "calculation", src),
        "09_conditional_formatting": _json(E.conditional_formats(nodes), "object_name", "object_type", "condition_type", "flags", "formula", "format_css", "layout", "layout_id", src),
        "10_hide_object_when": _json(E.hide_rules(nodes), "object_name", "object_type", "formula", "layout", "layout_id", src),
    }


def write_specs(nodes: DataFrame, folder: str) -> list[str]:
    """Each document as a folder of JSON lines."""
    made = specs(nodes)
    for name, df in made.items():
        df.write.mode("errorifexists").text(f"{folder}/{name}")
    return list(made)
