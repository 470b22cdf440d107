"""The relations as temporary views: plain Spark SQL is the query language over a set of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shalework.operators import entities, graph, rendering, resolution, status
from shalework.operators.calculations import calculations

VIEWS = {
    **{f.__name__: f for f in (
        entities.tables, entities.fields, entities.occurrences, entities.predicates, entities.relationships, entities.layouts, entities.layout_objects, entities.layout_fields, entities.portals, entities.buttons,
        entities.conditional_formats, entities.hide_rules, entities.scripts, entities.script_steps, entities.value_lists, entities.accounts, entities.privilege_sets, entities.record_grants, entities.field_grants,
        entities.layout_grants, entities.custom_functions, entities.data_sources, calculations,
    )},
    "reference_status": status.reference_rows, "unresolved": status.unresolved, "topology": resolution.topology, "objects": rendering.objects, "field_uses": graph.field_uses, "script_callers": graph.script_callers,
}


def register(nodes: DataFrame, prefix: str = "") -> list[str]:
    """Registers ``nodes`` and every relation made from it; nothing runs until a view is read."""
    nodes.createOrReplaceTempView(f"{prefix}nodes")
    for name, f in VIEWS.items():
        f(nodes).createOrReplaceTempView(f"{prefix}{name}")
    return [f"{prefix}{n}" for n in ("nodes", *VIEWS)]
