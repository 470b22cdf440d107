"""Catalog objects as ordered lines of text, one text per object, with an index of their hashes.

Nothing walks a tree here. Every element first gets its *facts*: strings that elements below it contribute (its bounds, the text of its first
calculation, the style it names, which of its children hold anything). From its attributes and facts follow its own lines by rules that are
data. An element without lines of its own stays only if one below it has some, which is a semi-join with the ancestors of those that do. The
lines are then put in the order of the document by (place, rank), so a text is one aggregation, and what a reference resolves to comes from joins made before
(:mod:`shalework.operators.status`).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shalework.functions import text as X
from shalework.functions.text import slug
from shalework.operators import entities as E
from shalework.operators import status as S
from shalework.operators.nodes import attr, parent_pre, parent_tag, path_is
from shalework.session import cut
from shalework.sources.reports import folder_names

#: Kinds of the catalogs, and what an object of a kind is called.
KINDS = {
    "ValueListCatalog": "value-lists", "AccountCatalog": "accounts", "PrivilegesCatalog": "privilege-sets", "ExtendedPrivilegeCatalog": "extended-privileges", "AuthFileCatalog": "auth-files",
    "CustomFunctionCatalog": "custom-functions", "ExternalDataSourcesCatalog": "data-sources", "CustomMenuSetCatalog": "custom-menu-sets", "CustomMenuCatalog": "custom-menus", "BaseDirectoryCatalog": "base-directories",
}
TITLES = {
    "tables": "table", "table-occurrences": "table occurrence", "relationships": "relationship", "layouts": "layout", "scripts": "script", "value-lists": "value list", "accounts": "account",
    "privilege-sets": "privilege set", "extended-privileges": "extended privilege", "auth-files": "auth file", "custom-functions": "custom function", "data-sources": "data source",
    "custom-menu-sets": "custom menu set", "custom-menus": "custom menu", "base-directories": "base directory", "file": "file",
}
#: Elements that hold options of a field, and their attributes whose False is worth showing.
OPTION_TAGS = ("AutoEnter", "Validation", "Storage", "NotEmpty", "Unique", "Existing", "StrictValidation", "MaxDataLength")
KEPT_FALSE = ("storeCalculationResults", "allowEditing", "enable")
#: The option that an attribute switches, by the child element that holds its setting.
SWITCHES = {"calculation": "Calculation", "lookup": "Lookup", "constant": "ConstantData", "valuelist": "ValueList", "maxLength": "MaxDataLength"}
#: Codes with a known meaning, defaults that say nothing, formats with their word, the attribute of the default and its values.
DISPLAY_TYPES = {"0": "edit box", "1": "drop-down list", "2": "pop-up menu", "3": "checkbox set", "4": "radio button set", "6": "drop-down calendar"}
TRIGGER_BITS = ((1, "browse"), (2, "find"), (4, "preview"))
DEFAULTS = {"rotation": "0", "flags": "0"}
FORMATS = {"NumFormat": ("number", "flags", ("0", "2304")), "DateFormat": ("date", "format", ("0",)), "TimeFormat": ("time", "flags", ("0", "143"))}
NO_LIST = "True(list-not-named-in-DDR)"

_HIDDEN = (*S.SKIPPED, "DDRInfo", "Bounds")
_PAIR = "array<struct<k:string,v:string>>"
_LINES = "array<string>"


# --- facts --------------------------------------------------------------------------------------------------------


def _tag(*names: str) -> Column:
    return F.col("tag").isin(*names)


def _text() -> Column:
    return F.coalesce(X.strip(F.col("text")), F.lit(""))


def pairs(attrs: Column, order: Column) -> Column:
    """Attributes in the order in which they were written."""
    return F.transform(F.coalesce(order, F.map_keys(attrs)), lambda k: F.struct(k.alias("k"), attrs[k].alias("v")))


def written(attributes: Column) -> Column:
    """`` key=value`` for each attribute."""
    return F.array_join(F.transform(attributes, lambda a: F.concat(F.lit(" "), a["k"], F.lit("="), X.quoted(F.coalesce(a["v"], F.lit(""))))), "")


def _format() -> Column:
    """A number, date or time format that is not the default, as words."""
    word = lambda pick: F.coalesce(*(F.when(_tag(t), F.lit(x)) for t, x in pick.items()))
    plain = reduce(lambda a, b: a | b, (_tag(t) & F.coalesce(attr(key).isin(*values), F.lit(False)) for t, (_, key, values) in FORMATS.items()))
    signs = {"thousandsSep", "decimalPoint"}
    sign = lambda k: (_tag("NumFormat") & k.isin(*signs)) | (~_tag("NumFormat") & (k == "separator"))
    named = F.transform(F.filter(pairs(F.col("attrs"), F.col("attr_order")), lambda a: a["k"] != "charStyle"), lambda a: F.struct(a["k"].alias("k"), F.when(sign(a["k"]), X.char_code(a["v"])).otherwise(a["v"]).alias("v")))
    wanted = F.when(_tag("NumFormat"), F.array(*map(F.lit, sorted(signs, reverse=True)))).otherwise(F.array(F.lit("separator")))
    lacking = F.transform(F.filter(wanted, lambda k: ~F.map_contains_key("attrs", k)), lambda k: F.struct(k.alias("k"), F.lit("").alias("v")))
    return F.when(_tag(*FORMATS) & ~plain, F.concat(word({t: w for t, (w, _, _) in FORMATS.items()}), written(F.concat(named, lacking))))


def _fact(owner: Column, key: Column | str, value: Column, rank: int = 0) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    return F.when(owner.isNotNull() & value.isNotNull(), F.struct(owner.alias("owner"), key.alias("key"), F.lit(rank).alias("rank"), value.alias("value")))


def facts(nodes: DataFrame) -> DataFrame:
    """(doc, owner, facts): what the elements below an element say about it, key -> (first, all values in order)."""
    up, up2, up3 = parent_pre(1), parent_pre(2), parent_pre(3)
    in_extended = parent_tag() == "ExtendedAttributes"
    holds = (F.size("attr_order") > 0) | (_text() != "") | (F.col("post") > F.col("pre"))
    place = F.array_position(F.transform("anc", lambda x: x["tag"]), "DateFormat").cast("int")
    above = lambda k: F.when(place > k, F.try_element_at("anc", place - k))
    of_date = F.when(place > 0, F.when(above(1)["tag"] == "ExtendedAttributes", above(2)["pre"]).otherwise(above(1)["pre"]))
    label = F.try_element_at(F.filter("anc", lambda x: x["tag"] == "TextObj"), F.lit(-1))["pre"]
    styled = F.exists("anc", lambda x: x["tag"] == "CharacterStyleVector")
    css = F.array_join(F.filter(F.transform(X.lines_of(F.col("text")), X.strip), lambda x: F.endswith(x, F.lit(";"))), " ")
    sides = F.array(*(F.bround(F.coalesce(attr(s).cast("double"), F.lit(0.0))).cast("int").cast("string") for s in ("top", "left", "bottom", "right")))
    repeated = F.when(F.coalesce(attr("maxRepetition"), F.lit("1")) != "1", F.concat(F.lit(" rep="), F.coalesce(attr("repetition"), F.lit("None")), F.lit("/"), attr("maxRepetition"))).otherwise("")
    refers = F.when(F.col("status").isNotNull(), F.concat(F.lit(" ref="), F.col("status"))).otherwise("")
    name = F.coalesce(attr("name"), F.lit("None"))
    shown = F.concat(F.col("tag"), F.lit(": "), F.when(_tag("Field"), F.concat(F.coalesce(attr("table"), F.lit("None")), F.lit("::"), name)).otherwise(name), F.lit("#"), F.coalesce(attr("id"), F.lit("None")), F.when(_tag("Field"), repeated).otherwise(""), refers)
    said = [
        _fact(up, F.concat(F.lit("has:"), F.col("tag")), F.when(parent_tag().isin(*OPTION_TAGS) | _tag("Calculation"), F.when(holds, "full").otherwise("empty"))),
        _fact(up, "calculation", F.when(_tag("Calculation"), F.coalesce("text", F.lit("")))), _fact(up, "constant", F.when(_tag("ConstantData"), F.coalesce("text", F.lit("")))),
        _fact(up, "printed", F.when(_tag("StepText"), _text())), _fact(up, "bounds", F.when(_tag("Bounds"), F.array_join(sides, ","))),
        _fact(up3, "style", F.when(_tag("Name") & path_is("Styles", "CustomStyles") & (_text() != ""), _text())),
        *(_fact(F.when(in_extended, up2).otherwise(up), t, F.when(_tag(t), F.coalesce(_format(), F.lit(""))), rank=0) for t in FORMATS),
        *(_fact(of_date, t, F.when(_tag(t), F.coalesce("text", F.lit("")))) for t in ("DateElement", "DateElementSep")),
        _fact(F.try_element_at(F.filter("anc", lambda x: x["tag"] == "Format"), F.lit(-1))["pre"], "css", F.when(_tag("LocalCSS") & (css != ""), css)),
        _fact(label, F.when(styled, "label").otherwise("plain label"), F.when(_tag("Data"), F.coalesce("text", F.lit("")))),
        *(_fact(F.when(path_is("FieldObj", "DDRInfo"), up2), f"shows {t}", F.when(_tag(t), shown)) for t in ("Field", "ValueList")),
    ]
    one = nodes.select("doc", "pre", F.explode(F.array_compact(F.array(*said))).alias("f")).select("doc", "pre", "f.*")
    in_order = F.sort_array(F.collect_list(F.struct("rank", "pre", "value")))
    per = one.groupBy("doc", "owner", "key").agg(F.transform(in_order, lambda x: x["value"]).alias("all"))
    return per.groupBy("doc", "owner").agg(F.map_from_entries(F.collect_list(F.struct("key", "all"))).alias("facts"))


def fact(key: str) -> Column:
    return F.try_element_at(F.col("facts"), F.lit(key))[0]


def fact_list(key: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("facts"), F.lit(key)), F.array().cast(_LINES))


# --- rules --------------------------------------------------------------------------------------------------------


def closed() -> Column:
    """Children of an option element whose setting is kept although the option is off."""
    is_false = lambda a: F.coalesce(attr(a) == "False", F.lit(False))
    off = {tag: is_false(a) & F.coalesce(fact(f"has:{tag}") == "full", F.lit(False)) for a, tag in SWITCHES.items()}
    # a formula beside a constant is in use only if it mirrors the constant; one that no attribute speaks of only if the kind of entry is a calculation
    formula, kind = fact("calculation"), F.lower(F.coalesce(attr("value"), F.lit("")))
    mirrored = X.bare(formula) == X.bare(F.coalesce(fact("constant"), F.lit("")))
    unspoken = attr("calculation").isNull() & (kind != "") & ~F.contains(kind, F.lit("calc"))
    off["Calculation"] = F.when(_tag("AutoEnter") & formula.isNotNull(), F.when(F.coalesce(attr("constant"), F.lit("")) == "True", ~mirrored).otherwise(off["Calculation"] | unspoken)).otherwise(off["Calculation"])
    return F.when(_tag(*OPTION_TAGS), F.array_compact(F.array(*(F.when(c, F.lit(t)) for t, c in off.items())))).otherwise(F.array().cast(_LINES))


def _decoded(a: Column) -> Column:
    """An attribute with its code in words."""
    k, v = a["k"], a["v"]
    kinds = F.create_map(*(F.lit(x) for code, words in DISPLAY_TYPES.items() for x in (code, words.replace(" ", "-"))))
    bits = F.when(v.rlike("^[0-9]+$"), v.try_cast("bigint"))
    modes = F.array_compact(F.array(*(F.when(bits.bitwiseAND(F.lit(bit)) > 0, F.lit(n)) for bit, n in TRIGGER_BITS), F.when(bits.bitwiseAND(F.lit(~sum(b for b, _ in TRIGGER_BITS))) != 0, "?")))
    worded = F.when(_tag("FieldObj") & (k == "displayType"), kinds[v]).when(_tag("Trigger") & (k == "triggerFlags") & bits.isNotNull(), F.array_join(modes, "+"))
    unnamed = _tag("Validation") & (k == "valuelist") & (v == "True") & fact("has:ValueList").isNull()
    return F.struct(k.alias("k"), F.when(unnamed, NO_LIST).otherwise(F.coalesce(F.concat(v, F.lit("("), worded, F.lit(")")), v)).alias("v"))


def shown_attributes(off: Column) -> Column:
    """What of the attributes is worth a place in the line: no defaults, no options that are merely off; then what the facts add."""
    switched = F.create_map(*(F.lit(x) for kv in SWITCHES.items() for x in kv))
    default = lambda a: reduce(lambda x, y: x | y, ((a["k"] == k) & (a["v"] == v) for k, v in DEFAULTS.items())) | ((a["k"] == "Parameter") & fact("has:Calculation").isNotNull())
    quiet = lambda a: _tag(*OPTION_TAGS) & (a["v"] == "False") & ~a["k"].isin(*KEPT_FALSE) & ~F.coalesce(F.array_contains(off, switched[a["k"]]), F.lit(False))
    own = F.transform(F.filter(pairs(F.col("attrs"), F.col("attr_order")), lambda a: ~(default(a) | quiet(a))), _decoded)
    added = F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.alias("v"))) for k, v in (("style", fact("style")), ("bounds", fact("bounds")), ("to", F.col("extra")["to"]), ("base", F.col("extra")["base"]), ("ref", F.col("status")))))
    return F.concat(own, F.array_compact(added)).cast(_PAIR)


def display_line() -> Column:
    """The formats of an element that are not the default, in one line; null where there is none."""
    dates = F.concat(F.lit(" elements="), F.array_join(fact_list("DateElement"), ","), F.lit(" separators="), X.quoted(F.array_join(fact_list("DateElementSep"), "|")))
    parts = F.array(*(F.when(fact(t) != "", F.concat(fact(t), dates if t == "DateFormat" else F.lit(""))) for t in FORMATS))
    return F.concat(F.lit("Display: "), F.nullif(F.array_join(F.array_compact(parts), "; "), F.lit("")))


def _block(text: Column) -> Column:
    return F.transform(X.lines_of(text), lambda x: F.concat(F.lit("  | "), x))


def _some(*lines: Column) -> Column:
    """The lines that are not null."""
    return F.array_compact(F.array(*lines))


def own_lines(printed: Column, off: Column) -> Column:
    """The lines of an element itself, from its own depth on; empty for one that only wraps others.

    ``printed`` is the text of the step round it, without white space and typographic quotes; ``off`` whether its setting is switched off."""
    tag, text, shown = F.col("tag"), _text(), F.col("shown")
    under = lambda line: F.concat(F.lit("  "), line)
    raw = F.rtrim(F.coalesce("text", F.lit("")), F.lit(X.WHITE))
    refs = F.concat(F.lit("refs: "), F.nullif(F.array_join("refs", ", "), F.lit("")))
    repeated = F.coalesce(F.contains(printed, X.normal(raw)), F.lit(False))
    calculation = F.when(repeated, _some(refs)).otherwise(F.concat(F.array(F.concat(F.lit("Calculation"), F.col("raw_pairs"), F.when(off, " (inactive)").otherwise(""), F.lit(":"))), _block(raw), _some(under(refs))))
    label = X.strip(F.array_join(F.when(F.size(fact_list("label")) > 0, fact_list("label")).otherwise(fact_list("plain label")), ""))
    head = F.concat(F.lit("Text"), written(shown))
    several = F.size(X.lines_of(label)) > 1
    text_object = F.concat(F.when(label == "", F.when(F.size(shown) > 0, F.array(head)).otherwise(F.array().cast(_LINES))).when(several, F.concat(F.array(head), _block(label))).otherwise(F.array(F.concat(head, F.lit(": "), X.quoted(label)))), _some(under(display_line())))
    css = F.array_join(fact_list("css"), " ")
    style = F.when((css != "") | (F.size("attr_order") > 0), F.array(F.concat(F.lit("Format"), F.col("raw_pairs"), F.lit(": "), css))).otherwise(F.array().cast(_LINES))
    button = F.array(F.concat(F.lit("Button "), F.col("pos").cast("string"), F.col("raw_pairs"), F.coalesce(F.concat(F.lit(": "), F.nullif(X.one_line(fact("calculation")), F.lit(""))), F.lit(""))))
    printer = F.array(F.concat(F.lit("PlatformData"), F.col("raw_pairs"), F.lit(": ("), F.floor(F.length(text) / 2).cast("string"), F.lit(" bytes of printer settings, not shown)")))
    lead = _some(*(under(F.when(tag == "FieldObj", fact(f"shows {t}"))) for t in ("Field", "ValueList")), under(display_line()))
    long = (F.size(X.lines_of(text)) > 1) | (F.length(text) >= 160)
    title = F.concat(F.when(off, "(inactive) ").otherwise(""), tag, written(shown))
    generic = F.when((F.size(shown) == 0) & (text == "") & (F.size(lead) == 0), F.array().cast(_LINES)).when(text == "", F.concat(F.array(title), lead)).when(long, F.concat(F.array(title), _block(text), lead)).otherwise(F.concat(F.array(F.concat(title, F.lit(": "), text)), lead))
    return F.when(tag == "Calculation", calculation).when(tag == "TextObj", text_object).when(tag == "Format", style).when((tag == "Button") & (parent_tag() == "Buttons"), button).when(tag == "PlatformData", printer).otherwise(generic)


def _step_lines() -> Column:
    """A numbered step: its printed text, its name where there is none; disabled ones marked."""
    on, remark = F.coalesce(attr("enable"), F.lit("True")) == "True", F.coalesce(attr("id"), F.lit("")) == "89"
    said = F.coalesce(F.nullif(fact("printed"), F.lit("")), F.when(remark, "#"), attr("name"), F.lit(""))
    lines = X.lines_of(F.when(~on & F.startswith(said, F.lit("//")), F.ltrim(F.substring(said, F.lit(3), F.length(said)), F.lit(X.WHITE))).otherwise(said))
    number = F.col("step_no").cast("string")
    first = F.concat(F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit(" ")), F.when(on, "    ").otherwise(" // "), lines[0])
    return F.concat(F.array(first), F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.concat(F.lit(" " * 8), x)))


def object_lines(rows: DataFrame) -> DataFrame:
    """(doc, item, body): the lines of every object in order. ``rows`` are the elements of objects: those of :data:`NODES` with item, kind, status, extra, refs."""
    tags = lambda x: x["tag"]
    inside = F.filter("anc", lambda x: x["pre"] >= F.col("item"))
    quiet = (*_HIDDEN, "Format", "PlatformData", "Calculation")
    gone = _tag(*_HIDDEN) | F.exists(inside, lambda x: x["tag"].isin(*quiet)) | F.arrays_overlap(F.transform(inside, tags), F.array(F.lit("Buttons"))) & F.exists(inside, lambda x: x["tag"] == "Button")
    f = facts(rows).withColumnsRenamed({"doc": "_fd", "owner": "_fo"})
    n = rows.join(f, (F.col("doc") == F.col("_fd")) & (F.col("pre") == F.col("_fo")), "left").drop("_fd", "_fo")
    n = n.withColumn("facts", F.coalesce("facts", F.create_map().cast("map<string,array<string>>"))).withColumn("inside", inside).withColumn("closed", closed())
    # of an object's elements the top ones of its text: steps of a script, fields of a table, else the object itself
    listed = F.when(F.col("kind") == "scripts", "Step").when(F.col("kind") == "tables", "Field")
    top_at = F.when(F.col("kind") == "scripts", F.when(F.try_element_at("inside", F.lit(2))["tag"] == "StepList", F.try_element_at("inside", F.lit(3)))).when(F.col("kind") == "tables", F.when(F.try_element_at("inside", F.lit(2))["tag"] == "FieldCatalog", F.try_element_at("inside", F.lit(3))).otherwise(F.try_element_at("inside", F.lit(2))))
    is_top = F.when(F.col("kind") == "scripts", path_is("StepList") & _tag("Step") & (F.size("inside") == 2)).when(F.col("kind") == "tables", _tag("Field") & ((path_is("FieldCatalog") & (F.size("inside") == 2)) | (F.size("inside") == 1))).otherwise(F.size("inside") == 0)
    top = F.when(is_top, F.col("pre")).when(listed.isNull(), F.col("item")).when(top_at["tag"] == listed, top_at["pre"])
    n = n.withColumn("is_top", F.coalesce(is_top, F.lit(False))).withColumn("top", top).where("top is not null")
    # what the element above says: which settings are off, whether a field's name is shown by its id; and the text of the step round it
    said = n.where("size(closed) > 0 or map_contains_key(facts, 'shows Field') or map_contains_key(facts, 'shows ValueList')").select(F.col("doc").alias("_ud"), F.col("pre").alias("_up"), F.col("closed").alias("up_closed"), F.map_keys("facts").alias("up_keys"))
    n = n.join(said, (F.col("doc") == F.col("_ud")) & (F.col("parent") == F.col("_up")), "left").drop("_ud", "_up")
    steps = n.where((F.col("kind") == "scripts") & F.col("is_top"))
    number = F.row_number().over(Window.partitionBy("doc", "item").orderBy("pre"))
    steps = steps.select(F.col("doc").alias("_sd"), F.col("pre").alias("_sp"), number.alias("step_no"), X.normal(F.coalesce(fact("printed"), F.lit(""))).alias("printed"), F.coalesce(attr("id"), F.lit("")).alias("step_type"))
    n = n.join(steps, (F.col("doc") == F.col("_sd")) & (F.col("top") == F.col("_sp")), "left").drop("_sd", "_sp")
    replaced = (parent_tag() == "FieldObj") & ((_tag("Name") & F.array_contains("up_keys", "shows Field")) | (_tag("ValueList") & F.array_contains("up_keys", "shows ValueList")))
    under_step = (F.col("kind") == "scripts") & (F.col("parent") == F.col("top")) & (_tag("StepText") | (_tag("Text") & (F.col("step_type") == "89")))
    n = n.where(~gone & ~F.coalesce(replaced, F.lit(False)) & ~F.coalesce(under_step, F.lit(False)))
    in_script, in_table = F.col("kind") == "scripts", F.col("kind") == "tables"
    step = in_script & F.col("is_top")
    n = n.withColumn("shown", shown_attributes(F.col("closed"))).withColumn("raw_pairs", written(pairs(F.col("attrs"), F.col("attr_order"))))
    off = F.coalesce(F.array_contains("up_closed", F.col("tag")), F.lit(False))
    n = n.withColumn("own", F.when(step, _step_lines()).otherwise(own_lines(F.col("printed"), off)))
    # wrappers stay if something below them does
    below = n.where("size(own) > 0").select(F.col("doc").alias("_wd"), F.explode(F.transform("inside", lambda x: x["pre"])).alias("_wp")).distinct()
    wraps = n.where((F.size("own") == 0) & ~_tag("Calculation", "TextObj", "Format") & ~((F.col("tag") == "Button") & (parent_tag() == "Buttons")))
    kept = wraps.join(below, (F.col("doc") == F.col("_wd")) & (F.col("pre") == F.col("_wp")), "left_semi").withColumn("own", F.array(F.concat(F.when(off, "(inactive) ").otherwise(""), F.col("tag"))))
    n = n.where("size(own) > 0").unionByName(kept)
    top_depth = F.size(F.filter("inside", lambda x: x["pre"] < F.col("top"))) + F.when(F.col("is_top"), F.lit(0)).otherwise(F.lit(0))
    deep = F.size("inside") - top_depth - F.when(in_script, 1).otherwise(0)
    pad = F.when(step, "").otherwise(F.concat(F.when(in_script, F.lit(" " * 8)).otherwise(""), F.repeat(F.lit("  "), F.greatest(deep, F.lit(0)))))
    out = n.select("doc", "item", F.struct(F.col("pre").alias("at"), F.lit(0).alias("rank"), F.transform("own", lambda x: F.concat(pad, x)).alias("lines")).alias("x"))
    # behind each field of a table an empty line, and a note where a formula is due
    due = (F.coalesce(attr("fieldType"), F.lit("")) == "Calculated") & fact("has:Calculation").isNull()
    fields = rows.join(f, (F.col("doc") == F.col("_fd")) & (F.col("pre") == F.col("_fo")), "left").withColumn("inside", inside).where(in_table & _tag("Field") & ((path_is("FieldCatalog") & (F.size("inside") == 2)) | (F.size("inside") == 1)))
    auto = rows.where(_tag("AutoEnter") & (attr("calculation") == "True") & (parent_tag() == "Field")).join(f, (F.col("doc") == F.col("_fd")) & (F.col("pre") == F.col("_fo")), "left").where(F.coalesce(F.map_contains_key("facts", F.lit("has:Calculation")), F.lit(False)) == F.lit(False)).select(F.col("doc").alias("_ad"), F.col("parent").alias("_ap")).distinct()
    ends = fields.join(auto, (F.col("doc") == F.col("_ad")) & (F.col("pre") == F.col("_ap")), "left")
    note = F.when(F.coalesce(due, F.lit(True)) | F.col("_ap").isNotNull(), F.array(F.lit("  (no formula in DDR)"), F.lit(""))).otherwise(F.array(F.lit("")))
    ends = ends.select("doc", "item", F.struct(F.col("post").alias("at"), F.lit(1).alias("rank"), note.alias("lines")).alias("x"))
    return out.unionByName(ends).groupBy("doc", "item").agg(F.flatten(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["lines"])).alias("body"))


def headers(rows: DataFrame) -> DataFrame:
    """(doc, item, extra_head): what the head of a script, table or layout says besides its name."""
    inside = F.filter("anc", lambda x: x["pre"] >= F.col("item"))
    n = rows.withColumn("inside", inside)
    step = (F.col("kind") == "scripts") & path_is("StepList") & _tag("Step") & (F.size("inside") == 2)
    field = (F.col("kind") == "tables") & _tag("Field") & ((path_is("FieldCatalog") & (F.size("inside") == 2)) | (F.size("inside") == 1))
    itself = F.col("pre") == F.col("item")
    options = F.array_join(F.transform(F.filter(pairs(F.col("attrs"), F.col("attr_order")), lambda a: ~a["k"].isin("id", "name")), lambda a: F.concat(a["k"], F.lit("="), a["v"])), " ")
    first = lambda v, c: F.min_by(v, F.when(c, F.col("pre")))
    g = n.groupBy("doc", "item").agg(
        F.first("kind").alias("kind"), F.count_if(step).alias("steps"), F.count_if(step & (F.coalesce(attr("enable"), F.lit("True")) != "True")).alias("disabled"), first(options, itself).alias("options"), F.count_if(field).alias("fields"),
        first(attr("records"), itself).alias("records"), first(attr("comment"), itself).alias("comment"), first(attr("shadow"), itself).alias("shadow"), F.count_if(_tag("Object") & ~itself).alias("objects"), F.max(_tag("Theme") & (F.size("inside") == 1)).alias("themed"), first(attr("name"), _tag("Theme") & (F.size("inside") == 1)).alias("theme"),
    )
    said = lambda word, c: F.concat(F.lit(f"{word}: "), F.coalesce(F.col(c).cast("string"), F.lit("None")))
    script = F.array(F.concat(said("steps", "steps"), F.lit(" ("), F.col("disabled").cast("string"), F.lit(" disabled)")), F.concat(F.lit("options: "), F.coalesce("options", F.lit(""))))
    tbl = _some(said("fields", "fields"), said("records", "records"), F.when(F.coalesce(X.strip(F.col("comment")), F.lit("")) != "", said("comment", "comment")), F.when(F.col("shadow") == "True", "shadow: True (external SQL table)"))
    layout = _some(said("objects", "objects"), F.when(F.col("themed"), said("theme", "theme")))
    return g.select("doc", "item", F.when(F.col("kind") == "scripts", script).when(F.col("kind") == "tables", tbl).when(F.col("kind") == "layouts", layout).otherwise(F.array().cast(_LINES)).alias("extra_head"))


def items(nodes: DataFrame) -> DataFrame:
    """(doc, file, pre, kind, id, name, folder, source) of every catalog object; separators are left out."""
    no_folder = F.array().cast("array<string>")
    pick = lambda d, kind, source, name="name", folder=no_folder: d.select("doc", "file", "pre", F.lit(kind).alias("kind"), "id", F.coalesce(name, F.lit("")).alias("name"), folder.alias("folder"), F.format_string(source, "id").alias("source"))
    rel = E.relationships(nodes).withColumn("name", F.concat(F.coalesce("left_table", F.lit("?")), F.lit(" = "), F.coalesce("right_table", F.lit("?"))))
    own = F.lit(None).cast("string")
    for catalog, kind in KINDS.items():
        own = F.when(F.col("catalog") == catalog, kind).otherwise(own)
    other = E.generic_items(nodes)
    kind = F.coalesce(own, F.lower(slug(F.col("catalog")))).alias("kind")
    other = other.select("doc", "file", "pre", kind, "id", F.coalesce("name", "tag").alias("name"), "folder", F.format_string("%s/%s[@id=%s]", "catalog", "tag", "id").alias("source"))
    # what a catalog holds besides its items, and the options of the file
    rest = nodes.where((F.col("depth") == 2) & (parent_tag() == "File") & ~F.col("tag").isin("BaseTableCatalog", "RelationshipGraph", "LayoutCatalog", "ScriptCatalog", "ThemeCatalog")).withColumn("catalog", F.col("tag"))
    options = F.col("tag") == "Options"
    rest = rest.select("doc", "file", "pre", F.when(options, "file").otherwise(F.coalesce(own, F.lower(slug(F.col("catalog"))))).alias("kind"), F.when(options, "0").otherwise("catalog").alias("id"), F.when(options, "options").otherwise(F.col("tag")).alias("name"), no_folder.alias("folder"), F.col("tag").alias("source"))
    keep = F.expr("not is_separator")
    return (
        pick(E.tables(nodes), "tables", "BaseTableCatalog/BaseTable[@id=%s]")
        .unionByName(pick(E.occurrences(nodes), "table-occurrences", "RelationshipGraph/TableList/Table[@id=%s]"))
        .unionByName(pick(rel, "relationships", "RelationshipGraph/RelationshipList/Relationship[@id=%s]"))
        .unionByName(pick(E.layouts(nodes, dashes=True).where(keep), "layouts", "LayoutCatalog/Layout[@id=%s]", folder=F.col("folder")))
        .unionByName(pick(E.scripts(nodes, dashes=True).where(keep), "scripts", "ScriptCatalog/Script[@id=%s]", folder=F.col("folder")))
        .unionByName(other)
        .unionByName(rest)
    )


def objects(nodes: DataFrame) -> DataFrame:
    """(file, kind, id, name, folder, path, text, sha256, lines, emit_seq) of every catalog object.

    An occurrence's text also holds the relationships it takes part in; one with itself stands there twice, once a side."""
    it = items(nodes)
    files = folder_names(nodes.where((F.col("tag") == "File") & (F.col("depth") == 1)).select("file"))
    tos = S.base_tables(nodes)
    t = E.tables(nodes).select(F.col("file").alias("_tf"), F.col("id").alias("_ti"), F.col("name").alias("_tn")).dropDuplicates(["_tf", "_ti"])
    base = tos.join(t, (F.col("base_file") == F.col("_tf")) & (F.col("base_table_id") == F.col("_ti")), "left").join(files.withColumnsRenamed({"file": "_ff", "folder": "_fold"}), F.col("base_file") == F.col("_ff"), "left")
    where = F.when(F.col("base_file").isNull(), "external").when(F.col("_ti").isNull(), "missing").otherwise(F.concat("_fold", F.lit("/tables/"), "_ti", F.lit("-"), slug(F.col("_tn")), F.lit(".txt")))
    base = base.groupBy(F.col("file").alias("_bf"), F.col("to_name").alias("_bn")).agg(F.min(F.struct(F.col("to_id").alias("to"), where.alias("base"))).alias("side"))

    refs = S.reference_rows(nodes).where("status is not null").select(F.col("doc").alias("_rd"), F.col("pre").alias("_rp"), "status")
    calc = E.calculations(nodes).select(F.col("doc").alias("_cd"), F.col("owner").alias("_co"), "refs")
    n = nodes.join(it.select(F.col("doc").alias("_id"), F.col("pre").alias("_ip"), "kind"), (F.col("doc") == F.col("_id")) & (F.col("pre") == F.col("_ip")), "left")
    n = n.join(refs, (F.col("doc") == F.col("_rd")) & (F.col("pre") == F.col("_rp")), "left").join(calc, (F.col("tag") == "Calculation") & (F.col("doc") == F.col("_cd")) & (F.col("parent") == F.col("_co")), "left")
    n = n.join(base, F.col("tag").isin("LeftTable", "RightTable") & (F.col("file") == F.col("_bf")) & (attr("name") == F.col("_bn")), "left")
    extra = F.when(F.col("side").isNotNull(), F.create_map(F.lit("to"), F.coalesce("side.to", F.lit("")), F.lit("base"), F.col("side.base")))
    # items don't nest: the last one that began is the one a row may belong to, else the rest of its catalog
    so_far = Window.partitionBy("doc").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = lambda of: F.last(F.when(F.col("_ip").isNotNull() & of, F.struct(F.col("pre").alias("item"), "post", "kind")), ignorenulls=True).over(so_far)
    whole = F.col("depth") == 2
    n = n.withColumn("o", begun(~whole)).withColumn("c", begun(whole))
    n = n.withColumn("o", F.when(F.col("pre") <= F.col("o.post"), F.col("o")).when((F.col("pre") <= F.col("c.post")) & (F.col("tag") != "Group"), F.col("c"))).where("o is not null")
    wrappers = it.where("id <> 'catalog' or id is null").select("doc", "pre").join(nodes.where("depth > 2").select("doc", "pre", "anc"), ["doc", "pre"]).select("doc", F.explode(F.slice("anc", 4, F.size("anc"))).alias("a")).select("doc", F.col("a.pre").alias("pre")).distinct()
    n = n.join(wrappers, ["doc", "pre"], "left_anti")
    rows = n.select("doc", F.col("o.item").alias("item"), F.col("o.kind").alias("kind"), "pre", "post", "parent", "pos", "tag", "attr_order", "attrs", "text", "anc", "status", extra.alias("extra"), "refs")
    rows = cut(rows)
    body = headers(rows).join(object_lines(rows), ["doc", "item"], "left").withColumn("body", F.coalesce("body", F.array().cast(_LINES)))

    one = it.join(body.withColumnsRenamed({"doc": "_d"}), (F.col("doc") == F.col("_d")) & (F.col("pre") == F.col("item"))).where("coalesce(id, '') <> 'catalog' or size(body) > 0")
    rel = E.relationships(nodes).select("doc", F.col("pre").alias("rel"), F.explode(F.array_compact(F.array("left_table", "right_table"))).alias("to_name"))
    texts = one.where("kind = 'relationships'").select(F.col("doc").alias("_rd"), F.col("pre").alias("_rp"), F.col("body").alias("rel_body"))
    mine = rel.join(texts, (F.col("doc") == F.col("_rd")) & (F.col("rel") == F.col("_rp"))).groupBy(F.col("doc").alias("_od"), F.col("to_name").alias("_on")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rel", "rel_body"))), lambda x: x["rel_body"]).alias("rels"))
    occurrence = F.col("kind") == "table-occurrences"
    one = one.join(mine, occurrence & (F.col("doc") == F.col("_od")) & (F.col("name") == F.col("_on")), "left").join(base, occurrence & (F.col("file") == F.col("_bf")) & (F.col("name") == F.col("_bn")), "left")
    rels = F.coalesce("rels", F.array().cast("array<array<string>>"))
    blank = F.array(F.lit(""))
    more = F.concat(F.array(F.lit(""), F.concat(F.lit("relationships: "), F.size(rels).cast("string"))), F.flatten(F.transform(rels, lambda r: F.concat(blank, r))))
    lines = F.when(occurrence, F.concat("body", more)).otherwise(F.col("body"))
    based = F.concat(F.lit("base table: "), F.when(F.col("side.base") == "missing", F.lit("missing ref=missing")).otherwise(F.coalesce("side.base", F.lit("missing ref=missing"))))
    extra_head = F.when(occurrence, F.array(based)).otherwise(F.col("extra_head"))
    title = F.coalesce(*(F.when(F.col("kind") == k, t) for k, t in TITLES.items()), F.col("kind"))
    flat = lambda c: F.regexp_replace(c, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "¶")
    folder = F.array_join("folder", " / ")
    head = F.array_compact(F.concat(
        F.array(F.concat(F.lit("# "), title, F.lit(" "), F.coalesce("id", F.lit("None")), F.lit(": "), flat(F.col("name"))), F.concat(F.lit("# file: "), F.col("file")), F.when(F.size("folder") > 0, F.concat(F.lit("# folder: "), folder)), F.concat(F.lit("# source: "), F.col("source"))),
        F.transform(extra_head, lambda x: F.concat(F.lit("# "), flat(x))),
    ))
    text = F.concat(F.array_join(F.concat(head, blank, lines), "\n"), F.lit("\n"))
    one = one.join(files.withColumnsRenamed({"file": "_nf", "folder": "_slug"}), F.col("file") == F.col("_nf"))
    path = F.concat("_slug", F.lit("/"), "kind", F.lit("/"), F.coalesce("id", F.lit("None")), F.lit("-"), slug(F.col("name")), F.lit(".txt"))
    return one.select("doc", "pre", "file", "kind", "id", "name", folder.alias("folder"), path.alias("path"), text.alias("text"), F.sha2(text, 256).alias("sha256"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint").alias("lines"), F.col("pre").alias("emit_seq"))


def odd_line_breaks(objs: DataFrame) -> DataFrame:
    """Objects whose text still holds a break other than a line feed."""
    return objs.where(F.col("text").rlike("[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).select("path")


def export(objs: DataFrame, folder: str) -> None:
    """Each object as a file of its own, by the executors, into a new folder that all of them reach."""
    from pathlib import Path

    if Path(folder).exists() and any(Path(folder).iterdir()):
        raise FileExistsError(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = Path(folder) / path
                at.parent.mkdir(parents=True, exist_ok=True)
                at.write_text(text, encoding="utf-8", newline="")
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], ["n"])

    objs.select("path", "text").mapInArrow(run, "n long").agg(F.sum("n")).collect()
