"""One query per operator of the inventory on the given tables, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shalework.functions import text as X
from shalework.operators import census, contract, graph, profile, resolution
from shalework.operators import semantics as M
from shalework.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STRIP = lambda c: rf"regexp_replace({c}, '^[\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"
_SLUG = lambda c: rf"CASE WHEN regexp_replace(regexp_replace({_STRIP(f'nfc_normalize({c})')}, '[^\pL\pN\p{{Mn}}\p{{Mc}}_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') = '' THEN 'unnamed' ELSE regexp_replace(substr(regexp_replace(regexp_replace({_STRIP(f'nfc_normalize({c})')}, '[^\pL\pN\p{{Mn}}\p{{Mc}}_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 60), '[._]+$', '') END"
_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_CUR = "SELECT * FROM object_index QUALIFY row_number() OVER (PARTITION BY snapshot_no, replace(path, '\\', '/') ORDER BY received_at DESC, sha256 DESC) = 1"


def _index(spark: SparkSession, d: str, snapshot: int) -> DataFrame:
    """One snapshot of the object index, each path once."""
    rows = table(spark, d, "object_index").where(F.col("snapshot_no") == snapshot).withColumn("path", F.translate("path", "\\", "/"))
    best = F.max(F.struct("received_at", "sha256", "file", "kind", "id", "name", "folder", "lines")).alias("m")
    return rows.groupBy("path").agg(best).select("path", "m.file", "m.kind", "m.id", "m.name", "m.folder", "m.sha256", "m.lines")


_IDX = lambda n: f"(SELECT replace(path, '\\', '/') AS path, file, kind, id, name, folder, sha256, lines FROM ({_CUR}) WHERE snapshot_no = {n})"


# --- sinks and text (K1, F1-F17) ----------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS sha256, length(text) - length(replace(text, chr(10), '')) AS lines FROM documents WHERE text IS NOT NULL")
def k1_object_hash(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.sha2("text", 256).alias("sha256"), (F.length("text") - F.length(F.translate("text", "\n", ""))).cast("long").alias("lines"))


@query(f"SELECT file, kind, id, name, folder, path FROM {_IDX(6)} x ORDER BY file, kind, CASE WHEN regexp_matches(id, '^[0-9]+$') THEN CAST(id AS HUGEINT) ELSE 0 END, path")
def k2_index_order(spark, d):
    from shalework.sources.exchange import index_order

    return index_order(_index(spark, d, 6)).select("file", "kind", "id", "name", "folder", "path")


@query(f"SELECT path, {_SLUG('name')} AS slug FROM {_IDX(6)} x")
def f1_slug(spark, d):
    return _index(spark, d, 6).select("path", X.slug(F.col("name")).alias("slug"))


@query(f"SELECT DISTINCT snapshot_no, path, name, {_SLUG('name')} AS slug FROM object_index")
def f1_slug_all(spark, d):
    """As f1_slug, over every row of every snapshot."""
    return table(spark, d, "object_index").select("snapshot_no", "path", "name", X.slug(F.col("name")).alias("slug")).distinct()


@query(f"SELECT doc_id, len(regexp_split_to_array(text, '{_BREAKS}')) AS n FROM documents WHERE text IS NOT NULL")
def f2_lines_of(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(X.lines_of(F.col("text"))).cast("long").alias("n"))


@query(f"SELECT calc_id, regexp_replace(calculation, '{_BREAKS}', '¶', 'g') AS line FROM (SELECT DISTINCT calc_id, calculation FROM calculations) WHERE calculation IS NOT NULL")
def f2_one_line(spark, d):
    t = table(spark, d, "calculations").select("calc_id", "calculation").distinct().where("calculation is not null")
    return t.select("calc_id", X.one_line(F.col("calculation")).alias("line"))


@query(r"SELECT DISTINCT step_uid, regexp_replace(translate(step_text, '“”„‘’…', '\"\"\"'''''), '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g') AS norm FROM steps WHERE step_text IS NOT NULL".replace('\\"', '"'))
def f3_norm(spark, d):
    return table(spark, d, "steps").where("step_text is not null").select("step_uid", X.normal(F.col("step_text")).alias("norm")).distinct()


@query(f"SELECT DISTINCT file, id, CASE WHEN name = '' OR contains(name, ' ') THEN '\"' || regexp_replace(name, '{_BREAKS}', '¶', 'g') || '\"' ELSE name END AS q FROM scripts WHERE name IS NOT NULL")
def f4_quoted(spark, d):
    return table(spark, d, "scripts").where("name is not null").select("file", "id", X.quoted(F.col("name")).alias("q")).distinct()


_LIVE = r"regexp_replace(calculation, '\"[^\"\\\\]*(?:\\\\(?s:.)[^\"\\\\]*)*\"?|“[^”]*”?|//[^\n\r]*|/\*(?s:.)*?(?:\*/|\z)', '\"', 'g')".replace('\\"', '"')


@query(rf"SELECT DISTINCT calc_id, {_LIVE} AS code FROM calculations WHERE calculation IS NOT NULL".replace("\\\\\\\\", "\\\\"))
def f5_live_code(spark, d):
    return table(spark, d, "calculations").where("calculation is not null").select("calc_id", X.live_code(F.col("calculation")).alias("code")).distinct()


@query(f"SELECT DISTINCT source_uid, CASE WHEN length({_STRIP('password')}) > 1 AND starts_with({_STRIP('password')}, '\"') AND ends_with({_STRIP('password')}, '\"') THEN substr({_STRIP('password')}, 2, length({_STRIP('password')}) - 2) ELSE {_STRIP('password')} END AS bare FROM data_sources WHERE password IS NOT NULL")
def f9_bare(spark, d):
    return table(spark, d, "data_sources").where("password is not null").select("source_uid", X.bare(F.col("password")).alias("bare")).distinct()


@query(f"SELECT DISTINCT source_uid, trim(regexp_extract(regexp_replace({_STRIP('path_list')}, '^[A-Za-z][A-Za-z0-9]*:', ''), '([^/\\\\]*)[/\\\\]*$', 1)) AS target FROM data_sources WHERE path_list IS NOT NULL AND NOT regexp_matches(path_list, '[\\r\\n]|\\s[A-Za-z][A-Za-z0-9]*:')")
def f12_path_target(spark, d):
    t = table(spark, d, "data_sources").where("path_list is not null and size(split(path_list, '[\\\\r\\\\n]|\\\\s(?=[A-Za-z][A-Za-z0-9]*:)')) = 1")
    return t.select("source_uid", X.path_target(F.col("path_list")).alias("target")).distinct()


@query("SELECT source_uid, count(*) AS entries FROM (SELECT DISTINCT source_uid, path_list FROM data_sources), LATERAL (SELECT unnest(regexp_split_to_array(regexp_replace(path_list, '\\s+([A-Za-z][A-Za-z0-9]*:)', chr(10) || '\\1', 'g'), '[\\r\\n]+')) AS p) WHERE trim(p) <> '' GROUP BY source_uid")
def f10_path_list(spark, d):
    t = table(spark, d, "data_sources").select("source_uid", "path_list").distinct().where("path_list is not null")
    return t.select("source_uid", F.explode(X.path_list(F.col("path_list"))).alias("p")).groupBy("source_uid").agg(F.count("*").alias("entries"))


@query(r"SELECT DISTINCT file, regexp_replace(file, '([^.])\.(fmp12|fp7|fp5|fp3|fmp)$', '\1', 'i') AS stem FROM scripts")
def f13_strip_extension(spark, d):
    return table(spark, d, "scripts").select("file", X.strip_extension(F.col("file")).alias("stem")).distinct()


@query("SELECT DISTINCT file, substr(sha256(file), 1, 8) AS h FROM object_index")
def f14_short_hash(spark, d):
    return table(spark, d, "object_index").select("file", X.short_hash(F.col("file")).alias("h")).distinct()


@query(f"SELECT row_id, {_STRIP('ref')} AS ref FROM (SELECT DISTINCT row_id, ref FROM unresolved) WHERE ref IS NOT NULL")
def f16_strip(spark, d):
    return table(spark, d, "unresolved").select("row_id", "ref").distinct().where("ref is not null").select("row_id", X.strip(F.col("ref")).alias("ref"))


@query(r"SELECT DISTINCT file, id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\1_\2', 'g'), '([A-Za-z])([0-9])', '\1_\2', 'g'), '([0-9])([A-Za-z])', '\1_\2', 'g'), '[^\pL\pN\p{Mn}\p{Mc}_]+', '_', 'g'), '^_+|_+$', '', 'g')) AS snake FROM value_lists WHERE name IS NOT NULL")
def f18_snake(spark, d):
    return table(spark, d, "value_lists").where("name is not null").select("file", "id", X.snake(F.col("name")).alias("snake")).distinct()


# --- references and resolution (J) --------------------------------------------------------------------------------


@query(rf"""WITH ids AS (SELECT DISTINCT lower(file) AS f, id, max(CASE WHEN name = '-' THEN 1 ELSE 0 END) OVER (PARTITION BY lower(file), id) AS sep FROM scripts),
files AS (SELECT DISTINCT lower(file) AS f FROM scripts),
r AS (SELECT DISTINCT row_id, lower(file) AS f, {_STRIP('ref')} AS ref FROM unresolved WHERE tag = 'Script' AND (target_file IS NULL OR {_STRIP('target_file')} = ''))
SELECT row_id, CASE WHEN ref IS NULL THEN 'no id' WHEN ref = '0' THEN 'none' WHEN r.f NOT IN (SELECT f FROM files) THEN 'external' WHEN ids.id IS NULL THEN 'missing' WHEN sep = 1 THEN 'separator' ELSE 'resolves' END AS status
FROM r LEFT JOIN ids ON ids.f = r.f AND ids.id = r.ref""")
def j1_reference_status(spark, d):
    s = table(spark, d, "scripts").groupBy(F.lower("file").alias("f"), "id").agg(F.max(F.when(F.col("name") == "-", 1).otherwise(0)).alias("sep"))
    u = table(spark, d, "unresolved").where((F.col("tag") == "Script") & X.blank(F.col("target_file"))).select("row_id", F.lower("file").alias("f"), X.strip(F.col("ref")).alias("ref")).distinct()
    files = s.select(F.col("f").alias("_f")).distinct()
    r = u.join(s.withColumnsRenamed({"f": "_sf", "id": "_id"}), (F.col("f") == F.col("_sf")) & (F.col("ref") == F.col("_id")), "left").join(files, F.col("f") == F.col("_f"), "left")
    status = F.when(F.col("ref").isNull(), "no id").when(F.col("ref") == "0", "none").when(F.col("_f").isNull(), "external").when(F.col("_id").isNull(), "missing").when(F.col("sep") == 1, "separator").otherwise("resolves")
    return r.select("row_id", status.alias("status"))


@query(rf"""WITH known AS (SELECT DISTINCT file FROM scripts), n AS (SELECT DISTINCT {_STRIP('target_file')} AS name FROM unresolved WHERE target_file IS NOT NULL AND {_STRIP('target_file')} <> ''),
st AS (SELECT name, regexp_replace(name, '([^.])\.(fmp12|fp7|fp5|fp3|fmp)$', '\1', 'i') AS s FROM n), k AS (SELECT file, regexp_replace(file, '([^.])\.(fmp12|fp7|fp5|fp3|fmp)$', '\1', 'i') AS s FROM known),
h AS (SELECT name, file, CASE WHEN name = file THEN 1 WHEN st.s = k.s THEN 2 ELSE 3 END AS tier FROM st JOIN k ON lower(st.s) = lower(k.s))
SELECT name, array_to_string(list_sort(list(file)), '|') AS hits FROM h WHERE tier = (SELECT min(tier) FROM h i WHERE i.name = h.name) GROUP BY name""")
def j5_tiered_match(spark, d):
    names = table(spark, d, "unresolved").select(X.strip(F.col("target_file")).alias("name")).where("name <> ''")
    return resolution.match_names(names, table(spark, d, "scripts").select("file")).select("name", F.array_join("hits", "|").alias("hits"))


@query(r"""WITH known AS (SELECT DISTINCT lower(regexp_replace(file, '\.fmp12$', '', 'i')) AS k, file FROM scripts),
s AS (SELECT DISTINCT file, concat_ws('|', id, name, path_list) AS id, name, path_list FROM data_sources WHERE source_kind = 'FileReference'),
p AS (SELECT s.*, unnest(regexp_split_to_array(regexp_replace(path_list, '\s+([A-Za-z][A-Za-z0-9]*:)', chr(10) || '\1', 'g'), '[\r\n]+')) AS p, generate_subscripts(regexp_split_to_array(regexp_replace(path_list, '\s+([A-Za-z][A-Za-z0-9]*:)', chr(10) || '\1', 'g'), '[\r\n]+'), 1) AS i FROM s),
t AS (SELECT *, lower(regexp_replace(trim(regexp_extract(regexp_replace(trim(p), '^[A-Za-z][A-Za-z0-9]*:', ''), '([^/\\]*)[/\\]*$', 1)), '([^.])\.(fmp12|fp7|fp5|fp3|fmp)$', '\1', 'i')) AS k FROM p WHERE trim(p) <> ''),
byp AS (SELECT t.file, t.id, arg_min(known.file, i) AS hit FROM t JOIN known ON t.k = known.k GROUP BY t.file, t.id),
n AS (SELECT s.file, s.id, CASE WHEN path_list IS NULL OR trim(path_list) = '' THEN known.file END AS hit FROM s LEFT JOIN known ON lower(regexp_replace(s.name, '([^.])\.(fmp12|fp7|fp5|fp3|fmp)$', '\1', 'i')) = known.k)
SELECT DISTINCT s.file, s.id, coalesce(byp.hit, n.hit) AS resolved_to FROM s LEFT JOIN byp ON byp.file = s.file AND byp.id = s.id LEFT JOIN n ON n.file = s.file AND n.id = s.id""")
def j7_data_sources(spark, d):
    s = table(spark, d, "data_sources").where("source_kind = 'FileReference'").select("file", F.concat_ws("|", "id", "name", "path_list").alias("id"), "name", X.path_list(F.col("path_list")).alias("paths")).distinct()
    known = table(spark, d, "scripts").select("file").distinct()
    return resolution.resolve_sources(s, known).select("file", "id", F.col("to.resolved_to").alias("resolved_to")).distinct()


@query("""SELECT step_uid, file, called_file, name AS called_name FROM (SELECT s.step_uid, s.file, s.called_file, x.name, row_number() OVER (PARTITION BY s.step_uid ORDER BY x.loaded_at DESC, x.name) AS r
FROM (SELECT DISTINCT step_uid, file, called_file, called_script FROM steps WHERE called_script IS NOT NULL AND called_file IS NOT NULL) s
JOIN scripts x ON regexp_replace(lower(x.file), '\\.fmp12$', '') = regexp_replace(lower(s.called_file), '\\.fmp12$', '') AND x.id = s.called_script) WHERE r = 1""")
def j11_cross_file_calls(spark, d):
    s = table(spark, d, "steps").where("called_script is not null and called_file is not null").select("step_uid", "file", "called_file", "called_script").distinct()
    last = table(spark, d, "scripts").groupBy(F.regexp_replace(F.lower("file"), r"\.fmp12$", "").alias("_f"), F.col("id").alias("_i")).agg(F.min_by("name", F.struct(-F.unix_micros(F.col("loaded_at").cast("timestamp")), "name")).alias("called_name"))
    return s.join(last, (F.regexp_replace(F.lower("called_file"), r"\.fmp12$", "") == F.col("_f")) & (F.col("called_script") == F.col("_i"))).select("step_uid", "file", "called_file", "called_name")


# --- aggregates and order (A, O, U) -------------------------------------------------------------------------------


@query(f"SELECT kind, count(*) AS n, CAST(sum(coalesce(lines, 0)) AS BIGINT) AS lines FROM {_IDX(6)} x GROUP BY kind")
def a1_count_by_kind(spark, d):
    return _index(spark, d, 6).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.coalesce("lines", F.lit(0))).alias("lines"))


@query("SELECT file, count(*) FILTER (WHERE kind = 'scripts') AS scripts, count(*) FILTER (WHERE kind = 'layouts') AS layouts, count(*) FILTER (WHERE kind = 'tables') AS tables FROM " + _IDX(6) + " x GROUP BY file")
def a2_file_counts(spark, d):
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return _index(spark, d, 6).groupBy("file").agg(n("scripts"), n("layouts"), n("tables"))


@query("""WITH c AS (SELECT code, value, count(*) AS n FROM (SELECT 'Object@flags' AS code, trim(flags) AS value FROM layout_objects UNION ALL SELECT 'FieldObj@displayType', trim(display_type) FROM layout_objects) WHERE value <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, value) AS k FROM c)
SELECT code, value, n, NULL::BIGINT AS rest_values, NULL::BIGINT AS rest_uses FROM r WHERE k <= 20 UNION ALL SELECT code, NULL, NULL, count(*), CAST(sum(n) AS BIGINT) FROM r WHERE k > 20 GROUP BY code""")
def a3_code_census(spark, d):
    o = table(spark, d, "layout_objects")
    codes = F.array(*(F.struct(F.lit(c).alias("code"), F.trim(x).alias("value")) for c, x in (("Object@flags", "flags"), ("FieldObj@displayType", "display_type"))))
    counts = o.select(F.inline(codes)).where("value <> ''").groupBy("code", "value").agg(F.count("*").alias("n"))
    return census.top_and_rest(counts, "code", "value", "n", 20)


@query("SELECT file, script_id, count(*) AS steps, count(*) FILTER (WHERE enabled = false) AS disabled FROM (SELECT DISTINCT step_uid, file, script_id, enabled FROM steps) GROUP BY file, script_id")
def a5_disabled_steps(spark, d):
    s = table(spark, d, "steps").select("step_uid", "file", "script_id", "enabled").distinct()
    return s.groupBy("file", "script_id").agg(F.count("*").alias("steps"), F.count_if(~F.col("enabled")).alias("disabled"))


@query("SELECT path, count(*) AS n FROM object_index WHERE snapshot_no = 6 GROUP BY path HAVING count(*) <> 1")
def a6_multiplicity(spark, d):
    return profile.key_duplicates(table(spark, d, "object_index").where("snapshot_no = 6"), ["path"])


@query("SELECT snapshot_no, path, count(*) AS n FROM object_index GROUP BY snapshot_no, path HAVING count(*) <> 1")
def a6_multiplicity_all(spark, d):
    """As a6_multiplicity, over every snapshot."""
    return profile.key_duplicates(table(spark, d, "object_index"), ["snapshot_no", "path"])


@query("SELECT name, arg_max(file, struct_pack(n := n, k := -o)) AS file, max(n) AS n FROM (SELECT name, file, count(*) AS n, dense_rank() OVER (ORDER BY file) AS o FROM scripts WHERE name <> '' GROUP BY name, file) GROUP BY name")
def a7_argmax_merge(spark, d):
    n = table(spark, d, "scripts").where("name <> ''").groupBy("name", "file").agg(F.count("*").alias("n"))
    return n.groupBy("name").agg(F.min_by("file", F.struct(-F.col("n"), F.col("file"))).alias("file"), F.max("n").alias("n"))


@query("SELECT 'steps' AS what, count(*) AS raw, count(DISTINCT step_uid) AS emitted FROM steps UNION ALL SELECT 'scripts', count(*), count(DISTINCT (file, id)) FROM scripts UNION ALL SELECT 'unresolved', count(*), count(DISTINCT row_id) FROM unresolved")
def a8_reconcile(spark, d):
    one = lambda n, *k: table(spark, d, n).agg(F.lit(n).alias("what"), F.count("*").alias("raw"), F.count_distinct(F.struct(*k)).alias("emitted"))
    return one("steps", "step_uid").unionByName(one("scripts", "file", "id")).unionByName(one("unresolved", "row_id"))


@query("SELECT file, sum(n)::BIGINT AS n FROM (SELECT file, count(*) AS n FROM scripts GROUP BY file UNION ALL SELECT file, count(*) FROM value_lists GROUP BY file UNION ALL SELECT file, count(*) FROM data_sources GROUP BY file) GROUP BY file")
def u1_union_all(spark, d):
    t = lambda n: table(spark, d, n).select("file")
    return t("scripts").unionByName(t("value_lists")).unionByName(t("data_sources")).groupBy("file").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT file, kind FROM object_index WHERE snapshot_no = 6 EXCEPT SELECT DISTINCT file, kind FROM object_index WHERE snapshot_no = 5")
def u2_difference(spark, d):
    o = lambda n: table(spark, d, "object_index").where(F.col("snapshot_no") == n).select("file", "kind").distinct()
    return o(6).join(o(5), ["file", "kind"], "left_anti")


@query("SELECT DISTINCT kind FROM object_index INTERSECT SELECT unnest(['scripts', 'layouts', 'nothing'])")
def u6_kinds_present(spark, d):
    return table(spark, d, "object_index").select("kind").where(F.col("kind").isin("scripts", "layouts", "nothing")).distinct()


# --- contract (B, V) ----------------------------------------------------------------------------------------------

_BATCHES = f"""WITH RECURSIVE o AS (SELECT *, kind || '|' || file || '|' || coalesce(folder, '') AS g, row_number() OVER (PARTITION BY kind, file, coalesce(folder, '') ORDER BY CASE WHEN regexp_matches(id, '^[0-9]+$') THEN CAST(id AS HUGEINT) ELSE 0 END, path) AS k, coalesce(lines, 0) AS n FROM {_IDX(6)} x),
b AS (SELECT path, g, k, n, 1 AS batch, 1 AS held, n AS total FROM o WHERE k = 1
UNION ALL SELECT o.path, o.g, o.k, o.n, CASE WHEN b.held >= 10 OR b.total + o.n > 400 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.held >= 10 OR b.total + o.n > 400 THEN 1 ELSE b.held + 1 END, CASE WHEN b.held >= 10 OR b.total + o.n > 400 THEN o.n ELSE b.total + o.n END
FROM b JOIN o ON o.g = b.g AND o.k = b.k + 1)"""


@query(f"{_BATCHES} SELECT path, batch, n AS lines FROM b")
def b1_batches(spark, d):
    i = _index(spark, d, 6)
    number = F.when(F.col("id").rlike("^[0-9]+$"), F.col("id").cast("decimal(38,0)")).otherwise(F.lit(0))
    rows = i.select("path", F.concat_ws("|", "kind", "file", F.coalesce("folder", F.lit(""))).alias("base"), number.alias("k"), F.coalesce("lines", F.lit(0)).alias("lines"))
    return contract.number_batches(rows, "base", ["k", "path"], "lines", 10, 400).select("path", "batch", "lines")


@query("""WITH RECURSIVE s AS (SELECT folder_kind, lines, row_number() OVER (ORDER BY lines DESC, folder_kind) AS k FROM (SELECT file || '/' || kind AS folder_kind, CAST(sum(coalesce(lines, 0)) AS BIGINT) AS lines FROM (""" + _CUR + """) WHERE snapshot_no = 6 GROUP BY ALL)),
a AS (SELECT k, folder_kind, lines, 1 AS agent, [lines, 0, 0, 0]::BIGINT[] AS ld FROM s WHERE k = 1
UNION ALL SELECT s.k, s.folder_kind, s.lines, list_position(a.ld, list_min(a.ld))::INT, list_transform(a.ld, lambda x, i: CASE WHEN i = list_position(a.ld, list_min(a.ld)) THEN x + s.lines ELSE x END) FROM a JOIN s ON s.k = a.k + 1)
SELECT folder_kind, lines, agent FROM a""")
def b2_longest_first(spark, d):
    i = _index(spark, d, 6).groupBy(F.concat_ws("/", "file", "kind").alias("folder_kind")).agg(F.sum(F.coalesce("lines", F.lit(0))).alias("lines"))
    b = i.select(F.lit("c").alias("catalog"), F.col("folder_kind").alias("output_file"), "lines", F.lit(0).cast("long").alias("ord"))
    return contract.spread(b, 4).select(F.col("output_file").alias("folder_kind"), "lines", "agent")


_COV = f"""WITH e AS (SELECT path AS id, lower(trim(sha256)) AS h, file || '/' || kind AS f FROM {_IDX(5)} x),
o AS (SELECT replace(path, '\\', '/') AS id, lower(trim(sha256)) AS h, file || '/' || kind AS f FROM object_index WHERE snapshot_no = 6),
c AS (SELECT id, count(*) AS n FROM o GROUP BY id)
SELECT 'missing' AS bucket, id AS source_id, 1 AS times FROM e WHERE id NOT IN (SELECT id FROM o)
UNION ALL SELECT DISTINCT 'extra', id, 1 FROM o WHERE id NOT IN (SELECT id FROM e)
UNION ALL SELECT 'duplicates', id, 1 FROM c WHERE n > 1
UNION ALL SELECT 'wrong_hash', o.id, count(*) FROM o JOIN e ON e.id = o.id WHERE o.h <> e.h GROUP BY o.id
UNION ALL SELECT 'wrong_file', o.id, count(*) FROM o JOIN e ON e.id = o.id WHERE o.f <> e.f GROUP BY o.id"""


@query(_COV)
def v1_coverage(spark, d):
    h = F.lower(F.trim("sha256")).alias("source_hash")
    e = _index(spark, d, 5).select(F.col("path").alias("source_id"), h, F.concat_ws("/", "file", "kind").alias("output_file"))
    o = table(spark, d, "object_index").where("snapshot_no = 6").select(F.translate("path", "\\", "/").alias("source_id"), h, F.concat_ws("/", "file", "kind").alias("output_file"))
    return contract.coverage(e, o)


@query(f"SELECT file, kind, count(*) AS stale FROM (SELECT file, kind, path, lower(trim(sha256)) FROM {_IDX(5)} x EXCEPT SELECT file, kind, path, lower(trim(sha256)) FROM {_IDX(6)} y) GROUP BY ALL")
def v3_stale(spark, d):
    i = lambda n: _index(spark, d, n).select("file", "kind", "path", F.lower(F.trim("sha256")).alias("h"))
    return i(5).exceptAll(i(6)).groupBy("file", "kind").agg(F.count("*").alias("stale"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')")
def v7_odd_breaks(spark, d):
    return table(spark, d, "documents").where(F.col("text").rlike(r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).select("doc_id")


# --- explorer questions (P19, Q) ----------------------------------------------------------------------------------

_STEPS = "SELECT DISTINCT step_uid, file, script_id, step_line, name, enabled FROM steps"


@query(f"""SELECT step_uid, CAST(coalesce(sum(CASE WHEN name IN ('If', 'Loop') THEN 1 WHEN name IN ('End If', 'End Loop') THEN -1 ELSE 0 END) OVER (PARTITION BY file, script_id ORDER BY step_line, step_uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - CASE WHEN name IN ('End If', 'End Loop') THEN 1 ELSE 0 END AS BIGINT) AS depth FROM ({_STEPS})""")
def q20_block_depth(spark, d):
    s = table(spark, d, "steps").select("step_uid", "file", "script_id", "step_line", "name").distinct().withColumn("at", F.struct("step_line", "step_uid"))
    return graph.block_depths(s, ["file", "script_id"], "at", "name").select("step_uid", F.col("depth").cast("long").alias("depth"))


@query(f"""WITH d AS (SELECT *, coalesce(sum(CASE WHEN name IN ('If', 'Loop') THEN 1 WHEN name IN ('End If', 'End Loop') THEN -1 ELSE 0 END) OVER (PARTITION BY file, script_id ORDER BY step_line, step_uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM ({_STEPS}) WHERE enabled),
x AS (SELECT *, min(CASE WHEN name IN ('Exit Script', 'Halt Script') AND depth = 0 THEN step_line END) OVER (PARTITION BY file, script_id) AS e FROM d)
SELECT file, script_id, count(*) AS dead FROM x WHERE step_line > e GROUP BY ALL""")
def q20_unreachable(spark, d):
    s = table(spark, d, "steps").where("enabled").select("step_uid", "file", "script_id", "step_line", "name").distinct().withColumn("at", F.struct("step_line", "step_uid"))
    x = graph.block_depths(s, ["file", "script_id"], "at", "name")
    e = F.min(F.when(F.col("name").isin("Exit Script", "Halt Script") & (F.col("depth") == 0), F.col("step_line"))).over(Window.partitionBy("file", "script_id"))
    return x.withColumn("e", e).where("step_line > e").groupBy("file", "script_id").agg(F.count("*").alias("dead"))


@query(r"""WITH s AS (SELECT DISTINCT regexp_replace(lower(file), '\.fmp12$', '') AS f, file, id FROM scripts), c AS (SELECT DISTINCT regexp_replace(lower(CASE WHEN called_file IS NULL OR trim(called_file) = '' THEN file ELSE called_file END), '\.fmp12$', '') AS f, trim(called_script) AS id, file AS from_file, script_id FROM steps WHERE called_script IS NOT NULL)
SELECT s.file, s.id, count(c.id) AS callers, CASE WHEN count(c.id) = 0 THEN 'none found' END AS reason FROM s LEFT JOIN c ON c.f = s.f AND c.id = s.id GROUP BY s.file, s.id""")
def q2_callers(spark, d):
    key = lambda c: F.regexp_replace(F.lower(c), r"\.fmp12$", "")
    s = table(spark, d, "scripts").select(key(F.col("file")).alias("f"), "file", "id").distinct()
    st = table(spark, d, "steps").where("called_script is not null")
    own = F.when(F.col("called_file").isNull() | (F.trim("called_file") == ""), F.col("file")).otherwise(F.col("called_file"))
    c = st.select(key(own).alias("f"), F.trim("called_script").alias("id"), F.col("file").alias("from_file"), "script_id").distinct().groupBy("f", "id").agg(F.count("*").alias("callers"))
    n = F.coalesce("callers", F.lit(0))
    return s.join(c, ["f", "id"], "left").select("file", "id", n.alias("callers"), F.when(n == 0, "none found").alias("reason"))


@query("SELECT step_uid, name AS effect FROM (SELECT DISTINCT step_uid, name, enabled FROM steps) WHERE enabled AND name IN ('Insert from URL', 'Send Mail', 'Open URL')")
def q19_external_effects(spark, d):
    return table(spark, d, "steps").where(F.col("enabled") & F.col("name").isin(*graph.EXTERNAL_STEPS)).select("step_uid", F.col("name").alias("effect")).distinct()


@query("SELECT h, count(*) AS files FROM (SELECT DISTINCT sha256(calculation) AS h, file FROM calculations WHERE owner_kind = 'custom-functions' AND calculation <> '') GROUP BY h HAVING count(*) > 1")
def q22_duplicate_functions(spark, d):
    t = table(spark, d, "calculations").where("owner_kind = 'custom-functions' and calculation <> ''").select(F.sha2("calculation", 256).alias("h"), "file").distinct()
    return t.groupBy("h").agg(F.count("*").alias("files")).where("files > 1")


@query("SELECT DISTINCT file, id, name FROM scripts WHERE run_full_access")
def q24_full_access(spark, d):
    return table(spark, d, "scripts").where("run_full_access").select("file", "id", "name").distinct()


@query("SELECT 'none found' AS signal, count(*) AS n FROM (SELECT DISTINCT file, id FROM scripts WHERE NOT include_in_menu) UNION ALL SELECT status, count(*) FROM (SELECT DISTINCT row_id, status FROM unresolved) WHERE status IS NOT NULL GROUP BY status")
def q21_signals(spark, d):
    a = table(spark, d, "scripts").where("not include_in_menu").select("file", "id").distinct().agg(F.lit("none found").alias("signal"), F.count("*").alias("n"))
    return a.unionByName(table(spark, d, "unresolved").where("status is not null").select("row_id", F.col("status").alias("signal")).distinct().groupBy("signal").agg(F.count("*").alias("n")))


# --- application semantics (M) ------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate <= o_orderdate")
def m1_theta_relationship(spark, d):
    j = M.related(table(spark, d, "lineitem"), table(spark, d, "orders"), [("l_orderkey", "Equal", "o_orderkey"), ("l_shipdate", "LessThanOrEqualTo", "o_orderdate")])
    return j.select("l.l_orderkey", "l.l_linenumber", "l.l_partkey", "r.o_orderdate")


@query("SELECT a.r_name AS left_name, b.r_name AS right_name FROM region a, region b")
def m1_cartesian_relationship(spark, d):
    j = M.related(table(spark, d, "region"), table(spark, d, "region"), [("r_regionkey", "CartesianProduct", "r_regionkey")])
    return j.select(F.col("l.r_name").alias("left_name"), F.col("r.r_name").alias("right_name"))


@query("SELECT c_custkey, arg_min(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def m2_first_related(spark, d):
    f = M.first_related(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")
    return table(spark, d, "customer").join(f, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey, portal_row FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS portal_row FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F') WHERE portal_row <= 5")
def m3_portal(spark, d):
    p = M.portal(table(spark, d, "customer"), table(spark, d, "orders"), [("c_custkey", "o_custkey")], [F.desc("o_totalprice"), F.col("o_orderkey")], F.col("o_orderstatus") == "F", 5)
    return p.select("c_custkey", "o_orderkey", "portal_row")


def _orders(spark, d):
    return M.FoundSet(table(spark, d, "orders"))


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR o_orderpriority = '1-URGENT'")
def m4_find_or(spark, d):
    return _orders(spark, d).find([F.col("o_orderstatus") == "F", F.col("o_totalprice") > 200000], [F.col("o_orderpriority") == "1-URGENT"]).rows().select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def m4_constrain(spark, d):
    return _orders(spark, d).find([F.col("o_orderstatus") == "F"]).constrain([F.col("o_totalprice") > 100000]).rows().select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 300000")
def m4_extend(spark, d):
    return _orders(spark, d).find([F.col("o_orderstatus") == "F"]).extend([F.col("o_totalprice") > 300000]).rows().select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND NOT o_orderpriority = '5-LOW'")
def m4_omit(spark, d):
    return _orders(spark, d).find([F.col("o_orderstatus") == "F"]).omit(F.col("o_orderpriority") == "5-LOW").rows().select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT o_orderstatus = 'F'")
def m4_show_omitted(spark, d):
    return _orders(spark, d).find([F.col("o_orderstatus") == "F"]).show_omitted().rows().select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def m5_replace(spark, d):
    return _orders(spark, d).find([F.col("o_orderstatus") == "F"]).replace_contents("o_orderpriority", F.lit("closed")).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def m6_summary_at_break(spark, d):
    return M.summary_at_break(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], {"n": F.count("*"), "total": F.round(F.sum(F.col("o_totalprice").cast("decimal(20,4)")), 2).cast("double")})


@query("SELECT o_orderkey, c.c_mktsegment AS segment FROM orders LEFT JOIN customer c ON o_custkey = c_custkey")
def m7_lookup(spark, d):
    return M.lookup(table(spark, d, "orders"), table(spark, d, "customer"), [("o_custkey", "c_custkey")], "c_mktsegment", "segment", ["c_custkey"]).select("o_orderkey", "segment")


@query("SELECT DISTINCT p_brand AS stored, p_brand AS shown FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def m8_value_list(spark, d):
    return M.value_list(table(spark, d, "part"), "p_brand", None, (table(spark, d, "lineitem").where("l_returnflag = 'R'"), "l_partkey", "p_partkey"))


@query("SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey < 10")
def m9_restrict(spark, d):
    return M.restrict(table(spark, d, "customer"), F.col("c_nationkey") < 10, ["c_nationkey", "c_mktsegment"], {"c_acctbal": F.col("c_mktsegment") == "BUILDING"})


@query("""SELECT l_orderkey, l_linenumber, x.column, x.rule, count(*) AS n FROM lineitem, LATERAL (SELECT 'l_quantity' AS "column", 'range' AS rule WHERE NOT l_quantity BETWEEN 1 AND 45 UNION ALL SELECT 'l_returnflag', 'member' WHERE l_returnflag NOT IN ('A', 'N') UNION ALL SELECT 'l_shipdate', 'formula' WHERE NOT l_shipdate >= TIMESTAMP '1993-01-01') x GROUP BY ALL""")
def m10_validation(spark, d):
    rules = [M.Rule("l_quantity", "range", (1, 45)), M.Rule("l_returnflag", "member", ("A", "N")), M.Rule("l_shipdate", "formula", (F.col("l_shipdate") >= F.lit("1993-01-01").cast("timestamp_ntz"),))]
    return M.violations(table(spark, d, "lineitem"), rules, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber", "column", "rule").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT file || '#' || id AS key, trim(v) AS value FROM (SELECT file, id, unnest(custom_values) AS v FROM value_lists) WHERE trim(v) <> ''")
def m11_multikey(spark, d):
    v = table(spark, d, "value_lists").where("custom_values is not null").select(F.concat_ws("#", "file", "id").alias("key"), F.array_join("custom_values", "\n").alias("list"))
    return M.multikey(v, "key", "list").distinct()


# --- data profile (D) ---------------------------------------------------------------------------------------------


@query("SELECT snapshot_no, file, count(*) AS n FROM object_index GROUP BY ALL")
def d1_row_counts(spark, d):
    return profile.row_counts(table(spark, d, "object_index"), "snapshot_no", "file")


_COLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest, CAST(max(length(CAST({c} AS VARCHAR))) AS INT) AS longest FROM orders" for c in _COLS))
def d2_profile(spark, d):
    return profile.profile_columns(table(spark, d, "orders"), list(_COLS))


@query("SELECT count(*) AS rows, CAST(sum(CAST(('0x' || substr(sha256(coalesce(length(c_name)::VARCHAR || ':' || c_name, '-') || coalesce(length(c_mktsegment)::VARCHAR || ':' || c_mktsegment, '-')), 1, 15)) AS HUGEINT)) AS VARCHAR) AS checksum FROM customer")
def d3_checksum(spark, d):
    return profile.checksum(table(spark, d, "customer"), ["c_name", "c_mktsegment"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def d4_key_duplicates(spark, d):
    return profile.key_duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def d4_orphans(spark, d):
    return profile.orphans(table(spark, d, "lineitem"), table(spark, d, "part").where("p_size <= 25"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL")
def d5_binary_profile(spark, d):
    return profile.binary_profile(table(spark, d, "documents").withColumn("b", F.encode("text", "UTF-8")), "b").select("n", "bytes")


@query("SELECT 'text' AS \"column\", 'replacement character' AS edge, count(*) FILTER (WHERE contains(text, chr(65533))) AS n FROM documents UNION ALL SELECT 'text', 'control character', count(*) FILTER (WHERE regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')) FROM documents UNION ALL SELECT 'text', 'outer white space', count(*) FILTER (WHERE text <> trim(text)) FROM documents UNION ALL SELECT 'text', 'beyond ASCII', count(*) FILTER (WHERE regexp_matches(text, '[^\\x00-\\x7f]')) FROM documents")
def d6_edges(spark, d):
    return profile.edge_values(table(spark, d, "documents"), ["text"], [], [])


@query("SELECT coalesce(a.kind, b.kind) AS kind, a.n AS a, b.n AS b FROM (SELECT kind, CAST(sum(lines) AS BIGINT) AS n FROM object_index WHERE snapshot_no = 5 GROUP BY kind) a FULL JOIN (SELECT kind, CAST(sum(lines) AS BIGINT) AS n FROM object_index WHERE snapshot_no = 6 GROUP BY kind) b ON a.kind = b.kind WHERE a.n IS DISTINCT FROM b.n")
def d7_totals(spark, d):
    o = table(spark, d, "object_index")
    return profile.totals_differ(o.where("snapshot_no = 5"), o.where("snapshot_no = 6"), ["kind"], "lines")


@query(f"""SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'rejected' WHEN a.path IS NULL THEN 'unexpected' ELSE array_to_string(list_filter([CASE WHEN a.name IS DISTINCT FROM b.name THEN 'name' END, CASE WHEN a.lines IS DISTINCT FROM b.lines THEN 'lines' END], lambda x: x IS NOT NULL), ',') END AS reason
FROM {_IDX(5)} a FULL JOIN {_IDX(6)} b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.name IS DISTINCT FROM b.name OR a.lines IS DISTINCT FROM b.lines""")
def d8_changed_rows(spark, d):
    return profile.changed_rows(_index(spark, d, 5), _index(spark, d, 6), ["path"], ["name", "lines"])


# --- more of the projections, joins and questions -----------------------------------------------------------------


@query("SELECT step_uid, CAST(row_number() OVER (PARTITION BY file, script_id ORDER BY step_line, step_uid) AS INT) AS line FROM (SELECT DISTINCT step_uid, file, script_id, step_line FROM steps)")
def e19_step_numbers(spark, d):
    s = table(spark, d, "steps").select("step_uid", "file", "script_id", "step_line").distinct()
    return s.select("step_uid", F.row_number().over(Window.partitionBy("file", "script_id").orderBy("step_line", "step_uid")).alias("line"))


@query("SELECT file, id, max(CASE WHEN name = '-' THEN 1 ELSE 0 END) AS dash, max(CASE WHEN name = '-' AND id NOT IN (SELECT script_id FROM steps s WHERE s.file = scripts.file) THEN 1 ELSE 0 END) AS separator FROM scripts GROUP BY file, id")
def e28_separators(spark, d):
    has = table(spark, d, "steps").select("file", F.col("script_id").alias("id")).distinct().withColumn("has", F.lit(True))
    s = table(spark, d, "scripts").join(has, ["file", "id"], "left")
    dash = F.coalesce(F.col("name") == "-", F.lit(False))
    return s.groupBy("file", "id").agg(F.max(dash.cast("int")).alias("dash"), F.max((dash & F.col("has").isNull()).cast("int")).alias("separator"))


@query("SELECT DISTINCT obj_id, CASE trim(display_type) WHEN '0' THEN 'edit box' WHEN '1' THEN 'drop-down list' WHEN '2' THEN 'pop-up menu' WHEN '3' THEN 'checkbox set' WHEN '4' THEN 'radio button set' WHEN '6' THEN 'drop-down calendar' ELSE trim(display_type) END AS shown, (TRY_CAST(trim(flags) AS BIGINT) & 4) > 0 AS bit_4 FROM layout_objects WHERE display_type IS NOT NULL")
def e31_codes(spark, d):
    from shalework.operators.rendering import DISPLAY_TYPES

    names = F.create_map(*(F.lit(x) for kv in DISPLAY_TYPES.items() for x in kv))
    code = F.trim("display_type")
    return table(spark, d, "layout_objects").where("display_type is not null").select("obj_id", F.coalesce(names[code], code).alias("shown"), (F.trim("flags").try_cast("bigint").bitwiseAND(F.lit(4)) > 0).alias("bit_4")).distinct()


@query("SELECT file, name, arg_min(id, struct_pack(a := loaded_at, b := id)) AS id FROM data_sources WHERE name <> '' GROUP BY file, name")
def j14_source_by_name(spark, d):
    return table(spark, d, "data_sources").where("name <> ''").groupBy("file", "name").agg(F.min_by("id", F.struct("loaded_at", "id")).alias("id"))


@query(_COV.replace("WITH e AS (SELECT path AS id, lower(trim(sha256)) AS h, file || '/' || kind AS f FROM", "WITH e AS (SELECT path AS id, lower(trim(sha256)) AS h, file || '/' || kind AS f FROM").replace(f"FROM {_IDX(5)} x)", f"FROM {_IDX(5)} x WHERE kind = 'scripts')").replace("WHERE snapshot_no = 6)", "WHERE snapshot_no = 6 AND kind = 'scripts' AND file || '/' || kind IN (SELECT f FROM e))"))
def j18_share_coverage(spark, d):
    h = F.lower(F.trim("sha256")).alias("source_hash")
    e = _index(spark, d, 5).select(F.col("path").alias("source_id"), h, F.concat_ws("/", "file", "kind").alias("output_file"))
    o = table(spark, d, "object_index").where("snapshot_no = 6").select(F.translate("path", "\\", "/").alias("source_id"), h, F.concat_ws("/", "file", "kind").alias("output_file"))
    return contract.coverage(e, o, e.where("output_file like '%/scripts'").select("output_file"))


@query(f"SELECT kind, file, count(*) AS objects, CAST(sum(coalesce(lines, 0)) AS BIGINT) AS lines FROM {_IDX(6)} x GROUP BY kind, file")
def a4_batch_sums(spark, d):
    rows = _index(spark, d, 6).select(F.concat_ws("|", "kind", "file").alias("output_file"), F.coalesce("lines", F.lit(0)).alias("lines"), F.lit(0).alias("ord"))
    b = contract.batches_of(rows, "c")
    return b.select(F.substring_index("output_file", "|", 1).alias("kind"), F.substring_index("output_file", "|", -1).alias("file"), "objects", "lines")


@query("SELECT file, count(*) AS fields, count(*) FILTER (WHERE object_type = 'Field') AS regular, count(*) FILTER (WHERE button_flags IS NOT NULL) AS buttons, count(*) FILTER (WHERE len(cond_ops) > 0) AS conditions FROM (SELECT DISTINCT obj_id, file, object_type, button_flags, cond_ops FROM layout_objects) GROUP BY file")
def q11_census(spark, d):
    o = table(spark, d, "layout_objects").select("obj_id", "file", "object_type", "button_flags", "cond_ops").distinct()
    return o.groupBy("file").agg(F.count("*").alias("fields"), F.count_if(F.col("object_type") == "Field").alias("regular"), F.count("button_flags").alias("buttons"), F.count_if(F.size("cond_ops") > 0).alias("conditions"))


@query("SELECT file, kind, count(*) AS objects FROM (" + _CUR + ") WHERE snapshot_no = 6 AND kind NOT IN ('scripts', 'tables', 'layouts') GROUP BY file, kind")
def q18_unclaimed(spark, d):
    return graph.unclaimed_kinds(_index(spark, d, 6), ["scripts", "tables", "layouts"])


@query("SELECT step_uid, found FROM (SELECT step_uid, name, last_value(CASE WHEN name IN ('Perform Find', 'Go to Related Record') THEN step_line END IGNORE NULLS) OVER (PARTITION BY file, script_id ORDER BY step_line, step_uid ROWS UNBOUNDED PRECEDING) AS found FROM (SELECT DISTINCT step_uid, file, script_id, step_line, name FROM steps)) WHERE name = 'Set Field'")
def q23_found_set(spark, d):
    s = table(spark, d, "steps").select("step_uid", "file", "script_id", "step_line", "name").distinct()
    w = Window.partitionBy("file", "script_id").orderBy("step_line", "step_uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.last(F.when(F.col("name").isin(*graph.FINDS), F.col("step_line")), ignorenulls=True).over(w)
    return s.withColumn("found", found).where("name = 'Set Field'").select("step_uid", "found")


@query("SELECT DISTINCT obj_id, CASE WHEN TRY_CAST(trim(object_key) AS BIGINT) BETWEEN 1 AND 55295 THEN chr(CAST(trim(object_key) AS INT)) WHEN TRY_CAST(trim(object_key) AS BIGINT) BETWEEN 57344 AND 1114111 THEN chr(CAST(trim(object_key) AS INT)) ELSE '' END AS c FROM layout_objects WHERE regexp_matches(object_key, '^[0-9]{1,4}$')")
def f8_characters(spark, d):
    return table(spark, d, "layout_objects").where(F.col("object_key").rlike("^[0-9]{1,4}$")).select("obj_id", X.char_of(F.col("object_key")).alias("c")).distinct()


@query("SELECT DISTINCT obj_id, CASE WHEN n = 0 THEN '' WHEN n BETWEEN 55296 AND 57343 OR n > 1114111 THEN printf('U+%04X', n) ELSE chr(CAST(n AS INT)) END AS c FROM (SELECT obj_id, coalesce(TRY_CAST(trim(object_key) AS BIGINT), 0) * 7919 AS n FROM layout_objects WHERE object_key IS NOT NULL AND NOT regexp_matches(trim(object_key), '[^0-9]'))")
def f8_characters_of_any_code(spark, d):
    """As f8_characters, over codes of any length: keys are multiplied so that surrogates and numbers beyond Unicode occur."""
    keys = table(spark, d, "layout_objects").where("object_key is not null").where(~F.trim("object_key").rlike("[^0-9]"))
    n = F.coalesce(F.trim("object_key").try_cast("bigint"), F.lit(0)) * 7919
    return keys.select("obj_id", X.char_of(n.cast("string")).alias("c")).distinct()


@query("SELECT path, lines FROM (" + _CUR + ") WHERE snapshot_no = 6 AND lines IS NOT NULL ORDER BY lines DESC, path DESC LIMIT 1")
def o3_largest(spark, d):
    return _index(spark, d, 6).where("lines is not null").orderBy(F.desc("lines"), F.desc("path")).limit(1).select("path", "lines")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def st_windowed_counts(spark, d):
    """The events as a stream of one file, counted per day under a watermark, run to its end."""
    import uuid

    from shalework.session import shared_dir
    from shalework.streaming.ingest import windowed_counts

    name = f"windows_{uuid.uuid4().hex}"
    whole = table(spark, d, "events")
    stream = spark.readStream.schema(whole.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counts = windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", None, "400 days", "event_type")
    q = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_dir(spark)}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")
