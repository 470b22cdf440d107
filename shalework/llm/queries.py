"""Queries on texts and code values by name, with the SQL they are held against where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shalework.llm import contamination, frequency, neardup, packing, secrets, splitting, tokens
from shalework.session import table


STEP_FIELDS = [secrets.Field("step_text"), secrets.Field("calculation"), secrets.Field("smtp_password", password=True)]
SOURCE_FIELDS = [secrets.Field("password", password=True)]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Credentials in steps and data sources -> tab, rec_id, field, secret."""
    steps = secrets.fields_of(table(spark, d, "steps"), "steps", "step_uid", "file", STEP_FIELDS)
    sources = secrets.fields_of(table(spark, d, "data_sources"), "data_sources", "source_uid", "file", SOURCE_FIELDS)
    return secrets.find_secrets(steps.unionByName(sources))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every step with its credentials masked -> step_uid, received_at, step_text, calculation, smtp_password."""
    steps = table(spark, d, "steps").select("step_uid", "received_at", "step_text", "calculation", "smtp_password")
    return secrets.redact(steps, p3_found(spark, d), "steps", "step_uid", STEP_FIELDS)


def p3_redacted_sources(spark: SparkSession, d: str) -> DataFrame:
    """Every data source with its credentials masked -> the columns of data_sources."""
    sources = table(spark, d, "data_sources")
    return secrets.redact(sources, p3_found(spark, d), "data_sources", "source_uid", SOURCE_FIELDS)


def p4_batches(spark: SparkSession, d: str) -> DataFrame:
    """The objects of the last snapshot in batches of at most 6,000 lines, each of one file, kind and folder."""
    return packing.pack_snapshot(table(spark, d, "object_index"))


def p4_mixed(spark: SparkSession, d: str) -> DataFrame:
    """As p4_batches, but a batch may mix kinds and folders of a file, the most alike first, which leaves fewer lines unused."""
    return packing.pack_snapshot(table(spark, d, "object_index"), within=("file",))


def p4_unused(spark: SparkSession, d: str) -> DataFrame:
    """Batches, lines and unused lines of p4_batches by kind."""
    batches = p4_batches(spark, d).groupBy("file", "kind", "batch").agg(F.sum("lines").alias("lines"))
    return batches.groupBy("kind").agg(F.count("*").alias("batches"), F.sum("lines").alias("lines"), F.sum(6000 - F.col("lines")).alias("unused"))


def _p5_texts(spark: SparkSession, d: str) -> DataFrame:
    return neardup.texts_of(table(spark, d, "steps"), table(spark, d, "calculations"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of similar step texts and of similar calculations -> tab, id_a, id_b."""
    return neardup.similar_pairs(_p5_texts(spark, d))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per text of at least 25 words: its class of equal sets, its group, and its number of links to other classes."""
    return neardup.groups(_p5_texts(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Codes of layout objects that are too rare or too common -> field, val, mark."""
    f = frequency.code_frequencies(table(spark, d, "layout_objects"))
    return f.where(F.col("mark").isNotNull()).select("field", "val", "mark")


def p7_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct code of each field with its occurrences and objects."""
    return frequency.code_frequencies(table(spark, d, "layout_objects"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document -> doc_id, ids (empty for empty and null texts)."""
    return tokens.encode_documents(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that leak a held-out item -> doc_id, item_id."""
    return contamination.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Documents of more than 512 tokens as pieces of at most 512 that share up to 64."""
    return splitting.split_documents(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_redacted, p3_redacted_sources, p4_batches, p4_mixed, p4_unused, p5_found, p5_groups, p7_found, p7_frequencies, p8_ids, p9_found, p10_pieces)}

_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_P7 = f"""
WITH cur AS (SELECT * FROM layout_objects WHERE obj_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY obj_id ORDER BY received_at DESC NULLS LAST, flags DESC NULLS LAST, display_type DESC NULLS LAST, button_flags DESC NULLS LAST, cond_ops DESC NULLS LAST) = 1),
codes AS (
  SELECT obj_id, 'Object.flags' AS field, flags AS c FROM cur UNION ALL SELECT obj_id, 'FieldObj.displayType', display_type FROM cur
  UNION ALL SELECT obj_id, 'ButtonObj.buttonFlags', button_flags FROM cur UNION ALL SELECT obj_id, 'Condition.op', unnest(cond_ops) FROM cur),
t AS (SELECT obj_id, field, regexp_replace(c, '^{_WS}+|{_WS}+$', '', 'g') AS val FROM codes),
n AS (SELECT field, val, count(*) AS occurrences, count(DISTINCT obj_id) AS objects FROM t WHERE val <> '' GROUP BY ALL),
h AS (SELECT field, count(DISTINCT obj_id) AS holders FROM t WHERE val <> '' GROUP BY ALL)
SELECT n.field, val, occurrences, objects, holders, CASE WHEN objects < 5 THEN 'rare' WHEN objects > 0.4 * holders THEN 'common' END AS mark
FROM n JOIN h ON n.field = h.field"""

_P9 = """
WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^\\pL\\pN]', '', 'g') AS t FROM documents),
i AS (SELECT item_id, regexp_replace(lower(text), '[^\\pL\\pN]', '', 'g') AS t FROM benchmark),
dw AS (SELECT DISTINCT doc_id, hash(substr(t, k, 60)) AS w FROM (SELECT doc_id, t, unnest(range(1, length(t) - 58)) AS k FROM d WHERE length(t) >= 60)),
iw AS (SELECT DISTINCT item_id, hash(substr(t, k, 60)) AS w FROM (SELECT item_id, t, unnest(range(1, length(t) - 58)) AS k FROM i WHERE length(t) >= 60))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw ON dw.w = iw.w"""

_P5 = """
WITH t AS (SELECT DISTINCT 'steps' AS tab, step_uid AS id, step_text AS x FROM steps UNION SELECT 'calculations', calc_id, calculation FROM calculations),
w AS (SELECT tab, id, regexp_extract_all(lower(x), '[\\pL\\pN_]+') AS w FROM t WHERE id IS NOT NULL),
g AS (SELECT DISTINCT tab, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 25),
n AS (SELECT tab, id, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT a.tab, a.id AS id_a, b.id AS id_b, count(*) AS c FROM g a JOIN g b ON a.tab = b.tab AND a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT c.tab, id_a, id_b FROM c JOIN n x ON x.tab = c.tab AND x.id = id_a JOIN n y ON y.tab = c.tab AND y.id = id_b
WHERE 10 * c >= 6 * (x.n + y.n - c)"""

SQL = {
    "p5_found": _P5,
    "p7_found": f"SELECT field, val, mark FROM ({_P7}) WHERE mark IS NOT NULL",
    "p7_frequencies": _P7,
    "p9_found": _P9,
}
