"""Design reports: files or table rows of XML text, read into a lossless node table.

A report is one document with the root ``FMPReport``. Bytes are decoded, forbidden characters dropped and counted, and each
document is shredded in one streaming pass. A document that cannot be read is listed with its reason, never lost silently.

One document is one task's work: documents are not splittable, but the shredder streams and emits bounded batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shalework.functions.text import slug
from shalework.sources.xml_text import FORBIDDEN, TreeError, clean_xml, walk

#: One row per element. ``pre`` and ``post`` are the first and last number of its subtree, ``anc`` its ancestors from the root.
NODES = (
    "doc string, file string, pre int, post int, parent int, depth int, pos int, tag string, attrs map<string,string>, "
    "attr_order array<string>, text string, tail string, anc array<struct<pre:int,tag:string>>"
)
EMIT = 20_000


@F.pandas_udf(T.StringType())
def _decoded(content: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([bytes(b).decode(e, "replace") for b, e in zip(content, encoding)], dtype=object)


def decoded(content: Column, encoding: str = "UTF-16") -> Column:
    """Bytes as text; what is no character becomes a replacement character, so that one bad byte never stops a run."""
    return _decoded(content, F.lit(encoding))


def raw_documents(spark: SparkSession, path: str, encoding: str = "UTF-16") -> DataFrame:
    """(doc, bytes, text) of the XML files of a folder (not of its subfolders), or of one file; names in any letter case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    if not path.lower().endswith(".xml"):
        files = files.option("pathGlobFilter", "*.[xX][mM][lL]")
    return files.load(path).select(F.col("path").alias("doc"), F.col("length").alias("bytes"), decoded(F.col("content"), encoding).alias("text"))


def dropped_characters(docs: DataFrame) -> DataFrame:
    """(doc, dropped): how many forbidden characters each document holds."""
    odd = FORBIDDEN.pattern.replace("\ud800-\udfff", "")
    return docs.select("doc", (F.length("text") - F.length(F.regexp_replace("text", odd, ""))).alias("dropped")).where("dropped > 0")


def _shred(doc: str, text: str) -> Iterator[tuple]:
    """Rows of one document in order of ``pre``; raises TreeError."""
    rows: list[list] = []
    stack: list[list] = []  # [row, children so far, ancestors for children]
    last: list | None = None  # the element that closed last: its tail is what follows
    n, file = 0, None
    for tag, data in walk(clean_xml(text), with_text=True):
        if tag is None:
            row = stack.pop()[0]
            row[3] = n
            last = row
            if row[7] == "File":
                file = None
        elif tag == "":
            if last is not None:
                last[11] = (last[11] or "") + data
            elif stack:
                stack[-1][0][10] = (stack[-1][0][10] or "") + data
        else:
            n += 1
            up = stack[-1] if stack else None
            if up is not None:
                up[1] += 1
            if tag == "File" and (up is None or up[0][7] == "FMPReport"):
                file = data.get("name") or ""
            anc = up[2] if up else []
            row = [doc, file, n, n, up[0][2] if up else 0, len(stack), up[1] if up else 1, tag, list(data.items()), list(data), None, None, anc]
            rows.append(row)
            stack.append([row, 0, [*anc, {"pre": n, "tag": tag}]])
            last = None
    yield from rows


_ARROW = pa.schema(
    [
        ("doc", pa.string()), ("file", pa.string()), ("pre", pa.int32()), ("post", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()),
        ("pos", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("attr_order", pa.list_(pa.string())),
        ("text", pa.string()), ("tail", pa.string()), ("anc", pa.list_(pa.struct([("pre", pa.int32()), ("tag", pa.string())]))),
    ]
)


def _batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(_ARROW)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def shred(docs: DataFrame) -> DataFrame:
    """(doc, text) -> the node table. Unreadable documents give no rows here; see :func:`ingest_errors`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                t = text.as_py()
                if not t:
                    continue
                try:
                    for row in _shred(doc, t):
                        rows.append(row)
                        if len(rows) >= EMIT:
                            yield _batch(rows)
                            rows = []
                except TreeError:
                    pass
        yield _batch(rows)

    return docs.select(F.col("doc").cast("string").alias("doc"), "text").mapInArrow(run, NODES)


def ingest_errors(docs: DataFrame) -> DataFrame:
    """(doc, reason) of each document that is empty, not well-formed, or no report."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                t = text.as_py()
                if not t:
                    out.append((doc, "empty"))
                    continue
                try:
                    root = next(iter(walk(clean_xml(t))))
                    if root[0] != "FMPReport" or root[1].get("type") != "Report":
                        out.append((doc, "not a report"))
                except TreeError as e:
                    out.append((doc, re.sub(r": line.*", "", str(e))))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["doc", "reason"])

    return docs.select(F.col("doc").cast("string").alias("doc"), "text").mapInArrow(run, "doc string, reason string")


def discover(docs: DataFrame) -> DataFrame:
    """The documents that are reports; if none is, the largest document (ties: the greater name)."""
    bad = ingest_errors(docs)
    good = docs.join(bad, docs["doc"].cast("string") == bad["doc"], "left_anti")
    if good.take(1):
        return good.orderBy("doc")
    return docs.orderBy(F.desc("bytes"), F.desc("doc")).limit(1)


class DuplicateSource(ValueError):
    """Two documents describe the same application file."""


def files_of(nodes: DataFrame) -> DataFrame:
    """(doc, file, pre, host_path, version, created) of every file element; a document may hold several."""
    f = nodes.where((F.col("tag") == "File") & (F.col("depth") == 1))
    root = nodes.where(F.col("depth") == 0).select(F.col("doc").alias("_d"), F.col("attrs")["version"].alias("version"), F.col("attrs")["creationDate"].alias("created"))
    return f.join(root, f["doc"] == root["_d"]).select("doc", F.coalesce(F.col("attrs")["name"], F.lit("")).alias("file"), "pre", F.col("attrs")["path"].alias("host_path"), "version", "created")


def duplicate_sources(files: DataFrame) -> DataFrame:
    """(file, docs) of each file that more than one document describes."""
    return files.groupBy("file").agg(F.sort_array(F.collect_set("doc")).alias("docs"), F.count("*").alias("_n")).where("_n > 1").drop("_n")


def check_sources(files: DataFrame) -> None:
    """Raises with the names of both documents, since ids of one file must come from one document."""
    first = duplicate_sources(files).orderBy("file").limit(1).collect()
    if first:
        raise DuplicateSource(f"File name '{first[0]['file']}' in {', '.join(first[0]['docs'])}")


def folder_names(files: DataFrame) -> DataFrame:
    """(file, folder): a folder name per file; names that differ in case only, or not at all as slugs, get a hash suffix."""
    named = files.select("file").distinct().withColumn("slug", slug(F.col("file"), 80))
    shared = named.groupBy(F.lower("slug").alias("_k")).agg(F.count("*").alias("_n"))
    both = named.join(shared, F.lower("slug") == F.col("_k"))
    return both.select("file", F.when(F.col("_n") > 1, F.concat("slug", F.lit("--"), F.substring(F.sha2("file", 256), 1, 8))).otherwise(F.col("slug")).alias("folder"))
