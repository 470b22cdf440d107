"""What changed between full snapshots of a catalog.

The snapshots are range-partitioned by (file, path) and sorted by (file, path, snapshot); all versions of a path thereby lie
side by side in one range. Each range is streamed once: the row at hand is the cursor on the later snapshot, the row before
it the cursor on the earlier one, and comparing the two decides between added, removed and changed for every pair of
consecutive snapshots. Ranges that hold a hot file are split by path, so no file has to fit into one task.

Defined results. Rows without file, path or snapshot number are left out. Of several rows of one snapshot and path the one
received last counts (then the greater hash); null ``received_at`` is the oldest. A null hash equals a null hash only. A file
that is missing from a whole snapshot is compared across the gap. Empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shalework.functions.text import path_key, strip

#: A (file, snapshot) list up to this size is broadcast to the ranges.
BROADCAST_ROWS = 200_000

RESULT = "snapshot_no int, path string, delta string"


def current_rows(index: DataFrame) -> DataFrame:
    """(file, path, snapshot_no, hash, received_at) in their one spelling, not yet unique."""
    return index.where(F.col("file").isNotNull() & F.col("path").isNotNull() & F.col("snapshot_no").isNotNull()).select(
        "file", path_key(F.col("path")).alias("path"), "snapshot_no", F.lower(strip(F.col("sha256"))).alias("hash"), "received_at"
    )


def with_neighbours(rows: DataFrame) -> DataFrame:
    """Adds the snapshot of the same file before and after (``prev``, ``next``; null at the ends)."""
    of_file = Window.partitionBy("file").orderBy("snapshot_no")
    seen = (
        rows.select("file", "snapshot_no").distinct()
        .withColumn("prev", F.lag("snapshot_no").over(of_file))
        .withColumn("next", F.lead("snapshot_no").over(of_file))
    )
    if seen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        seen = F.broadcast(seen)
    return rows.join(seen, ["file", "snapshot_no"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams a sorted range. The last row of a batch waits for its successor."""
    held: pa.Table | None = None
    before: pa.Table | None = None  # the version that precedes the rows at hand

    def emit(rows: pa.Table, before: pa.Table | None, after: pa.Table | None) -> pa.RecordBatch:
        n = rows.num_rows
        around = pa.concat_tables([t for t in (before, rows, after) if t is not None])
        lead, trail = before is not None, after is not None
        same = np.asarray(
            pc.and_(
                pc.equal(around["file"].slice(1), around["file"].slice(0, around.num_rows - 1)),
                pc.equal(around["path"].slice(1), around["path"].slice(0, around.num_rows - 1)),
            )
        ).astype(bool) if around.num_rows > 1 else np.zeros(0, bool)
        no = lambda c: np.asarray(pc.fill_null(around[c], -(2**31)))
        snap, prev, nxt = no("snapshot_no"), no("prev"), no("next")
        h = pc.fill_null(around["hash"], "\0")
        differs = np.asarray(pc.not_equal(h.slice(1), h.slice(0, around.num_rows - 1))).astype(bool) if around.num_rows > 1 else np.zeros(0, bool)
        # element i of same/differs compares around[i] with around[i + 1]
        at = np.arange(n) + int(lead)
        has_prev, has_next = prev[at] != -(2**31), nxt[at] != -(2**31)
        in_prev = np.zeros(n, bool)
        changed = np.zeros(n, bool)
        for_prev = at >= 1
        i = at[for_prev]
        in_prev[for_prev] = same[i - 1] & (snap[i - 1] == prev[i])
        changed[for_prev] = in_prev[for_prev] & differs[i - 1]
        in_next = np.zeros(n, bool)
        for_next = at < around.num_rows - 1
        i = at[for_next]
        in_next[for_next] = same[i] & (snap[i + 1] == nxt[i])
        added, removed = has_prev & ~in_prev, has_next & ~in_next
        path = rows["path"]
        take = lambda mask: path.filter(pa.array(mask)).to_pylist()
        own, later = snap[at], nxt[at]
        paths = take(added) + take(changed) + take(removed)
        numbers = np.concatenate([own[added], own[changed], later[removed]]).astype(np.int32)
        kinds = ["added"] * int(added.sum()) + ["changed"] * int(changed.sum()) + ["removed"] * int(removed.sum())
        return pa.record_batch([pa.array(numbers, pa.int32()), pa.array(paths, pa.string()), pa.array(kinds, pa.string())], ["snapshot_no", "path", "delta"])

    def unique(rows: pa.Table) -> pa.Table:
        """The first of each run of equal (file, path, snapshot): it was received last."""
        if rows.num_rows < 2:
            return rows
        n = rows.num_rows - 1
        same = None
        for c in ("file", "path", "snapshot_no"):
            e = pc.equal(rows[c].slice(1), rows[c].slice(0, n))
            same = e if same is None else pc.and_(same, e)
        keep = np.concatenate([[True], ~np.asarray(same).astype(bool)])
        return rows.filter(pa.array(keep))

    for b in batches:
        t = pa.Table.from_batches([b])
        t = unique(t if held is None else pa.concat_tables([held, t]))
        if t.num_rows > 1:
            rows, held = t.slice(0, t.num_rows - 1), t.slice(t.num_rows - 1)
            yield emit(rows, before, held)
            before = rows.slice(rows.num_rows - 1)
        else:
            held = t
    if held is not None and held.num_rows:
        yield emit(held, before, None)


def changes(index: DataFrame) -> DataFrame:
    """(snapshot_no, path, delta): delta is added, removed or changed, snapshot_no the later of the two snapshots."""
    rows = with_neighbours(current_rows(index))
    ranged = rows.repartitionByRange("file", "path").sortWithinPartitions(
        "file", "path", "snapshot_no", F.desc_nulls_last("received_at"), F.desc_nulls_last("hash")
    )
    return ranged.select("file", "path", "snapshot_no", "hash", "prev", "next").mapInArrow(_merge, RESULT)
