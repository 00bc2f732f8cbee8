"""Exact deduplication by content sort.

Rows are range-partitioned by sampled splitters over (first characters, SHA-256, id) of
the normalised text, sorted externally within each range so that equal texts
stand next to each other, and neighbours are compared in full. The hash and the
id take part in the splitters, so a huge group of copies spans several ranges. A
run at the edge of a range is a part of a group, and so is every HELD rows of a
long run; the parts of a group (two a range and one for HELD rows at most) carry
their text once each and meet by the whole text.

Defined results: a null text counts as empty, and all empty texts are one group;
a null id sorts first and is kept only if the whole group has null ids; repeated
rows (same id and text) share keep_id, and all rows with that id count as kept;
a very long text is compared whole, and a run of any number of rows is handed on
in bounded batches; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, spread, stored

#: Characters of a text that take part in the splitters; the driver samples no more than these.
PREFIX = 24
#: Rows of a run after which a part of it is handed on, about.
HELD = 50_000
_RUNS = "doc_id long, lo long, hi long, n long, sha binary, part long, norm string"


class _Runs:
    """Sorted rows (doc_id, norm, sha) to rows of _RUNS. part is null for a whole run; a part's first row has its text."""

    def __init__(self, pid: int):
        self.part = pid << 32
        self.head: str | None = None
        self.ids: list[pa.Array] = []
        self.held, self.edge = 0, True

    def rows(self, doc: pa.Array, starts: np.ndarray, sha: pa.Array, edge: bool) -> pa.RecordBatch:
        """Runs of doc that begin at starts, each with its digest; at an edge it is one part."""
        n = np.diff(np.append(starts, len(doc)))
        none = doc.is_null().to_numpy(zero_copy_only=False)
        ids = doc.fill_null(0).to_numpy()
        most = np.iinfo(np.int64)
        lo = np.minimum.reduceat(np.where(none, most.max, ids), starts)
        hi = np.maximum.reduceat(np.where(none, most.min, ids), starts)
        void = np.repeat(np.add.reduceat((~none).astype(np.int64), starts) == 0, n)
        first = [self.head if edge else None] + [None] * (len(doc) - 1)
        self.part += edge
        cols = [
            doc, pa.array(np.repeat(lo, n), mask=void), pa.array(np.repeat(hi, n), mask=void), pa.array(np.repeat(n, n)),
            sha.take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.full(len(doc), self.part), mask=np.full(len(doc), not edge)), pa.array(first, pa.string()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in _RUNS.split(", ")])

    def flush(self, edge: bool) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield self.rows(pa.concat_arrays(self.ids), np.zeros(1, np.int64), self.sha, edge)
        self.ids, self.held = [], 0

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        doc, norm, sha = batch.columns
        starts = np.concatenate([[0], np.flatnonzero(pc.not_equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)) + 1])
        ends = np.append(starts[1:], len(doc))
        begin = norm[0].as_py()
        if self.head is not None and begin != self.head:
            yield from self.flush(self.edge)
            self.edge = False
        for k in (0, len(starts) - 1) if len(starts) > 1 else (0,):
            if k:  # the run that went on has ended, and those between are whole
                yield from self.flush(self.edge)
                self.edge = False
                if k > 1:
                    inner = slice(int(starts[1]), int(starts[k]))
                    yield self.rows(doc[inner], starts[1:k] - starts[1], sha.take(pa.array(starts[1:k])), False)
            self.head, self.sha = norm[int(starts[k])].as_py(), sha[int(starts[k]) : int(starts[k]) + 1]
            # Copied, or the slice would keep its whole batch.
            self.ids.append(pa.array(doc[int(starts[k]) : int(ends[k])].to_pandas(integer_object_nulls=True), pa.int64()))
            self.held += int(ends[k] - starts[k])
        if self.held >= HELD:
            self.edge = True
            yield from self.flush(True)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = _Runs(TaskContext.get().partitionId())
    for batch in batches:
        if batch.num_rows:
            yield from runs.take(batch)
    yield from runs.flush(True)


def exact_groups(docs: DataFrame, keep: str = "smallest", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" id of a group of equal texts.
    """
    bounded(docs.sparkSession)
    norm = docs.select(F.col(doc_id).cast("long").alias("doc_id"), ascii_lower(text).alias("norm"))
    keys = ["prefix", "sha", "doc_id"]
    dealt = (
        norm.withColumns({"prefix": F.substring("norm", 1, PREFIX), "sha": F.unhex(F.sha2("norm", 256))})
        .repartitionByRange(spread(norm), *keys)
        .sortWithinPartitions(*keys)
        .select("doc_id", "norm", "sha")
    )
    runs = stored(dealt.mapInArrow(_runs, _RUNS))
    ends = runs.where("part is not null and norm is not null").select("part", "norm", "lo", "hi", "n")
    whole = ends.groupBy("norm").agg(F.sum("n").alias("size"), F.min("lo").alias("least"), F.max("hi").alias("most"))
    # Two parts a range and one for HELD rows at most, four numbers each.
    parts = F.broadcast(ends.select("part", "norm").join(whole, "norm").select("part", "size", "least", "most"))
    best, own = ("most", "hi") if keep == "largest" else ("least", "lo")
    kept = F.when(F.col("size").isNull(), F.col(own)).otherwise(F.col(best))
    return runs.drop("norm").join(parts, "part", "left").select(
        "doc_id",
        kept.alias("keep_id"),
        F.coalesce("size", "n").alias("group_size"),
        F.col("doc_id").eqNullSafe(kept).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
