"""Exact vector search: blocks of queries against all rows, by matrix products on Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.sets import bound
from .lexical import top

DIM = 64
#: Queries that travel with the tasks at a time.
BLOCK = 2_048
#: Scores are compared after rounding to six decimals, so before it those that lie up to a whole last decimal below may count as equal.
MARGIN = 1.1e-6


def encode(t: Column, dim: int = DIM) -> Column:
    """The default encoder: counts of tokens by a hash of each (the first two hex digits of its md5)."""
    at = F.transform(tx.tokens(t), lambda w: F.pmod(F.conv(F.left(F.md5(w), F.lit(2)), 16, 10).cast("int"), F.lit(dim)))
    return bound(lambda v: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(F.filter(v["at"], lambda x: x == d)).cast("double")), at=at)


def encode_text(text: str, dim: int = DIM) -> list[float]:
    """The same on the driver."""
    out = [0.0] * dim
    for w in (text or "").lower().split():
        out[int(hashlib.md5(w.encode()).hexdigest()[:2], 16) % dim] += 1
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of a row; null if one is of length zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow batch; one that is null or of another length is all NaN."""
    out = np.full((len(column), width), np.nan)
    for k, r in enumerate(column.to_pylist()):
        if r is not None and len(r) == width and None not in r:
            out[k] = r
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def search(queries: DataFrame, rows: DataFrame, k: int | None = None, least: float | None = None) -> DataFrame:
    """query_id, idx, score (cosine) of the k best rows, or of all rows from least on.

    queries: (query_id, vec); rows: (idx, vec). A vector of length zero (or null), or of another
    number of dimensions than the query's, has no cosine and is left out. Each batch hands on its k best for a query, so no more than that is shuffled.
    """
    parts: list[DataFrame] = []
    blocks: dict[int, list] = {}

    def run(ids: list, matrix: np.ndarray) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                unit = _unit(_matrix(b.column(1), matrix.shape[1]))
                scores = np.nan_to_num(unit @ matrix.T, nan=-2.0)
                keep = scores > -1.5
                if least is not None:
                    keep &= scores >= least - MARGIN
                if k is not None and len(scores) > k:
                    edge = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
                    keep &= scores >= edge - MARGIN  # ties at the edge stay until all batches are known
                r, q = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(ids, np.int64)[q]), b.column(0).take(pa.array(r)), pa.array(scores[r, q])], names=["query_id", "idx", "score"])

        return rows.select(F.col("idx").cast("long").alias("idx"), "vec").mapInArrow(work, "query_id long, idx long, score double")

    def flush(width: int) -> None:
        block = blocks.pop(width)
        parts.append(run([b[0] for b in block], _unit(np.array([b[1] for b in block], np.float64).reshape(len(block), width))))

    for r in queries.where("vec is not null").select("query_id", "vec").toLocalIterator():
        block = blocks.setdefault(len(r[1]), [])
        block.append((r[0], r[1]))
        if len(block) == BLOCK:
            flush(len(r[1]))
    for width in list(blocks) or [1]:
        blocks.setdefault(width, [])
        flush(width)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    scored = out.withColumn("score", F.round("score", 6))
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    return top(scored, k, F.desc("score"), F.asc("idx")) if k is not None else scored
