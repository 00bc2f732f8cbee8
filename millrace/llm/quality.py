"""Quality with a regularised quadratic discriminant.

Each document is described by transformed statistics of its whole text. Two
Gaussians, one for each label, are fitted to the statistics of all labelled
training rows: sums and sums of products are aggregated on the executors, the
covariances are shrunk towards their diagonal, and their Cholesky factors are
cached. The score is the logistic of the difference of the log densities (by
Mahalanobis distances from the factors) with the classes' shares.

Defined results: null and empty texts have the statistics of an empty text;
repeated rows get equal scores; rows with a null label or id are not learned
from; with a class missing every score is its share (0.5 without labels); extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, fresh, stored

#: Share of the diagonal in the covariances, and of the pooled variance in that diagonal.
SHRINK, POOL = 0.05, 0.02
#: Log odds beyond which the score no longer moves; Gaussian tails are surer than they should be.
LIMIT = 30.0

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SPACE = np.array([b in b" \t\n\r\x0b\f" for b in range(256)])
_HIGH = np.arange(256) >= 128
_STOP = np.array([chr(b) in ".,;:!?'\"-()" for b in range(256)])
_SIGN = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH | _STOP)
NAMES = (
    "log_words", "word_length", "upper", "digits", "signs", "stops", "high", "types", "repeats",
    "lines", "line_repeats", "top_word", "entropy", "short", "long", "marked",
)


def statistics(text: bytes) -> list[float]:
    """Transformed statistics, in the order of NAMES."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = lambda mask: math.sqrt(count[mask].sum() / size)
    sizes = np.fromiter(map(len, words), np.int64, n)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    p = count[count > 0] / size
    many = max(1, n)
    return [
        math.log1p(n),
        math.log1p(float(sizes.mean()) if n else 0.0),
        share(_UPPER),
        share(_DIGIT),
        share(_SIGN),
        share(_STOP),
        share(_HIGH),
        math.log((len(seen) + 1) / (n + 1)),
        math.sqrt(sum(a == b for a, b in zip(words, words[1:])) / many),
        math.log1p(len(lines)) - math.log1p(n),
        math.sqrt(1 - len(set(lines)) / len(lines)) if lines else 0.0,
        math.sqrt(max(seen.values(), default=0) / many),
        float(-(p * np.log2(p)).sum()),
        math.sqrt(float((sizes <= 3).mean()) if n else 0.0),
        math.sqrt(float((sizes >= 14).mean()) if n else 0.0),
        math.sqrt(sum(w[-1:] in b"!*%&#$" for w in words) / many),
    ]


class Discriminant:
    """Two Gaussians with cached Cholesky factors."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        total = sum(n for n, _, _ in sums.values())
        self.share = sums[1][0] / total if total else 0.5
        self.parts: list[tuple[np.ndarray, np.ndarray, float]] = []
        if min(n for n, _, _ in sums.values()) < 2:
            return
        covs = {y: s2 / n - np.outer(s1 / n, s1 / n) for y, (n, s1, s2) in sums.items()}
        pooled = sum(sums[y][0] * np.diag(c) for y, c in covs.items()) / total + 1e-6
        for y in (0, 1):
            n, s1, _ = sums[y]
            own = np.diag(covs[y])
            shrunk = (1 - SHRINK) * covs[y] + SHRINK * np.diag((1 - POOL) * own + POOL * pooled) + np.diag(POOL * pooled)
            factor = np.linalg.cholesky(shrunk)
            bias = math.log(n / total) - np.log(np.diag(factor)).sum()
            self.parts.append((s1 / n, np.linalg.inv(factor), float(bias)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), self.share)
        no, yes = (b - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, b in self.parts)
        return 1 / (1 + np.exp(-np.clip(yes - no, -LIMIT, LIMIT)))


def measured(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """Every row without its text, with an array of its statistics; returns the rows and the column's name."""
    (name,) = fresh(docs, "stats")

    def start():
        def work(texts: list[bytes]) -> list[pa.Array]:
            flat = np.array([statistics(t) for t in texts], np.float64).reshape(-1)
            ends = np.arange(0, len(flat) + 1, len(NAMES), dtype=np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]

        return work

    return annotate(docs, start, [(name, T.ArrayType(T.DoubleType()))], text, keep_text=False), name


def fit(rows: DataFrame, labels: DataFrame, stats: str, label: str = "quality") -> Discriminant:
    """Fit on all labelled rows (doc_id, statistics)."""
    known = labels.where(f"{label} in (0, 1)").groupBy("doc_id").agg(F.max(label).alias("y"))
    k = len(NAMES)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    at = lambda i: F.get(F.col(stats), F.lit(i))
    sums = rows.select("doc_id", stats).join(known, "doc_id").groupBy("y").agg(
        F.count("*").alias("n"), F.array(*(F.sum(at(i)) for i in range(k))).alias("one"), F.array(*(F.sum(at(i) * at(j)) for i, j in pairs)).alias("two")
    )
    out = {y: (0.0, np.zeros(k), np.zeros((k, k))) for y in (0, 1)}
    for r in sums.collect():  # one row a label
        two = np.zeros((k, k))
        for (i, j), v in zip(pairs, r["two"]):
            two[i, j] = two[j, i] = v
        out[int(r["y"])] = (float(r["n"]), np.array(r["one"]), two)
    return Discriminant(out)


def score(rows: DataFrame, model: Discriminant, stats: str) -> tuple[DataFrame, str]:
    """Append the score (0 to 1) to measured rows; returns them and the column's name."""
    (name,) = fresh(rows, "score")
    columns = rows.columns

    def run(batches):
        for b in batches:
            x = np.array(b.column(columns.index(stats)).flatten().to_numpy()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(x))], names=[*columns, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])), name


def kept(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """Statistics of all rows, written once: the fit and the scores read them and no text again."""
    rows, stats = measured(docs, text)
    return stored(rows), stats
