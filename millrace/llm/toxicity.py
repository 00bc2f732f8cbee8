"""Toxicity with a convolutional text classifier trained in numpy.

A word (ASCII lower-cased, letters, digits and non-ASCII only) is the sum of the
rows that it and its beginnings have in a hashed embedding table. Filters of several widths slide over a whole
text, each keeps its maximum, and a linear layer scores the maxima. Rows of the
table that no training word touched stay zero, so unknown words are neutral.
Decision thresholds are calibrated for each language on all labelled training
rows, by histograms made on the executors; a language with fewer than POSITIVES
positive rows takes the threshold of all rows. The score itself never sees language, source, labels or id.

The fit takes a bounded sample of the labelled training rows (TRAIN_ROWS rows and
TRAIN_BYTES bytes at most, drawn by hash; rows that share an id count once, and a
text of more than a twentieth of the bytes is passed over); every document is
scored in full, however long, block by block.

Defined results: a null or empty text is scored from its empty maxima (a low
score); repeated rows get equal scores; rows with null labels are not learned
from; without labelled rows of both classes every score is 0; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OBJECT, WORD_TABLE, annotate, fresh, pieces, stored

BITS, DIM, WIDTHS, FILTERS = 18, 8, (1, 2, 3), 8
#: Bytes of a word that its table rows are hashed from: beginnings, and the whole of it (words are cut nowhere).
PARTS = (4, 5, 6, 1 << 30)
#: Rows of the sample that the network is fitted on, and bytes of their texts.
TRAIN_ROWS, TRAIN_BYTES = 6_000, 24 << 20
EPOCHS, BATCH = 8, 32
#: Share of a text's words that are left out whenever the fit meets it, so that no single word carries a label.
DROP = 0.3
#: Bytes of text scored at a time; words that a filter may straddle are carried on to the next block.
BLOCK = 1 << 20
#: Bytes of words and their embeddings that a task remembers.
CACHE = 48 << 20
#: Bins of the scores that thresholds are cut from, and the positive rows that a language's own threshold takes.
BINS, POSITIVES = 1_000, 20


def rows_of(word: bytes) -> tuple[int, ...]:
    """Table rows of a word: its own, and those of its beginnings (inflected forms share them)."""
    mask = (1 << BITS) - 1
    return tuple(xxhash.xxh3_64_intdigest(word[:n], n) & mask for n in PARTS)


class Words(dict):
    """word to a number; parts has the table rows of those numbered since it was cleared."""

    def __init__(self):
        self.clear_parts()

    def clear_parts(self) -> None:
        self.parts: list[tuple[int, ...]] = []
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        self.parts.append(rows_of(word))
        self.bytes += len(word)
        return out

    def numbers(self, text: bytes) -> np.ndarray:
        words = text.translate(WORD_TABLE).split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.table = np.zeros((1 << BITS, DIM), np.float32)
        self.filters = [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
        self.out = rng.normal(0, 0.5, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.float32(-1.0)

    def embed(self, parts: np.ndarray) -> np.ndarray:
        return self.table[parts].sum(1)

    def peaks(self, blocks: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of one text, embedded block by block: each filter's maximum (zero at least) and where it starts (-1: nowhere)."""
        best = np.zeros(len(self.bias), np.float32)
        where = np.full(len(self.bias), -1, np.int64)
        reach = max(WIDTHS) - 1

        def take(x: np.ndarray, size: int, at: int) -> None:
            for k, f in enumerate(self.filters):
                y = x[:size] @ f[0]
                for j in range(1, len(f)):
                    y += x[j : j + size] @ f[j]
                s = slice(k * FILTERS, (k + 1) * FILTERS)
                top = y.argmax(0)
                high = y[top, np.arange(FILTERS)] + self.bias[s]
                more = high > best[s]
                best[s] = np.where(more, high, best[s])
                where[s] = np.where(more, top + at, where[s])

        held, at = np.zeros((0, DIM), np.float32), 0
        for own in blocks:
            if len(held) and len(own) >= reach:
                take(np.concatenate([held, own[:reach]]), len(held), at)
                at += len(held)
                held = own
            else:
                held = np.concatenate([held, own]) if len(held) else own
        if len(held):  # the last words are followed by zeros
            take(np.concatenate([held, np.zeros((reach, DIM), np.float32)]), len(held), at)
        return best, where

    def logit(self, blocks: Iterable[np.ndarray]) -> float:
        return float(self.peaks(blocks)[0] @ self.out + self.base)

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05, seed: int = 9, drop: float = DROP) -> None:
        """Adagrad; the gradient reaches only the words under each filter's maximum."""
        rng = np.random.default_rng(seed)
        weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
        dense = [*self.filters, self.bias, self.out]
        sums = [np.full_like(p, 0.1) for p in dense]
        table_sum, base_sum = np.full(1 << BITS, 0.1, np.float32), 0.1
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for s in range(0, len(order), BATCH):
                grads = [np.zeros_like(p) for p in dense]
                touched: list[np.ndarray] = []
                pulls: list[np.ndarray] = []
                g_base = 0.0
                ids = order[s : s + BATCH]
                for i in ids:
                    rows = texts[i][rng.random(len(texts[i])) >= drop]
                    x = self.embed(rows)
                    best, where = self.peaks([x])
                    p = 1 / (1 + np.exp(-np.clip(best @ self.out + self.base, -30, 30)))
                    g = float((p - labels[i]) * weight[i]) / len(ids)
                    g_base += g
                    grads[-1] += g * best
                    down = g * self.out * (where >= 0)
                    grads[-2] += down
                    if not len(rows):
                        continue
                    for k, f in enumerate(self.filters):
                        own = slice(k * FILTERS, (k + 1) * FILTERS)
                        at = np.maximum(where[own], 0)[:, None] + np.arange(len(f))
                        part = down[own, None] * (at < len(rows))  # filter, place
                        at = np.minimum(at, len(rows) - 1)
                        grads[k] += (part[..., None] * x[at]).transpose(1, 2, 0)
                        pull = part[..., None] * f.transpose(2, 0, 1)
                        touched.append(rows[at].ravel())
                        pulls.append(np.repeat(pull.reshape(-1, DIM), len(PARTS), axis=0))
                for p, g, a in zip(dense, grads, sums):
                    g += 1e-5 * p
                    a += g * g
                    p -= rate * g / np.sqrt(a)
                base_sum += g_base**2
                self.base -= np.float32(rate * g_base / np.sqrt(base_sum))
                if touched:
                    at, back = np.unique(np.concatenate(touched), return_inverse=True)
                    g = np.zeros((len(at), DIM), np.float32)
                    np.add.at(g, back, np.concatenate(pulls))
                    table_sum[at] += (g * g).sum(1)
                    self.table[at] -= 4 * rate * g / np.sqrt(table_sum[at])[:, None]


def _cut(hist: list[tuple[int, int, int, float, float]]) -> float:
    """The middle of the threshold range with the best F1, from (bin, label, rows, least, largest score); 0.5 if a class has no row."""
    bins = sorted({h[0] for h in hist})
    at = {x: k for k, x in enumerate(bins)}
    rows, low, high = np.zeros((2, len(bins)), np.int64), np.full(len(bins), np.inf), np.zeros(len(bins))
    for x, y, n, least, largest in hist:
        k = at[x]
        rows[y, k] += n
        low[k], high[k] = min(low[k], least), max(high[k], largest)
    if not rows.sum(1).all():
        return 0.5
    caught = np.cumsum(rows[1, ::-1])[::-1]
    f1 = 2 * caught / (np.cumsum(rows.sum(0)[::-1])[::-1] + rows[1].sum())
    k = int(f1.argmax())
    return float(np.clip(((high[k - 1] if k else 0.0) + low[k]) / 2, 0.05, 0.95))


def _calibrated(net: Network, docs: DataFrame, known: DataFrame, sampled: list[int]) -> dict[str | None, float]:
    """Thresholds of the languages, and of all rows (None), from every row of docs (doc_id, lang, text) that known (doc_id, y) labels.

    The rows are scored where they lie and joined by their scores, so that no text moves.

    Rows that the network was fitted on count only where the others hold fewer
    than POSITIVES positive ones; a language with fewer in all has no threshold of its own.
    """
    spark = docs.sparkSession
    scored, name = score(docs, Model(net, {}), keep_text=False)
    seen = F.broadcast(spark.createDataFrame([(d,) for d in set(sampled)], "doc_id long")).withColumn("s", F.lit(True))
    marked = scored.join(known, "doc_id").join(seen, "doc_id", "left").withColumn("seen", F.coalesce("s", F.lit(False)))
    place = F.least(F.floor(F.col(name) * BINS), F.lit(BINS - 1)).cast("int").alias("bin")
    figures = F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")
    hist = stored(marked.groupBy("lang", "seen", "y", place).agg(F.count("*").alias("rows"), F.min(name).alias("low"), F.max(name).alias("high")))
    large = hist.where("y = 1").groupBy("lang").agg(F.sum("rows").alias("n")).where(F.col("n") >= POSITIVES).select("lang")
    parts: dict[str | None, list] = {None: []}
    every = hist.groupBy("seen", "y", "bin").agg(*figures).withColumn("lang", F.lit(None).cast("string"))
    own = hist.join(F.broadcast(large), "lang", "left_semi")
    for r in every.unionByName(own).toLocalIterator():  # BINS rows at most for each language, label and side
        parts.setdefault(r["lang"], []).append((r["seen"], (r["bin"], r["y"], r["rows"], r["low"], r["high"])))
    out = {}
    for lang, both in parts.items():
        fresh_rows = [h for seen_, h in both if not seen_]
        enough = sum(h[2] for h in fresh_rows if h[1]) >= POSITIVES and not all(h[1] for h in fresh_rows)
        out[lang] = _cut(fresh_rows if enough else [h for _, h in both])
    return out


class Scorer:
    """Scores texts, remembering the embeddings of the words met so far, CACHE bytes of them at most and a block's."""

    def __init__(self, net: Network):
        self.net = net
        self._afresh()

    def _afresh(self) -> None:
        self.words, self.known, self.held = Words(), np.zeros((1 << 14, DIM), np.float32), 0

    def embedded(self, piece: bytes) -> np.ndarray:
        if self.held > CACHE:
            self._afresh()
        numbers, new = self.words.numbers(piece), self.words.parts
        if new:
            have = len(self.words)
            start = have - len(new)
            while have > len(self.known):
                self.known = np.concatenate([self.known, np.zeros_like(self.known)])
            self.known[start:have] = self.net.embed(np.array(new, np.int64))
            self.held += self.words.bytes + len(new) * (2 * OBJECT + 4 * DIM)
            self.words.clear_parts()
        return self.known[numbers]

    def logit(self, text: bytes) -> float:
        return self.net.logit(map(self.embedded, pieces(text, BLOCK)))


class Model:
    """A fitted network, compact enough to travel with the tasks, and the languages' thresholds."""

    def __init__(self, net: Network | None, cuts: dict[str, float]):
        self.net, self.cuts = net, cuts

    def scorer(self) -> Callable[[list[bytes]], np.ndarray]:
        if self.net is None:
            return lambda texts: np.zeros(len(texts))
        own = Scorer(self.net)

        def scores(texts: list[bytes]) -> np.ndarray:
            z = np.array([own.logit(t) for t in texts], np.float64)
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return scores


def _drawn(ids: DataFrame, rows: int, size: int) -> dict[int, int]:
    """Of ids (doc_id, y, bytes), those of the sample with their labels: by hash, as long as their bytes fit, both classes if there are both.

    The driver sees rows * 1.2 ids at most. A text of more than a twentieth of the bytes is never in.
    """
    ids = ids.where(F.col("bytes") <= size // 20).withColumn("place", F.xxhash64("doc_id"))
    first = lambda df, n: df.orderBy("place", "doc_id").limit(n)
    few = max(1, rows // 10)
    out, held = {}, 0
    for part, budget in ((first(ids.where("y = 1"), few), size // 10), (first(ids.where("y = 0"), few), size // 5), (first(ids, rows), size)):
        for r in part.toLocalIterator():
            if r["doc_id"] not in out and len(out) < rows and held + r["bytes"] <= budget:
                out[r["doc_id"]] = r["y"]
                held += r["bytes"]
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES, text: str = "text") -> Model:
    """Fit on labelled rows of docs (doc_id, text, lang if there): rows of them, of size bytes in all, at most, drawn by hash."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    known = labels.where(f"{label} in (0, 1)").groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    own = docs.select(F.col("doc_id").cast("long"), lang.alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The ids are drawn first, so that no more than the sample's texts move.
    sized = own.groupBy("doc_id").agg(F.max(F.octet_length("text")).cast("long").alias("bytes")).join(known, "doc_id")
    drawn = _drawn(stored(sized), rows, size)
    if not any(drawn.values()) or all(drawn.values()):
        return Model(None, {})
    chosen = F.broadcast(spark.createDataFrame(list(drawn.items()), "doc_id long, y int"))
    picked = own.join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def hashed(batches):
        for b in batches:
            lists = []
            for t in b.column(2).cast(pa.large_binary()).to_pylist():
                lexicon = Words()
                numbers = lexicon.numbers(t)
                lists.append(np.array(lexicon.parts, np.int32).reshape(-1, len(PARTS))[numbers])
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([x.tobytes() for x in lists], pa.binary())], names=["doc_id", "y", "parts"])

    got = [(np.frombuffer(r["parts"], np.int32).reshape(-1, len(PARTS)), r["y"], r["doc_id"]) for r in picked.mapInArrow(hashed, "doc_id long, y int, parts binary").orderBy("doc_id").toLocalIterator()]
    y = np.array([g[1] for g in got], np.float64)
    net = Network()
    net.fit([g[0] for g in got], y)
    return Model(net, _calibrated(net, own, known, [g[2] for g in got]))


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> tuple[DataFrame, str]:
    """Append the score (0 to 1); returns the rows and the column's name."""
    (name,) = fresh(docs, "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def start() -> Callable:
        scores = shared.value.scorer()
        return lambda texts: [pa.array(scores(texts), pa.float64())]

    return annotate(docs, start, [(name, T.DoubleType())], text, keep_text), name


def threshold(model: Model, lang: str | None = "lang"):
    """The calibrated threshold of a row's language; that of all rows if the language is unknown."""
    every = F.lit(model.cuts.get(None, 0.5))
    known = [(k, v) for k, v in model.cuts.items() if k is not None]
    if not known or lang is None:
        return every
    table = F.create_map(*(F.lit(x) for kv in known for x in kv))
    return F.coalesce(F.try_element_at(table, F.coalesce(F.col(lang), F.lit(""))), every)
