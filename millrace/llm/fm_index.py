"""Benchmark decontamination with an FM-index for each training shard.

A window is 13 consecutive words of a benchmark item (a shorter item is one
window). Each shard of training texts is mapped onto the words that occur in the
benchmark: a window can only lie inside a run of such words, so other words act
as separators and runs shorter than the shortest window are left out. A suffix
array of the runs gives the Burrows-Wheeler transform, a wavelet matrix its
ranks; all windows are searched backwards at once, occurrences are located from
sampled suffix positions, and overlapping ones are merged into removal spans.

Defined results: null and empty texts have no words, no hits and are not
contaminated; repeated rows get equal results; an item without words has no
window; extra columns pass through; an empty benchmark finds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_TABLE, annotate, fresh

WINDOW = 13
#: Words of a shard's runs at which its index is built and searched.
SHARD = 1_000_000
#: Every so manieth position of a shard is a sampled suffix position.
SAMPLE = 16
#: Bytes of benchmark text that one pass carries; a larger benchmark is taken in so many more passes.
BLOCK = 8_000_000


def words_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits (lower-cased) and non-ASCII characters."""
    return text.translate(WORD_TABLE).split()


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of a sequence whose zeros all differ from each other (the earlier, the smaller), by prefix doubling."""
    n = len(s)
    zeros = s == 0
    rank = np.where(zeros, np.cumsum(zeros) - 1, s.astype(np.int64) + int(zeros.sum()))
    step = 1
    while True:
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2 + n) + later
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if new.max() == n - 1 or step >= n:
            return order
        rank, step = new, step * 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector for each bit of a symbol."""

    def __init__(self, s: np.ndarray, symbols: int):
        self.levels = []
        for shift in range(max(1, int(symbols).bit_length()) - 1, -1, -1):
            bits = (s >> shift) & 1
            ones = np.concatenate([[0], np.cumsum(bits)]).astype(np.int32)
            zeros = len(s) - int(ones[-1])
            self.levels.append((shift, ones, zeros))
            s = np.concatenate([s[bits == 0], s[bits == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before position i, elementwise."""
        start = np.zeros(len(c), np.int64)
        for shift, ones, zeros in self.levels:
            bit = ((c >> shift) & 1).astype(bool)
            a, b = ones[start], ones[i]
            start, i = np.where(bit, zeros + a, start - a), np.where(bit, zeros + b, i - b)
        return i - start


class FMIndex:
    """Over symbols 1.. with separators 0; the last symbol must be a separator."""

    def __init__(self, s: np.ndarray, symbols: int):
        order = suffix_array(s)
        self.bwt = s[order - 1]
        self.ranks = WaveletMatrix(self.bwt, symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols + 1))])
        starts = np.concatenate([[True], s[:-1] == 0])
        kept = starts[order] | (order % SAMPLE == 0)
        self.sampled = kept
        self.before = np.cumsum(kept) - 1
        self.places = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long patterns, one a row: their ranges of suffixes."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), len(self.bwt), np.int64)
        live = np.arange(len(patterns))
        for c in patterns.T[::-1]:
            c = c[live].astype(np.int64)
            lo[live] = self.first[c] + self.ranks.rank(c, lo[live])
            hi[live] = self.first[c] + self.ranks.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a sampled one."""
        out, steps = np.empty(len(rows), np.int64), 0
        live, rows = np.arange(len(rows)), rows.copy()
        while len(live):
            done = self.sampled[rows]
            out[live[done]] = self.places[self.before[rows[done]]] + steps
            live, rows = live[~done], rows[~done]
            c = self.bwt[rows].astype(np.int64)
            rows = self.first[c] + self.ranks.rank(c, rows)
            steps += 1
        return out


class Phrases:
    """The windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.word: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[int]] = {}
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        for item, text in items:
            ids = [self.word.setdefault(w, len(self.word) + 1) for w in words_of(text.encode())]
            for k in range(max(1, len(ids) - window + 1)) if ids else ():
                windows.setdefault(tuple(ids[k : k + window]), set()).add(number[item])
        by_length: dict[int, list] = {}
        for w, own in windows.items():
            by_length.setdefault(len(w), []).append((w, own))
        self.groups = []
        for length, group in sorted(by_length.items()):
            flat = [x for _, own in group for x in sorted(own)]
            sizes = np.array([len(own) for _, own in group])
            self.groups.append((length, np.array([w for w, _ in group], np.int64), np.array(flat), sizes, np.cumsum(sizes) - sizes))
        self.shortest = min(by_length, default=window)

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: its number of words, merged spans of hit words (end exclusive), items that occur."""
        out: list = [None] * len(texts)
        runs: list = []
        held, first = 0, 0
        for k, text in enumerate(texts):
            words = words_of(text)
            out[k] = (len(words), [], [])
            ids = np.fromiter(map(self.word.get, words, (0 for _ in words)), np.int32, len(words))
            known = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]])))
            for s, e in zip(known[::2].tolist(), known[1::2].tolist()):
                if e - s >= self.shortest:
                    runs.append((k, s, ids[s:e]))
                    held += e - s + 1
            if held >= SHARD:
                self._index(runs, out)
                runs, held = [], 0
        if runs:
            self._index(runs, out)
        return out

    def _index(self, runs: list, out: list) -> None:
        sep = np.zeros(1, np.int32)
        s = np.concatenate([x for _, _, ids in runs for x in (ids, sep)])
        sizes = np.array([len(ids) + 1 for _, _, ids in runs])
        start = np.cumsum(sizes) - sizes
        doc = np.repeat(np.array([k for k, _, _ in runs]), sizes)
        word = np.arange(len(s)) - np.repeat(start, sizes) + np.repeat(np.array([w for _, w, _ in runs]), sizes)
        index = FMIndex(s, len(self.word))
        cover = np.zeros(len(s) + 1, np.int64)
        pairs = []
        for length, patterns, flat, n_items, offset in self.groups:
            lo, hi = index.search(patterns)
            found = np.flatnonzero(lo < hi)
            if not len(found):
                continue
            many = (hi - lo)[found]
            which = np.repeat(found, many)
            rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[found], many)
            at = index.locate(rows)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            seen = np.unique(doc[at] * len(n_items) + which)  # once for each document and window
            d, w = seen // len(n_items), seen % len(n_items)
            each = n_items[w]
            of = flat[np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(offset[w], each)]
            pairs.append(np.unique(np.repeat(d, each) * len(self.items) + of))
        if not pairs:
            return
        for x in np.unique(np.concatenate(pairs)).tolist():
            out[x // len(self.items)][2].append(self.items[x % len(self.items)])
        hit = np.cumsum(cover[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):  # a separator is never hit, so a span stays in its run
            out[doc[a]][1].append((int(word[a]), int(word[a]) + b - a))


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK, text: str = "text", keep_text: bool = True
) -> tuple[DataFrame, dict[str, str]]:
    """Append n_words, spans (of hit words, merged) and items (ids as sorted strings).

    Returns the rows and the names that the three columns got. The benchmark
    travels with the tasks in blocks of bounded size, one pass over the batches a block.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block))
    own = [fresh(docs, "n_words", "spans", "items")]
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        rows = [tuple(r) for r in part.toLocalIterator()]
        names = fresh(docs, "n_words", "spans", "items") if k == 0 else fresh(docs, *own[-1])
        docs = annotate(docs, _work(rows, window), list(zip(names, (T.LongType(), SPANS, T.ArrayType(T.StringType())))), text, keep_text or k < blocks - 1)
        own.append(names)
    names = dict(zip(("n_words", "spans", "items"), own[-1]))
    if blocks > 1:
        docs = _merged(docs, own[1:])
    return docs, names


def _work(rows: list[tuple[str, str]], window: int) -> Callable:
    def start():
        phrases = Phrases(rows, window)

        def work(texts: list[bytes]) -> list[pa.Array]:
            found = phrases.scan(texts)
            return [
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([[{"start": s, "end": e} for s, e in _union(spans)] for _, spans, _ in found], _SPANS),
                pa.array([sorted(items) for _, _, items in found], pa.list_(pa.string())),
            ]

        return work

    return start


def _merged(docs: DataFrame, passes: list[list[str]]) -> DataFrame:
    """Merge the spans and items of several blocks into the columns of the last."""
    n, spans, items = passes[-1]
    every = F.array_sort(F.concat(*(F.col(p[1]) for p in passes)))

    def add(acc, x):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), grown).otherwise(F.concat(acc, F.array(x)))

    empty = F.lit(None).cast(SPANS)
    union = F.aggregate(every, F.coalesce(empty, F.array().cast(SPANS)), add)
    docs = docs.withColumns({spans: union, items: F.array_sort(F.array_distinct(F.concat(*(F.col(p[2]) for p in passes))))})
    return docs.drop(*(c for p in passes[:-1] for c in p))


def hits(spans: str):
    """How many words the merged spans cover."""
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def contaminated(n_words: str, spans: str):
    return (hits(spans) > 0) & (20 * hits(spans) >= F.col(n_words))
