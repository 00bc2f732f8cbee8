"""SimHash near-deduplication with vantage-point trees.

Fingerprints of word shingles are grouped by value. A vantage-point tree, grown
on a bounded sample, deals them out into shards: a node sends those within its
radius to one side and the rest to the other, and by the triangle inequality
every link that crosses the border has its inner end within LINK of the radius,
so that ring goes to both sides. Each shard goes on in the same way and compares
the leaves in full, so all links are found. A shard hands on a spanning forest of
its links; components are joined by alternating star contraction.

Defined results: null and empty texts have fingerprint zero and are linked like
any other; a text of fewer words than a shingle is one shingle; a null id gets a
row, and its component is the smallest id of the others; repeated rows share a
component; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, partitions, stored

LINK = 3
WORDS = 3
#: Fingerprints that the upper part of the tree is grown on, taken by hash from all distinct ones.
SAMPLE = 20_000
#: Sampled fingerprints at which the upper part stops, as long as a shard is expected to hold more than SHARD.
SHARD = 40_000
#: A shard's leaves are compared in full.
LEAF = 2_048
#: Shingles hashed at a time.
BLOCK = 200_000


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) < words:
        w, words = [b" ".join(w)], 1
    h, total, ones = xxhash.xxh64_intdigest, len(w) - words + 1, np.zeros(64, np.int64)
    for at in range(0, total, BLOCK):
        part = w[at : min(at + BLOCK, total) + words - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(words))))
        hashes = np.fromiter((h(g, 42) for g in grams), np.uint64, min(BLOCK, total - at))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long)."""

    def start():
        def work(texts: list[bytes]) -> list[pa.Array]:
            made = np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts))
            return [pa.array(made.view(np.int64))]

        return work

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return annotate(rows, start, [("fp", T.LongType())], keep_text=False)


def _split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and a radius with the least overlap among some candidates; None if no split parts the points."""
    best = None
    sample = points if len(points) <= 2000 else points[rng.integers(0, len(points), 2000)]
    for v in points[rng.integers(0, len(points), 6)]:
        count = np.bincount(np.bitwise_count(sample ^ v), minlength=65)
        inside = np.cumsum(count)
        for r in range(65):
            low = inside[r - LINK] if r >= LINK else 0
            larger = max(inside[r], len(sample) - low)  # the sides with the ring in both
            cost = larger + 0.5 * (inside[r] - low)
            if larger < 0.9 * len(sample) and (best is None or cost < best[0]):
                best = (cost, v, r)
    return None if best is None else (best[1], best[2])


def grow(points: np.ndarray, leaf: int, rng: np.random.Generator):
    """The upper tree: nested (vantage point, radius, inner, outer), leaves None."""
    cut = _split(points, rng) if len(points) > leaf else None
    if cut is None:
        return None
    d = np.bitwise_count(points ^ cut[0]).astype(int)
    return (*cut, grow(points[d <= cut[1]], leaf, rng), grow(points[d > cut[1] - LINK], leaf, rng))


def deal(points: np.ndarray, tree, at: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """Shard numbers and the points they get (a point of a ring to both sides)."""
    if tree is None:
        yield at, points
    elif len(points):
        d = np.bitwise_count(points ^ tree[0]).astype(int)
        yield from deal(points[d <= tree[1]], tree[2], 2 * at)
        yield from deal(points[d > tree[1] - LINK], tree[3], 2 * at + 1)


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(points: np.ndarray, seed: int = 7) -> list[tuple[int, int]]:
    """Positions of a spanning forest of the links among distinct points."""
    rng, parent, out = np.random.default_rng(seed), np.arange(len(points)), []

    def leaf(ids: np.ndarray) -> None:
        own = points[ids]
        for s in range(0, len(ids), 512):
            near = np.argwhere(np.bitwise_count(own[s : s + 512, None] ^ own[None, s:]) <= LINK)
            for i, j in near[near[:, 0] < near[:, 1]].tolist():
                a, b = int(ids[s + i]), int(ids[s + j])
                ra, rb = _root(parent, a), _root(parent, b)
                if ra != rb:
                    parent[ra] = rb
                    out.append((a, b))

    stack = [np.arange(len(points))]
    while stack:
        ids = stack.pop()
        cut = _split(points[ids], rng) if len(ids) > LEAF else None
        if cut is None:
            leaf(ids)
            continue
        d = np.bitwise_count(points[ids] ^ cut[0]).astype(int)
        stack += [ids[d <= cut[1]], ids[d > cut[1] - LINK]]
    return out


def links(values: DataFrame) -> DataFrame:
    """Spanning links (a, b) among distinct fingerprints (column fp), within LINK bits of each other."""
    spark = values.sparkSession
    total = values.count()
    share = min(1.0, SAMPLE / max(1, total))
    drawn = values.where(F.pmod(F.xxhash64("fp"), F.lit(1_000_003)) < int(1_000_003 * share) + 1).limit(2 * SAMPLE)
    sample = np.array([r[0] for r in drawn.toLocalIterator()], np.int64).view(np.uint64)
    # About a SHARD's worth of fingerprints each, but no fewer shards than keep all cores at work.
    leaf = max(50, int(len(sample) * min(SHARD / max(1, total), 1 / 12)))
    tree = grow(np.sort(sample), leaf, np.random.default_rng(11))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, points in deal(b.column(0).to_numpy().view(np.uint64), tree):
                if len(points):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(points), shard)), pa.array(points.view(np.int64))], names=["shard", "fp"])

    dealt = values.select("fp").mapInArrow(spread, "shard long, fp long")
    # A shard of many points that lie too close to be parted is compared block against block.
    sizes = dealt.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(4 * SHARD)).cast("int").alias("blocks"))
    wide = {r[0]: r[1] for r in sizes.where("blocks > 1").toLocalIterator()}  # no more rows than the tree has leaves
    if wide:
        blocks = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in wide.items() for x in kv)), F.col("shard")), F.lit(1))
        dealt = dealt.withColumns({"n": blocks}).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
        dealt = dealt.select("shard", "fp", "own", other).select("shard", "fp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    else:
        dealt = dealt.withColumns({"x": F.lit(0), "y": F.lit(0)})

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(pdf["fp"].to_numpy().view(np.uint64))
        pairs = np.array(forest(points), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": points[pairs[:, 0]].view(np.int64), "b": points[pairs[:, 1]].view(np.int64)})

    return dealt.groupBy("shard", "x", "y").applyInPandas(search, "a long, b long")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root (the smallest node reachable) for nodes with links, by large-star and small-star steps.

    A step only takes minima and joins on a node, so a node with many links is
    pre-aggregated and its join can be split; each round is written to the shared folder.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = stored(small.select("e.a", "e.b").where("a <> b").distinct())
        # Done when every node has one link, to a root that is the lower end of no link itself.
        many = after.groupBy("a").count().where("count > 1").limit(1).count()
        chained = after.join(after.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        edges = after
        if not many and not chained:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(docs: DataFrame, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, fp, component_id (the smallest id reachable over links)."""
    rows = stored(fingerprints(docs, words, doc_id, text))
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(classes.select("fp")))
    rooted = classes.join(found, classes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(best, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")
