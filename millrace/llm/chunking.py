"""Substring deduplication by content-defined chunking with a gear rolling hash.

A text's bytes are cut where a gear hash of the bytes before meets a condition;
cuts depend on a few neighbouring bytes only, so an insertion moves no cut
farther away. Chunks are compared by digest, two neighbours at a time: a pair whose digests occur one after the other
in several documents is repeated, and repeated pairs that overlap make a passage.
So chunks from unrelated places don't add up to one. A passage counts from
MIN_CHARS characters. A digest with a large share of all rows is sent to the rows
instead of joined by shuffle.

Defined results: null and empty texts have no chunks; rows that share an id count
as one document, so repeated rows repeat nothing; a row without an id is a
document of its own, known by its text, and comes after all that have one; the
smallest document keeps a chunk, all others lose it; a very long text is chunked
whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, stored, texts_of

#: A cut falls after one byte in so many (a power of two) on average.
AVERAGE = 32
#: Candidates closer than this to the one before are no cuts (a run of equal bytes would else be cut everywhere).
LEAST = 4
MIN_CHARS = 100
#: The lowest bit of the hash that is looked at; with those above it takes in 16 bytes.
SHIFT = 11
#: Digests of two neighbours are mixed with this odd number.
PAIR = np.uint64(0x9E3779B97F4A7C15)
HEAVY = 1_000
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 77) for b in range(256)], np.uint32)


def cuts(text: bytes) -> np.ndarray:
    """Ends of the chunks of a text (the last is its length)."""
    if not text:
        return np.zeros(0, np.int64)
    h = GEAR[np.frombuffer(text, np.uint8)]
    for step in (1, 2, 4, 8):  # after the steps, the hash of the last 16 bytes at each place
        h[step:] += h[:-step] << np.uint32(step)
    at = np.flatnonzero((h >> np.uint32(SHIFT)) & np.uint32(AVERAGE - 1) == 0) + 1
    at = at[np.diff(at, prepend=-LEAST) >= LEAST]
    return at if len(at) and at[-1] == len(text) else np.append(at, len(text))


def chunks(docs: DataFrame, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each two neighbouring chunks, and for a chunk of min_chars or more alone: digest, none, doc_id, tag, start, end (in code points).

    doc_id and none (true without an id) name the document; one without an id goes by tag, a hash of its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc, tag, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch, "text")):
                ends = cuts(t)
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                made = np.fromiter((digest(t[s:e]) for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, len(ends))
                chars = np.concatenate([[0], np.cumsum(np.frombuffer(t, np.uint8) & 0xC0 != 0x80)]).astype(np.int32)
                long = chars[ends] - chars[starts] >= min_chars
                pairs = (made[:-1] * PAIR ^ made[1:]) * PAIR
                d = np.concatenate([pairs, made[long]]).view(np.int64)
                key = tag if doc is None else doc
                out.append((d, np.full(len(d), doc is None), np.full(len(d), key), np.full(len(d), tag), chars[np.concatenate([starts[:-1], starts[long]])], chars[np.concatenate([ends[1:], ends[long]])]))
                held += len(d)
                if held > 100_000:
                    yield pack(out)
                    out, held = [], 0
            if held:
                yield pack(out)

    names = ["digest", "none", "doc_id", "tag", "start", "end"]
    pack = lambda out: pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=names)
    bounded(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tag"), F.col(text).alias("text"))
    return own.mapInArrow(run, "digest long, none boolean, doc_id long, tag long, start int, end int")


def passages(docs: DataFrame, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Repeated passages: doc_id, tag, start, end, n_chunks, first_doc_id and removed_chars (of what a smaller document keeps)."""
    every = stored(chunks(docs, min_chars, doc_id, text))
    # Partial sums meet a frequent pair once a task.
    owner = F.struct("none", "doc_id")
    seen = stored(every.groupBy("digest").agg(F.min(owner).alias("first"), F.max(owner).alias("last"), F.count("*").alias("n")).where("first < last").select("digest", "first", "n"))
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # No more than HEAVY digests can hold a share of 1 / HEAVY each: these are sent to the rows, and the others join by shuffle.
    heavy = F.broadcast(seen.where(F.col("n") * HEAVY >= total).select("digest", "first"))
    light = seen.where(F.col("n") * HEAVY < total).select("digest", "first")
    rest = every.join(heavy.select("digest"), "digest", "left_anti")
    repeated = rest.join(light, "digest").unionByName(every.join(heavy, "digest"))
    return _runs(repeated, min_chars)


def _runs(repeated: DataFrame, min_chars: int) -> DataFrame:
    """Pairs that overlap in a document become one passage."""
    key = ["none", "doc_id", "tag"]
    order = Window.partitionBy(*key).orderBy("start", "end")
    before = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(before), F.lit(-1))
    placed = repeated.withColumn("reach", reach).withColumn("run", F.sum((F.col("start") >= F.col("reach")).cast("int")).over(order))
    kept = (F.col("first.none") == F.col("none")) & (F.col("first.doc_id") == F.col("doc_id"))
    # What a pair adds to its run, so that no character counts twice.
    adds = F.col("end") - F.greatest("start", "reach")
    runs = placed.groupBy(*key, "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_chunks"),
        F.min("first").alias("first"), F.sum(F.when(kept, 0).otherwise(F.greatest(adds, F.lit(0)))).cast("long").alias("removed_chars"),
    )
    named = lambda none, x: F.when(~none, x)
    return runs.where(F.col("end") - F.col("start") >= min_chars).select(
        named(F.col("none"), F.col("doc_id")).alias("doc_id"), "tag", "start", "end", "n_chunks",
        named(F.col("first.none"), F.col("first.doc_id")).alias("first_doc_id"), "removed_chars",
    )


def without(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the passages that smaller documents keep (passages that lose all their chunks)."""
    gone = spans.where("removed_chars >= end - start").groupBy(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("gone"))
    t = F.coalesce(F.col(f"__row.{text}"), F.lit(""))
    own = docs.select(F.struct(*docs.columns).alias("__row")).withColumns({"__own": F.col(f"__row.{doc_id}").cast("long"), "__sum": F.xxhash64(t)})
    joined = own.join(gone, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__sum") == F.col("__tag")), "left")
    pieces = F.transform("gone", lambda g, i: F.substring(t, F.when(i == 0, 0).otherwise(F.get(F.col("gone"), i - 1)["end"]) + 1, g["start"] - F.when(i == 0, 0).otherwise(F.get(F.col("gone"), i - 1)["end"])))
    tail = F.substring(t, F.element_at("gone", -1)["end"] + 1, F.length(t))
    rest = F.when(F.col("gone").isNull(), F.col(f"__row.{text}")).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return joined.select(*(rest.alias(c) if c == text else F.col(f"__row.{c}").alias(c) for c in docs.columns))
