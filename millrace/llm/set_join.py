"""Near copies by the Jaccard similarity of word shingles, found without loss.

Fingerprints come first: those that the vantage-point trees of simhash link, at its
bits, are candidates, and the exact check below keeps the similar ones. Most similar
pairs lie beyond those bits, so a join completes the links.

Shingles have one order: those that a sample finds in many documents come last,
the others go by hash. Two sets with a similarity of 0.8 share a shingle among
the first fifth of each, whatever the order, so only those are joined on. Rows
that share one and that the trees have not connected are linked to the row with the smallest key; then every two
of them that are not yet connected are compared. Sizes and parity sketches (whose
differing bits are no more than the differing shingles; a larger set has a wider
one) rule pairs out, never in: what is left is compared shingle by shingle. So the components are those of all
pairs of 0.8 or more, while rows grow with the shared shingles and not with their square.

Defined results: words are parted at white space and A-Z lower-cased; a text of
fewer words than a shingle is one shingle; texts without words are copies of each
other; a null id gets no component of its own (the smallest id of the others);
repeated rows share a component; a very long text is taken whole; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, bounded, stored, texts_of
from .simhash import components, fingerprint, links

#: Words of a shingle.
WORDS = 5
#: Documents whose shingles are counted for the order, about; the order decides on the cost only, not on the result.
SAMPLE = 20_000
#: Shingles that the order puts last, and the documents of the sample that such a one lies in at least.
COMMON, OFTEN = 200_000, 3
#: Bits of a sketch, and of the wide one that a set of more members has besides, at most.
BITS, WIDEST = 1_024, 1 << 16


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    w = text.lower().split()
    if len(w) < words:
        w, words = [b" ".join(w)] if w else [], 1
    h = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(w[k:] for k in range(words))))
    return np.unique(np.fromiter((h(g, 42) for g in grams), np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def sketch(hashes: np.ndarray, bits: int = BITS) -> bytes:
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide(hashes: np.ndarray) -> bytes:
    """A sketch of about as many bits as members, for sets that would fill the narrow one; empty for others."""
    return sketch(hashes, min(WIDEST, 1 << (len(hashes) - 1).bit_length())) if len(hashes) > BITS else b""


def folded(bits: bytes, size: int) -> bytes:
    """The sketch of size bytes of the same set."""
    while len(bits) > size:
        x = np.frombuffer(bits, np.uint8)
        bits = (x[: len(x) // 2] ^ x[len(x) // 2 :]).tobytes()
    return bits


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles in the order: of n, n - ceil(0.8 n) + 1. common is sorted, rank its places."""
    n = len(hashes)
    wanted = n + 1 + (-4 * n // 5) if n else 0
    if not len(common):
        return hashes[:wanted]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    last = common[at] == hashes
    light = hashes[~last]
    if len(light) >= wanted:
        return light[:wanted]
    return np.concatenate([light, hashes[last][np.argsort(rank[at[last]])]])[:wanted]


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents of a sample hold, and their places from rare to frequent."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * share) + 1).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in texts_of(b, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t).view(np.int64))], names=["h"])

    counts = drawn.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= OFTEN)
    got = np.array([r["h"] for r in counts.orderBy(F.desc("count"), "h").limit(COMMON).toLocalIterator()], np.int64).view(np.uint64)
    by = np.argsort(got)
    return got[by], (len(got) - by).astype(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, tag (of the text), key (of the set), n, sketches, the prefix and the fingerprint of each document."""
    order = docs.sparkSession.sparkContext.broadcast(_common(docs))  # no more than COMMON entries

    def start():
        def work(texts: list[bytes]) -> list[pa.Array]:
            sets = [shingles(t) for t in texts]
            keys = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets), np.uint64, len(sets))
            return [
                pa.array(keys.view(np.int64)),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([sketch(s) for s in sets], pa.binary()),
                pa.array([wide(s) for s in sets], pa.binary()),
                pa.array([prefix(s, *order.value).view(np.int64) for s in sets], pa.list_(pa.int64())),
                pa.array(np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)),
            ]

        return work

    fields = [("key", T.LongType()), ("n", T.IntegerType()), ("sketch", T.BinaryType()), ("wide", T.BinaryType()), ("prefix", T.ArrayType(T.LongType())), ("fp", T.LongType())]
    return annotate(docs.withColumn("tag", F.xxhash64("text")), start, fields, keep_text=False)


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _far(x: np.ndarray, y: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether sketches differ in more bits than sets with total members may differ in members (a ninth)."""
    return 9 * np.bitwise_count(x ^ y).sum(1, dtype=np.int64) > total


def _apart(x: list[bytes], y: list[bytes], total: np.ndarray) -> np.ndarray:
    """_far of sketches of any sizes."""
    out = np.zeros(len(x), bool)
    size = np.fromiter((min(len(a), len(b)) for a, b in zip(x, y)), np.int64, len(x))
    for s in np.unique(size).tolist():
        at = np.flatnonzero(size == s)
        a, b = (np.frombuffer(b"".join(folded(v[i], s) for i in at), np.uint64).reshape(len(at), -1) for v in (x, y))
        out[at] = _far(a, b, total[at])
    return out


def _verified(edges: DataFrame, info: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of edges (a, b), distinct keys, whose sets are similar."""
    # Sizes first, which are short and rule most pairs out; only the others meet sketches.
    size = lambda c: info.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"))
    widest = F.when(F.octet_length("wide") > 0, F.col("wide")).otherwise(F.col("sketch"))
    bits = lambda c: info.select(F.col("key").alias(c), widest.alias(f"s{c}"))
    sized = edges.join(size("a"), "a").join(size("b"), "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)")
    sized = sized.join(bits("b"), "b").join(bits("a"), "a").select("a", "b", "na", "nb", "sa", "sb")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                total = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
                keep = pa.array(~_apart(b.column(4).to_pylist(), b.column(5).to_pylist(), total))
                yield pa.RecordBatch.from_arrays([b.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    left = stored(sized.mapInArrow(close, "a long, b long"))
    need = left.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(info.select("key", "tag"), "key")
    # Only the texts of candidates move.
    texts = docs.withColumn("tag", F.xxhash64("text")).join(need.select("tag").distinct(), "tag", "left_semi").dropDuplicates(["tag"])

    def start():
        return lambda ts: [pa.array([shingles(t).tobytes() for t in ts], pa.binary())]

    sets = annotate(texts.select("tag", "text"), start, [("grams", T.BinaryType())], keep_text=False)
    sets = stored(need.join(sets, "tag").select("key", "grams"))
    met = left.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("key").alias("b"), F.col("grams").alias("gb")), "b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column(2), b.column(3))
            keep = pa.array([similar(*(np.frombuffer(x.as_py(), np.uint64) for x in p)) for p in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    return stored(met.select("a", "b", "ga", "gb").mapInArrow(exact, "a long, b long"))


def _treed(info: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between keys whose fingerprints the vantage-point trees link and whose sets are similar."""
    lead = stored(info.groupBy("fp").agg(F.min("key").alias("lead")))
    same = info.join(lead, "fp").where("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    of = lambda c: lead.select(F.col("fp").alias(c), F.col("lead").alias(f"k{c}"))
    near = links(lead.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    return _verified(stored(same.union(near).distinct()), info, docs)


def _compared(token: np.ndarray, key: np.ndarray, root: np.ndarray, n: np.ndarray, left: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the pairs of one token and of two roots that size, place and sketch let pass; rows come by token and n.

    left counts a set's members from the token on, in the order of all. At the first that two sets share they have no more in common
    than the lesser of these, so a similar pair passes there, and one that meets too late for a similarity of 0.8 need not pass.
    """
    at, k = np.arange(len(token)), 0
    while len(at):
        k += 1
        at = at[at + k < len(token)]
        at = at[(token[at] == token[at + k]) & (5 * n[at] >= 4 * n[at + k])]
        one = at[(root[at] != root[at + k]) & (9 * np.minimum(left[at], left[at + k]) >= 4 * (n[at] + n[at + k]))]
        one = one[~_far(bits[one], bits[one + k], n[one] + n[one + k])]
        if len(one):
            yield np.minimum(key[one], key[one + k]), np.maximum(key[one], key[one + k])


def _across(posts: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (token, key, root, n, at, sketch) that share a token (at place at in the order), not a root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            cols = [t.column(k).to_numpy() for k in range(5)]
            n = cols[3].astype(np.int64)
            for a, b in _compared(*cols[:3], n, n - cols[4], _bits(t.column(5))):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            token = b.column(0).to_numpy()
            cut = int(np.searchsorted(token, token[-1]))  # its last token may go on in the next batch
            if held and (cut or held[-1].column(0)[-1].as_py() != token[0]):
                held.append(b.slice(0, cut))
                yield from pairs()
                held = []
            elif cut:
                held = [b.slice(0, cut)]
                yield from pairs()
                held = []
            held.append(b.slice(cut))
        if held:
            yield from pairs()

    bounded(posts.sparkSession)
    rows = posts.select("token", "key", "root", "n", "at", "sketch").repartition("token").sortWithinPartitions("token", "n")
    return rows.mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, tag (xxhash64 of the text), component_id (the smallest id reachable over pairs of a similarity of 0.8 or more), stays.

    stays is true for one (doc_id, tag) of a component: the smallest id, null last, and of equal ids the smallest tag.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = stored(_rows(docs))
    lead = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("tag").alias("tag"))
    info = stored(rows.groupBy("key").agg(F.min(lead).alias("least"), F.min("tag").alias("tag"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"), F.min("fp").alias("fp")))
    postings = rows.select("key", F.posexplode("prefix").alias("at", "token"))
    shared = postings.groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("token", "lo")
    posts = stored(postings.join(shared, "token").select("token", "key", "lo", "at"))
    treed = _treed(info, docs)
    roots = stored(components(treed))
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    stars = posts.where("key <> lo").select(F.col("lo").alias("a"), F.col("key").alias("b")).distinct()
    stars = stars.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    stars = treed.union(_verified(stars, info, docs))
    found = stored(components(stars))
    placed = posts.join(found, posts.key == found.node, "left").select("token", "key", "at", F.coalesce("root", "key").alias("root"))
    parted = placed.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
    rest = placed.join(parted, "token", "left_semi").join(info.select("key", "n", "sketch"), "key")
    found = components(stars.union(_verified(_across(rest), info, docs)))
    rooted = stored(info.join(found, info.key == found.node, "left").select("key", "least", F.coalesce("root", "key").alias("root")))
    best = rooted.groupBy("root").agg(F.min("least").alias("best"))
    of = rooted.join(best, "root").select("key", "best")
    return rows.select("doc_id", "tag", "key").join(of, "key").select(
        "doc_id", "tag", F.col("best.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("tag") == F.col("best.tag"))).alias("stays")
    )
