"""Models, sharding, chunking and the pipeline: brute force where there is one, accuracy and edge rows otherwise."""

import collections
import math

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import chunking, compaction, context_mixing, fm_index, queries as Q, simhash

from . import brute, edge


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return edge.write(spark, tmp_path_factory.mktemp("models") / "in")


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return edge.write(spark, tmp_path_factory.mktemp("none") / "in", rows=[], bench=[], labels=[])


MODELS = [Q.op3_lm_score, Q.op5_toxicity, Q.op6_quality, Q.op7_sharding, Q.op9_substring_dedup, corpus_pipeline.run]


@pytest.mark.parametrize("query", MODELS)
def test_empty_tables(spark, none, query):
    assert query(spark, none).collect() == []


@pytest.mark.parametrize("query", MODELS[:4])
def test_one_row_a_document(spark, small, query):
    got = collections.Counter(r["doc_id"] for r in query(spark, small).collect())
    assert got == collections.Counter(d for d, _ in edge.texts())


@pytest.mark.parametrize("query,n,r", [(Q.op5_toxicity, 5, 0), (Q.op6_quality, 3, 1)])
def test_classifier_columns(spark, small, query, n, r):
    for x in query(spark, small).collect():
        assert x["held_out"] == (brute.bucket(x["doc_id"], n) == r)
        assert 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5)


def lm_base(docs):
    bags = [(d, brute.WS.findall(brute.low(t)) + [""]) for d, t in docs]
    count = collections.Counter(w for d, b in bags if brute.bucket(d, 7) != 2 for w in b)
    n, v = sum(count.values()), len(count)
    return [(d, brute.bucket(d, 7) == 2, len(b), sum(count[w] > 0 for w in b), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in b)) for d, b in bags]


@pytest.mark.parametrize("where", ["edge", "data"])
def test_lm_base(spark, small, sf_dir, where):
    path = small if where == "edge" else sf_dir
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = Q.op3_lm_score(spark, path).collect()
    have = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=repr)
    assert have == sorted(((*x[:5], round(x[5], 6)) for x in lm_base(docs)), key=repr)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_lm_bits_are_a_distribution():
    rng = np.random.default_rng(1)
    words = [b"", *{bytes(rng.integers(97, 101, rng.integers(1, 4)).astype(np.uint8)) for _ in range(60)}]
    n = rng.integers(1, 20, len(words))
    cls = np.zeros(len(words), np.int64)
    counts = [np.zeros(2 << t, np.float32) for t in context_mixing.TABLES]
    b = context_mixing.Bytes(words, cls)
    for live, slots, bit in b.steps():
        for c, s in zip(counts, slots):
            np.add.at(c, 2 * s + bit, n.astype(np.float32)[b.word[live]])
    model = context_mixing.Mixer(counts)
    model.learn(words, cls, n)
    model.settle()
    # After any beginning, the probabilities of all next bytes (or the end) add up to one.
    for begin in (b"", b"a", b"ab", b"zq"):
        symbols = [bytes([x]) for x in range(256) if x != 0x20]
        ends = model.log10([begin + x for x in symbols] + [begin], np.zeros(256, np.int64))
        deep = np.array([model.log10([begin + x + bytes([y]) for y in range(256) if y != 0x20] + [begin + x], np.zeros(256, np.int64)) for x in symbols[97:101]])
        assert (10.0**ends).sum() <= 1 + 1e-6
        assert deep.shape == (4, 256)


def test_lm_beats_base_on_held_out(spark):
    got = [r for r in Q.op3_lm_score(spark, "/root/testdata/sf0.1").collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


@pytest.mark.parametrize("query,label", [(Q.op5_toxicity, "toxic"), (Q.op6_quality, "quality")])
def test_held_out_accuracy(spark, query, label):
    path = "/root/testdata/sf0.1"
    y = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    got = [(r["score"], y[r["doc_id"]]) for r in query(spark, path).collect() if r["held_out"] and r["doc_id"] in y]
    yes, no = [s for s, t in got if t], [s for s, t in got if not t]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in yes for b in no])
    assert auc > 0.97


# chunking ------------------------------------------------------------------------------------------


def test_cuts_move_only_near_an_insertion():
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 123, 20_000).astype(np.uint8))
    changed = text[:7000] + b"inserted" + text[7000:]
    a, b = set(chunking.cuts(text).tolist()), set(chunking.cuts(changed).tolist())
    assert {x for x in a if x < 7000} == {x for x in b if x < 7000}
    assert {x + 8 for x in a if x > 7040} == {x for x in b if x > 7048}
    h = 0
    for k, byte in enumerate(text[:300]):  # the vectorised hash is the rolling one
        h = (h << 1) + int(chunking.GEAR[byte]) & 0xFFFF_FFFF
        assert (k + 1 in a) <= (h >> chunking.SHIFT & chunking.AVERAGE - 1 == 0)


def passage_docs():
    rng = np.random.default_rng(3)
    word = lambda: bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)).decode()
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(3)]
    docs = [(k, text(80) + " é " + shared[k % 3] + " " + text(90)) for k in range(30)]
    return docs + [(k, text(150)) for k in range(30, 60)], shared


def test_passages(spark):
    docs, shared = passage_docs()
    found = chunking.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == set(range(30))
    text = dict(docs)
    for r in found:
        passage = f" é {shared[r['doc_id'] % 3]} "
        assert text[r["doc_id"]][r["start"] : r["end"]] in passage
        assert r["first_doc_id"] == r["doc_id"] % 3 and (r["removed_chars"] == 0) == (r["doc_id"] < 3)


def test_without_passages(spark):
    docs, _ = passage_docs()
    frame = spark.createDataFrame([*docs, (None, None), (99, "")], "doc_id long, text string")
    spans = chunking.passages(frame)
    gone = collections.defaultdict(list)
    for r in spans.collect():
        if r["removed_chars"] >= r["end"] - r["start"]:
            gone[r["doc_id"]].append((r["start"], r["end"]))
    for r in chunking.without(frame, spans).collect():
        text = dict(docs).get(r["doc_id"], r["text"])
        for s, e in sorted(gone.get(r["doc_id"], []), reverse=True):
            text = text[:s] + text[e:]
        assert r["text"] == text


# sharding -------------------------------------------------------------------------------------------


def test_compaction_keeps_all_rows(spark, tmp_path):
    store = compaction.Store(spark, str(tmp_path / "store"), target=6_000, fanout=3)
    rows = []
    for k in range(7):
        own = [(k * 100 + i, f"text {k} {i} " * 5) for i in range(40)]
        rows += own
        assert store.append(spark.createDataFrame(own, "doc_id long, text string").coalesce(1)) == k + 1
    before = store.manifest()
    version = store.compact()
    after = store.manifest(version)
    assert version > 7 and len(after) < len(before)
    assert sorted(map(tuple, store.read().collect())) == sorted(rows)
    assert sum(s.rows for s in after) == len(rows) and not store.plan(after)
    with pytest.raises(RuntimeError):
        store.commit([], version - 1)


# similarity search and phrases ----------------------------------------------------------------------


def test_forest_finds_all_links():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    points = [*base]
    for p in rng.choice(base, 900):
        q = int(p)
        for bit in rng.choice(64, rng.integers(1, 6), replace=False):
            q ^= 1 << int(bit)
        points.append(np.uint64(q))
    points = np.unique(np.array(points, np.uint64))
    want = brute.components([(i, int(p)) for i, p in enumerate(points)])
    parent = list(range(len(points)))
    for a, b in simhash.forest(points):
        ra, rb = simhash._root(np.array(parent), a), simhash._root(np.array(parent), b)
        parent = [ra if x == rb else x for x in parent]
    groups = collections.defaultdict(list)
    for i, x in enumerate(parent):
        groups[x].append(i)
    have = [0] * len(points)
    for g in groups.values():
        for i in g:
            have[i] = min(g)
    assert have == want


def test_dealt_shards_share_every_link():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    points = np.unique(np.concatenate([base, near]))
    tree = simhash.grow(points[::5], 150, rng)
    assert tree is not None
    where = collections.defaultdict(set)
    for shard, own in simhash.deal(points, tree):
        for p in own.tolist():
            where[p].add(shard)
    assert all(where[int(a)] & where[int(b)] for a, b in zip(base, near))


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100 + k, 100) for k in range(1, 30)] + [(-5, 200), (200, -9)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {k: 0 for k in range(1, 41)} | {100 + k: 100 for k in range(1, 30)} | {-5: -9, 200: -9}
    assert got == want


def test_benchmark_in_blocks(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    whole, a = fm_index.decontaminate(docs, bench)
    parts, b = fm_index.decontaminate(docs, bench, block=30)
    take = lambda df, n: sorted(repr((r["doc_id"], r[n["n_words"]], r[n["spans"]], r[n["items"]])) for r in df.collect())
    assert take(whole, a) == take(parts, b)


# pipeline -------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    named = lambda df: sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=repr)
    rows = named(docs)
    assert corpus_pipeline.drop_toxic(spark, docs, small).columns == docs.columns
    best = {}
    for d, t in rows:
        best[brute.low(t)] = max(d or -1, best.get(brute.low(t), -1))
    exact = named(corpus_pipeline.drop_exact(spark, docs, small))
    assert len(exact) == len(best) and all((d or -1) == best[brute.low(t)] for d, t in exact)
    prints = [(d, brute.fingerprint(t)) for d, t in rows]
    near = named(corpus_pipeline.drop_near(spark, docs, small))
    assert near == sorted((r for r, c in zip(rows, brute.components(prints)) if r[0] == c), key=repr)
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = named(corpus_pipeline.drop_contaminated(spark, docs, small))
    assert clean == sorted((r for r, x in zip(rows, brute.contamination([t for _, t in rows], items)) if not x[4]), key=repr)


def test_pipeline_runs(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    got = out.select("doc_id", "n_tokens", "ids_sha256").collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert 0 < len(got) < len(text)
    for r, x in zip(got, brute.bpe([text[r["doc_id"]] for r in got], Q.tokenizer_path())):
        assert (r["n_tokens"], r["ids_sha256"]) == x[:2]


def test_lm_reads_along_the_text(spark):
    """The order of words counts: contexts cross the borders of tokens, and the score is the mixed bits' sum."""
    rng = np.random.default_rng(4)
    follow = rng.permutation(40)
    word = [f"w{k:02d}" for k in range(40)]

    def text(n):
        k, out = int(rng.integers(40)), []
        for _ in range(n):
            out.append(word[k])
            k = int(follow[k]) if rng.random() < 0.95 else int(rng.integers(40))
        return out

    docs = [(k, " ".join(text(60))) for k in range(300)]
    plain = text(60)
    shuffled = [plain[k] for k in rng.permutation(60)]
    held = [k for k in range(300, 400) if brute.bucket(k, 7) == 2][:2]
    docs += [(held[0], " ".join(plain)), (held[1], " ".join(shuffled))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in context_mixing.scored(frame, context_mixing.F.pmod(context_mixing.F.crc32(context_mixing.F.col("doc_id").cast("string")), context_mixing.F.lit(7)) == 2).collect()}
    one, two = (got[k] for k in held)
    assert one["base_score"] == pytest.approx(two["base_score"]) and one["held_out"] and two["held_out"]
    assert one["score"] > two["score"] + 20


def lm_of(texts):
    code = context_mixing.Code(texts)
    tables = context_mixing.sized(sum(map(len, texts)))
    model = context_mixing.Mixer(context_mixing.counted(iter(texts), tables, code), code=code)
    for b, _ in context_mixing.blocks(iter(texts), tables, code):
        model.step(b)
    return model.settle()


def test_lm_bits_of_grown_codes_are_a_distribution():
    """After text that crosses tokens, all next bytes share a probability of no more than one."""
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 102, rng.integers(1, 5)).astype(np.uint8)) for _ in range(30)]
    texts = [context_mixing.spelled([words[k] for k in rng.integers(0, 30, 50)]) for _ in range(60)]
    model = lm_of(texts)
    assert model.code.tree.max() > 0
    for begin in (b"", b"a", texts[0][:41], texts[1][:60] + b"zq"):
        less = model.texts([begin])[0] if begin else 0.0
        share = 10 ** (model.texts([begin + bytes([x]) for x in range(256)]) - less)
        assert 0.9 < share.sum() <= 1 + 1e-6


def test_lm_pieces_of_a_long_text():
    texts = [context_mixing.spelled([b"ab%d" % (k % 7) for k in range(9_000)]), context_mixing.spelled([b"x" * 70_000, b"y"])]
    for t in texts:
        got = list(context_mixing.pieces(t))
        assert len(got) > 1 and b"".join(p[lead:] for p, lead in got) == t
    model = lm_of(texts)
    assert np.isfinite(model.texts(texts)).all()
    assert model.texts(texts)[1] == model.texts(texts[1:])[0]


def test_lm_nodes_of_a_context_lie_together():
    """The bits after one context share a stretch of the table and never a slot, so a block's look-ups stay near each other."""
    rng = np.random.default_rng(6)
    texts = [context_mixing.spelled([bytes(rng.integers(97, 123, 4).astype(np.uint8)) for _ in range(400)]) for _ in range(20)]
    code = context_mixing.Code(texts)
    begin = texts[0][:31]
    b = context_mixing.Bytes([begin + bytes([x]) for x in range(256)], np.zeros(256), lead=np.full(256, 31), code=code)
    used = [{} for _ in context_mixing.TABLES]
    for live, slots, bit in b.steps():
        for own, s in zip(used, slots):
            for at, slot in zip(live.tolist(), s.tolist()):
                own.setdefault(int(b.flat[at]), set()).add(slot)
    for own in used:
        every = set().union(*own.values())
        assert len(own) == 256 and len({s >> 10 for s in every}) == 1
        assert len(every) == len(set().union(*({n for n in code.nodes[:, r]} for r in b.coded()[1])) - {0})


def test_lm_texts_are_spelled_alike():
    for t in (b"", b" \t ", b"A  b\r\nC\x0bd ", b"a\x1cb c", "É x".encode()):
        assert context_mixing.along(t) == context_mixing.spelled(context_mixing.tokens_of(t))


def test_lm_codes_see_three_bytes():
    """Where the third byte before decides on the next, a code of its own needs one bit for it."""
    rng = np.random.default_rng(7)
    words = [x + b"mm" + y * 3 for x, y in zip((b"a", b"b", b"c", b"d"), (b"w", b"x", b"y", b"z"))]
    texts = [context_mixing.spelled([words[k] for k in rng.integers(0, 4, 400)]) for _ in range(20)]
    code = context_mixing.Code(texts)
    b = context_mixing.Bytes(texts, np.zeros(len(texts)), lead=np.zeros(len(texts), np.int64), code=code)
    live, row, _, longer = b.coded()
    flat, size = b.flat[live], code.sizes[row]
    assert set(size[np.isin(flat, list(b"wxyz"))].tolist()) == {1}
    assert sum(longer) < 1.5 * len(b.live)


def test_lm_bits_to_predict(spark):
    """The work grows with the bits that are left to predict: on other texts than the sampled ones 2.9 a byte with codes of two bytes."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 1300").orderBy("doc_id").select("text").collect()
    texts = [context_mixing.along((r[0] or "").encode()) for r in rows]
    code = context_mixing.Code(texts[:900])
    bits = seen = 0
    for b, _ in context_mixing.blocks(iter(texts[900:]), context_mixing.TABLES, code):
        bits, seen = bits + sum(b.coded()[3]), seen + len(b.live)
    assert seen and bits < 2.8 * seen


def test_lm_slots_take_a_byte():
    """Counting, learning and scoring look at random slots: their tables are small, and small counts are kept exactly."""
    texts = [context_mixing.spelled([b"ab", b"ba", b"abc"] * 40)]
    code = context_mixing.Code(texts)
    model = context_mixing.Mixer(context_mixing.counted(iter(texts), (12,) * 4, code), code=code)
    assert all(x.dtype == np.uint8 for x in model.states)
    odds, _ = context_mixing._odds(0.3)
    for zero, one in ((0, 0), (3, 1), (0, 14), (9, 5)):
        state = context_mixing._STATES[zero | one << 8]
        assert odds[0, state] == pytest.approx(math.log((one + 0.3) / (zero + 0.3)))
        if one:
            assert odds[2, state] == pytest.approx(math.log((one - 0.7) / (zero + 0.3)))
    large = np.array([(z, o) for z in range(0, 256, 5) for o in range(0, 256, 5) if z + o > 14])
    got = odds[0, context_mixing._STATES[large[:, 0] | large[:, 1] << 8]]
    assert np.abs(1 / (1 + np.exp(-got)) - (large[:, 1] + 0.3) / (large.sum(1) + 0.6)).max() < 0.05


def test_lm_parts_tokens():
    texts = [context_mixing.along(t) for t in (b"", b" a  bb\tA ", b"", "É x".encode(), b"x" * 9)]
    got = context_mixing.parted(texts).to_pylist()
    assert got == [w for t in texts for w in [*t.split(), b""]]
    assert [t.count(b" ") for t in texts] == [len(t.split()) + 1 for t in texts]
    assert len(context_mixing.parted([])) == 0
