"""Runs, blocks and caches: results don't depend on where they are cut, and what a task holds is bounded."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from millrace.llm import bpe, chunking, common, content_sort, fm_index, queries as Q, simhash, toxicity

from . import brute, edge


def run_batches(groups, size):
    """Rows of groups (text, ids) in order, in batches of size rows."""
    doc = [i for _, ids in groups for i in ids]
    norm = [t for t, ids in groups for _ in ids]
    for at in range(0, len(doc), size):
        own = norm[at : at + size]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[at : at + size], pa.int64()), pa.array(own), pa.array([t.encode()[:4] for t in own], pa.binary())], names=["doc_id", "norm", "sha"]
        )


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_runs_add_up(size, monkeypatch):
    monkeypatch.setattr(content_sort, "HELD", 5)
    groups = [("a", [1, 2]), ("b", [3]), ("c", [None, None]), ("d", [None, 4, 9, *range(20, 40)]), ("e", [5]), ("f", [6, 7])]
    runs, out = content_sort._Runs(3), []
    for b in run_batches(groups, size):
        out += [r for x in runs.take(b) for r in x.to_pylist()]
    out += [r for x in runs.flush(True) for r in x.to_pylist()]
    assert [r["doc_id"] for r in out] == [i for _, ids in groups for i in ids]
    texts, parts = {}, {}
    for r in out:
        if r["part"] is not None and r["norm"] is not None:
            assert r["part"] not in texts
            texts[r["part"]] = r["norm"]
            parts.setdefault(r["norm"], []).append((r["n"], r["lo"], r["hi"]))
    assert {"a", "f"} <= set(parts) and (size == 100 or "d" in parts)
    at = 0
    for text, ids in groups:
        for r in out[at : at + len(ids)]:
            if r["part"] is None:
                got = [i for i in ids if i is not None]
                assert (r["n"], r["lo"], r["hi"]) == (len(ids), min(got, default=None), max(got, default=None))
            else:
                assert texts[r["part"]] == text and sum(n for n, _, _ in parts[text]) == len(ids)
        at += len(ids)


def test_a_run_of_a_million_rows_comes_in_bounded_batches():
    runs, text = content_sort._Runs(0), "x" * 1000
    most = rows = 0
    for at in range(0, 1_000_000, 10_000):
        b = pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + 10_000)), pa.array([text] * 10_000), pa.array([b"s"] * 10_000, pa.binary())], names=["doc_id", "norm", "sha"])
        for x in runs.take(b):
            most, rows = max(most, x.num_rows), rows + x.num_rows
        assert runs.held <= content_sort.HELD
    rows += sum(x.num_rows for x in runs.flush(True))
    assert rows == 1_000_000 and most <= content_sort.HELD + 10_000


def test_groups_over_many_ranges(spark):
    """A group that holds most rows, whose parts meet again."""
    rows = [(k, "Same text" if k % 3 else f"text {k % 50}") for k in range(3000)] + [(None, "same TEXT"), (7000, None), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[brute.low(t)].append(d)
    got = content_sort.exact_groups(frame, keep="largest").collect()
    assert len(got) == len(rows)
    have = collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got)
    want = collections.Counter()
    for ids in groups.values():
        top = max((i for i in ids if i is not None), default=None)
        want.update((i, top, len(ids), i == top) for i in ids)
    assert have == want


def test_null_ids_stay_apart(spark, sf_dir):
    """A null id is no key: an unrelated row without an id outlives a near copy without one."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (None, text + " more"), (None, "something else that no other row has in it"), (2, "a third text of some words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["text"] for r in corpus_pipeline.drop_near(spark, docs, sf_dir).collect()}
    assert got == {rows[0][1], rows[2][1], rows[3][1]}


def test_passages_of_rows_without_an_id(spark):
    rng = random.Random(1)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    shared = say(70)
    rows = [(7, say(40) + " " + shared + " " + say(30)), (None, say(50) + " " + shared), (9, say(90)), (None, say(90))]
    found = chunking.passages(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, start int")).collect()
    assert sorted((r["doc_id"], r["first_doc_id"]) for r in found if r["doc_id"]) == [(7, 7)]
    assert [r["first_doc_id"] for r in found if r["doc_id"] is None] == [7] and len(found) == 2
    kept = {r["text"] for r in chunking.without(spark.createDataFrame(rows, "doc_id long, text string"), chunking.passages(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert {rows[0][1], rows[2][1], rows[3][1]} < kept and all(shared not in t for t in kept - {rows[0][1]})


def spans_by_brute(rows, min_chars):
    """Passages by dictionaries instead of joins: unions of pairs of neighbouring chunks that other documents hold too."""
    holders, own = collections.defaultdict(set), []
    for d, t in rows:
        raw, made = t.encode(), []
        ends = chunking.cuts(raw).tolist()
        parts = [raw[s:e] for s, e in zip([0, *ends], ends)]
        char = lambda at: len(raw[:at].decode("utf-8", "ignore"))
        for k in range(1, len(parts)):
            made.append(((parts[k - 1], parts[k]), char(ends[k - 2] if k > 1 else 0), char(ends[k])))
        for key, _, _ in made:
            holders[key].add(d)
        own.append((d, made))
    out = []
    for d, made in own:
        spans = []
        for key, s, e in made:
            if len(holders[key]) > 1:
                if spans and s < spans[-1][1]:
                    spans[-1][1] = e
                else:
                    spans.append([s, e])
        out += [(d, s, e) for s, e in spans if e - s >= min_chars]
    return sorted(out)


def test_passages_by_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("text is not null and text not rlike '[^\\x00-\\x7f]'").collect()]
    found = chunking.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["start"], r["end"]) for r in found) == spans_by_brute(rows, chunking.MIN_CHARS)


def long_text():
    rng = random.Random(6)
    words = [f"{rng.choice('abcxyz')}{rng.randrange(3_000_000)}" for _ in range(330_000)]
    return " ".join(words)


def test_texts_longer_than_every_block(spark, tmp_path):
    """op4, op5, op8 and op10 on a text of more words than any block holds, against plain restatements."""
    long = long_text()
    item = " ".join(long.split()[250_000:250_013])
    assert len(long) > 2 << 20
    path = edge.write(spark, tmp_path / "long", rows=[(1, long), (2, long + " tail")], bench=[(5, item)], labels=[])
    got = {r["doc_id"]: r for r in Q.op4_simhash_dedup(spark, path).collect()}
    assert int(got[1]["fingerprint"], 16) == brute.fingerprint(long)
    ids = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in Q.op8_bpe(spark, path).collect()}
    assert ids[1] == brute.bpe([long], Q.tokenizer_path())[0]
    hit = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in Q.op10_decontaminate(spark, path).collect()}
    assert hit[1] == (330_000, 13, 1) and hit[2] == (330_001, 13, 1)
    net = toxicity.Network()
    net.table[:] = np.random.default_rng(1).normal(0, 1, net.table.shape)
    words = toxicity.Words()
    numbers = words.numbers(long.encode())
    x = net.embed(np.array(words.parts))[numbers]
    assert np.isclose(toxicity.Scorer(net).logit(long.encode()), net.logit([x]), atol=1e-4)


def test_pieces_join_to_the_text():
    raw = b"ab cd\tef " * 50 + b"x" * 400 + b" y"
    for size in (1, 3, 10, 100, 5000):
        own = list(common.pieces(raw, size))
        assert b"".join(own) == raw and [w for p in own for w in p.split()] == raw.split()
    assert list(common.pieces(b"", 4)) == [b""]


def test_encoder_forgets():
    enc = bpe.Encoder(Q.tokenizer_path(), cache=20_000)
    texts = [f"Some Text {k} " * 3 + "word" * k + f" naïve{k} caf\u00e9 12{k}" for k in range(300)]
    want = brute.bpe(texts, Q.tokenizer_path())
    for t, w in zip(texts, want):
        assert len(enc.text(t.encode())) // 4 == w[0]
        assert enc.held <= 20_000 + 60_000
    enc.forget()
    assert not enc.known and not enc.words and not enc.old_known


def test_decode(spark):
    enc = bpe.encoder(Q.tokenizer_path())
    texts = ["Hello world again", "", None, "naïve <|endoftext|> x"]
    rows = [(k, None if t is None else np.frombuffer(enc.text(t.encode()), np.int32).tolist()) for k, t in enumerate(texts)]
    out, name = bpe.decode(spark.createDataFrame(rows, "decoded int, ids array<int>").coalesce(1), Q.tokenizer_path())
    assert name != "decoded"
    got = {r["decoded"]: r[name] for r in out.collect()}
    plain = __import__("tokenizers").Tokenizer.from_file(Q.tokenizer_path())
    assert got == {k: plain.decode(ids or [], skip_special_tokens=False) for k, ids in rows}


def test_stages_on_edge_rows(spark, tmp_path):
    small = edge.write(spark, tmp_path / "in")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    named = lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    # Without labels of both classes nothing goes; with them, what goes is what reaches the threshold.
    bare = edge.write(spark, tmp_path / "bare", labels=[])
    assert named(corpus_pipeline.drop_toxic(spark, docs, bare)) == named(docs)
    marks = [(1000 + k, 0, k % 2) for k in range(300)]
    texts = [(1000 + k, ("vile words here " if k % 2 else "kind words here ") + f"w{k % 17}") for k in range(300)]
    full = edge.write(spark, tmp_path / "full", rows=edge.texts() + texts, labels=marks)
    left = named(corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{full}/documents.parquet"), full))
    assert all((d % 2 == 0) == ((d, t) in left) for d, t in texts)
    assert left[(18, "dup row")] in (0, 2) and left[(None, "no id")] in (0, 2)
    out = corpus_pipeline.encode(spark, docs, small).collect()
    assert len(out) == docs.count() and sum(r["n_tokens"] == 0 for r in out) == sum(not (t or "").strip() for _, t in edge.texts())
    assert all(len(r["ids"]) == r["n_tokens"] for r in out)


def test_a_huge_row_does_not_empty_the_sample(spark):
    """Rows that don't fit the sample are passed over; both classes are in it."""
    rows = [(k, "bad thing" if k % 40 == 0 else "good thing") for k in range(400)] + [(10_000 + k, "big " * 200_000) for k in range(3)]
    labels = [(d, int(t.startswith("bad"))) for d, t in rows]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), rows=50, size=200_000)
    bad, good = model.scorer()([b"bad thing", b"good thing"])
    assert bad > 0.5 > good


def test_workers_hand_memory_back(spark):
    """What a task needed goes back to the system with its end, and Parquet's texts come in short batches."""

    def start():
        def work(texts):
            many = [pa.array(np.arange(500, dtype=np.int64) + k) for k in range(60_000)]  # 240 MB, in small blocks
            return [pa.array([len(many)] * len(texts))]

        return work

    def held(batches):
        for b in batches:
            anon = re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())
            yield pa.RecordBatch.from_arrays([pa.array([int(anon[1]) >> 10] * b.num_rows)], names=["mb"])

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").coalesce(1)
    assert common.annotate(docs, start, [("n", common.T.LongType())]).first()["n"] == 60_000
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512
    assert max(r["mb"] for r in spark.range(40).repartition(8).mapInArrow(held, "mb long").collect()) < 200
