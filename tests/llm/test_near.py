"""The pipeline's near-dedup stage against all pairs by Jaccard similarity."""

import random

import numpy as np

import corpus_pipeline
from millrace.llm import set_join, simhash


def grams(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return {b" ".join(w)} if w else set()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def kept(rows):
    """Ids that stay: the smallest of each component over pairs of 0.8 or more."""
    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted(d for i, (d, _) in enumerate(rows) if least[root(i)] == d)


def stage(spark, rows, sf_dir):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(r["doc_id"] for r in corpus_pipeline.drop_near(spark, docs, sf_dir).collect())


def test_stage_against_all_pairs(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert stage(spark, rows, sf_dir) == kept(rows)


def test_stage_on_edited_copies(spark, sf_dir):
    """Copies around the border of 0.8, in chains, with a line that all share."""
    rng = random.Random(5)
    rows = []
    for _ in range(12):
        text = [f"w{rng.randrange(300)}" for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(12):
            rows.append((len(rows), " ".join(text) + " one line that each of these texts holds at its end"))
            text = list(text)
            for _ in range(rng.randrange(1, 2 + len(text) // 40)):
                text[rng.randrange(len(text))] = f"w{rng.randrange(300)}"
    rows += [(len(rows) + k, t) for k, t in enumerate(["", "  ", None, "One two", "one  TWO", "one two three"])]
    rng.shuffle(rows)
    assert stage(spark, rows, sf_dir) == kept(rows)


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    for n in [1, 2, 4, 5, 6, 9, 10, 50, 333]:
        for _ in range(50):
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            b = a[np.sort(rng.permutation(n)[: n - n // 5])]
            common = np.unique(np.concatenate([a[::2], b[:3]]))
            assert set_join.similar(a, b)
            args = common, rng.permutation(len(common))
            assert np.intersect1d(set_join.prefix(a, *args), set_join.prefix(b, *args)).size
            assert not set_join._far(*(np.frombuffer(set_join.sketch(x), np.uint64)[None] for x in (a, b)), np.array([len(a) + len(b)]))[0]


def test_sketches_of_any_size_rule_out_only_unlike_sets():
    rng = np.random.default_rng(6)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    best = lambda s: set_join.wide(s) or set_join.sketch(s)
    for n in (1, 100, 1_000, 1_024, 1_025, 2_000, 2_048, 5_000, 70_000):
        a = np.unique(draw(n))
        close, other = np.unique(np.concatenate([a[n // 9 :], draw(n // 10)])), np.unique(draw(n))
        assert set_join.folded(best(a), 128) == set_join.sketch(a)
        pairs = [(a, close), (a, other), (close, a)]
        apart = set_join._apart([best(x) for x, _ in pairs], [best(y) for _, y in pairs], np.array([len(x) + len(y) for x, y in pairs]))
        assert all(not out for out, p in zip(apart, pairs) if set_join.similar(*p))
        assert n < 100 or apart.tolist() == [False, True, False]


def test_links_come_from_the_trees_and_are_checked(spark, monkeypatch):
    """Close fingerprints link similar sets, also without the join; unlike sets are not linked by theirs."""
    rng = random.Random(8)
    text = [f"w{rng.randrange(10**6)}" for _ in range(3_000)]
    rows = [(1, " ".join(text)), (2, " ".join([*text, "end"])), (3, " ".join(f"v{rng.randrange(10**6)}" for _ in range(3_000)))]
    # Equal fingerprints, as all three-word shingles are equal, and no five-word shingle in common.
    rows += [(4, "a a a a"), (5, "a a a a a a a")]
    fps = {d: simhash.fingerprint(t.encode()) for d, t in rows}
    assert (fps[1] ^ fps[2]).bit_count() <= simhash.LINK and fps[4] == fps[5]
    asked = []
    real = set_join.links
    monkeypatch.setattr(set_join, "links", lambda values: asked.append(1) or real(values))
    monkeypatch.setattr(set_join, "prefix", lambda hashes, *_: hashes[:0])  # nothing to join on
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in set_join.near_groups(docs).collect()}
    assert asked and got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
