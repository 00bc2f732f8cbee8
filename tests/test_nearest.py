"""Searches of many queries, in blocks of both sides."""

import random

from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import lexical, spelling


def test_blocks_find_the_same_rows(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("the a of ox pig hen cow elk bee ant fly owl rat cat".split()) for _ in range(rng.randrange(1, 9)))
    docs = spark.createDataFrame([(k, text()) for k in range(70)] + [(70, ""), (71, None)], "idx long, text string")
    q = spark.createDataFrame([(k, text()) for k in range(25)] + [(25, "unknown"), (26, None)], "query_id long, query string")

    def first(df):
        rated = df.withColumn("score", F.round("score", 6))
        return sorted(map(tuple, lexical.top(rated, 5, F.desc("score"), F.asc("idx")).select("query_id", "rank", "idx", "score").collect()))

    for block in (1 << 15, 13):
        monkeypatch.setattr(lexical, "BLOCK", block)
        assert first(lexical.bm25_nearest(q, docs, 5)) == first(lexical.bm25(q, docs))
        assert first(lexical.jaccard_nearest(q, docs, tx.words, 5)) == first(lexical.jaccard(q, docs, tx.words))
    few = lexical.jaccard_nearest(q, docs, tx.words, 5).count()
    assert few < lexical.jaccard(q, docs, tx.words).count()


def test_distances_of_any_length():
    rng = random.Random(1)
    text = lambda *n: bytes(rng.choice(b"abc d") for _ in range(rng.choice(n)))
    one, two = [text(0, 1, 5, 63, 64, 65, 128, 129) for _ in range(60)], [text(0, 1, 7, 64, 100) for _ in range(60)]

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    assert spelling.distances(one, two).tolist() == [plain(a, b) for a, b in zip(one, two)]


def test_spellings_in_blocks_as_pair_by_pair(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice("the a of oxen pigs hens cows elk bees ants flies Zoë".split()) for _ in range(rng.randrange(1, 9)))
    docs = spark.createDataFrame([(k, text()) for k in range(60)] + [(60, None)], "idx long, text string")
    q = spark.createDataFrame([(k, text()) for k in range(20)] + [(20, "")], "query_id long, query string")
    monkeypatch.setattr(lexical, "FUZZY_BLOCK", (7, 25))

    def first(df):
        return sorted(map(tuple, lexical.top(df.withColumn("score", F.round("score", 6)), 5, F.desc("score"), F.asc("idx")).select("query_id", "rank", "idx", "score").collect()))

    assert first(lexical.fuzzy_nearest(q, docs, 5)) == first(lexical.fuzzy(q, docs, tx.ascii_words))
    assert first(lexical.normalized_nearest(q, docs, 5)) == first(lexical.normalized(q, docs))
    assert first(lexical.stemmed_nearest(q, docs, tx.stem_words, 5)) == first(lexical.stemmed(q, docs, tx.stem_words))


def test_most_pairs_need_no_distance(monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(300)] + ["the"] * 60
    texts = [sorted({"the", *(rng.choice(vocabulary) for _ in range(rng.randrange(2, 40)))}) for _ in range(900)]
    asked = [sorted(rng.sample(t, max(1, len(t) - 2))) for t in texts[:12]] + [["the"]]
    table = lambda key, rows: pa.table({key: list(range(len(rows))), "n": [len(r) for r in rows], "items": rows, "weights": [[1.0] * len(r) for r in rows]})
    whole, looked = spelling._within, []
    monkeypatch.setattr(spelling, "_within", lambda one, a, *x: looked.append(len(a)) or whole(one, a, *x))

    def exact(q, d):
        both = set(q) & set(d)
        n, one, two = len(" ".join(sorted(both))), *("".join(" " + w for w in x if w not in both).encode() for x in (q, d))
        shorter, longer = sorted((len(one), len(two)))
        return max(n / (n + shorter), 1 - int(spelling.distances([one], [two])[0]) / (n + longer)) if both else 0.0

    got = lexical._block(table("query_id", asked), table("idx", texts), 5, 0.0, None).to_pylist()
    assert sum(looked) < 0.8 * len(asked) * len(texts)
    for i, q in enumerate(asked):
        own = sorted(((-round(r["score"], 6), r["idx"]) for r in got if r["query_id"] == i))[:5]
        assert own == sorted((-round(exact(q, d), 6), k) for k, d in enumerate(texts))[:5]


def test_many_queries_are_dealt_to_several_tasks(spark):
    q = spark.range(1300).select(F.col("id").alias("query_id"), F.concat(F.lit("ox "), F.col("id").cast("string")).alias("query"))
    docs = spark.createDataFrame([(0, "ox"), (1, "an ox")], "idx long, text string")
    for found in (lexical.jaccard_nearest(q, docs, tx.words, 5), lexical.fuzzy_nearest(q, docs, 5)):
        assert found.groupBy(F.spark_partition_id()).count().count() > 1
        assert found.count() == 2600
