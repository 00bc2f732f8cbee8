"""The toxicity model's thresholds and sample."""

import random

import numpy as np

from millrace.llm import toxicity


def tables(spark, n=1500, rare=10):
    """Documents in two languages; every rare-th is in 'xx', whose positive rows hold the bad word once among others."""
    rng = random.Random(8)
    rows, marks = [], []
    for d in range(n):
        lang, bad = "xx" if d % rare == 0 else "en", rng.random() < 0.4
        words = [f"{lang}{rng.randrange(200)}" for _ in range(30)]
        if bad and rng.random() < 0.9:
            words[rng.randrange(30)] = "vile"
        elif rng.random() < 0.1:
            words[0] = "vile"
        rows.append((d, " ".join(words), lang))
        marks.append((d, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, toxic int"), rows, dict(marks)


def test_thresholds_cover_all_labelled_rows(spark):
    """A language with few positive rows in the sample and many in the table has a threshold of its own, the best of all its rows outside the sample."""
    docs, labels, rows, marks = tables(spark)
    model = toxicity.fit(docs, labels, rows=100)
    assert set(model.cuts) == {None, "en", "xx"}
    place = {r["doc_id"]: r["p"] for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS p").collect()}
    sampled = set(sorted(place, key=lambda d: (place[d], d))[:100])
    scores = dict(zip((r[0] for r in rows), model.scorer()([r[1].encode() for r in rows])))
    for lang in ("en", "xx", None):
        own = [d for d, _, x in rows if lang in (None, x) and d not in sampled]
        y, s = np.array([marks[d] for d in own]), np.array([scores[d] for d in own])
        assert y.sum() >= 20
        f1 = lambda t: 2 * y[s >= t].sum() / ((s >= t).sum() + y.sum())
        assert f1(model.cuts[lang]) >= max(f1(t) for t in np.unique(np.clip(s, 0.05, 0.95))) - 0.01


def test_small_languages_take_the_threshold_of_all_rows(spark):
    docs, labels, rows, marks = tables(spark, n=300, rare=30)
    assert sum(marks[d] for d, _, x in rows if x == "xx") < 20
    assert set(toxicity.fit(docs, labels).cuts) == {None, "en"}
