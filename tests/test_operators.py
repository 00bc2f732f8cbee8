"""Tie rules, edge rows and order-dependent operators against plain restatements."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import sets, urls
from millrace.functions import text as tx
from millrace.operators import crawl, dedup, edits, fusion, html, lexical, vector
from millrace.sources import kb


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").orderBy("k")
    return [r[0] for r in rows.select(f(F.col("v"))).collect()]


def test_normalize(spark):
    given = [None, "", "Co-Founder", "É–x", "a_b", "tabs\tand\nlines ", "health care", "e-mail"]
    assert column(spark, given, tx.normalize) == ["", "", "cofounder", "é x", "a_b", "tabs and lines", "health care", "email"]


def test_ngrams(spark):
    assert column(spark, ["", "a", "ab", "abc", "   ", "a b c d", None, "aaaa"], tx.ngrams) == [[], [], [], ["abc"], [], ["abc", "bcd"], [], ["aaa"]]


def test_variants(spark):
    got = column(spark, ["cofounder", "co-op", "plain"], tx.variants)
    assert set(got[0]) == {"cofounder", "co-founder", "co founder", "founder"}
    assert {"co-op", "coop", "co op"} <= set(got[1]) and got[2] == ["plain"]


def test_cut_content(spark):
    dots = lambda n, at: "x" * at + "." + "y" * (n - at - 1)
    got = column(spark, ["a" * 4000, dots(4001, 3000), dots(4001, 3001), "Skip to content  hi", None], tx.cut_content)
    assert got == ["a" * 4000, dots(4001, 3000)[:4000], dots(4001, 3001)[:3002], "hi", ""]


def test_labels(spark):
    assert column(spark, ["Read More", "x", "42", "", None, "Services"], tx.generic_label) == [True] * 5 + [False]
    assert column(spark, ["https://a/b//Our-team_page", "x"], tx.topic_of_path) == ["Our team page", "x"]
    assert column(spark, [0.8, 0.79, 0.2, 0.1], tx.stars, "double") == [5, 4, 2, 1]


def test_urls(spark):
    given = ["https://a.com", "https://a.com/", "https://a.com/x/", "https://a.com/x//", "https://a.com/x#f", "https://a.com/x/?q=1#f", "http://a.com:8080/p/"]
    want = ["https://a.com", "https://a.com/", "https://a.com/x", "https://a.com/x", "https://a.com/x", "https://a.com/x?q=1", "http://a.com:8080/p"]
    assert column(spark, given, urls.normalize) == want
    assert column(spark, ["http://a.com:8080/p", "/x", "#f"], urls.authority) == ["a.com:8080", "", ""]
    assert column(spark, ["https://a.com/x/y/", "https://a.com", "/p/q.html?z"], urls.slug) == ["y", "", "q.html"]
    base = lambda h: urls.resolve(F.lit("https://a.com/d/p.html?q"), h)
    assert column(spark, ["/x", "//b.org/y", "z", "https://c/d"], base) == ["https://a.com/x", "https://b.org/y", "https://a.com/d/z", "https://c/d"]


def test_sets(spark):
    rows = spark.createDataFrame([([], ["a"]), (["a"], ["a"]), (["a"], ["b"]), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [round(r[0], 4) for r in rows.select(sets.jaccard(F.col("a"), F.col("b"))).collect()] == [0, 1, 0, 0.3333]
    assert [r[0] for r in rows.select(sets.overlap(F.col("a"), F.col("b"))).collect()] == [0, 1, 0, 0.5]


def test_idf_of_common_words(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, "a b"), (2, "a c")], "idx int, text string")
    got = {r["word"]: round(r["idf"], 4) for r in lexical.idf(docs).collect()}
    assert got == {"a": -0.2877, "b": 0.0, "c": 0.4055}


def test_bm25_counts_repeated_query_tokens(spark):
    docs = spark.createDataFrame([(0, "x y"), (1, "y z"), (2, "z z w")], "idx int, text string")
    q = spark.createDataFrame([(0, "x"), (1, "x x")], "query_id int, query string")
    got = {(r["query_id"], r["idx"]): r["score"] for r in lexical.bm25(q, docs).collect()}
    assert set(got) == {(0, 0), (1, 0)} and got[1, 0] == pytest.approx(2 * got[0, 0])


def test_keyword_paths_agree(spark, monkeypatch):
    qa = spark.createDataFrame([(0, "who is the cofounder", "the co-founder is ann"), (1, "email", "write an e-mail to the team"), (2, "x", "nothing")], "idx long, question string, answer string")
    q = spark.createDataFrame([(0, "cofounder email"), (1, "team")], "query_id long, query string")
    rows = lambda: sorted(map(tuple, lexical.keywords(q, qa).collect()))
    short = rows()
    monkeypatch.setattr(lexical, "FORMS", 0)
    assert rows() == short and [r[:3] for r in short] == [(0, 0, 1), (0, 1, 1), (1, 1, 1)]


def test_vector_search_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(200)] + [(200, [0.0] * 8), (201, None)]
    frame = spark.createDataFrame(rows, "idx long, vec array<double>")
    q = frame.where("idx % 50 = 0").withColumnRenamed("idx", "query_id")

    def cos(a, b):
        dot = sum(x * y for x, y in zip(a, b))
        return dot / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    want = set()
    for i, v in rows:
        if i % 50 == 0 and i != 200:
            best = sorted(((-round(cos(v, w), 6), j) for j, w in rows[:200]))[:5]
            want |= {(i, j) for _, j in best}
    for block in (2048, 2):
        monkeypatch.setattr(vector, "BLOCK", block)
        got = {(r["query_id"], r["idx"]) for r in vector.search(q, frame, 5).collect()}
        assert got == want


def test_default_encoder(spark):
    got = column(spark, ["A b a", "", None], vector.encode)
    assert got[0] == vector.encode_text("a B A") and sum(got[1]) == sum(got[2]) == 0


def test_rrf_arithmetic(spark):
    lists = fusion.lists(**{n: spark.createDataFrame([(0, 1, 0.5, 1)], "query_id int, idx int, score double, rank int") for n in fusion.WEIGHTS})
    got = fusion.floor(fusion.rrf(lists, fusion.WEIGHTS)).first()
    assert got["score"] == pytest.approx(4.5 / 61) and got["votes"] == 4 and got["answered"]
    single = fusion.lists(question_semantic=spark.createDataFrame([(0, 1, 0.5, 1)], "query_id int, idx int, score double, rank int"))
    assert not fusion.floor(fusion.rrf(single, fusion.WEIGHTS)).first()["answered"]


def test_cascade_ties_and_fallback(spark):
    stage = lambda rows: spark.createDataFrame(rows, "query_id int, idx int, score double")
    q = spark.createDataFrame([(0,), (1,), (2,)], "query_id int")
    got = fusion.cascade([(1, "a", stage([(0, 5, 0.7), (1, 1, 0.1)]), 0.5), (2, "b", stage([(0, 3, 0.7), (1, 2, 0.6)]), 0.5)], q)
    assert sorted((r["query_id"], r["source"], r["idx"]) for r in got.collect()) == [(0, "a", 5), (1, "b", 2), (2, "fallback", None)]


def scan(n, edges):
    near, leader = {}, {}
    for lo, hi in edges:
        near.setdefault(hi, set()).add(lo)
    for k in range(n):
        own = sorted(x for x in near.get(k, ()) if leader[x] == x)
        leader[k] = own[0] if own else k
    return leader


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_equals_scan(spark, seed):
    rng = random.Random(seed)
    edges = sorted({tuple(sorted(rng.sample(range(25), 2))) for _ in range(30)} | {(25, 26), (26, 27)})
    got = dedup.leaders(spark.range(28), spark.createDataFrame(edges, "lo long, hi long")).collect()
    assert {r["id"]: r["leader"] for r in got} == scan(28, edges)


def test_online_blocks_by_question_first(spark):
    e = lambda rows: spark.createDataFrame(rows, "lo long, hi long")
    got = dedup.online(spark.range(5), e([(0, 1), (1, 2)]), e([(0, 1), (0, 3)]))
    assert {r["id"]: r["status"] for r in got.collect()} == {0: "accepted", 1: "question", 2: "accepted", 3: "answer", 4: "accepted"}
    s = dedup.stats(got).first()
    assert (s["total_seen"], s["accepted"], s["blocked_by_question"], s["blocked_by_answer"], s["dedup_rate"]) == (5, 3, 1, 1, 40.0)


def test_merged_answers(spark):
    qa = spark.createDataFrame([(0, "q", "a"), (1, "q1", "a1"), (2, "q2", "a2")], "idx long, question string, answer string")
    state = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "id long, leader long")
    log = dedup.report(state, qa, spark.createDataFrame([(0, 1, 0.99)], "lo long, hi long, score double"))
    assert {r["id"]: r["action"] for r in log.collect()} == {1: "DISCARDED", 2: "MERGED"}
    assert dedup.merged(state, qa, log).first()["answer"] == "a\n\n[MERGED]: a2"


TOPICS = [{"topic": "t", "semantic_path": "p", "original_url": "u", "qa_pairs": [{"question": f"q{i}", "answer": f"a{i}"} for i in range(3)]}]


@pytest.mark.parametrize("body", [TOPICS, {"metadata": {"domain": "d"}, "tree": {}, "topics": TOPICS}])
def test_topic_files(spark, tmp_path, body):
    (tmp_path / "kb.json").write_text(json.dumps(body))
    topics = kb.read_topics(spark, str(tmp_path / "kb.json"))
    flat = kb.flatten(topics).orderBy("qa_index").collect()
    assert [(r["question"], r["answer"], r["is_bucketed"]) for r in flat] == [(f"q{i}", f"a{i}", False) for i in range(3)]
    kb.write_topics(topics, str(tmp_path / "out"), {"domain": "d"} if isinstance(body, dict) else None)
    again = kb.flatten(kb.read_topics(spark, str(tmp_path / "out")))
    assert [r["question"] for r in again.orderBy("qa_index").collect()] == ["q0", "q1", "q2"]


ELEMENT = {"text": "x", "element_type": "link", "original_url": "u", "depth": 1}


@pytest.mark.parametrize("body", [{"semantic_elements": {"/a": ELEMENT, "/b": ELEMENT}}, {"/a": ELEMENT, "/b": ELEMENT}, [ELEMENT | {"semantic_path": "/a"}, ELEMENT | {"semantic_path": "/b"}]])
def test_element_files(spark, tmp_path, body):
    (tmp_path / "e.json").write_text(json.dumps(body))
    got = kb.read_elements(spark, str(tmp_path / "e.json"))
    assert sorted((r["semantic_path"], r["element_type"], r["depth"]) for r in got.collect()) == [("/a", "link", 1), ("/b", "link", 1)]
    assert kb.read_elements(spark, str(tmp_path / "e.json"), limit=1).count() == 1


def test_snapshots(spark, tmp_path):
    store = kb.Snapshots(spark, str(tmp_path / "s"))
    assert store.versions() == [] and store.save(spark.range(3)) == 1 and store.save(spark.range(5)) == 2
    assert store.rollback(1) == 3 and store.read().count() == 3 and store.read(2).count() == 5


def test_listing_and_cases(spark, tmp_path):
    (tmp_path / "a.json").write_text("x" * 2048)
    (tmp_path / "b.json").write_text("y")
    assert {r["name"]: r["kb"] for r in kb.listing(spark, str(tmp_path), ("b.json",)).collect()} == {"a.json": 2.0}
    (tmp_path / "c.csv").write_text('original_question,rephrased_question\n"who, me",you\n')
    assert tuple(kb.read_eval_cases(spark, str(tmp_path / "c.csv")).first()) == ("who, me", "you")


def nested(spark):
    rows = [(k, f"t{k}", [(i, f"q{i}", f"a{i}") for i in range(k + 1)]) for k in range(3)]
    return spark.createDataFrame(rows, "topic_index int, topic string, qa_pairs array<struct<qa_index:int,question:string,answer:string>>")


def test_edits(spark):
    left = lambda df: {r["topic_index"]: [p["question"] for p in r["qa_pairs"]] for r in df.collect()}
    here = F.col("topic_index") == 2
    assert left(edits.delete(nested(spark), here, F.array(F.lit(0), F.lit(0), F.lit(9))))[2] == ["q1", "q2"]
    assert 2 not in left(edits.delete(nested(spark), here, F.array().cast("array<int>")))
    assert set(left(edits.delete(nested(spark), F.lit(True), F.array(F.lit(0))))) == {1, 2}
    assert left(edits.pick(nested(spark), F.array(F.lit(1), F.lit(7))))[2] == ["q1"]
    assert left(edits.edit(nested(spark), 1, 1, "new", "n"))[1] == ["q0", "new"]


def test_parsers(spark):
    reply = spark.createDataFrame([(0, "BUCKET_1:\nQ: one\nQ: two\nANSWER: both\nBUCKET_2:\nQ: lost\nBUCKET_3:\nANSWER: lonely")], "id int, text string")
    assert [(r["bucket_id"], r["question"], r["answer"]) for r in edits.buckets(reply).orderBy("q_index").collect()] == [("bucket_1", "one", "both"), ("bucket_1", "two", "both")]
    reply = spark.createDataFrame([(0, "Q1: a\nQ2: b\nUNIFIED_ANSWER: c")], "id int, text string")
    got = edits.unified(reply).first()
    assert got["questions"] == ["a"] + ["b"] * 9 and got["answer"] == "c"
    reply = spark.createDataFrame([(0, "A: stray\nQ1: a\nA1: x\nQ: b\nA: y")], "id int, text string")
    assert [tuple(r)[2:] for r in edits.alternating(reply).orderBy("n").collect()] == [("a", "x"), ("b", "y")]
    assert [tuple(x) for x in column(spark, ["MERGED_QUESTION: q\nMERGED_ANSWER: a\nb", "q\na"], edits.merged_pair)] == [("q", "a\nb"), ("q", "a")]
    assert [x and x["a"] for x in column(spark, ['so {"a": 1} ok', "none"], lambda c: edits.embedded_json(c, "a int"))] == [1, None]
    assert column(spark, ["an Entailment", "Contradiction!", "?"], edits.verdict) == ["Entailment", "Contradiction", "Neutral"]


def test_html(spark):
    page = '<html><head><script>var t="</p>";</script></head><body><nav><a href="/n">Nav</a></nav><article><h1>T &amp; <b>x</b></h1><p>one<br><p>two <a href="/l" data-k="v">link</a></article></body></html>'
    pages = spark.createDataFrame([(1, "https://a.com/", page), (2, "https://a.com/e", None)], "page_id long, url string, html string")
    found = html.elements(pages)
    got = [(r["element_type"], r["text"], r["zone"]) for r in found.orderBy("pos").collect() if r["element_type"] in ("heading", "paragraph", "link")]
    assert got == [("link", "Nav", "nav"), ("heading", "T & x", None), ("paragraph", "one", None), ("paragraph", "two link", None), ("link", "link", None)]
    assert [r["href"] for r in html.links(found, strip=True).collect()] == ["/l"]
    assert html.page_text(pages).orderBy("page_id").collect()[0]["text"] == "NavT & xonetwo link"
    assert html.containers(found).first()["main_link"] == "/l"


def test_trees(spark):
    paths = spark.createDataFrame([("a",), ("a/b",), ("a/b/c/d",), ("x/y",), ("a/b",)], "path string")
    assert {r["path"]: r["parent"] for r in crawl.parents_by_prefix(paths).collect()} == {"a": None, "a/b": "a", "a/b/c/d": "a/b", "x/y": None}
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("c", "r"), ("c", "d")], "src string, dst string")
    got = {r["url"]: r["depth"] for r in crawl.breadth_first(spark.createDataFrame([("r",)], "url string"), edges, 2).collect()}
    assert got == {"r": 0, "a": 1, "b": 1, "c": 2}
    assert crawl.depth_first({"r": ["a", "b"], "b": ["c"]}, ["r"], 9) == ["r", "b", "c", "a"]


def test_labels_and_displays(spark):
    from millrace.functions import labels

    rows = spark.createDataFrame([("Read more", {"aria-label": "Our team"}, "/x/about-us"), ("", {}, "/x/about-us?q"), ("Prices", {}, "/p"), ("go", {}, "")], "t string, a map<string,string>, h string")
    got = rows.select(labels.heuristic(F.col("t"), F.col("a"), F.col("h")).alias("l"), labels.final(labels.heuristic(F.col("t"), F.col("a"), F.col("h")), F.col("t"), F.col("h")).alias("f")).collect()
    assert [tuple(r) for r in got] == [("Our team", "Our team"), ("About Us", "About Us"), ("Prices", "Prices"), (None, "go")]
    assert column(spark, ["What is it", "who", "Where to "], lambda c: labels.rephrase(c, F.lit(0))) == ["Which is it", "Can you tell me: who", "In what location to"]
    assert column(spark, ["Say The word"], lambda c: labels.highlight(c, "the")) == ["Say >>>THE<<< word"]
    assert column(spark, ["1. a", "2) b", "c"], labels.numbered) == ["a", "b", "c"]
    assert column(spark, ["https://a.com/Home/About//Team"], labels.readable_path) == ["a.com → Home → About → Team"]


def test_relabel_levels(spark):
    nodes = spark.createDataFrame([(0, None, "r"), (1, 0, "a"), (2, 1, "b"), (3, 0, "c")], "ord int, parent_ord int, label string")
    assert {r["ord"]: r["path"] for r in crawl.relabel(nodes, 9).collect()} == {0: "r", 1: "r/a", 2: "r/a/b", 3: "r/c"}


def test_status_fold_over_several_batches(spark, tmp_path):
    from millrace.streaming import progress

    rows = [(0, 1, "click"), (1, 1, "error"), (2, 1, "click"), (3, 2, "view"), (4, 2, "purchase"), (5, 3, "view")]
    for k in range(3):
        own = [(e, u, t) for e, u, t in rows if e // 2 == k]
        frame = spark.createDataFrame(own, "event_id long, user_id long, event_type string")
        frame.select("event_id", F.timestamp_seconds(F.col("event_id")).alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit("{}").alias("props")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = {}
    stream = progress.fold(progress.source(spark, str(tmp_path / "in")))
    q = stream.writeStream.foreachBatch(lambda df, n: seen.update({r["node"]: (r["status"], r["seen"]) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == {1: ("error", 3), 2: ("completed", 2), 3: ("processing", 1)}


def test_heartbeat_after_silence(spark, tmp_path):
    import time

    from millrace.streaming import progress

    spark.createDataFrame([(0, 1, "click")], "event_id long, user_id long, event_type string").select("event_id", F.timestamp_seconds(F.col("event_id")).alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit("{}").alias("props")).write.parquet(str(tmp_path / "in"))
    got = []
    q = progress.heartbeats(progress.source(spark, str(tmp_path / "in"))).writeStream.foreachBatch(lambda df, n: got.extend(r["type"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(processingTime="500 milliseconds").start()
    for _ in range(60):
        if "heartbeat" in got:
            break
        time.sleep(0.5)
    q.stop()
    assert got[0] == "events" and "heartbeat" in got
