"""Injected services, look-ups by position, files of a knowledge base, and cancelled streams."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import paths
from millrace.operators import ann, edits, html, services, vector
from millrace.sources import kb
from millrace.streaming import progress


def test_a_failing_service_gives_zero_vectors(spark):
    def embed(texts):
        if "bad" in texts:
            raise OSError
        return [[1.0, float(len(t))] for t in texts]

    rows = spark.createDataFrame([("aa",), ("bad",), (None,), ("cccc",)], "t string").coalesce(1)
    one = services.batched(embed, 2, 1)(F.col("t"))
    assert [r[0] for r in rows.select(one).collect()] == [[1.0, 2.0], [0.0, 0.0], [1.0, 0.0], [1.0, 4.0]]
    pairs = services.batched(embed, 2, 2)(F.col("t"))
    assert [r[0] for r in rows.select(pairs).collect()] == [[0.0, 0.0], [0.0, 0.0], [1.0, 0.0], [1.0, 4.0]]


def test_guarded_rows_go_on(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, "yyy")], "id long, t string")
    got = {r["id"]: (r["n"], r["error"]) for r in services.guarded(rows, lambda r: {"n": len(r["t"])}, "n long").collect()}
    assert got[1] == (1, None) and got[3] == (3, None) and got[2][0] is None and got[2][1].startswith("TypeError")


def test_router():
    routes = {"v1": lambda: 1, "v2": lambda: 2, "v3": lambda: 3}
    assert [services.Router(routes, e).answer() for e in (("v1",), ("v1", "v2"), ("v3", "v2"), ())] == [1, 2, 3, 1]


def test_positions(spark):
    topics = spark.createDataFrame([(0, [("q0", "a0"), ("q1", "a1")])], "topic_index long, qa_pairs array<struct<question:string,answer:string>>")
    assert topics.select(edits.pair_at(1)["question"]).first()[0] == "q1"
    assert [p["question"] for p in edits.remove_at(topics, 0).first()["qa_pairs"]] == ["q1"]
    for bad in (2, -1):
        with pytest.raises(Exception, match="no pair at"):
            topics.select(edits.pair_at(bad)["question"]).collect()
        with pytest.raises(Exception, match="no pair at"):
            edits.remove_at(topics, bad).collect()
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(paths.must(F.col("id") > 0, F.col("id"), "out of range")).collect()


def test_index_keeps_its_rows_and_finds_most(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(12)]) for k in range(400)]
    near = [(1000 + k, [x + rng.gauss(0, 0.05) for x in v]) for k, v in rows[:100]]
    frame = spark.createDataFrame(rows, "idx long, vec array<double>")
    index = ann.Index(spark, str(tmp_path / "index"), 12)
    assert not index.exists()
    index.rebuild(frame.where("idx < 200"))
    again = ann.Index(spark, str(tmp_path / "index"), 12).rebuild(frame)
    again.add(frame.where("idx >= 200"))
    assert again.rows().count() == 400
    q = spark.createDataFrame(near, "query_id long, vec array<double>")
    got = {(r["query_id"], r["idx"]) for r in again.search(q, 1, least=0.5).collect()}
    exact = {(r["query_id"], r["idx"]) for r in vector.search(q, frame, 1).collect()}
    assert len(got & exact) >= 90


def test_siblings_and_contexts(spark):
    page = "<div><h2>One</h2><ul><li>x</li></ul><p>text</p></div><div><h2>Two</h2><br><br><br><br><br><p>far</p></div><section id='s'>\n<a href='/a'>go</a> <a href='#x'>skip</a></section><h3>End"
    got = {r["text"]: r for r in html.siblings(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")).collect()}
    assert got["One"]["paragraph_follows"] and not got["Two"]["paragraph_follows"] and not got["End"]["paragraph_follows"]
    assert got["go"]["context"] == "<section id='s'>\n<a href='/a'>go</a> <a href='#x'>skip</a></section>" and got["go"]["href"] == "/a"
    assert html.siblings(spark.createDataFrame([(1, page)], "page_id long, html string"), chars=9).where("text = 'go'").first()["context"] == "<section "


def test_trees_and_crawls(spark, tmp_path):
    nodes = [(0, None, "Home", "h", "u0", 0), (1, 0, "B", "h/b", "u1", 1), (2, 0, "A", "h/a", "u2", 1), (3, 2, "C", "h/a/c", "u3", 2)]
    frame = spark.createDataFrame(nodes, "ord long, parent_ord long, title string, path string, url string, depth int")
    kb.write_tree(frame, str(tmp_path / "tree"), "example.org")
    (part,) = (tmp_path / "tree").glob("part-*")
    tree = json.loads(part.read_text())
    assert (tree["domain"], tree["total_nodes"]) == ("example.org", 4)
    (home,) = tree["tree"]
    assert [c["title"] for c in home["children"]] == ["A", "B"] and home["children"][0]["children"][0]["title"] == "C"
    top = kb.read_tree(spark, str(tmp_path / "tree")).collect()
    assert [r["title"] for r in top] == ["Home"] and len(json.loads(top[0]["children"])) == 2
    none = frame.where("false")
    assert kb.tree_of(none, None, frame).count() == 4 and kb.tree_of(none, None, None) is None
    kb.write_crawl(frame, str(tmp_path / "crawl"), {"max_depth": "2"})
    assert spark.read.json(str(tmp_path / "crawl" / "stats")).first()["total_pages"] == 4


def test_switch_preview_and_guarded_delete(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.json").write_text(json.dumps([{"topic": n, "qa_pairs": []}]))
    (tmp_path / "c.json").write_text(json.dumps({"crawl_metadata": {"crawl_type": "bfs"}, "semantic_elements": {"x": {}, "y": {}}}))
    base = kb.Base(spark, str(tmp_path / "a.json"))
    assert base.topics.first()["topic"] == "a" and base.switch(str(tmp_path / "b.json")).first()["topic"] == "b"
    with pytest.raises(ValueError):
        base.delete(str(tmp_path / "b.json"))
    base.delete(str(tmp_path / "a.json"))
    assert not (tmp_path / "a.json").exists() and (tmp_path / "b.json").exists()
    got = kb.preview(spark, [str(tmp_path / "none.json"), str(tmp_path / "c.json")]).first()
    assert (got["crawl_type"], got["elements"]) == ("bfs", 2)


@pytest.mark.parametrize("save", [True, False])
def test_cancelled_streams(spark, tmp_path, save):
    made = spark.range(6).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 2 AS user_id", "'click' AS event_type", "1.0D AS value", "'' AS props")
    made.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    counts = progress.counts(progress.source(spark, str(tmp_path / "in")))
    q = counts.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")).option("checkpointLocation", f"{out}/state").outputMode("complete").start()
    q.processAllAvailable()
    got = progress.cancelled(spark, q, out, save)
    assert not q.isActive
    if save:
        assert [r["n"] for r in got.collect()] == [6]
    else:
        assert got is None and not (tmp_path / "out").exists()
