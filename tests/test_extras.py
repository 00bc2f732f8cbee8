"""Stems, spellings, labels, page contents and file checks on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import fuzzy, labels, stems
from millrace.operators import edits, html
from millrace.sources import kb, shared
from tests.test_operators import column


@pytest.mark.parametrize(
    "word, stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("caress", "caress"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"),
        ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("failing", "fail"), ("filing", "file"),
        ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("digitizer", "digit"), ("triplicate", "triplic"), ("hopeful", "hope"),
        ("goodness", "good"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"),
        ("is", "is"), ("", ""), ("über", "über"), ("b2b", "b2b"),
    ],
)
def test_published_stems(word, stem):
    assert stems.stem(word) == stem


def test_stems_of_arrays(spark):
    assert column(spark, [["cats", "cat", "hopping"], [], None], stems.stems, "array<string>") == [["cat", "hop"], [], None]


def test_spellings(spark):
    rows = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("ab", ""), ("big red dog", "dog red big"), ("red dog", "red dog house")], "a string, b string")
    a, b = F.split("a", " "), F.split("b", " ")
    got = rows.select(fuzzy.ratio(F.col("a"), F.col("b")), fuzzy.sorted_ratio(a, b), fuzzy.set_ratio(a, b)).collect()
    assert got[0][0] == pytest.approx(1 - 3 / 7) and got[1][0] == 1.0 and got[2][0] == 0.0
    assert got[3][1] == got[3][2] == 1.0
    assert got[4][2] == 1.0 and got[4][1] < 1.0 and got[0][2] == 0.0


def test_display_labels(spark):
    assert column(spark, [1, 2, 3, 4, 5], labels.consensus, "int") == ["✓ Weak Agreement", "✓✓ Moderate Agreement", "✓✓✓ Good Consensus", "✓✓✓✓ Strong Consensus", "✓ Weak Agreement"]
    assert column(spark, [0.06, 0.05, 0.04, 0.03, 0.0], labels.fused_label, "double") == ["Very High", "High", "Medium", "Low", "Very Low"]
    assert column(spark, [["a", "A", "b", "a"], [], None], labels.without_repeats, "array<string>") == [["a", "b", "a"], [], None]
    assert column(spark, [["here", "Contact", "About us"], ["abc", "Contact"], ["12", "go"], []], labels.meaningful, "array<string>") == ["About us", "Contact", None, None]


def test_places(spark):
    rows = spark.createDataFrame([("heading", "News", "https://a.com/x"), ("link", "More", "https://a.com/x"), ("page", "T", "https://a.com/x/y/?q"), ("page", None, "https://a.com/"), ("link", " ", "https://a.com")], "k string, l string, u string")
    assert [r[0] for r in rows.select(labels.located(F.col("k"), F.col("l"), F.col("u"))).collect()] == ["/News", "//More", "x/y", "Home", "Home"]


def test_requests(spark):
    replies = ["TYPE: simplify\nTOPIC: Fees ", "TYPE: other", "Simplify\nTOPIC: a\nTOPIC: b"]
    assert [tuple(r) for r in column(spark, replies, edits.requested)] == [("simplify", "Fees"), ("unknown", "all"), ("simplify", "b")]


PAGE = """<nav><p>navigation navigation navigation</p></nav><h2>Two</h2><p>short text</p><article><h1>One</h1><p>tiny</p><p>an excerpt of more than twenty characters</p><a href="/x">x</a></article><article></article>"""


def test_contents_of_pages(spark):
    found = html.elements(spark.createDataFrame([(1, "https://a.com", PAGE), (2, "https://a.com/e", ""), (3, "https://a.com/n", None)], "page_id long, url string, html string")).cache()
    assert [tuple(r)[2:] for r in html.cards(found).collect()] == [("One", "an excerpt of more than twenty characters", "/x")]
    assert [tuple(r) for r in html.main_content(found).collect()] == [(1, "short text\n\ntiny\n\nan excerpt of more than twenty characters")]
    assert sorted(tuple(r)[2:] for r in html.following(found).collect()) == [("One", "an excerpt of more than twenty characters"), ("Two", "")]
    assert [tuple(r) for r in html.primary_heading(found).collect()] == [(1, "One")]
    assert [tuple(r) for r in html.main_content(found, long=10, least=5).collect()] == [(1, "an excerpt of more than twenty characters")]


def test_checked_files(spark, tmp_path):
    files = {
        "good.json": [{"topic": "a", "qa_pairs": []}], "envelope.json": {"metadata": {}, "topics": [{"topic": "a", "qa_pairs": [{"question": "q", "answer": "a"}]}]},
        "empty.json": [], "other.json": {"x": 1}, "pairs.json": [{"topic": "a", "qa_pairs": []}, {"topic": "b", "qa_pairs": "none"}], "missing.json": {"topics": [{"topic": "a"}]},
    }
    for name, body in files.items():
        (tmp_path / name).write_text(json.dumps(body))
    (tmp_path / "broken.json").write_text("{")
    got = {r.file: (r.topics, r.problem) for r in kb.checked(spark, str(tmp_path)).collect()}
    assert got["good.json"] == (1, None) and got["envelope.json"] == (1, None)
    assert got["empty.json"] == (0, "no topics") and got["broken.json"] == (None, "not JSON")
    assert got["other.json"][1].startswith("neither") and got["pairs.json"][1].endswith("topic 1") and got["missing.json"][1].endswith("topic 0")
    (figures,) = kb.diagnostics(spark, str(tmp_path)).collect()
    assert (figures.kind, figures.files) == ("json", 7)


def test_written_elements(spark, tmp_path):
    rows = [(0, "a/b", "T", "heading", "u", "p", 1, "c"), (1, "a//l", "L", "link", "v", "u", 2, None), (2, "a/b", "T2", "heading", "u", "p", 1, "c")]
    df = spark.createDataFrame(rows, "ord int, semantic_path string, text string, element_type string, original_url string, parent_url string, depth int, content string")
    kb.write_elements(df, str(tmp_path / "crawl"), {"domain": "a"})
    back = {r.semantic_path: r.text for r in kb.read_elements(spark, str(tmp_path / "crawl")).collect()}
    assert back == {"a/b": "T2", "a//l": "L"}


class Session:
    """As much of a session as the shared folder needs."""

    def __init__(self, master, folder):
        self.sparkContext = type("C", (), {"master": master})
        self.conf = type("F", (), {"get": staticmethod(lambda key, default=None: folder or default)})


def test_shared_folder_follows_the_setting(spark):
    assert shared.folder(Session("yarn", "hdfs://x/shared/")).startswith("hdfs://x/shared/millrace-")
    assert shared.folder(Session("local[4]", None)).startswith("/tmp/checkpoints/millrace-")
    with pytest.raises(ValueError):
        shared.folder(Session("spark://host:7077", None))
    assert shared.kept(spark.range(3)).count() == 3
