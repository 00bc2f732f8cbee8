"""The V1 cascade's stage over answers."""

from millrace import catalog


def test_answers_compete_with_questions(spark, sf_dir):
    """What only an answer matches gets no fallback row, and no query fares worse than by questions alone."""
    two, three = ({r["query_id"]: r for r in catalog.queries()[n](spark, sf_dir).collect()} for n in ("cascade_v1", "cascade_v1_answers"))
    assert set(two) == set(three)
    assert all(three[k]["source"] == "answer" or three[k] == two[k] for k in two)
    assert all(r["score"] is None or three[k]["score"] >= r["score"] for k, r in two.items())
    assert any(r["source"] == "answer" for r in three.values())
