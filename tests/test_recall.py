"""Stages of the recall chain on their own."""

import pytest

from skeinmill.operators import recall


class Lengths:
    def score(self, question, texts):
        return [float(len(t)) if question == "long" else 0.0 for t in texts]


class Short:
    def score(self, question, texts):
        return [1.0]


def test_rerank_replaces_scores_and_keeps_ties_in_order(spark):
    hits = spark.createDataFrame([(1, 10, 0, 0.9), (1, 11, 1, 0.8), (1, 12, 2, 0.7), (2, 10, 0, 0.5), (2, 12, 1, 0.4)], "query_id long, doc_id long, rank long, score double")
    texts = spark.createDataFrame([(10, "a"), (11, "aaa"), (12, None)], "doc_id long, text string")
    questions = spark.createDataFrame([(1, "long"), (2, "other")], "query_id long, text string")
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score, r.recall_score) for r in recall.rerank(hits, questions, texts, Lengths()).collect())
    assert got == [(1, 0, 11, 3.0, 0.8), (1, 1, 10, 1.0, 0.9), (1, 2, 12, 0.0, 0.7), (2, 0, 10, 0.0, 0.5), (2, 1, 12, 0.0, 0.4)]
    with pytest.raises(Exception, match="expected"):
        recall.rerank(hits, questions, texts, Short()).collect()


def test_postprocess(spark):
    hits = spark.createDataFrame([(1, "a", 0.9, 0), (1, "a", 0.8, 1), (1, "b", 0.8, 2), (1, "a", 0.7, 3), (1, "c", 0.2, 4)], "query_id long, doc_uuid string, score double, rank long")
    places = lambda *a: [(r.place, r["rank"]) for r in sorted(recall.postprocess(hits, *a).collect(), key=lambda r: r.place)]
    assert places(None, 0, 10) == [(i, i) for i in range(5)]
    assert places(0.7, 2, 10) == [(0, 0), (1, 1), (2, 2)]
    assert places(0.5, 1, 1) == [(0, 0)]


def test_dedup_and_reading_order(spark):
    rows = [(1, "b", 5, False, 0), (1, "a", 9, True, None), (1, "b", 5, True, None), (1, "a", 2, False, 1), (2, "z", 1, False, 0), (2, "a", 1, False, 1)]
    hits = spark.createDataFrame(rows, "query_id long, doc_uuid string, chunk_index long, added boolean, place long")
    got = recall.in_reading_order(recall.dedup_hits(hits, ["added", "place"])).collect()
    assert sorted((r.query_id, r.place, r.doc_uuid, r.chunk_index) for r in got) == [(1, 0, "a", 2), (1, 1, "a", 9), (1, 2, "b", 5), (2, 0, "z", 1), (2, 1, "a", 1)]
