"""The recall chain of a batch of questions in one plan: filters, two legs, fusion, rerank, score filter, cap, cut, siblings.

Each stage is a function of its own; only hits go from one to the next, at most
``candidates`` a question, so texts are joined after the cut and nothing but the
legs sees the corpus.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinmill.operators.answers import expand_siblings
from skeinmill.operators.assistant import Reranker
from skeinmill.operators.inverted_index import InvertedIndex
from skeinmill.operators.retrieval import (
    _BM25,
    _DENSE,
    PREFETCH,
    _inputs,
    _rank,
    base_filter,
    dense_scores,
    document_index,
    fuse,
    metadata_filter,
    ranked,
)
from skeinmill.runtime import table


@dataclass(frozen=True)
class RecallRequest:
    """What a batch of questions asks for. ``candidates`` counts only with a reranker; without one the cut is ``top_k``."""

    top_k: int = 10
    candidates: int = 50
    min_score: float | None = None
    max_hits_per_doc: int = 3
    siblings: bool = True
    keep: Column | None = None


def rerank(hits: DataFrame, questions: DataFrame, texts: DataFrame, reranker: Reranker) -> DataFrame:
    """Hits (query_id, doc_id, rank, score) with the reranker's score as ``score``, the old one as ``recall_score`` and a new
    ``rank``; equal scores keep their order. Texts are scored in Arrow batches, all of one question in a batch in one call."""

    @F.pandas_udf("double")
    def score(question: pd.Series, text: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=question.index)
        for asked, own in text.fillna("").groupby(question.fillna("")):
            made = reranker.score(asked, own.tolist())
            if len(made) != len(own):
                raise ValueError(f"expected {len(own)} scores, got {len(made)}")
            out[own.index] = made
        return out

    joined = hits.join(questions.select("query_id", F.col("text").alias("question")), "query_id").join(texts.select("doc_id", "text"), "doc_id")
    scored = joined.select("query_id", "doc_id", F.col("rank").alias("before"), F.col("score").alias("recall_score"), score("question", "text").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "before")
    return scored.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).drop("before")


def postprocess(hits: DataFrame, min_score: float | None, max_hits_per_doc: int, top_k: int) -> DataFrame:
    """Hits (query_id, doc_uuid, score, rank) of at least ``min_score``, the first of each document (0: all), the first ``top_k`` of those, ranked anew."""
    kept = hits if min_score is None else hits.where(F.col("score") >= min_score)
    if max_hits_per_doc > 0:
        kept = kept.withColumn("n", F.row_number().over(W.partitionBy("query_id", "doc_uuid").orderBy("rank"))).where(F.col("n") <= max_hits_per_doc).drop("n")
    order = W.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("place", (F.row_number().over(order) - 1).cast("long")).where(F.col("place") < top_k)


def dedup_hits(hits: DataFrame, order: list) -> DataFrame:
    """The first hit of each question on each chunk."""
    first = F.row_number().over(W.partitionBy("query_id", "doc_uuid", "chunk_index").orderBy(*order))
    return hits.withColumn("n", first).where("n = 1").drop("n")


def in_reading_order(hits: DataFrame) -> DataFrame:
    """``place`` of each hit (query_id, doc_uuid, chunk_index, added, place): by document and chunk where siblings were added, else as it was."""
    question = W.partitionBy("query_id")
    reading = F.row_number().over(question.orderBy("doc_uuid", "chunk_index")) - 1
    grown = F.max("added").over(question)
    return hits.withColumn("place", F.when(grown, reading).otherwise(F.col("place")).cast("long"))


def recall(questions: DataFrame, points: DataFrame, index: InvertedIndex, vectors: DataFrame, asked_vectors: DataFrame, request: RecallRequest = RecallRequest(), reranker: Reranker | None = None) -> DataFrame:
    """query_id, place, doc_uuid, chunk_index, score of every question's context.

    ``points`` (doc_id, doc_uuid, chunk_index, breadcrumb, text, is_deleted and
    what ``request.keep`` looks at) are restricted before the legs are ranked.
    Siblings that are added score 0.
    """
    allowed = points.where(base_filter()) if request.keep is None else points.where(base_filter() & request.keep)
    allowed = allowed.select("doc_id")
    cut = max(request.top_k, request.candidates) if reranker else request.top_k
    each = max(cut, PREFETCH)
    sparse = index.search(questions, each, allowed).select("query_id", "doc_id", "rank")
    dense = ranked(dense_scores(vectors.join(allowed, "doc_id", "left_semi"), asked_vectors, each), each)
    hits = ranked(fuse([dense, sparse]), cut)
    hits = rerank(hits, questions, points, reranker) if reranker else hits.withColumn("recall_score", F.col("score"))
    known = points.select("doc_id", "doc_uuid", "chunk_index", "breadcrumb")
    hits = postprocess(hits.join(known, "doc_id"), request.min_score, request.max_hits_per_doc, request.top_k)
    own = hits.select("query_id", "doc_uuid", "chunk_index", "breadcrumb", "score", "place")
    if not request.siblings:
        return dedup_hits(own, ["place"]).select("query_id", "place", "doc_uuid", "chunk_index", "score")
    live = points.where(base_filter()).select("doc_uuid", "chunk_index", "breadcrumb")
    grown = expand_siblings(own.drop("place"), live).join(own.select("query_id", "doc_uuid", "chunk_index", "place"), ["query_id", "doc_uuid", "chunk_index"], "left")
    once = dedup_hits(grown.withColumn("added", F.col("place").isNull()), ["added", "place"])
    return in_reading_order(once).select("query_id", "place", "doc_uuid", "chunk_index", "score")


# Query -------------------------------------------------------------------------
class OverlapReranker:
    """A deterministic stand-in for a cross-encoder: the share of a question's distinct words that a text holds."""

    def score(self, question: str, texts: list[str]) -> list[float]:
        asked = set(re.findall(r"[^\W_]+", question.lower()))
        return [len(asked & set(re.findall(r"[^\W_]+", t.lower()))) / len(asked) if asked else 0.0 for t in texts]


def recall_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions over the English documents that are not deleted, with every stage of the chain."""
    docs, deleted, queries, vectors, asked = _inputs(spark, sf_dir)
    path = F.concat(F.coalesce("lang", F.lit("")), F.lit(" > c"), F.col("doc_id") % 7, F.lit(" > d"), F.col("doc_id") % 3)
    points = docs.join(deleted.withColumn("is_deleted", F.lit(True)), "doc_id", "left").select(
        "doc_id", F.col("source").alias("doc_uuid"), F.col("doc_id").alias("chunk_index"), path.alias("breadcrumb"), "text", "is_deleted", F.col("lang").alias("doc_type")
    )
    request = RecallRequest(min_score=0.5, keep=metadata_filter(doc_type="en"))
    found = recall(queries, points, document_index(spark, sf_dir), vectors, asked, request, OverlapReranker())
    return found.withColumn("score", F.round("score", 6))


_LIVE = "doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)"
_CHAIN = f"""WITH corpus AS (SELECT doc_id, text FROM documents), {_BM25}, {_DENSE},
    pt AS (SELECT doc_id, source, lang || ' > c' || doc_id % 7 AS parent, lang || ' > c' || doc_id % 7 || ' > d' || doc_id % 3 AS path FROM documents WHERE {_LIVE}),
    ok AS (SELECT doc_id FROM documents WHERE lang = 'en' AND {_LIVE}),
    b1 AS (SELECT * FROM bm SEMI JOIN ok USING (doc_id)), d1 AS (SELECT query_id, doc_id, list_dot_product(e, qe) / (norm * qn) AS score FROM nv SEMI JOIN ok USING (doc_id), qv),
    legs AS (SELECT query_id, doc_id, rank FROM {_rank("b1", 50)} UNION ALL SELECT query_id, doc_id, rank FROM {_rank("d1", 50)}),
    fused AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (2 + rank)) AS score FROM legs GROUP BY 1, 2), f AS (SELECT query_id, doc_id, rank FROM {_rank("fused", 50)}),
    nq AS (SELECT query_id, count(*) AS n FROM qt GROUP BY 1), s AS (SELECT f.query_id, f.doc_id, f.rank, count(p.term) AS k FROM f JOIN qt USING (query_id) LEFT JOIN post p ON p.doc_id = f.doc_id AND p.term = qt.term GROUP BY 1, 2, 3),
    r AS (SELECT query_id, doc_id, k / n::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY k / n::DOUBLE DESC, rank) AS rank FROM s JOIN nq USING (query_id)),
    c AS (SELECT r.*, source, path, parent FROM r JOIN pt USING (doc_id) WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) <= 3),
    h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS place FROM c QUALIFY place < 10),
    near AS (SELECT DISTINCT query_id, source, parent FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM h) WHERE score >= best - 0.02),
    w AS (SELECT query_id, source, near.parent, doc_id FROM near JOIN pt USING (source) WHERE starts_with(pt.path, near.parent) QUALIFY row_number() OVER (PARTITION BY query_id, source, near.parent ORDER BY doc_id) <= 30),
    x AS (SELECT DISTINCT query_id, source, doc_id FROM (SELECT * FROM w ANTI JOIN h USING (query_id, source, doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, source, parent ORDER BY doc_id) <= 10)),
    g AS (SELECT query_id, source, doc_id, score, place, false AS added FROM h UNION ALL SELECT query_id, source, doc_id, 0.0, NULL, true FROM x)
    SELECT query_id, CASE WHEN bool_or(added) OVER (PARTITION BY query_id) THEN row_number() OVER (PARTITION BY query_id ORDER BY source, doc_id) - 1 ELSE place END AS place, source AS doc_uuid, doc_id AS chunk_index, round(score, 6) AS score FROM g"""
QUERIES = {"recall_chain": (recall_chain, _CHAIN)}
