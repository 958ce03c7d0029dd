"""Retrieval over a corpus for a stated set of queries: BM25, dense k-NN, fusion, post-processing.

The query set is bounded (a batch of questions); documents are scanned once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinmill.operators.inverted_index import InvertedIndex, index_of, query_terms
from skeinmill.runtime import settle, table

PREFETCH = 20
MOST_QUERIES = 100_000
RRF_K = 2


def _scorer(q: np.ndarray, q_ids: np.ndarray, k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column(0))
            m = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(len(ids), -1)
            m = m / np.sqrt((m * m).sum(axis=1))[:, None]
            for i in range(len(q)):
                s = (m * q[i]).sum(axis=1)
                best = np.lexsort((ids, -np.round(s, 9)))[:k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), q_ids[i])), pa.array(ids[best]), pa.array(s[best])], names=["query_id", "doc_id", "score"])

    return score


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows whose embedding is not null, finite throughout and not zero, as doubles."""
    own = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0.0))


def dense_scores(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score: each task's k rows of largest cosine for each vector of a query set of at most ``MOST_QUERIES``.

    Vectors that are null, zero or not finite take no part, and a query is compared with vectors of its own length.
    """
    asked = _usable(queries).limit(MOST_QUERIES + 1).collect()
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"a query set may hold {MOST_QUERIES} vectors")
    found = vectors.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
    usable = _usable(vectors).select("doc_id", "embedding")
    for d in sorted({len(r.embedding) for r in asked}):
        own = [r for r in asked if len(r.embedding) == d]
        q = np.array([r.embedding for r in own], dtype=np.float64)
        q /= np.sqrt((q * q).sum(axis=1))[:, None]
        scored = usable.where(F.size("embedding") == d).mapInArrow(_scorer(q, np.array([r.query_id for r in own], np.int64), k), "query_id long, doc_id long, score double")
        found = found.unionByName(scored)
    return found


def base_filter(tenant: str | None = None, include_deleted: bool = False) -> Column:
    """Rows of a tenant that are not marked deleted; a missing mark keeps."""
    own = F.lit(True) if tenant is None else F.coalesce(F.col("tenant_id") == tenant, F.lit(False))
    return own if include_deleted else own & ~F.coalesce("is_deleted", F.lit(False))


def metadata_filter(doc_uuid: str | None = None, doc_type: str | None = None, filename: str | None = None, tags: tuple[str, ...] = ()) -> Column:
    """All of the equalities that are asked for, and every tag present."""
    wanted = F.lit(True)
    for name, value in (("doc_uuid", doc_uuid), ("doc_type", doc_type), ("filename", filename)):
        wanted = wanted if value is None else wanted & (F.col(name) == value)
    for tag in tags:
        wanted = wanted & F.array_contains("tags", tag)
    return F.coalesce(wanted, F.lit(False))


def scroll_by_doc(points: DataFrame, page_size: int = 256) -> DataFrame:
    """``points`` with the page that each lies on when its document is read by chunk_index."""
    order = W.partitionBy("doc_uuid").orderBy("chunk_index", "id")
    return points.withColumn("page", F.floor((F.row_number().over(order) - 1) / page_size).cast("int"))


def validate_request(collection: str, query: str, top_k: int, candidates: int, collections: tuple[str, ...]) -> None:
    if collection not in collections:
        raise ValueError(f"unknown collection: {collection}")
    if not query.strip():
        raise ValueError("the query is blank")
    if not 1 <= top_k <= 100 or not 1 <= candidates <= 200:
        raise ValueError("top_k lies in 1..100 and candidates in 1..200")


def encode_query(query: str, embedder) -> tuple[list[float], list[str]]:
    """Dense vector and sparse terms of a question that is not blank."""
    if not query.strip():
        raise ValueError("the query is blank")
    vector = embedder.embed([query])[0]
    if len(vector) != embedder.dim:
        raise ValueError(f"expected {embedder.dim} numbers, got {len(vector)}")
    return vector, re.findall(r"[^\W_]+", query.lower())


def ranked(scores: DataFrame, k: int, name: str = "rank") -> DataFrame:
    """The k best of each query, ranks from 0, ties to the smaller document."""
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scores.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k).withColumn(name, (F.col(name) - 1).cast("long"))


def fuse(legs: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked legs (query_id, doc_id, rank): one union and one grouped sum."""
    whole = legs[0].select("query_id", "doc_id", "rank")
    for leg in legs[1:]:
        whole = whole.unionByName(leg.select("query_id", "doc_id", "rank"))
    return whole.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def live(docs: DataFrame, deleted: DataFrame) -> DataFrame:
    """Documents not marked deleted; a missing mark keeps."""
    return docs.join(deleted, "doc_id", "left_anti")


def per_document_cap(hits: DataFrame, cap: int, document: str) -> DataFrame:
    if cap <= 0:
        return hits
    order = W.partitionBy("query_id", document).orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).drop("n")


def _inputs(spark: SparkSession, sf_dir: str):
    docs = table(spark, sf_dir, "documents")
    deleted = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = vectors.join(queries.select("query_id"), F.col("doc_id") == F.col("query_id")).select("query_id", "embedding")
    return docs, deleted, queries, vectors, asked


def document_index(spark: SparkSession, sf_dir: str) -> InvertedIndex:
    """The index that all BM25 queries over the whole corpus share."""
    return index_of(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("collection")), "documents", [f"{sf_dir}/documents.parquet"])


def recall_hybrid(spark: SparkSession, sf_dir: str, limit: int = 10) -> DataFrame:
    """Both legs, filtered by soft deletion, fused; a question's dense vector is the one with its id."""
    docs, deleted, queries, vectors, asked = _inputs(spark, sf_dir)
    size = max(limit, PREFETCH)
    index = index_of(live(docs.select("doc_id", "text"), deleted), "live documents", [f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet"])
    sparse = index.search(queries, size).select("query_id", "doc_id", "score", "rank")
    dense = ranked(dense_scores(live(vectors, deleted), asked, size), size)
    return ranked(fuse([dense, sparse]), limit).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, queries, _, _ = _inputs(spark, sf_dir)
    return document_index(spark, sf_dir).search(queries, 10).select("query_id", "doc_id", "rank", F.round("score", 5).alias("score"))


def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(spark, sf_dir).rows().groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))


def dense_knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, vectors, asked = _inputs(spark, sf_dir)
    return ranked(dense_scores(vectors, asked, 10), 10).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def dense_knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, deleted, _, vectors, asked = _inputs(spark, sf_dir)
    allowed = live(vectors, deleted).join(docs.where("lang = 'en'").select("doc_id"), "doc_id", "left_semi")
    return ranked(dense_scores(allowed, asked, 10), 10).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rerank stage with a deterministic scorer: the share of a question's distinct terms that a hit holds; the recall score stays beside it."""
    _, _, queries, _, _ = _inputs(spark, sf_dir)
    hits = document_index(spark, sf_dir).search(queries, 50).select("query_id", "doc_id", F.col("rank").alias("recall_rank"), "matched")
    terms = query_terms(queries).groupBy("query_id").agg(F.count("*").alias("terms"))
    scored = hits.join(terms, "query_id").withColumn("score", F.col("matched") / F.col("terms"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "recall_rank")
    return scored.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).where("rank < 10").select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def score_filter_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score filter, then the cap of three hits a document (here: a source), then the first ten."""
    docs, _, queries, _, _ = _inputs(spark, sf_dir)
    hits = F.broadcast(document_index(spark, sf_dir).search(queries, 50).where("round(score, 9) >= 1.0")).join(docs.select("doc_id", "source"), "doc_id")
    capped = per_document_cap(hits.withColumn("score", F.round("score", 9)), 3, "source")
    return ranked(capped.drop("rank"), 10).select("query_id", "doc_id", "source", "rank")


def multi_collection_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each collection (source) recalls its own ten; the union is cut to ten again."""
    _, _, queries, _, _ = _inputs(spark, sf_dir)
    index = document_index(spark, sf_dir)
    asked, _ = index.of_terms(queries)
    scores = index.scores(settle(asked, "bm25-asked"))
    order = W.partitionBy("query_id", "collection").orderBy(F.desc(F.round("score", 9)), "doc_id")
    own = scores.withColumn("n", F.row_number().over(order)).where("n <= 10").drop("n")
    return ranked(own, 10).select("query_id", "doc_id", "collection", "rank")


def render_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered blocks of a question's hits, bodies cut at 1800 characters."""
    docs, _, queries, _, _ = _inputs(spark, sf_dir)
    hits = F.broadcast(document_index(spark, sf_dir).search(queries, 5)).join(docs.select("doc_id", "source", F.col("text").alias("body")), "doc_id")
    block = F.concat(F.lit("["), F.col("rank") + 1, F.lit("] "), F.coalesce("source", F.lit("")), F.lit("\n"), F.substring("body", 1, 1800))
    return hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("b")).select("query_id", F.md5(F.array_join("b.b", "\n\n").cast("binary")).alias("context_md5"))


_TOK = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: true)"
_BM25 = f"""
tok AS (SELECT doc_id, {_TOK} AS t FROM corpus), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY 1, 2),
qt AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({_TOK}) AS term FROM benchmark)),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
bm AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM post JOIN dfs USING (term) JOIN qt USING (term), st GROUP BY 1, 2)"""
_DENSE = """
nv AS (SELECT doc_id, e, sqrt(list_dot_product(e, e)) AS norm FROM (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL)),
qv AS (SELECT item_id AS query_id, e AS qe, norm AS qn FROM benchmark JOIN nv ON doc_id = item_id)"""


def _rank(src: str, k: int, extra: str = "", part: str = "query_id") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM {src} {extra}) WHERE rank < {k})"


_LIVE = "doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)"
QUERIES = {
    "recall_hybrid": (recall_hybrid, f"""WITH corpus AS (SELECT doc_id, text FROM documents WHERE {_LIVE}), {_BM25}, {_DENSE},
        dn AS (SELECT query_id, doc_id, list_dot_product(e, qe) / (norm * qn) AS score FROM nv, qv WHERE {_LIVE}),
        legs AS (SELECT query_id, doc_id, rank FROM {_rank("bm", 20)} UNION ALL SELECT query_id, doc_id, rank FROM {_rank("dn", 20)}),
        fused AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (2 + rank)) AS score FROM legs GROUP BY 1, 2)
        SELECT query_id, doc_id, rank, round(score, 6) AS score FROM {_rank("fused", 10)}"""),
    "bm25_topk": (bm25_topk, f"WITH corpus AS (SELECT doc_id, text FROM documents), {_BM25} SELECT query_id, doc_id, rank, round(score, 5) AS score FROM {_rank('bm', 10)}"),
    "bm25_term_stats": (bm25_term_stats, f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1"),
    "dense_knn_topk": (dense_knn_topk, f"WITH {_DENSE}, dn AS (SELECT query_id, doc_id, list_dot_product(e, qe) / (norm * qn) AS score FROM nv, qv) SELECT query_id, doc_id, rank, round(score, 6) AS score FROM {_rank('dn', 10)}"),
    "dense_knn_filtered": (dense_knn_filtered, f"WITH {_DENSE}, dn AS (SELECT query_id, doc_id, list_dot_product(e, qe) / (norm * qn) AS score FROM nv, qv WHERE {_LIVE} AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')) SELECT query_id, doc_id, rank, round(score, 6) AS score FROM {_rank('dn', 10)}"),
    "rerank_overlap": (rerank_overlap, f"""WITH corpus AS (SELECT doc_id, text FROM documents), {_BM25}, h AS (SELECT query_id, doc_id, rank AS rr FROM {_rank("bm", 50)}),
        nq AS (SELECT query_id, count(*) AS n FROM qt GROUP BY 1), s AS (SELECT h.query_id, h.doc_id, rr, count(p.term) AS k FROM h JOIN qt USING (query_id) LEFT JOIN post p ON p.doc_id = h.doc_id AND p.term = qt.term GROUP BY 1, 2, 3),
        o AS (SELECT query_id, doc_id, k / n::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY k / n::DOUBLE DESC, rr) - 1 AS rank FROM s JOIN nq USING (query_id))
        SELECT query_id, doc_id, rank, round(score, 6) AS score FROM o WHERE rank < 10"""),
    "score_filter_cap": (score_filter_cap, f"""WITH corpus AS (SELECT doc_id, text FROM documents), {_BM25}, h AS (SELECT query_id, doc_id, source, round(score, 9) AS score FROM {_rank("bm", 50)} JOIN documents USING (doc_id) WHERE round(score, 9) >= 1.0),
        c AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS n FROM h) WHERE n <= 3)
        SELECT query_id, doc_id, source, rank FROM {_rank("c", 10)}"""),
    "multi_collection_merge": (multi_collection_merge, f"""WITH corpus AS (SELECT doc_id, text FROM documents), {_BM25}, s AS (SELECT bm.*, source AS collection FROM bm JOIN documents USING (doc_id)),
        o AS (SELECT * EXCLUDE (rank) FROM {_rank("s", 10, part="query_id, collection")}) SELECT query_id, doc_id, collection, rank FROM {_rank("o", 10)}"""),
    "render_context": (render_context, f"""WITH corpus AS (SELECT doc_id, text FROM documents), {_BM25}, h AS (SELECT query_id, rank, source, text FROM {_rank("bm", 5)} JOIN documents USING (doc_id))
        SELECT query_id, md5(string_agg('[' || (rank + 1) || '] ' || coalesce(source, '') || chr(10) || substr(text, 1, 1800), chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM h GROUP BY 1"""),
}
