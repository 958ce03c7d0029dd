"""Quality classifier that combines a document's own evidence with its site's record.

A logistic model over hashed words, hashed byte pairs and text statistics gives
each document a log odds. Labelled outcomes are counted by host and by path; a
path's good rate is shrunk to its host's posterior and that to the global rate
(beta-binomial, strengths by moments), so a sparse site says little. The site's
shift of log odds against the global rate is added to the document's. A labelled
document's own label is taken out of its site's counts before they judge it.

Features are worked out twice, for the bounded training sample and when texts are
scored, and are never stored for the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.llm.shingles import text_runs, word_hashes
from skeinmill.llm.url_reputation import _strength
from skeinmill.runtime import bounded_sample, settle, table, text_batches

STATISTICS = ("log_bytes", "letters", "upper", "digits", "marks", "bars", "newlines", "spaces", "word_length", "distinct_words", "repeats", "top_word", "distinct_sqrt")
WORD_BITS, PAIR_BITS = 8, 7
FEATURES = len(STATISTICS) + (1 << WORD_BITS) + (1 << PAIR_BITS)
#: A table of sites of at most so many bytes goes whole to every task; a larger one is joined by salted keys.
SITE_BYTES, SALTS = 32 << 20, 16
_CLASS = np.zeros((256, 6), dtype=np.float32)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (_b >= 128 or ("A" <= _c <= "Z") or ("a" <= _c <= "z"), "A" <= _c <= "Z", "0" <= _c <= "9", _c in "!#$%&*^~@=<>{}[]", _c == "|", _c == "\n")


def features(column: pa.Array) -> np.ndarray:
    """(rows, FEATURES) of a string column; zero for texts without words."""
    out = np.zeros((len(column), FEATURES))
    n_stat, n_words, n_pairs = len(STATISTICS), 1 << WORD_BITS, 1 << PAIR_BITS
    for first, end, data, offsets in text_runs(column):
        words, counts = word_hashes(data, offsets)
        rows, at = end - first, np.concatenate([[0], np.cumsum(counts)])
        slot = np.repeat(np.arange(rows), counts) * n_words + (words >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        hashed = np.bincount(slot, minlength=rows * n_words).reshape(rows, n_words)
        sizes = np.diff(offsets)
        low = data.astype(np.uint32)
        pair = ((low[:-1] * np.uint32(0x9E3779B1) + low[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - PAIR_BITS)).astype(np.int64)
        owner = np.repeat(np.arange(rows), sizes)
        within = owner[:-1] == owner[1:]
        pairs = np.bincount(owner[:-1][within] * n_pairs + pair[within], minlength=rows * n_pairs).reshape(rows, n_pairs)
        for r in range(rows):
            n, k = int(sizes[r]), int(counts[r])
            if not k:
                continue
            kinds = np.bincount(data[offsets[r] : offsets[r + 1]], minlength=256) @ _CLASS / n
            own = words[at[r] : at[r + 1]]
            per_word = np.unique(own, return_counts=True)[1]
            out[first + r, :n_stat] = (
                np.log(n), kinds[0], kinds[1] / max(kinds[0], 1e-9), kinds[2], kinds[3], kinds[4], kinds[5], (k - 1) / n, min(n / k, 50.0),
                len(per_word) / k, float((own[1:] == own[:-1]).mean()) if k > 1 else 0.0, per_word.max() / k, len(per_word) / np.sqrt(k),
            )
            out[first + r, n_stat : n_stat + n_words] = np.sqrt(hashed[r] / k)
            out[first + r, n_stat + n_words :] = np.sqrt(pairs[r] / n)
    return out


def _featurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = pa.array([r.tobytes() for r in features(batch.column(0)).astype(np.float32)], pa.binary())
        yield pa.RecordBatch.from_arrays([packed, batch.column(1)], names=["f", "good"])


def _scorer(weights: np.ndarray, bias: float):
    """Rows (text, ...) as (..., log_odds)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = features(batch.column(0)) @ weights + bias
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(odds, pa.float64())], names=[*batch.schema.names[1:], "log_odds"])

    return score


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 20.0, rounds: int = 15) -> tuple[np.ndarray, float]:
    """Weights and bias (on raw features) of a ridge logistic regression on standardised features."""
    if not len(x) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(x.shape[1] if x.ndim == 2 else FEATURES), float(np.log(rate / (1 - rate)))
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd < 1e-9] = 1
    z = np.c_[(x - mean) / sd, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / sd, float(w[-1] - (w[:-1] * mean / sd).sum())


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def site_posteriors(labelled: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """Counts and prior strengths from rows (host, path, good): paths (host, path, n_p, k_p), hosts (host, n_h, k_h),
    and n, k (of all rows), s_h, s_p."""
    paths = settle(labelled.groupBy("host", "path").agg(F.count("*").alias("n_p"), F.sum("good").alias("k_p")), "quality-paths")
    hosts = settle(paths.groupBy("host").agg(F.sum("n_p").alias("n_h"), F.sum("k_p").alias("k_h")), "quality-hosts")
    total = hosts.agg(F.coalesce(F.sum("n_h"), F.lit(0)).alias("n"), F.coalesce(F.sum("k_h"), F.lit(0)).alias("k")).collect()[0]
    strengths = {"s_h": _strength(hosts, "n_h", "k_h", 1.0, 1000.0), "s_p": _strength(paths, "n_p", "k_p", 1.0, 1000.0)}
    return paths, hosts, {"n": total["n"], "k": total["k"]} | strengths


def _with_sites(rows: DataFrame, sites: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` left joined with ``sites``: a small table is broadcast, a large one copied to the salts of its keys, so
    that no host or path gathers its documents in one task."""
    size = sites.agg(F.coalesce(F.sum(F.octet_length(F.concat(*keys)) + 32), F.lit(0)).alias("n")).collect()[0]["n"]
    if size <= SITE_BYTES:
        return rows.join(F.broadcast(sites), keys, "left")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "log_odds"), F.lit(SALTS)))
    copies = sites.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*keys, "salt"], "left").drop("salt")


def classify_quality(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, site_weight: float = 1.0, sample_rows: int = 20_000
) -> DataFrame:
    """One row per row of ``docs``: doc_id, host, path, doc_score, host_rate, path_rate, quality, kept.

    ``labels`` has ``id_col`` and good (0 or 1; nulls are no label; of repeated
    labels the worst counts). The logistic model is fitted on the ``sample_rows``
    labelled texts with the smallest id hashes; site counts cover all labels. The
    rates of a labelled row leave its own label out, in the global rate too; an id
    counts once on a path however many rows it has there.
    Null and empty texts have features of zero. A null host or path is one of
    its own. Without labels every score is one half. Null and repeated ids get a
    row each; a row without an id has no label. An empty table gives an empty
    result.
    """
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    own = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("doc_id"), name(host).alias("host"), name(path).alias("path"))
    good = labels.select(F.col(id_col).alias("doc_id"), F.col("good").cast("long").alias("good")).where("doc_id IS NOT NULL AND good IS NOT NULL").groupBy("doc_id").agg(F.min("good").alias("good"))
    labelled = own.select("doc_id", "host", "path", F.xxhash64("text").alias("t")).join(good, "doc_id")
    labelled = settle(labelled, "quality-labelled")
    texts = labelled.select("doc_id", "t", "good").distinct()
    sample = bounded_sample(texts, "doc_id", sample_rows, texts.count())
    named = own.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("t"), "text").join(F.broadcast(sample), ["doc_id", "t"])  # sample_rows rows of three numbers
    seen = named.groupBy("doc_id", "t").agg(F.max("good").alias("good"), F.max("text").alias("text")).select("text", "good").mapInArrow(_featurer, "f binary, good long").toArrow()
    x = np.frombuffer(b"".join(seen.column("f").to_pylist()), np.float32).reshape(-1, FEATURES).astype(float)
    weights, bias = fit_logistic(x, np.asarray(seen.column("good"), dtype=float))

    paths, hosts, at = site_posteriors(labelled.select("doc_id", "host", "path", "good").distinct())
    id_type = own.schema["doc_id"].dataType.simpleString()
    rows = own.mapInArrow(_scorer(weights, bias), f"doc_id {id_type}, host string, path string, log_odds double")
    rows = settle(rows, "quality-scores")
    # rows without an id match no label: they are dealt out by their scores
    deal = lambda c: F.when(F.col("doc_id").isNull(), c).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("deal", deal(F.xxhash64("log_odds", "host", "path"))).join(good.withColumn("deal", F.lit(0).cast("long")), ["doc_id", "deal"], "left").drop("deal")
    rows = _with_sites(_with_sites(rows, hosts, ["host"]), paths, ["host", "path"])
    one, y = F.col("good").isNotNull().cast("long"), F.coalesce("good", F.lit(0))
    zero = F.lit(0)
    n_h, k_h, n_p, k_p = (F.coalesce(c, zero) for c in ("n_h", "k_h", "n_p", "k_p"))
    rate = (at["k"] - y + 1) / (at["n"] - one + 2)
    host_rate = (k_h - y + at["s_h"] * F.col("rate")) / (n_h - one + at["s_h"])
    path_rate = (k_p - y + at["s_p"] * F.col("host_rate")) / (n_p - one + at["s_p"])
    rows = rows.withColumn("rate", rate).withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    whole = F.col("log_odds") + site_weight * (_logit(F.col("path_rate")) - _logit(F.col("rate")))
    sigmoid = lambda c: 1 / (1 + F.exp(-c))
    return rows.select(
        "doc_id", F.expr("nullif(substr(host, 2), '')").alias("host"), F.expr("nullif(substr(path, 2), '')").alias("path"),
        sigmoid(F.col("log_odds")).alias("doc_score"), "host_rate", "path_rate",
        sigmoid(whole).alias("quality"), (sigmoid(whole) >= threshold).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources; a path is a source's documents in one language."""
    with text_batches(spark):
        path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
        labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))
        return classify_quality(table(spark, sf_dir, "documents"), labels, F.col("source"), path)


ORACLE = None
