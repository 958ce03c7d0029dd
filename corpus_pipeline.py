"""From raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.llm.language_id import UNKNOWN, ByteGru, fit_language_model, held_out, predict_language
from skeinmill.llm.minhash import minhash_near_duplicates
from skeinmill.llm.mixing import mix_sources
from skeinmill.llm.packing import default_tokenizer, pack_documents
from skeinmill.llm.secret_scan import redact_live
from skeinmill.runtime import keep_text_batches, settle, text_batches

#: Fewer rightly named held-out texts set no threshold.
LEAST_CALIBRATION = 100

#: Rests that may come before one that waits for its window; the fewer, the closer the order and the more are cut.
LONGEST_WAIT = 512


def least_language_score(docs: DataFrame, model: ByteGru) -> float:
    """Half way from chance (one by the number of languages) to the score that 99 % of all held-out texts of a rightly
    predicted language reach; chance alone, which every text reaches, where too few of those are at hand."""
    chance = 1 / len(model.languages)
    own = docs.where(held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    judged = predict_language(own.select("text", "lang"), model).where("lang_pred = row.lang")
    found = judged.agg(F.count("*").alias("n"), F.percentile_approx("score", 0.01, 10_000).alias("low")).first()
    return (chance + found.low) / 2 if found.n >= LEAST_CALIBRATION else 0.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are ``und`` (no text, no letter) or that no language fits; the others stay unchanged.

    The model learns from documents that are not held out, or from all if those
    lack a language. Without any labelled text nothing can be judged, so all
    documents with a letter stay.
    """
    keep_text_batches(spark)  # the result is worked out when it is written
    named = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    languages = named.groupBy("lang").agg(F.min(held_out(F.col("doc_id"))).alias("only_held_out")).collect()  # a row a language
    if not languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    whole = any(r.only_held_out for r in languages)
    model = fit_language_model(docs if whole else docs.where(~held_out(F.col("doc_id"))))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    least = 0.0 if whole else least_language_score(docs, model)
    judged = predict_language(docs, model)
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five words, 0.8) stays, that with the smallest id.

    Of rows with equal ids and texts the one whose other columns are smallest as
    JSON stays. Rows without an id cannot be told apart from their copies and
    stay.
    """
    with text_batches(spark):
        kept = minhash_near_duplicates(docs, width=5, percent=80).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*rest)) if rest else F.lit("")  # columns of any type have one
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), order.alias("order"))
    named = row.where("id IS NOT NULL").join(kept, F.col("id") == F.col("kept_id"), "left_semi")
    first = named.groupBy("id", "h").agg(F.min_by("row", "order").alias("row")).select("row.*")
    return first.unionByName(row.where("id IS NULL").select("row.*"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces live-looking secrets in the texts; widely copied examples and all documents stay."""
    repository = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    clean = redact_live(docs, F.col("source"), repository)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def in_slot_order(docs: DataFrame) -> DataFrame:
    """All documents, range-partitioned by slot and sorted: partition after partition they are the mixture."""
    return mix_sources(docs).repartitionByRange("slot", "start").sortWithinPartitions("slot", "start").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts all documents in the order of the mixture, so the table's files follow the target weights one after another."""
    return in_slot_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into windows of 1024, 512 and 256 tokens, whose ``sequence_id`` follows the mixture.

    A reader deals files out by size, not by name, and slots are no column of
    the table, so the slots, which depend only on what the table holds, are
    worked out again. No rest waits for more than ``LONGEST_WAIT`` others.
    """
    with text_batches(spark):
        return pack_documents(in_slot_order(docs), default_tokenizer(), max_wait=LONGEST_WAIT)


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing_sources", mix),
    ("packing", pack),
]

#: The first stage's trained model and the last stage's tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
