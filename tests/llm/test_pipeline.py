from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from skeinmill.llm import mixing, registry


def test_stages_keep_columns_and_clean_documents(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    left = docs.collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == [1, 7, 8, 10, 10]
    assert sum(r.doc_id is None for r in left) == 1
    assert not any("hunter2hunter" in r.text for r in left)
    assert all(r.n_chars == len(r.text) for r in left)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in left}


def test_stages_of_an_empty_table(spark, no_docs):
    docs = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_names():
    assert sorted(registry.queries()) == sorted([*registry._MODULES, "pipeline"])
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_packed_sequences_follow_the_slots_of_a_table_of_many_files(spark, tmp_path):
    rows = [(i, f"word{i} " * (5 if i % 4 else 300), "aa", f"s{i % 4}", 0) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    corpus_pipeline.mix(spark, docs, "").repartition(13).write.parquet(f"{tmp_path}/mixed")
    table = spark.read.parquet(f"{tmp_path}/mixed")
    order = [r.doc_id for r in mixing.mix_sources(table).orderBy("slot", "start").select("row.doc_id").collect()]
    rank = {doc: i for i, doc in enumerate(order)}
    packed = corpus_pipeline.pack(spark, table, "").select("doc_id", "start", "length", "doc_tokens", "sequence_id").collect()
    tokens = {r.doc_id: r.doc_tokens for r in packed}
    assert len(tokens) == 4000 and sum(r.length for r in packed) == sum(tokens.values())
    highest = 0
    for r in sorted(packed, key=lambda r: r.sequence_id):
        assert rank[r.doc_id] > highest - 2 * corpus_pipeline.LONGEST_WAIT
        highest = max(highest, rank[r.doc_id])


def test_language_threshold_follows_held_out_scores(spark):
    rng = np.random.default_rng(3)
    letters = {"aa": "abcde", "bb": "vwxyz"}
    rows = [(i, " ".join("".join(rng.choice(list(letters[k]), 5)) for _ in range(30)), k, "s", 0) for i, k in enumerate(["aa", "bb"] * 500)]
    rows += [(5000 + i, "av wb xc dy ez " * 20, None, "s", 0) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = corpus_pipeline.fit_language_model(docs)
    assert 0.5 < corpus_pipeline.least_language_score(docs, model) < 1  # two languages: no best score is below 0.5
    assert corpus_pipeline.identify_language(spark, docs, "").where("lang IS NOT NULL").count() == 1000


def test_documents_stay_without_a_labelled_text(spark):
    rows = [(1, "one two", None, "s", 7), (2, "\u00e9", None, "s", 1), (3, "12 !", None, "s", 4), (4, None, None, "s", 0), (5, None, "aa", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == [1, 2]


def test_stages_bear_columns_of_odd_names_and_types(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, `my col:x` string, facts map<string,int>, `a.b` array<struct<x:int>>, row string, slot long"
    rows = [(i, f"some plain words of number {'abcdefgh'[i % 8]} " * 9, "aa", "s", 0, "v", {"k": i}, [(i,)], "r", 1) for i in range(6)]
    rows += [(0, rows[0][1], "aa", "s", 0, "v", {"k": 0}, [(0,)], "r", 1), (None, "another text without an id", None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, ""), "t")
        assert docs.columns == columns, name
    assert docs.count() > 0 and docs.where("facts IS NOT NULL").count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0


def test_language_threshold_is_set_by_all_held_out_texts(spark, monkeypatch):
    docs = spark.range(9000).selectExpr("id AS doc_id", "'aa' AS lang", "cast(id AS string) AS text")
    judged = []

    def predict(docs, model):
        judged.append(docs.count())
        return docs.select(F.struct("text", "lang").alias("row"), F.lit("aa").alias("lang_pred"), (F.col("text").cast("double") / 9000).alias("score"))

    monkeypatch.setattr(corpus_pipeline, "predict_language", predict)
    least = corpus_pipeline.least_language_score(docs, SimpleNamespace(languages=["aa", "bb"]))
    held = sorted(r.doc_id for r in docs.where(corpus_pipeline.held_out(F.col("doc_id"))).collect())
    assert judged == [len(held)]
    assert abs(least - (0.5 + held[len(held) // 100 - 1] / 9000) / 2) < 1e-3
