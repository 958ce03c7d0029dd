import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from skeinmill.functions import toc
from skeinmill.operators import answers, business, cleaning, ingest, neardup, retrieval, sessions
from skeinmill.operators.graph import connected_components


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, j) for j in range(101, 160)] + [(200, 200), (None, 3), (40, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {j: 100 for j in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_sliding_limit_counts_accepted_calls_only(spark):
    calls = spark.createDataFrame([(i, 1, float(t)) for i, t in enumerate([0, 1, 2, 3, 59, 60, 61, 61.5])] + [(50, 2, 0.0)], "event_id long, user_id long, t double")
    got = {r.event_id: r.allowed for r in sessions.rate_limit_sliding(calls).collect()}
    assert [got[i] for i in range(8)] == [True, True, True, False, False, True, True, False] and got[50]


def test_session_gap_is_strict(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, 1, base + dt.timedelta(seconds=s)) for i, s in enumerate([0, 1800, 3601])]
    got = sessions.sessions(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp"), "user_id", "ts").orderBy("event_id").collect()
    assert [r.session for r in got] == [0, 0, 1]


def test_blank_message_ids_stay(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, ""), (5, None), (6, None)], "event_id long, m string")
    assert sorted(r.event_id for r in sessions.dedup_messages(rows, "m", ["event_id"]).collect()) == [1, 3, 4, 5, 6]


def test_streaming_counts_equal_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, base + dt.timedelta(seconds=7 * i)) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = sessions.streaming_counts(stream).writeStream.outputMode("complete").format("memory").queryName("calls").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(repr, spark.sql("SELECT * FROM calls").collect())) == sorted(map(repr, sessions.streaming_counts(df).collect()))


def test_budget_keeps_the_newest(spark):
    turns = spark.createDataFrame([("a", i, 30) for i in range(20)] + [("b", 0, 500)], "k string, turn int, tokens int")
    got = sessions.budget_suffix(turns, "k", "turn", "tokens", 100).collect()
    assert sorted((r.k, r.turn) for r in got) == [("a", 17), ("a", 18), ("a", 19), ("b", 0)]


def test_point_ids_are_uuid5(spark):
    names = ["doc_0", "文档_1", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(ingest.point_id(F.col("n")).alias("id")).collect()
    space = uuid.UUID(ingest.NAMESPACE)
    assert [r.id for r in got] == [str(uuid.uuid5(space, n)) for n in names]


def test_chunkers():
    assert ingest.paragraph_chunks("a\n\nb\n\n" + "c" * 600, 512) == ["a\n\nb", "c" * 600]
    assert all(len(c) <= 50 for c in ingest.recursive_chunks("word. " * 100 + "x" * 200, 50, 10))
    assert [x[:3] for x in ingest.heading_sections("# A\nx\n## B\ny\n# C")] == [(1, "A", "A"), (2, "B", "A > B"), (1, "C", "C")]
    assert ingest.markdown_chunks("# A\nbody\n## B\n") == ["A\nbody"]
    with pytest.raises(ValueError):
        ingest.chunk_documents(None, "none")


def test_document_types(spark):
    rows = [("## Slide 1\n\n---\n\n## Slide 2", "", "ppt"), ("| a | b |\n|---|---|\n| 1 | 2 |", "", "excel"), ("SOP-IN-001 SOP-OUT-002", "", "sop_report"), ("一、x\n二、y", "", "structured_biz"), ("x", "pptx", "ppt"), ("x", "", "general")]
    got = spark.createDataFrame(rows, "t string, e string, want string").select(ingest.document_type(F.col("t"), F.col("e")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_similar_links_connect_like_brute_force(spark):
    draws = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base), None, "", "one"]
    for _ in range(120):
        words = list(base) if draws.random() < 0.7 else [f"v{draws.randrange(40)}" for _ in range(40)]
        for _ in range(draws.randrange(14)):
            words[draws.randrange(len(words))] = f"x{draws.randrange(1000)}"
        texts.append(" ".join(words))
    rows = [(i + 1, t) for i, t in enumerate(texts)] + [(None, texts[0])]
    rows += [(200, "one"), (300, " ".join(base)), (300, " ".join(f"u{i}" for i in range(40))), (301, " ".join([*(f"u{i}" for i in range(39)), "other"]))]
    by_id: dict = {}
    for i, t in rows:
        if i and (w := (t or "").split()):
            by_id.setdefault(i, []).append({*zip(w, w[1:], strict=False)} or {*w})
    near = lambda i, j: any(len(a & b) >= 0.6 * len(a | b) for a in by_id[i] for b in by_id[j])
    beside = {i: [j for j in by_id if near(i, j)] for i in by_id}
    want = {i: i for i in by_id}
    for _ in range(12):
        want = {i: min(want[j] for j in beside[i]) for i in by_id}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = neardup.similar_links(docs).collect()
    assert all(near(r.a, r.b) for r in links)
    got = {r.node: r.component for r in connected_components(neardup.similar_links(docs), "a", "b").collect()}
    assert {i: got.get(i, i) for i in by_id} == want and want[301] == want[300] == 1 and want[200] == want[5]
    assert neardup.similar_links(docs.limit(0)).count() == 0


def test_crowded_buckets_lose_no_link(spark):
    """One bucket whose centre resembles nobody: the pairs in it are found block against block."""
    rows = [(0, [1, 2, 3])] + [(i, [i // 2 * 10, i // 2 * 10 + 1, 5]) for i in range(2, 202)]
    feats = spark.createDataFrame(rows, "doc_id long, f array<long>").withColumn("d1", F.xxhash64("f"))
    apart = feats.select(F.lit(0).alias("band"), F.lit(7).cast("long").alias("key"), "doc_id", "d1", F.col("doc_id").alias("component"), F.lit(201).cast("long").alias("members"))
    got = {(r.a, r.b) for r in neardup._block_links(apart, feats, 0.6).collect()}
    assert got == {(i + 1, i) for i in range(2, 202, 2)}


def test_toc_blocks(spark):
    df = spark.createDataFrame(answers.TOC_DOCS + [("null", None)], "doc_id string, text string")
    got = {r.doc_id: (r.c.text, r.c.toc) if r.c else (None, None) for r in df.select("doc_id", toc.remove_toc(F.col("text")).alias("c")).collect()}
    assert got["list"] == ("# T\n<!-- page: 2 -->\nbody\n- x", ["## Contents", "- a", "- b", "1. c"])
    assert got["short"][0] == "## 目录\n- a\n- b\nbody" and got["twice"][0] == "# Agenda"
    assert got["dots"] == ("intro\n\n\nFour .... 4\nend", ["One .... 1", "Two ..... 2", "Three ……… 13"])
    assert got["two"][1] == [] and got["bar"][1] == [] and got["empty"] == ("", []) and got["null"][0] is None


def test_payload_upsert_and_deletion(spark):
    chunks = spark.createDataFrame([("d", 0, "a", ["A", "", "B"]), ("d", 1, None, None), ("e", 0, "c", [])], "doc_uuid string, chunk_index int, text string, breadcrumb array<string>")
    points = answers.payload(chunks)
    got = {(r.doc_uuid, r.chunk_index): r for r in points.collect()}
    assert got["d", 0].breadcrumb == "A > B" and got["d", 0].title == "B" and got["d", 1].content == "" and got["e", 0].title == ""
    assert got["d", 0].id == str(uuid.uuid5(uuid.UUID(ingest.NAMESPACE), "d_0"))
    fresh = answers.upsert(points, answers.payload(spark.createDataFrame([("d", 0, "new", []), ("f", 0, "f", [])], chunks.schema)))
    assert {(r.doc_uuid, r.chunk_index): r.content for r in fresh.collect()} == {("d", 0): "new", ("d", 1): "", ("e", 0): "c", ("f", 0): "f"}
    doomed = spark.createDataFrame([("d",), ("d",)], "doc_uuid string")
    assert [r.doc_uuid for r in answers.soft_delete(fresh, doomed).where("is_deleted").collect()] == ["d", "d"]
    assert answers.hard_delete(fresh, doomed).count() == 2


def test_throttle_and_stage(spark):
    rows = [(1, i, float(t), n, f) for i, (t, n, f) in enumerate([(0, 1, False), (1, 5, False), (2, 50, False), (2.5, 99, False), (2.6, 99, True), (9, 100, False)])] + [(2, 0, 0.0, 0, False)]
    got = answers.throttle(spark.createDataFrame(rows, "stream long, seq long, t double, chars long, force boolean"), 20, 1.0).orderBy("stream", "seq").collect()
    assert [r.flush for r in got] == [True, False, True, False, True, False, True]
    case = spark.createDataFrame([(False, 0, None, ""), (True, 0, None, "x"), (True, 2, 0.5, " "), (True, 2, 0.7, " "), (True, 2, 0.5, "x"), (True, 1, 0.1, "[NO_ANSWER]")], "s boolean, n int, t double, a string")
    assert [r[0] for r in case.select(answers.answer_stage(F.col("s"), F.col("n"), F.col("t"), F.col("a"))).collect()] == ["direct", "refuse", "refuse", "answer", "answer", "refuse"]


def test_clean_pipeline_order(spark):
    text = "Title\n\n第 3 页\n---\nparagraph that is long enough\n\nparagraph that is long enough\n\n##\n\nThanks!\n\nCopyright 2020"
    got = cleaning.clean_markdown(spark.createDataFrame([("d", text)], "doc_id string, text string")).collect()[0]
    assert got.text == "Title\n\nparagraph that is long enough"
    assert (got.removed_page_number, got.removed_closing, got.removed_decoration, got.removed_empty_block, got.removed_short_noise) == (1, 1, 1, 1, None)


def test_visible_text_and_unescape(spark):
    page = "<title>T &amp; U</title><script>x()</script><p>a<b>b</b></p><style>s</style>c"
    got = ingest.extract_pages(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert (got[0].title, got[0].text) == ("T & U", "a\nb\nc") and got[1].text == ""
    one = spark.createDataFrame([("&amp;amp;lt;", "é")], "a string, b string").select(ingest.unescape("a").alias("a")).collect()[0]
    assert one.a == "<" and cleaning.composed("e\u0301") == "\u00e9"


def test_templates_are_guarded(spark):
    assert business.is_select_template("SELECT 1;") and not business.is_select_template("DROP TABLE x") and not business.is_select_template("SELECT 1; SELECT 2")
    with pytest.raises(ValueError):
        business.run_template(spark, "DELETE FROM x", {})


def test_fusion_ranks_from_zero(spark):
    leg = lambda ids: spark.createDataFrame([(1, d, r) for r, d in enumerate(ids)], "query_id long, doc_id long, rank long")
    got = {r.doc_id: r.score for r in retrieval.fuse([leg([5, 6]), leg([6, 7])]).collect()}
    assert got == {5: 1 / 2, 6: 1 / 3 + 1 / 2, 7: 1 / 3}
