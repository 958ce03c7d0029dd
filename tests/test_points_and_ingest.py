"""The point table at each of its versions, and ingest that fails between stages."""

import pytest
from pyspark.sql import functions as F

from skeinmill.sources.points import PointTable
from skeinmill.streaming import ingest
from skeinmill.streaming.runs import arrive, arrived, fresh_folder

SCHEMA = "collection string, id string, doc_uuid string, content string, is_deleted boolean"


def points(spark, *rows):
    return spark.createDataFrame([(c, f"{d}{i}", d, text, False) for c, d, i, text in rows], SCHEMA)


def marks(spark, *rows):
    return spark.createDataFrame(list(rows), "collection string, doc_uuid string, hard boolean")


def seen(df):
    return sorted((r.collection, r.id, r.content, r.is_deleted) for r in df.collect())


@pytest.fixture
def filled(spark):
    t = PointTable(spark, fresh_folder(spark, "points"), spark.createDataFrame([], SCHEMA).schema)
    t.commit(1, points(spark, ("x", "a", 0, "a0"), ("x", "a", 1, "a1"), ("x", "b", 0, "b0"), ("y", "c", 0, "c0"), ("y", "c", 0, "c9")))
    t.commit(2, points(spark, ("x", "a", 0, "new")), marks(spark, ("x", "b", False)))
    t.commit(3, points(spark, ("x", "b", 0, "back")), marks(spark, ("y", "c", True)))
    t.commit(4, points(spark, ("x", "a", 0, "only")), marks(spark, ("x", "a", True)))
    return t


STATES = {
    1: [("x", "a0", "a0", False), ("x", "a1", "a1", False), ("x", "b0", "b0", False), ("y", "c0", "c9", False)],
    2: [("x", "a0", "new", False), ("x", "a1", "a1", False), ("x", "b0", "b0", True), ("y", "c0", "c9", False)],
    3: [("x", "a0", "new", False), ("x", "a1", "a1", False), ("x", "b0", "back", False)],
    4: [("x", "a0", "only", False), ("x", "b0", "back", False)],
}


def test_versions_compaction_and_repeats(spark, filled):
    t = filled
    assert {v: seen(t.read(v)) for v in t.versions()} == STATES
    t.commit(4, points(spark, ("x", "z", 0, "ignored")))  # committed already
    assert seen(t.read()) == STATES[4]
    t.compact()
    assert t.versions() == [4] and seen(t.read()) == STATES[4]
    assert seen(t.read(collections=["y"])) == []  # all of it is gone from the base too
    t.compact()
    t.commit(3, points(spark, ("x", "z", 0, "late")))  # compacted already
    t.commit(5, marks=marks(spark, ("x", "b", False)))
    assert seen(t.read(4)) == STATES[4] and seen(t.read()) == [("x", "a0", "only", False), ("x", "b0", "back", True)]
    t.compact()
    assert seen(t.read()) == [("x", "a0", "only", False), ("x", "b0", "back", True)]
    with pytest.raises(ValueError, match="compacted"):
        t.read(4)


def test_half_done_work_is_not_seen_and_is_redone(spark, filled, monkeypatch):
    t = filled
    touch = t._touch
    monkeypatch.setattr(t, "_touch", lambda name: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        t.commit(5, points(spark, ("x", "half", 0, "half")))
    with pytest.raises(RuntimeError):
        t.compact()  # the base is written, the versions are still there
    monkeypatch.setattr(t, "_touch", touch)
    assert {v: seen(t.read(v)) for v in (1, 4)} != {} and seen(t.read()) == STATES[4]
    t.commit(5, points(spark, ("x", "whole", 0, "whole")))
    assert ("x", "whole0", "whole", False) in seen(t.read()) and all(r[1] != "half0" for r in seen(t.read()))
    t.compact()
    assert len(seen(t.read())) == 3


def test_reads_prune_partitions(spark, filled):
    filled.compact()
    filled.commit(5, points(spark, ("y", "n", 0, "n")))
    plan = filled.read(5, ["y"])._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "content#" in line]
    assert scans and all("PartitionFilters: [" in line and "collection" in line.split("PartitionFilters:")[1].split("PushedFilters")[0] for line in scans)


def test_empty_table(spark):
    t = PointTable(spark, fresh_folder(spark, "points"), spark.createDataFrame([], SCHEMA).schema)
    assert t.read().count() == 0 and t.versions() == []
    t.compact()
    t.commit(1, points(spark).limit(0), marks(spark, ("x", "nobody", True)))
    t.compact()
    assert t.read().count() == 0


def sources(spark, *rows):
    return spark.createDataFrame([(k, "c", e, len(t or ""), t) for k, e, t in rows], ingest.SOURCE)


def state(job):
    found = sorted((r.key, r.stage) for r in job.records().collect())
    return found, sorted((r.doc_uuid, r.chunk_index, r.content) for r in job.points.read().collect())


FIRST = (("a", "1", "one\ntwo"), ("b", '"2"', "b"), ("n", "9", None), ("a", "1", "one\ntwo"), (None, "5", "x"))
SECOND = (("a", '"1"', "one\ntwo"), ("b", "3", "b\nc"), ("n", "9", " "), ("d", None, "dd"))
WANT = [("a", "vectorized"), ("b", "vectorized"), ("d", "vectorized"), ("n", "raw")], [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "b"), ("b", 1, "c"), ("d", 0, "dd")]


def job_of(spark, root, before=None, chunk=ingest.lines):
    schema = spark.createDataFrame([], ingest.POINT).schema
    return ingest.Ingest(spark, root, PointTable(spark, f"{root}/points", schema), ingest.trimmed, chunk, before)


@pytest.mark.parametrize("stage", ["markdown", "chunk", "vectorized", None])
def test_a_batch_that_dies_between_stages_goes_on(spark, stage):
    root, folder, checkpoint = (fresh_folder(spark, f"t-{x}") for x in ("root", "in", "checkpoint"))
    done = []

    def dies(at, batch):
        done.append((at, batch))
        if at == stage and batch == 1 and done.count((at, batch)) == 1:
            raise RuntimeError("executor lost")

    job = job_of(spark, root, dies)
    stream = lambda: arrived(spark, folder, ingest.SOURCE)
    arrive(sources(spark, *FIRST).coalesce(1), folder)
    job.run(stream(), checkpoint)
    arrive(sources(spark, *SECOND).coalesce(1), folder)
    if stage:
        with pytest.raises(Exception, match="executor lost"):
            job.run(stream(), checkpoint)
        job_of(spark, root).run(stream(), checkpoint)  # a new process
    else:
        job.run(stream(), checkpoint)
    assert state(job) == WANT
    runs = job.log().where("stage = 'markdown'").groupBy("key").count().collect()
    assert {r["key"]: r["count"] for r in runs} == {"a": 1, "b": 2, "d": 1}  # a was known, b had a new etag


def test_a_failed_stage_is_tried_again_from_there(spark):
    root, folder, checkpoint = (fresh_folder(spark, f"t-{x}") for x in ("root", "in", "checkpoint"))
    broken = lambda m: F.when(m == "bad", F.lit(None).cast("array<string>")).otherwise(ingest.lines(m))
    arrive(sources(spark, ("bad", "1", "bad"), ("good", "1", "good")).coalesce(1), folder)
    job_of(spark, root, chunk=broken).run(arrived(spark, folder, ingest.SOURCE), checkpoint)
    job = job_of(spark, root)
    assert state(job)[0] == [("bad", "markdown"), ("good", "vectorized")]
    arrive(sources(spark, ("bad", "1", None), ("good", "1", None)).coalesce(1), folder)  # not read again: the Markdown is there
    job.run(arrived(spark, folder, ingest.SOURCE), checkpoint)
    assert state(job) == ([("bad", "vectorized"), ("good", "vectorized")], [("bad", 0, "bad"), ("good", 0, "good")])


def test_finished_batches_keep_no_texts_but_failed_markdown(spark):
    root, folder, checkpoint = (fresh_folder(spark, f"t-{x}") for x in ("root", "in", "checkpoint"))
    broken = lambda m: F.when(m == "bad", F.lit(None).cast("array<string>")).otherwise(ingest.lines(m))
    job = job_of(spark, root, chunk=broken)
    arrive(sources(spark, ("bad", "1", "bad"), ("good", "1", "good")).coalesce(1), folder)
    job.run(arrived(spark, folder, ingest.SOURCE), checkpoint)
    kept = [f"{name}/batch=0" for name in ("plan", "markdown", "chunks") if job._has(f"{name}/batch=0")]
    assert kept == [] and [r.key for r in job._read("markdown-open", ingest._MARKDOWN).collect()] == ["bad"]
    before = state(job)
    job.process(sources(spark, ("bad", "1", "bad"), ("good", "1", "good")), 0)  # the stream repeats its last batch
    assert state(job) == before == ([("bad", "markdown"), ("good", "vectorized")], [("good", 0, "good")]) and job.log().count() == 4
