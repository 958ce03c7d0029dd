"""Streams against one pass over the same rows, with arrivals cut anywhere and restarts between them."""

import random

import pytest
from pyspark.sql import functions as F

from skeinmill.operators.answers import throttle
from skeinmill.operators.assistant import Memory, fold_memory
from skeinmill.operators.sessions import rate_limit_sliding
from skeinmill.streaming import limits, memory
from skeinmill.streaming.runs import arrive, arrived, fresh_folder, run_to_table


def plain(df):
    return sorted(repr(r) for r in df.collect())


@pytest.mark.parametrize("cuts", [[0], [0, 7, 8, 40], [0, 59]])
def test_sliding_limit_in_any_cut(spark, cuts):
    rng = random.Random(1)
    times = sorted(rng.choice([0.0, 0.5, 1.0, 10.0, 60.0, 61.0]) + 30 * rng.randrange(12) for _ in range(60))
    calls = spark.createDataFrame([(i, rng.randrange(3), 1_000_000 + t) for i, t in enumerate(times)], "event_id long, user_id long, t double")
    pieces = [(F.col("event_id") >= a) & (F.col("event_id") < b) for a, b in zip(cuts, [*cuts[1:], 10**6], strict=True)]
    got = limits.in_cuts(calls, pieces, lambda s: limits.stream_rate_limit(s, 3, 60))
    assert plain(got) == plain(rate_limit_sliding(calls, 3, 60))


def test_throttle_in_cuts(spark):
    rng = random.Random(2)
    rows = [(s, i, i * rng.choice([0.1, 0.5]), i * rng.randrange(1, 9), rng.random() < 0.1) for s in range(3) for i in range(20)]
    deltas = spark.createDataFrame(rows, "stream long, seq long, t double, chars long, force boolean")
    got = limits.in_cuts(deltas, [F.col("seq") < 3, F.col("seq") == 3, F.col("seq") > 3], lambda s: limits.stream_throttle(s, 10, 1.0))
    assert plain(got) == plain(throttle(deltas, 10, 1.0))


def _turns(spark):
    """Gaps of exactly the time to live and of a second more, and a turn larger than the budget."""
    gaps = {("a", 3): 1800, ("a", 4): 1801, ("b", 2): 5000}
    rows = []
    for n, key in enumerate("abc"):
        t = 1_000_000.0
        for i in range(8):
            t += gaps.get((key, i), 60)
            rows.append((n, i, "q" * (10 if i % 3 else 90), "r" * 20, t))
    return spark.createDataFrame(rows, "session_key long, turn long, question string, answer string, t double")


def _plain_memory(spark, turns, rules):
    """Each topic folded by itself; the state after each turn is that of the turns up to it."""
    out = []
    for key in {r.session_key for r in turns.collect()}:
        state, last, topic = None, None, 0
        for r in sorted(turns.where(F.col("session_key") == key).collect(), key=lambda r: r.turn):
            if state is None or r.t - last > 1800:
                topic, state = topic + (state is not None), Memory.fresh()
            rules.append(state, r.question, r.answer)
            last = r.t
            out.append((key, r.turn, [tuple(t) for t in state["turns"]], state["summary"], state["summarised"], topic))
    return sorted(out)


@pytest.mark.parametrize("summariser", [None, memory.digest_summary, lambda s, t, f: None])
def test_memory_in_cuts_with_recovery(spark, summariser):
    turns, rules = _turns(spark), Memory(100, summariser)
    source, out, checkpoint = (fresh_folder(spark, f"t-{x}") for x in "abc")
    for cut in ("turn < 1", "turn >= 1 AND turn < 4"):
        arrive(turns.where(cut), source)
        run_to_table(memory.stream_memory(arrived(spark, source, turns.schema), rules), out, checkpoint)
    later, more, fresh = (fresh_folder(spark, f"t-{x}") for x in "def")
    arrive(turns.where("turn >= 4"), later)
    saved = memory.last_states(spark.read.parquet(out))
    run_to_table(memory.stream_memory(arrived(spark, later, turns.schema), rules, initial=saved), more, fresh)
    states = spark.read.parquet(out).unionByName(spark.read.parquet(more))
    got = sorted((r.session_key, r.turn, [(t.question, t.answer) for t in r.turns], r.summary, r.summarised, r.topic) for r in states.collect())
    assert got == _plain_memory(spark, turns, rules)


def test_stream_memory_is_the_batch_fold_within_a_topic(spark):
    turns = _turns(spark).where("session_key = 2")
    named = turns.withColumn("session_key", F.col("session_key").cast("string"))
    batch = fold_memory(named, 100, memory.digest_summary).first()
    source, out, checkpoint = (fresh_folder(spark, f"t-{x}") for x in "ghi")
    arrive(turns, source)
    run_to_table(memory.stream_memory(arrived(spark, source, turns.schema), Memory(100, memory.digest_summary)), out, checkpoint)
    last = memory.last_states(spark.read.parquet(out)).first()
    assert (last.turns, last.summary, last.summarised) == (batch.turns, batch.summary, batch.summarised)


def test_expired_states_are_not_recovered(spark):
    states = spark.createDataFrame([(1, 100.0), (2, 99.0)], "session_key long, last_active double")
    assert [r.session_key for r in memory.live_states(states, 1900.0).collect()] == [1]
