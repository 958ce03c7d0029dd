"""Order-dependent admission on streams: sliding rate limits and the throttle of streamed answers.

Both decide a row by the rows of its key that were let through before, so the
state of a key is what was let through lately and nothing else. Rows of one batch
are taken in order of time; batches have to arrive in that order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from skeinmill.operators.answers import throttle
from skeinmill.operators.sessions import rate_limit_sliding
from skeinmill.runtime import table
from skeinmill.streaming.runs import arrive, arrived, fresh_folder, run_to_table

CALLS = "event_id long, user_id long, t double, allowed boolean"
FLUSHES = "stream long, seq long, t double, chars long, force boolean, flush boolean"


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A key's rows of one batch, the batch being what bounds them."""
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


class SlidingLimit(StatefulProcessor):
    """Lets a call through if fewer than ``limit`` were let through in the ``window_s`` seconds before it.

    The state is the times of those calls, at most ``limit``. A timer one window
    after the last one clears a user who has gone quiet.
    """

    def __init__(self, limit: int, window_s: float):
        self.limit, self.window_s = limit, window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getListState("accepted", "t double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [t for (t,) in self.accepted.get()]
        frame, allowed = _in_order(rows, ["t", "event_id"]), []
        for t in frame["t"].tolist():
            held = [a for a in held if a > t - self.window_s]
            allowed.append(len(held) < self.limit)
            if allowed[-1]:
                held.append(t)
        self.accepted.put([(t,) for t in held]) if held else self.accepted.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if held:
            self.handle.registerTimer(int((max(held) + self.window_s) * 1000) + 1)
        yield pd.DataFrame({"event_id": frame["event_id"], "user_id": frame["user_id"], "t": frame["t"], "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.accepted.clear()
        yield pd.DataFrame({"event_id": pd.Series(dtype="int64"), "user_id": pd.Series(dtype="int64"), "t": pd.Series(dtype="float64"), "allowed": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


def stream_rate_limit(calls: DataFrame, limit: int = 3, window_s: float = 60) -> DataFrame:
    """``CALLS`` for a stream of (event_id, user_id, t in seconds): as ``rate_limit_sliding`` over the whole."""
    timed = calls.select("event_id", "user_id", "t", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("at")).withWatermark("at", f"{int(window_s) + 1} seconds")
    return timed.groupBy("user_id").transformWithStateInPandas(SlidingLimit(limit, window_s), CALLS, "append", "eventtime")


class Throttle(StatefulProcessor):
    """Flushes a stream's text when forced, first, or after enough new characters and seconds; the state is the last flush."""

    def __init__(self, min_chars: int, min_seconds: float):
        self.min_chars, self.min_seconds = max(1, min_chars), min_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t double, chars long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, length = self.last.get() if self.last.exists() else (None, 0)
        frame, flushed = _in_order(rows, ["seq"]), []
        for t, n, force in zip(frame["t"].tolist(), frame["chars"].tolist(), frame["force"].tolist(), strict=True):
            flush = bool(force) or at is None or (n - length >= self.min_chars and t - at >= self.min_seconds)
            if flush:
                at, length = t, n
            flushed.append(flush)
        self.last.update((at, length))
        yield frame[["stream", "seq", "t", "chars", "force"]].assign(flush=flushed)

    def close(self) -> None:
        pass


def stream_throttle(deltas: DataFrame, min_chars: int, min_seconds: float) -> DataFrame:
    """``FLUSHES`` for a stream of (stream, seq, t, chars, force): as ``throttle`` over the whole."""
    return deltas.groupBy("stream").transformWithStateInPandas(Throttle(min_chars, min_seconds), FLUSHES, "append", "none")


def in_cuts(rows: DataFrame, cuts: list, transform) -> DataFrame:
    """What ``transform`` gives for a stream of ``rows`` that arrives in pieces, one for each condition in ``cuts``; the
    query is stopped after every piece and goes on from its checkpoint."""
    spark = rows.sparkSession
    source, out, checkpoint = (fresh_folder(spark, f"stream-{x}") for x in ("in", "out", "checkpoint"))
    for condition in cuts:
        arrive(rows.where(condition), source)
        run_to_table(transform(arrived(spark, source, rows.schema)), out, checkpoint)
    return spark.read.parquet(out)


# Queries ---------------------------------------------------------------------
def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


def q_rate_limit_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_limit_sliding(_calls(spark, sf_dir), 3, 36_000)


def q_rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arrivals, cut at a third and two thirds of the time that the events span."""
    calls = _calls(spark, sf_dir)
    span = calls.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    a, b = span.a + (span.b - span.a) / 3, span.a + 2 * (span.b - span.a) / 3
    cuts = [F.col("t") < a, (F.col("t") >= a) & (F.col("t") < b), F.col("t") >= b]
    return in_cuts(calls, cuts, lambda s: stream_rate_limit(s, 3, 36_000))


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    chars = F.sum(F.length("text")).over(W.partitionBy("conv_id").orderBy("turn")).cast("long")
    return turns.select(F.col("conv_id").alias("stream"), F.col("turn").alias("seq"), (F.col("turn") * 0.5).cast("double").alias("t"), chars.alias("chars"), F.lit(False).alias("force"))


def q_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throttle(_deltas(spark, sf_dir), 100, 1.0)


def q_throttle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stream's first two deltas arrive, then the rest."""
    return in_cuts(_deltas(spark, sf_dir), [F.col("seq") < 2, F.col("seq") >= 2], lambda s: stream_throttle(s, 100, 1.0))


_SLIDING = """WITH RECURSIVE c AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT event_id, user_id, t, i, true AS allowed, [t] AS held FROM c WHERE i = 1
      UNION ALL SELECT event_id, user_id, t, i, len(kept) < 3 AS allowed, CASE WHEN len(kept) < 3 THEN list_append(kept, t) ELSE kept END AS held
        FROM (SELECT c.event_id, c.user_id, c.t, c.i, list_filter(r.held, lambda x: x > c.t - 36000) AS kept FROM r JOIN c ON c.user_id = r.user_id AND c.i = r.i + 1))
    SELECT event_id, user_id, t, allowed FROM r"""
_THROTTLE = """WITH RECURSIVE c AS (SELECT conv_id AS stream, turn AS seq, turn * 0.5::DOUBLE AS t, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    r AS (SELECT stream, seq, t, chars, i, true AS flush, t AS last_t, chars AS length FROM c WHERE i = 1
      UNION ALL SELECT stream, seq, t, chars, i, due AS flush, CASE WHEN due THEN t ELSE last_t END AS last_t, CASE WHEN due THEN chars ELSE length END AS length
        FROM (SELECT c.*, r.last_t, r.length, c.chars - r.length >= 100 AND c.t - r.last_t >= 1.0 AS due FROM r JOIN c ON c.stream = r.stream AND c.i = r.i + 1))
    SELECT stream, seq, t, chars, false AS force, flush FROM r"""
QUERIES = {
    "rate_limit_sliding": (q_rate_limit_sliding, _SLIDING),
    "rate_limit_sliding_stream": (q_rate_limit_stream, _SLIDING),
    "stream_throttle": (q_throttle, _THROTTLE),
    "stream_throttle_stateful": (q_throttle_stream, _THROTTLE),
}
