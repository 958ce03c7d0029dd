"""Traces and feedback as two streams: an outer join within a time, and the statistics that are read from it.

Feedback is appended as it comes; what counts is decided when it is read: of the
votes of one user on one trace the last, apart by whether the voter asked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.runtime import table
from skeinmill.streaming.runs import arrive, arrived, fresh_folder, run_to_table

TRACE = "trace_id string, ts timestamp, asker long"
VOTE = "vote_id long, trace_id string, ts timestamp, voter long, vote string"


def join_feedback(traces: DataFrame, votes: DataFrame, within: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Every trace with each vote on it that is cast ``within`` a time of it; a trace whose time is over without one comes
    once, without a vote. Rows that are late by no more than ``late`` still meet; state older than both is dropped."""
    t = traces.select(F.col("trace_id").alias("id"), F.col("ts").alias("trace_ts"), "asker").withWatermark("trace_ts", late)
    v = votes.select("vote_id", "trace_id", F.col("ts").alias("vote_ts"), "voter", "vote").withWatermark("vote_ts", late)
    same = F.expr(f"id = trace_id AND vote_ts >= trace_ts AND vote_ts <= trace_ts + INTERVAL {within}")
    return t.join(v, same, "leftOuter").select(F.col("id").alias("trace_id"), "trace_ts", "asker", "vote_id", "vote_ts", "voter", "vote")


def last_votes(joined: DataFrame) -> DataFrame:
    """The last vote of every user on every trace: trace_id, voter, by_asker, vote."""
    cast = joined.where("vote_id IS NOT NULL")
    last = cast.groupBy("trace_id", "voter").agg(F.max_by(F.struct("asker", "vote"), F.struct("vote_ts", "vote_id")).alias("m"))
    return last.select("trace_id", "voter", F.coalesce(F.col("voter") == F.col("m.asker"), F.lit(False)).alias("by_asker"), "m.vote")


# Query -------------------------------------------------------------------------
def _streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sign-ups are the traces of their users' pair and day, purchases and errors the votes up and down on them."""
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    trace = F.concat(F.lit("t"), F.floor(F.col("user_id") / 2), F.lit("-"), F.date_format("ts", "yyyyMMdd"))
    traces = ev.where("event_type = 'signup'").groupBy(trace.alias("trace_id")).agg(F.min("ts").alias("ts"), F.min_by("user_id", F.struct("ts", "event_id")).alias("asker"))
    vote = F.when(F.col("event_type") == "purchase", "up").otherwise("down")
    votes = ev.where("event_type IN ('purchase', 'error')").select(F.col("event_id").alias("vote_id"), trace.alias("trace_id"), "ts", F.col("user_id").alias("voter"), vote.alias("vote"))
    return traces, votes


def feedback_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrivals, of which the second brings votes up to ten hours late; then a day on which nothing happens ends what is open."""
    traces, votes = _streams(spark, sf_dir)
    where, out, checkpoint = fresh_folder(spark, "feedback-in"), fresh_folder(spark, "feedback-out"), fresh_folder(spark, "feedback-checkpoint")
    span = traces.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    half, end = span.a + (span.b - span.a) / 2, F.lit(span.b) + F.expr("INTERVAL 30 DAYS")
    late = (F.col("vote_id") % 10 == 0) & (F.col("ts") >= F.lit(half) - F.expr("INTERVAL 10 HOURS"))
    quiet_trace = spark.range(1).select(F.lit("end").alias("trace_id"), end.alias("ts"), F.lit(-1).cast("long").alias("asker"))
    quiet_vote = spark.range(1).select(F.lit(-1).cast("long").alias("vote_id"), F.lit("").alias("trace_id"), end.alias("ts"), F.lit(-1).cast("long").alias("voter"), F.lit("up").alias("vote"))
    first, second = (F.col("ts") < F.lit(half)), (F.col("ts") >= F.lit(half))
    for t, v in ((traces.where(first), votes.where(first & ~late)), (traces.where(second), votes.where(second | late)), (quiet_trace, quiet_vote)):
        arrive(t.select("trace_id", "ts", "asker"), f"{where}/traces")
        arrive(v, f"{where}/votes")
        run_to_table(join_feedback(arrived(spark, f"{where}/traces", TRACE), arrived(spark, f"{where}/votes", VOTE), late="12 hours"), out, checkpoint)
    joined = spark.read.parquet(out).where("trace_id <> 'end'")
    last = last_votes(joined)
    counts = last.groupBy("trace_id").agg(
        *[F.count_if((F.col("by_asker") == asked) & (F.col("vote") == vote)).alias(f"{name}_{vote}") for asked, name in ((True, "asker"), (False, "other")) for vote in ("up", "down")]
    )
    return joined.groupBy("trace_id").agg(F.count("vote_id").alias("votes")).join(counts, "trace_id", "left").na.fill(0)


_JOINED = """WITH e AS (SELECT *, 't' || user_id // 2 || '-' || strftime(ts, '%Y%m%d') AS trace_id FROM events),
    t AS (SELECT trace_id, min(ts) AS ts, arg_min(user_id, (ts, event_id)) AS asker FROM e WHERE event_type = 'signup' GROUP BY 1),
    v AS (SELECT event_id, trace_id, ts, user_id AS voter, CASE WHEN event_type = 'purchase' THEN 'up' ELSE 'down' END AS vote FROM e WHERE event_type IN ('purchase', 'error')),
    j AS (SELECT t.trace_id, t.asker, v.event_id, v.ts, v.voter, v.vote FROM t LEFT JOIN v ON v.trace_id = t.trace_id AND v.ts >= t.ts AND v.ts <= t.ts + INTERVAL 1 DAY),
    l AS (SELECT * FROM j WHERE event_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trace_id, voter ORDER BY ts DESC, event_id DESC) = 1),
    c AS (SELECT trace_id, count_if(voter = asker AND vote = 'up') AS asker_up, count_if(voter = asker AND vote = 'down') AS asker_down, count_if(voter <> asker AND vote = 'up') AS other_up, count_if(voter <> asker AND vote = 'down') AS other_down FROM l GROUP BY 1)
    SELECT trace_id, votes, coalesce(asker_up, 0)::BIGINT AS asker_up, coalesce(asker_down, 0)::BIGINT AS asker_down, coalesce(other_up, 0)::BIGINT AS other_up, coalesce(other_down, 0)::BIGINT AS other_down
    FROM (SELECT trace_id, count(event_id) AS votes FROM j GROUP BY 1) LEFT JOIN c USING (trace_id)"""
QUERIES = {"feedback_stream": (feedback_stream, _JOINED)}
