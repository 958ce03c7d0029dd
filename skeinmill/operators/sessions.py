"""Conversation state over events and turns: admission, rate limits, sessions, memory windows, traces, feedback."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinmill.runtime import table

RATE_LIMIT, RATE_WINDOW_S = 3, 60
SESSION_TTL_S = 1800


def dedup_messages(messages: DataFrame, key: str, order: list) -> DataFrame:
    """First message of each key; blank and null keys are never dropped, nor ranked."""
    blank = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    first = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return messages.where(~blank).withColumn("n", first).where("n = 1").drop("n").unionByName(messages.where(blank))


def rate_limit_bucket(calls: DataFrame, user: str, ts: str, limit: int = RATE_LIMIT, window_s: int = RATE_WINDOW_S) -> DataFrame:
    """Fixed buckets of ``window_s`` seconds; every attempt counts, the first ``limit`` pass."""
    bucket = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (window_s * 1_000_000))
    n = F.row_number().over(W.partitionBy(user, "bucket").orderBy(ts, "event_id"))
    return calls.withColumn("bucket", bucket).withColumn("allowed", n <= limit)


def rate_limit_sliding(calls: DataFrame, limit: int = RATE_LIMIT, window_s: int = RATE_WINDOW_S) -> DataFrame:
    """Sliding window in which only accepted calls count: a fold over a user's calls in time order.

    Rows (event_id, user_id, t in seconds) are sorted within partitions and folded
    as a stream, so a user's calls are never gathered; state is ``limit`` times.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, accepted = None, []
        for frame in frames:
            allowed = []
            for u, t in zip(frame["user_id"], frame["t"], strict=True):
                if u != user:
                    user, accepted = u, []
                accepted = [a for a in accepted if a > t - window_s]
                allowed.append(len(accepted) < limit)
                if allowed[-1]:
                    accepted.append(t)
            yield frame.assign(allowed=allowed)

    sorted_calls = calls.select("event_id", "user_id", "t").repartition("user_id").sortWithinPartitions("user_id", "t", "event_id")
    return sorted_calls.mapInPandas(fold, "event_id long, user_id long, t double, allowed boolean")


def sessions(events: DataFrame, user: str, ts: str, ttl_s: int = SESSION_TTL_S) -> DataFrame:
    """A new session starts after more than ``ttl_s`` idle seconds."""
    own = W.partitionBy(user).orderBy(ts, "event_id")
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(own)
    return events.withColumn("session", F.sum(F.when(gap > ttl_s * 1_000_000, 1).otherwise(0)).over(own))


def budget_suffix(turns: DataFrame, key: str, order: str, tokens: str, budget: int) -> DataFrame:
    """Newest turns whose running tokens fit the budget; the newest always stays."""
    newest = W.partitionBy(key).orderBy(F.desc(order))
    return turns.withColumn("used", F.sum(tokens).over(newest.rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.row_number().over(newest)).where((F.col("used") <= budget) | (F.col("n") == 1)).drop("n")


def streaming_counts(events: DataFrame, ts: str = "ts", late: str = "10 minutes", window: str = "60 seconds") -> DataFrame:
    """Calls per user and bucket for batch or streaming input; late data within ``late`` still counts."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), "user_id").agg(F.count("*").alias("calls")).select("user_id", F.col("window.start").alias("bucket"), "calls")


def streaming_dedup(messages: DataFrame, key: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return messages.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def message_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages are keyed by user, type and props."""
    keyed = _events(spark, sf_dir).withColumn("message_id", F.concat_ws("/", "user_id", "event_type", "props"))
    return dedup_messages(keyed, "message_id", ["event_id"]).select("event_id", "message_id")


def q_rate_limit_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_limit_bucket(_events(spark, sf_dir), "user_id", "ts", 1, 3600).select("event_id", "user_id", "allowed")


def session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions(_events(spark, sf_dir), "user_id", "ts")
    return found.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def lru_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most recently active users; aggregated first, so the final sort sees one row a user."""
    last = _events(spark, sf_dir).groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return last.orderBy(F.desc("m.ts"), F.desc("m.event_id")).limit(20).select("user_id", F.col("m.ts").alias("last_active"))


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumn("tokens", F.length("text"))


def memory_budget_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget_suffix(_turns(spark, sf_dir), "conv_id", "turn", "tokens", 2000).select("conv_id", "turn", "used")


def memory_rewrite_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return _turns(spark, sf_dir).withColumn("n", newest).where("n <= 2").select("conv_id", "turn", "role")


def session_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("tokens").alias("tokens"))


def last_user_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where((F.col("role") == "user") & (F.trim("text") != ""))
    return asked.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.md5(F.max_by("text", "turn").cast("binary")).alias("text_md5"))


def history_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A system row with the first turn as summary, then all later rows in order."""
    turns = table(spark, sf_dir, "conversations")
    role = F.when(F.col("turn") == 0, "system").otherwise(F.col("role"))
    return turns.select("conv_id", F.col("turn").alias("seq"), role.alias("role"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def qa_trace_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces are events: stage is the type, the top score the value."""
    day = F.date_trunc("day", "ts")
    return _events(spark, sf_dir).groupBy(day.alias("day"), "event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") >= 0.68).alias("n_good"), F.round(F.avg("value"), 6).alias("mean_score"), F.max("value").alias("top_score")
    )


def feedback_last_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases vote up and errors down on the user's signup trace; the last vote of each user counts."""
    ev = _events(spark, sf_dir)
    votes = ev.where(F.col("event_type").isin("purchase", "error")).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("vote"))
    traces = ev.where("event_type = 'signup'").select("event_id", "user_id")
    return traces.join(votes, "user_id", "left").groupBy("vote").agg(F.count("*").alias("n"))


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads parsed with a schema; bad JSON gives null."""
    k = F.from_json("props", "k int")["k"]
    return _events(spark, sf_dir).select(k.alias("k")).groupBy("k").agg(F.count("*").alias("n"))


_EV = "epoch_us(ts)"
QUERIES = {
    "message_dedup": (message_dedup, "SELECT event_id, concat_ws('/', user_id, event_type, props) AS message_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) = 1"),
    "rate_limit_bucket": (q_rate_limit_bucket, f"SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, {_EV} // 3600000000 ORDER BY ts, event_id) <= 1 AS allowed FROM events"),
    "session_ttl": (session_ttl, f"""WITH g AS (SELECT *, {_EV} - lag({_EV}) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(CASE WHEN gap > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM g)
        SELECT user_id, session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2"""),
    "lru_sessions": (lru_sessions, "SELECT user_id, ts AS last_active FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) ORDER BY ts DESC, event_id DESC LIMIT 20"),
    "memory_budget_window": (memory_budget_window, "SELECT conv_id, turn, used FROM (SELECT *, sum(length(text)) OVER w::BIGINT AS used, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) WHERE used <= 2000 OR n = 1"),
    "memory_rewrite_view": (memory_rewrite_view, "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2"),
    "session_tokens": (session_tokens, "SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS tokens FROM conversations GROUP BY 1"),
    "last_user_question": (last_user_question, "SELECT conv_id, max(turn) AS turn, md5(arg_max(text, turn)) AS text_md5 FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY 1"),
    "history_messages": (history_messages, "SELECT conv_id, turn AS seq, CASE WHEN turn = 0 THEN 'system' ELSE role END AS role, md5(text) AS text_md5 FROM conversations"),
    "qa_trace_rollup": (qa_trace_rollup, "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, count_if(value >= 0.68)::BIGINT AS n_good, round(avg(value), 6) AS mean_score, max(value) AS top_score FROM events GROUP BY 1, 2"),
    "feedback_last_vote": (feedback_last_vote, """WITH v AS (SELECT user_id, event_type AS vote FROM events WHERE event_type IN ('purchase', 'error') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
        SELECT vote, count(*) AS n FROM events LEFT JOIN v USING (user_id) WHERE event_type = 'signup' GROUP BY 1"""),
    "event_props": (event_props, "SELECT (props::JSON->>'k')::INT AS k, count(*) AS n FROM events GROUP BY 1"),
}
