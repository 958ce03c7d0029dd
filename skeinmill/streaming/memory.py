"""Conversation memory as keyed stream state: topics that expire, turns within a budget, summaries, recovery."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from skeinmill.operators.assistant import Memory
from skeinmill.operators.sessions import SESSION_TTL_S
from skeinmill.runtime import table
from skeinmill.streaming.runs import arrive, arrived, fresh_folder, run_to_table

_TURNS = "array<struct<question:string,answer:string>>"
STATE = f"turns {_TURNS}, summary string, summarised int, topic int, last_active double"
#: A row a turn: the session's state after it.
STATES = f"session_key long, turn long, {STATE}"


class SessionMemory(StatefulProcessor):
    """Each session's state after each of its turns.

    A session that was idle for more than ``ttl_s`` seconds starts a new topic with
    empty memory. When the watermark says that no turn can come in time any more,
    a timer clears turns and summary; the number of the topic stays.
    """

    def __init__(self, memory: Memory, ttl_s: float):
        self.memory, self.ttl_s = memory, ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", STATE)

    def _load(self) -> dict:
        if not self.state.exists():
            return Memory.fresh() | {"topic": 0, "last": None}
        turns, summary, summarised, topic, last = self.state.get()
        return {"turns": [(t[0], t[1]) for t in turns], "summary": summary, "summarised": summarised, "topic": topic, "last": last}

    def _save(self, s: dict) -> None:
        self.state.update((s["turns"], s["summary"], s["summarised"], s["topic"], s["last"]))

    def _wait(self, last: float) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(int((last + self.ttl_s) * 1000) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, out = self._load(), []
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["t", "turn"], kind="stable")
        for turn, question, answer, t in zip(frame["turn"].tolist(), frame["question"].tolist(), frame["answer"].tolist(), frame["t"].tolist(), strict=True):
            if s["last"] is not None and t - s["last"] > self.ttl_s:
                s |= Memory.fresh() | {"topic": s["topic"] + 1}
            self.memory.append(s, question, answer)
            s["last"] = t
            out.append((key[0], turn, [{"question": q, "answer": a} for q, a in s["turns"]], s["summary"], s["summarised"], s["topic"], t))
        self._save(s)
        self._wait(s["last"])
        yield pd.DataFrame(out, columns=["session_key", "turn", "turns", "summary", "summarised", "topic", "last_active"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            s = self._load()
            self._save(s | Memory.fresh())
        yield pd.DataFrame({c: pd.Series(dtype=d) for c, d in (("session_key", "int64"), ("turn", "int64"), ("turns", "object"), ("summary", "object"), ("summarised", "int32"), ("topic", "int32"), ("last_active", "float64"))})

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        turns = [(t["question"], t["answer"]) for t in row["turns"]]
        self._save({"turns": turns, "summary": row["summary"], "summarised": int(row["summarised"]), "topic": int(row["topic"]), "last": float(row["last_active"])})
        self._wait(float(row["last_active"]))

    def close(self) -> None:
        pass


def stream_memory(turns: DataFrame, memory: Memory, ttl_s: float = SESSION_TTL_S, initial: DataFrame | None = None, late: str = "10 minutes") -> DataFrame:
    """``STATES`` for a stream of (session_key, turn, question, answer, t in seconds), sessions' turns arriving in order.

    ``initial`` has states to go on from when a new checkpoint is begun: a row a
    session, as ``last_states`` gives them.
    """
    own = turns.select("session_key", "turn", "question", "answer", "t", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("at")).withWatermark("at", late)
    begun = initial.groupBy("session_key") if initial is not None else None
    return own.groupBy("session_key").transformWithStateInPandas(SessionMemory(memory, ttl_s), STATES, "append", "eventtime", begun)


def last_states(states: DataFrame) -> DataFrame:
    """The newest state of every session among the rows that a stream has written."""
    rest = [c for c in states.columns if c not in ("session_key", "turn")]
    return states.groupBy("session_key").agg(F.max_by(F.struct(*rest), F.struct("last_active", "turn")).alias("s")).select("session_key", "s.*")


def live_states(states: DataFrame, now: float, ttl_s: float = SESSION_TTL_S) -> DataFrame:
    """States that a start at ``now`` recovers: those idle for no longer than ``ttl_s``."""
    return states.where(F.lit(now) - F.col("last_active") <= ttl_s)


# Query -------------------------------------------------------------------------
BUDGET = 900


def digest_summary(summary: str, turns: list[tuple[str, str]], facts: list[str]) -> str:
    """A deterministic stand-in for a language model: how many turns went and how long they were."""
    return f"{summary}+{len(turns)}:{sum(len(q) + len(a) for q, a in turns)}"


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the answers that follow them; times are derived: six minutes a turn, an hour more before every fifth conversation's fourth turn."""
    said = table(spark, sf_dir, "conversations")
    following = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    pairs = said.withColumn("answer", following).where("turn % 2 = 0")
    t = 1_700_000_000 + F.col("turn") * 360 + F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") >= 4), 3600).otherwise(0) + F.col("conv_id") % 7
    return pairs.select(F.col("conv_id").alias("session_key"), "turn", F.col("text").alias("question"), "answer", t.cast("double").alias("t"))


def memory_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arrivals: the second goes on from the checkpoint, the third from the saved states in a new checkpoint."""
    turns, memory = conversation_turns(spark, sf_dir), Memory(BUDGET, digest_summary)
    source, out, checkpoint = (fresh_folder(spark, f"memory-{x}") for x in ("in", "out", "checkpoint"))
    for cut in ("turn < 2", "turn >= 2 AND turn < 4"):
        arrive(turns.where(cut), source)
        run_to_table(stream_memory(arrived(spark, source, turns.schema), memory), out, checkpoint)
    later, more, fresh = (fresh_folder(spark, f"memory-{x}") for x in ("in", "out", "checkpoint"))
    arrive(turns.where("turn >= 4"), later)
    saved = last_states(spark.read.parquet(out))
    run_to_table(stream_memory(arrived(spark, later, turns.schema), memory, initial=saved), more, fresh)
    states = spark.read.parquet(out).unionByName(spark.read.parquet(more))
    chars = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.length(t["question"]) + F.length(t["answer"]))
    return states.select("session_key", "turn", "topic", F.size("turns").cast("long").alias("kept"), chars.alias("chars"), "summary", "summarised")


#: One fold over all turns. A turn is its length; what is kept is the newest suffix within the budget, at least one.
_MEMORY = f"""WITH RECURSIVE p AS (SELECT conv_id AS k, turn, length(text) + length(coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '')) AS n,
      (1700000000 + turn * 360 + CASE WHEN conv_id % 5 = 0 AND turn >= 4 THEN 3600 ELSE 0 END + conv_id % 7)::DOUBLE AS t FROM conversations),
    c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, turn) AS i FROM p WHERE turn % 2 = 0),
    r AS (SELECT k, turn, i, t, 0 AS topic, [n]::BIGINT[] AS held, '' AS summary, 0 AS summarised FROM c WHERE i = 1
      UNION ALL SELECT k, turn, i, t, topic, held[cut + 1:] AS held, CASE WHEN cut > 0 THEN summary || '+' || cut || ':' || list_sum(held[1:cut])::BIGINT ELSE summary END AS summary, (summarised + cut)::INT AS summarised
        FROM (SELECT *, (len(held) - greatest(1, len(list_filter(range(1, len(held) + 1), lambda j: list_sum(held[j:]) <= {BUDGET}))))::INT AS cut
          FROM (SELECT c.k, c.turn, c.i, c.t, CASE WHEN c.t - r.t > {SESSION_TTL_S} THEN r.topic + 1 ELSE r.topic END AS topic, CASE WHEN c.t - r.t > {SESSION_TTL_S} THEN [c.n]::BIGINT[] ELSE list_append(r.held, c.n) END AS held,
              CASE WHEN c.t - r.t > {SESSION_TTL_S} THEN '' ELSE r.summary END AS summary, CASE WHEN c.t - r.t > {SESSION_TTL_S} THEN 0 ELSE r.summarised END AS summarised
            FROM r JOIN c ON c.k = r.k AND c.i = r.i + 1)))
    SELECT k AS session_key, turn, topic, len(held)::BIGINT AS kept, list_sum(held)::BIGINT AS chars, summary, summarised FROM r"""
QUERIES = {"memory_stream": (memory_stream, _MEMORY)}
