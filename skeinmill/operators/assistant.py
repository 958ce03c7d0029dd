"""Around a question: intake, permissions, guards, tools, prompts, memory with summaries, configuration."""

from __future__ import annotations

import json
import os
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.functions.text import let, strip_mentions, stripped
from skeinmill.operators.business import has_business_intent
from skeinmill.operators.sessions import RATE_LIMIT, RATE_WINDOW_S, rate_limit_sliding

# The argument pairs that a date window may come in, in the order in which they are looked at.
DATE_PAIRS = (
    ("start_date", "end_date"), ("start_time", "end_time"), ("from_date", "to_date"), ("from_time", "to_time"), ("begin_date", "end_date"),
    ("begin_time", "end_time"), ("created_start", "created_end"), ("created_at_start", "created_at_end"), ("updated_start", "updated_end"), ("updated_at_start", "updated_at_end"),
)
WEEKDAYS = ("星期一", "星期二", "星期三", "星期四", "星期五", "星期六", "星期日")


# Plug-in surfaces ------------------------------------------------------------
class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, question: str, texts: list[str]) -> list[float]: ...


class Summariser(Protocol):
    def __call__(self, summary: str, turns: list[tuple[str, str]], facts: list[str]) -> str | None: ...


class BusinessBackend(Protocol):
    def query(self, operation: str, arguments: dict[str, Any], max_rows: int) -> DataFrame: ...


class PageReader(Protocol):
    """Text of a scanned or rendered page: a recognition or vision model."""

    def read(self, page: bytes) -> str: ...


def embed_column(text: Column, embedder: Embedder, most: int = 10) -> Column:
    """Vectors of texts, ``most`` a call; another count or length than the embedder names is an error."""

    def run(texts: pd.Series) -> pd.Series:
        asked, out = texts.fillna("").tolist(), []
        for at in range(0, len(asked), most):
            got = embedder.embed(asked[at : at + most])
            if len(got) != len(asked[at : at + most]) or any(len(v) != embedder.dim for v in got):
                raise ValueError(f"the embedder must give one vector of {embedder.dim} numbers a text")
            out += [list(map(float, v)) for v in got]
        return pd.Series(out)

    from pyspark.sql.types import ArrayType, FloatType

    return F.pandas_udf(run, ArrayType(FloatType()))(text)


def checked_vector(vec: Column, dim: int) -> Column:
    return F.when(F.size(vec) == dim, vec).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} numbers, got "), F.size(vec).cast("string"))))


def retried(call: Callable[[], Any], passing: Callable[[Exception], bool], tries: int = 3, first: float = 0.5, most: float = 8.0, jitter: float = 0.3, linear: bool = False, sleep=time.sleep) -> Any:
    """What ``call`` gives; failures that ``passing`` names are tried again after growing (doubled, or linear) waits."""
    for n in range(tries):
        try:
            return call()
        except Exception as e:  # noqa: BLE001 judged by ``passing``
            if n == tries - 1 or not passing(e):
                raise
            sleep(first * n if linear else min(most, first * 2**n) + random.uniform(0, jitter))


@dataclass
class Tools:
    """Tools by name. ``execute`` gives a result or an error text and never raises."""

    known: dict[str, tuple[Callable[..., Any], dict, str]] = field(default_factory=dict)

    def tool(self, name: str, schema: dict, group: str = ""):
        def add(f: Callable[..., Any]) -> Callable[..., Any]:
            self.known[name] = (f, schema, group)
            return f

        return add

    def schemas(self, allowed: Callable[[str], bool] = lambda group: True) -> list[dict]:
        return [{"type": "function", "function": {"name": n, "description": (f.__doc__ or "").strip(), "parameters": s}} for n, (f, s, g) in self.known.items() if allowed(g)]

    def execute(self, name: str, arguments: str | dict) -> str:
        try:
            found = self.known[name][0](**(json.loads(arguments) if isinstance(arguments, str) else arguments))
            return found if isinstance(found, str) else json.dumps(found, ensure_ascii=False, default=str)
        except Exception as e:  # noqa: BLE001 a failing tool is an answer
            return json.dumps({"error": str(e) or type(e).__name__}, ensure_ascii=False)


# Configuration ---------------------------------------------------------------
def interpolated(value: Any, env: dict[str, str] | None = None) -> Any:
    """``${NAME}`` and ``${NAME:-default}`` in all strings of a nested value; a name without either is an error."""
    env = dict(os.environ) if env is None else env

    def one(m: re.Match[str]) -> str:
        if m[1] not in env and m[2] is None:
            raise KeyError(f"{m[1]} is not set and has no default")
        return env.get(m[1], m[2])

    if isinstance(value, str):
        return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}", one, value)
    if isinstance(value, dict):
        return {k: interpolated(v, env) for k, v in value.items()}
    return [interpolated(v, env) for v in value] if isinstance(value, list) else value


def typed(env: dict[str, str], name: str, kind: type = str, default: Any = None, least: float | None = None, most: float | None = None) -> Any:
    """A setting as bool, list (comma separated), int, float or str, within its bounds; anything else is an error."""
    raw = env.get(name, "").strip()
    if not raw:
        return default
    if kind is bool:
        if raw.lower() not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
            raise ValueError(f"{name} must be true or false")
        return raw.lower() in ("1", "true", "yes", "on")
    if kind is list:
        return [x.strip() for x in raw.split(",") if x.strip()]
    value = kind(raw)
    if (least is not None and value < least) or (most is not None and value > most):
        raise ValueError(f"{name} must lie between {least} and {most}")
    return value


def bullets(text: str, label: str) -> list[str]:
    """The first run of ``- `` lines after a label."""
    _, found, rest = text.partition(label)
    out: list[str] = []
    for line in map(str.strip, rest.splitlines() if found else []):
        if line.startswith("- ") and not line.endswith(":"):
            out.append(line[2:].strip())
        elif out:
            break
    return out


def parse_skill(content: str) -> dict[str, Any]:
    """Front matter (name, version and summary are required) and, for every ``## Tool: x`` section, its field lists."""
    head = re.match(r"---\n(.*?)\n---\n", content, re.DOTALL)
    facts = {k.strip(): v.strip().strip("\"'") for k, _, v in (line.partition(":") for line in (head[1] if head else "").splitlines()) if _}
    for name in ("name", "version", "summary"):
        if not facts.get(name):
            raise ValueError(f"a skill must define {name}")
    body = content[head.end() :]
    tools = {}
    for section in re.split(r"(?m)^(?=## )", body):
        if m := re.match(r"## Tool: (\S+)", section):
            fields = lambda label, s=section: [x.strip("`") for x in bullets(s, label)]
            tools[m[1]] = {"required": fields("Required fields:"), "optional": fields("Optional fields:"), "clarification": "\n".join(bullets(section, "Clarification:"))}
    return {**facts, "content": body.strip(), "tools": tools}


def token_counter(path: str | None = None) -> Callable[[str], int]:
    """Counts tokens by a tokenizer file of the tokenizers library; characters without one or where it cannot be read."""
    try:
        from tokenizers import Tokenizer

        known = Tokenizer.from_file(path)
    except Exception:  # noqa: BLE001 any missing or unreadable file
        return len
    return lambda text: len(known.encode(text, add_special_tokens=False).ids)


# Intake ----------------------------------------------------------------------
def normalised_event(event: Column) -> Column:
    """struct(message_id, chat_id, chat_type, message_type, text, open_id) of a JSON message event with nested fallbacks."""
    at = lambda *paths: F.coalesce(*[F.get_json_object(event, f"$.{p}") for p in paths])
    content = at("message.content")
    parsed = F.get_json_object(content, "$.text")
    is_json = F.try_parse_json(content).isNotNull()
    return F.struct(
        at("message.message_id").alias("message_id"), at("message.chat_id").alias("chat_id"), at("event.chat_type", "chat_type", "message.chat_type").alias("chat_type"),
        at("message.message_type").alias("message_type"), F.when(is_json, parsed).otherwise(content).alias("text"), at("sender.sender_id.open_id", "sender.open_id").alias("open_id"),
    )


def question_of(message_type: Column, chat_type: Column, text: Column, mentioned: Column, names: Column, bot: str) -> Column:
    """The question in a text message: any text of a private chat, in a group only where the bot is mentioned; else null."""
    private = F.nullif(stripped(F.coalesce(text, F.lit(""))), F.lit(""))
    addressed = F.array_contains(mentioned, bot) if bot else F.size(mentioned) > 0
    asked = F.when(chat_type == "p2p", private).when((chat_type == "group") & addressed, strip_mentions(F.coalesce(text, F.lit("")), names))
    return F.when(message_type == "text", asked)


def may_use(group: Column, chat_type: Column, user: Column, allowed: tuple[str, ...]) -> Column:
    """Tools of the business group only in private chats of listed users; all others for everyone."""
    return F.coalesce((group != "business") | ((chat_type == "p2p") & user.isin(*allowed)), F.lit(False))


def attaches_skill(enabled: bool, chat_type: Column, user: Column, allowed: tuple[str, ...], text: Column) -> Column:
    return F.lit(enabled) & may_use(F.lit("business"), chat_type, user, allowed) & F.coalesce(has_business_intent(text), F.lit(False))


# Guards ----------------------------------------------------------------------
def _local_time(value: Column) -> Column:
    """An ISO date or date-time without its zone; null for anything else."""
    bare = F.regexp_replace(F.trim(value), r"(?:Z|[+-]\d{2}:?\d{2})$", "")
    plain = F.when(F.trim(value).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.trim(value)).otherwise(bare)
    return F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?$"), plain.try_cast("timestamp_ntz"))


def date_window_guard(arguments: Column, days: int = 30) -> Column:
    """ALLOW, INVALID_TIME_RANGE or TIME_RANGE_TOO_LARGE of a map of arguments: the first pair that offends decides; pairs
    that do not parse are not judged, and exactly ``days`` days pass."""

    def first_offence(given: Column) -> Column:
        codes = []
        for start, end in DATE_PAIRS:
            a, b = (_local_time(F.try_element_at(given, F.lit(k))).cast("timestamp") for k in (start, end))
            span = F.unix_micros(b) - F.unix_micros(a)
            codes.append(F.when(span < 0, "INVALID_TIME_RANGE").when(span > days * 86_400_000_000, "TIME_RANGE_TOO_LARGE"))
        return F.coalesce(*codes, F.lit("ALLOW"))

    return F.coalesce(let(arguments, first_offence), F.lit("ALLOW"))


def guarded_calls(calls: DataFrame, days: int = 30, limit: int = RATE_LIMIT, window_s: int = RATE_WINDOW_S) -> DataFrame:
    """Calls (event_id, user_id, t in seconds, arguments: map) with ``code``: the date window first, then the sliding limit,
    which only calls with a fair window count for."""
    judged = calls.withColumn("window_code", date_window_guard(F.col("arguments"), days))
    limited = rate_limit_sliding(judged.where("window_code = 'ALLOW'"), limit, window_s).select("event_id", "allowed")
    return judged.join(limited, "event_id", "left").select("event_id", "user_id", "t", F.when(F.col("allowed") == F.lit(False), "RATE_LIMIT_EXCEEDED").otherwise(F.col("window_code")).alias("code"))


def envelope(rows: DataFrame, operation: str, max_rows: int = 50, order: list[str] | None = None) -> DataFrame:
    """One row: operation, row_count, rows (JSON objects) of at most 1..200 rows, the first by ``order`` (all columns by default)."""
    most = max(1, min(200, max_rows))
    some = rows.orderBy(*(order or rows.columns)).limit(most)
    packed = some.select(F.to_json(F.struct(*rows.columns)).alias("j")).agg(F.sort_array(F.collect_list("j")).alias("rows"))
    return packed.select(F.lit(operation).alias("operation"), F.size("rows").alias("row_count"), "rows")


def tool_call(arguments: Column, schema: str) -> Column:
    """struct(arguments, error) of a tool call's JSON; what is no object is an error."""
    parsed = F.when(F.try_parse_json(arguments).isNotNull() & F.trim(arguments).startswith("{"), F.from_json(arguments, schema))
    return F.struct(parsed.alias("arguments"), F.when(parsed.isNull(), F.concat(F.lit("invalid arguments: "), F.coalesce(arguments, F.lit("null")))).alias("error"))


def clock(at: Column) -> Column:
    return F.concat_ws(" ", F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(at) + 1))


def web_results(rows: DataFrame, max_results: int = 5, most_chars: int = 1200) -> DataFrame:
    """Results (query_id, rank, title, url, content) of a search, the answer block (rank 0) first, contents cut."""
    return rows.where(F.col("rank") <= max(1, min(10, max_results))).select("query_id", "rank", "title", "url", F.substring(F.coalesce("content", F.lit("")), 1, most_chars).alias("content"))


def prompt(header: Column, history: Column, question: Column, blocks: Column) -> Column:
    """Header, history of struct(question, answer), question and numbered blocks as one text; empty parts are left out."""
    said = F.array_join(F.transform(history, lambda t: F.concat(F.lit("Q: "), t["question"], F.lit("\nA: "), t["answer"])), "\n")
    listed = F.array_join(F.transform(blocks, lambda b, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), b)), "\n\n")
    return F.array_join(F.filter(F.array(header, said, question, listed), lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n")


def display_label(hits: DataFrame, chats: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits (source, filename, doc_uuid) with ``label``: names of the chat and the document found in the source by their
    ids, else the file name without ids, else the file name or id itself. Names come from tables (id, name)."""
    text = F.concat_ws(" ", "source", "filename")
    own = hits.withColumn("_chat", F.regexp_extract(text, r"oc_[0-9a-z]+", 0)).withColumn("_doc", F.regexp_extract(text, r"wiki_([0-9A-Za-z]+)", 1))
    own = own.join(chats.select(F.col("id").alias("_chat"), F.col("name").alias("_chat_name")), "_chat", "left").join(documents.select(F.col("id").alias("_doc"), F.col("name").alias("_doc_name")), "_doc", "left")
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("filename", F.lit("")), r"^(om_[0-9a-z]+_)+", ""), r"wiki_[0-9A-Za-z]+", "")
    label = F.nullif(F.concat_ws(" / ", "_chat_name", F.coalesce("_doc_name", F.nullif(F.btrim(bare, F.lit(" _-")), F.lit("")))), F.lit(""))
    return own.withColumn("label", F.coalesce(label, F.nullif("filename", F.lit("")), "doc_uuid", F.lit("未知来源"))).drop("_chat", "_doc", "_chat_name", "_doc_name")


# Admission and memory ----------------------------------------------------------
def admitted(arrivals: DataFrame, workers: int = 10, queue: int = 50) -> DataFrame:
    """Arrivals (lane, event_id, t, seconds) with ``admitted``: rejected when all workers are busy and the queue is full.

    Lanes are independent; each is folded in time order with a state of at most workers + queue ends.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, ends = None, []
        for frame in frames:
            out = []
            for own, t, seconds in zip(frame["lane"], frame["t"], frame["seconds"], strict=True):
                if own != lane:
                    lane, ends = own, []
                ends = [e for e in ends if e > t]
                out.append(len(ends) < workers + queue)
                if out[-1]:
                    busy = sorted(ends)
                    start = t if len(busy) < workers else busy[len(busy) - workers]
                    ends.append(start + seconds)
            yield frame.assign(admitted=out)

    own = arrivals.select("lane", "event_id", "t", "seconds").repartition("lane").sortWithinPartitions("lane", "t", "event_id")
    return own.mapInPandas(fold, "lane string, event_id long, t double, seconds double, admitted boolean")


def recent_ids(seen: DataFrame, most: int = 1000) -> DataFrame:
    """The ``most`` newest first sightings of ids (message_id, t): a repeat does not refresh its place."""
    return seen.groupBy("message_id").agg(F.min("t").alias("t")).orderBy(F.desc("t"), "message_id").limit(most)


SESSION_SCHEMA = "session_key string, turns array<struct<question:string,answer:string>>, summary string, summarised int, last_active double"


@dataclass
class Memory:
    """Rules of one session's memory; its state is a dict of turns (question, answer), summary and summarised.

    Beyond ``budget`` tokens the oldest turns go, at least one stays: with a
    summariser, facts are drawn from them and they become part of the summary; if
    it gives None they wait until three times the budget.
    """

    budget: int
    summariser: Summariser | None = None
    facts: Callable[[list[tuple[str, str]]], list[str]] | None = None
    count: Callable[[str], int] = len
    summary_chars: int = 1000

    @staticmethod
    def fresh() -> dict:
        return {"turns": [], "summary": "", "summarised": 0}

    def _size(self, turn: tuple[str, str]) -> int:
        return self.count(turn[0]) + self.count(turn[1])

    def _overflow(self, held: list[tuple[str, str]]) -> int:
        sizes = [self._size(t) for t in held]
        if len(held) < 2 or sum(sizes) <= self.budget:
            return 0
        kept, n = 0, 0
        for size in reversed(sizes):
            if n and kept + size > self.budget:
                break
            kept, n = kept + size, n + 1
        return len(held) - n

    def append(self, state: dict, question: str | None, answer: str | None) -> None:
        held = state["turns"]
        held.append((question or "", answer or ""))
        cut = self._overflow(held)
        if not cut:
            return
        if self.summariser is not None:
            old = held[:cut]
            made = self.summariser(state["summary"], old, self.facts(old) if self.facts else [])
            if made is None:
                if sum(map(self._size, held)) <= 3 * self.budget:
                    return
            else:
                state["summary"], state["summarised"] = made[: self.summary_chars], state["summarised"] + cut
        del held[:cut]


def fold_memory(
    turns: DataFrame, budget: int, summariser: Summariser | None = None, facts: Callable[[list[tuple[str, str]]], list[str]] | None = None, count: Callable[[str], int] = len, summary_chars: int = 1000, initial: DataFrame | None = None
) -> DataFrame:
    """State (``SESSION_SCHEMA``) of every session after its turns (session_key, turn, question, answer, t), by the rules of ``Memory``.

    ``initial`` has states to go on from. Turns are sorted within partitions and
    folded as a stream, so what a task holds is one session's state.
    """
    memory = Memory(budget, summariser, facts, count, summary_chars)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict | None = None
        done: list[tuple] = []
        row = lambda s: (s["key"], [{"question": q, "answer": a} for q, a in s["turns"]], s["summary"], s["summarised"], s["last"])
        names = [c.split()[0] for c in re.split(r", (?=\w+ )", SESSION_SCHEMA)]
        for frame in frames:
            for key, question, answer, t, saved, summary, n in zip(*(frame[c] for c in ("session_key", "question", "answer", "t", "saved", "summary", "summarised")), strict=True):
                if state is None or key != state["key"]:
                    done += [row(state)] if state else []
                    state = Memory.fresh() | {"key": key, "last": 0.0}
                if saved is not None:
                    state |= {"turns": [(x["question"], x["answer"]) for x in saved], "summary": summary or "", "summarised": int(n)}
                else:
                    memory.append(state, question, answer)
                state["last"] = t
            if len(done) >= 1000:
                yield pd.DataFrame(done, columns=names)
                done = []
        done += [row(state)] if state else []
        yield pd.DataFrame(done, columns=names)

    none = F.lit(None)
    fresh = turns.select("session_key", F.col("turn").cast("long").alias("turn"), "question", "answer", F.col("t").cast("double").alias("t"), none.cast("array<struct<question:string,answer:string>>").alias("saved"), none.cast("string").alias("summary"), none.cast("int").alias("summarised"))
    if initial is not None:
        fresh = fresh.unionByName(initial.select("session_key", F.lit(-(2**62)).alias("turn"), none.cast("string").alias("question"), none.cast("string").alias("answer"), F.col("last_active").alias("t"), F.col("turns").alias("saved"), "summary", "summarised"))
    return fresh.repartition("session_key").sortWithinPartitions("session_key", "turn").mapInPandas(fold, SESSION_SCHEMA)


def save_sessions(states: DataFrame, path: str, saved_at: float) -> None:
    states.select("session_key", F.to_json("turns").alias("turns"), "summary", "summarised", "last_active", F.lit(saved_at).alias("saved_at"), F.lit(False).alias("deleted")).write.mode("append").parquet(path)


def forget_session(spark: SparkSession, path: str, key: str, saved_at: float) -> None:
    schema = "session_key string, turns string, summary string, summarised int, last_active double, saved_at double, deleted boolean"
    spark.createDataFrame([(key, None, None, 0, 0.0, saved_at, True)], schema).write.mode("append").parquet(path)


def live_sessions(saved: DataFrame, now: float, ttl_s: float = 1800) -> DataFrame:
    """Last saved state of every session that was not deleted and not idle for longer; rows whose turns are no JSON are skipped."""
    turns = F.from_json("turns", "array<struct<question:string,answer:string>>")
    whole = saved.where(F.col("deleted") | F.try_parse_json("turns").isNotNull())
    last = whole.groupBy("session_key").agg(F.max_by(F.struct("turns", "summary", "summarised", "last_active", "deleted"), "saved_at").alias("s")).select("session_key", "s.*")
    return last.where(~F.col("deleted") & (now - F.col("last_active") <= ttl_s)).select("session_key", turns.alias("turns"), "summary", "summarised", "last_active")


# Query -----------------------------------------------------------------------
def q_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    return envelope(rows, "product_lookup", 3, ["p_partkey"]).select("operation", "row_count", F.array_join("rows", ";").alias("rows"))


QUERIES = {
    "business_envelope": (q_envelope, """SELECT 'product_lookup' AS operation, 3 AS row_count, string_agg(j, ';' ORDER BY j) AS rows FROM (SELECT '{"p_partkey":' || p_partkey || ',"p_size":' || p_size || '}' AS j FROM part ORDER BY p_partkey LIMIT 3)"""),
}
