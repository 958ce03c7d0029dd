"""Queries of operators whose inputs (logs, messages, points, calls) the tables do not hold as such: their columns are
derived from the tables, and the SQL derives what is due from the same rows by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.operators.assistant import (
    admitted,
    attaches_skill,
    display_label,
    fold_memory,
    guarded_calls,
    live_sessions,
    may_use,
    normalised_event,
    prompt,
    question_of,
    tool_call,
)
from skeinmill.operators.business import _WORDS, ORDER_NUMBER, SKU
from skeinmill.operators.ingest import best_record, resume_action
from skeinmill.operators.retrieval import base_filter, metadata_filter, scroll_by_doc
from skeinmill.runtime import table
from skeinmill.sources.objects import attachment_candidates, is_source_key, merged_index, path_part, safe_filename
from skeinmill.streaming.memory import conversation_turns, digest_summary

_T = "epoch_us(ts) / 1e6"


def _seconds():
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6


# Points ------------------------------------------------------------------------
def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", "left")
    tags = F.when(F.col("doc_id") % 7 > 0, F.array_compact(F.array(F.when(F.col("doc_id") % 2 == 0, "x"), F.when(F.col("doc_id") % 3 == 0, "y"), F.lit("z"))))
    return docs.select(
        F.concat(F.lit("p"), "doc_id").alias("id"), F.col("source").alias("doc_uuid"), F.col("doc_id").alias("chunk_index"), F.col("lang").alias("doc_type"),
        F.concat(F.lit("f"), F.col("doc_id") % 10, F.lit(".md")).alias("filename"), tags.alias("tags"), (F.col("toxic") == 1).alias("is_deleted"), F.concat(F.lit("t"), F.col("doc_id") % 2).alias("tenant_id"),
    )


def metadata_filter_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filter over all documents as points: a row a filter and point that passes."""
    asked = {
        "base": base_filter("t1"), "deleted": base_filter("t1", include_deleted=True), "any": base_filter(), "tags": base_filter() & metadata_filter(tags=("x", "y")),
        "all": base_filter("t0") & metadata_filter("src1", "en", "f4.md", ("x",)), "file": metadata_filter(filename="f3.md"),
    }
    rows = _points(spark, sf_dir).select("id", F.explode(F.array(*[F.when(c, n) for n, c in asked.items()])).alias("filter"))
    return rows.where("filter IS NOT NULL")


def scroll_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scroll_by_doc(_points(spark, sf_dir), 16).select("id", "page")


_FILTERS = """WITH t AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1), p AS (SELECT 'p' || doc_id AS id, doc_id AS i, source, lang, coalesce(toxic = 1, false) AS gone FROM documents LEFT JOIN t USING (doc_id))
    SELECT id, 'base' AS filter FROM p WHERE i % 2 = 1 AND NOT gone UNION ALL SELECT id, 'deleted' FROM p WHERE i % 2 = 1 UNION ALL SELECT id, 'any' FROM p WHERE NOT gone
    UNION ALL SELECT id, 'tags' FROM p WHERE NOT gone AND i % 6 = 0 AND i % 7 > 0 UNION ALL SELECT id, 'all' FROM p WHERE i % 2 = 0 AND NOT gone AND source = 'src1' AND lang = 'en' AND i % 10 = 4 AND i % 7 > 0
    UNION ALL SELECT id, 'file' FROM p WHERE i % 10 = 3"""
_PAGES = "SELECT 'p' || doc_id AS id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id, 'p' || doc_id) - 1) // 16)::INT AS page FROM documents"


# Logs --------------------------------------------------------------------------
def ingest_resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of their users' sources: what each customer's and user's source needs next."""
    ev = table(spark, sf_dir, "events")
    stage = F.element_at(F.array(*map(F.lit, ("raw", "markdown", "chunk", "vectorized", "other"))), (F.col("event_id") % 5 + 1).cast("int"))
    etag = F.when(F.col("event_id") % 11 > 0, F.concat(F.lit("e"), F.floor(F.col("value") / 40).cast("string")))
    log = ev.select(F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("key"), etag.alias("etag"), stage.alias("stage"))
    now = F.concat(F.lit("e"), F.col("c_custkey") % 3)
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), now.alias("now"))
    return sources.join(best_record(log), "key", "left").select("key", "stage", resume_action(F.col("stage"), F.col("etag"), F.col("now")).alias("action"))


_RESUME = """WITH l AS (SELECT event_id AS pos, user_id::VARCHAR AS key, CASE WHEN event_id % 11 > 0 THEN 'e' || floor(value / 40)::BIGINT END AS etag, (['raw', 'markdown', 'chunk', 'vectorized', 'other'])[event_id % 5 + 1] AS stage FROM events),
    g AS (SELECT *, CASE WHEN etag IS NOT DISTINCT FROM lag(etag) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM l WINDOW w AS (PARTITION BY key ORDER BY pos)),
    e AS (SELECT *, sum(c) OVER (PARTITION BY key ORDER BY pos) AS epoch FROM g),
    b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY epoch DESC, coalesce(list_position(['raw', 'markdown', 'chunk', 'vectorized'], stage), 0) DESC, pos DESC) = 1)
    SELECT s.key, b.stage, CASE WHEN etag IS NOT NULL AND etag <> now THEN 'full' WHEN stage = 'vectorized' THEN 'skip' WHEN stage = 'chunk' THEN 'vectorize' WHEN stage = 'markdown' THEN 'chunk' ELSE 'full' END AS action
    FROM (SELECT c_custkey::VARCHAR AS key, 'e' || c_custkey % 3 AS now FROM customer) s LEFT JOIN b USING (key)"""


def q_merged_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as three logs of rising rank over their users."""
    ev = table(spark, sf_dir, "events")
    logs = [ev.where(F.col("event_id") % 10 == n).select(F.when(F.col("user_id") % 9 > 0, F.col("user_id")).alias("key"), F.col("event_id").alias("pos"), F.col("event_type").alias("stage"), F.col("props").alias("etag")) for n in (0, 1, 2)]
    return merged_index(logs)


_MERGED = """SELECT user_id AS key, event_type AS stage, props AS etag FROM events WHERE event_id % 10 <= 2 AND user_id % 9 > 0
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 10 DESC, event_id DESC) = 1"""


# Guards ------------------------------------------------------------------------
def q_guard_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a call whose dates are derived from it: windows of -3 to 36 days, some of another pair or unreadable."""
    day, span = F.to_date("ts"), (F.col("event_id") % 40 - 3).cast("int")
    first, last = F.date_format(day, "yyyy-MM-dd"), F.date_format(F.date_add(day, span), "yyyy-MM-dd")
    pair = F.when(F.col("event_id") % 6 == 0, F.create_map(F.lit("from_time"), F.concat(first, F.lit("T00:00:00Z")), F.lit("to_time"), F.concat(last, F.lit(" 00:00"))))
    pair = pair.when(F.col("event_id") % 13 == 0, F.create_map(F.lit("start_date"), F.lit("soon"), F.lit("end_date"), last)).otherwise(F.create_map(F.lit("start_date"), first, F.lit("end_date"), last))
    calls = table(spark, sf_dir, "events").select("event_id", "user_id", _seconds().alias("t"), pair.alias("arguments"))
    return guarded_calls(calls, 30, 2, 36_000).select("event_id", "code")


_GUARDS = f"""WITH RECURSIVE j AS (SELECT event_id, user_id, {_T} AS t, CASE WHEN event_id % 13 = 0 AND event_id % 6 > 0 THEN 'ALLOW' WHEN event_id % 40 - 3 < 0 THEN 'INVALID_TIME_RANGE' WHEN event_id % 40 - 3 > 30 THEN 'TIME_RANGE_TOO_LARGE' ELSE 'ALLOW' END AS w FROM events),
    c AS (SELECT event_id, user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM j WHERE w = 'ALLOW'),
    r AS (SELECT event_id, user_id, t, i, true AS allowed, [t] AS held FROM c WHERE i = 1
      UNION ALL SELECT event_id, user_id, t, i, len(kept) < 2 AS allowed, CASE WHEN len(kept) < 2 THEN list_append(kept, t) ELSE kept END AS held
        FROM (SELECT c.event_id, c.user_id, c.t, c.i, list_filter(r.held, lambda x: x > c.t - 36000) AS kept FROM r JOIN c ON c.user_id = r.user_id AND c.i = r.i + 1))
    SELECT j.event_id, CASE WHEN NOT allowed THEN 'RATE_LIMIT_EXCEEDED' ELSE w END AS code FROM j LEFT JOIN r USING (event_id)"""


def q_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.element_at(F.array(F.lit("p2p"), F.lit("group"), F.lit(None).cast("string")), (F.col("conv_id") % 3 + 1).cast("int")).alias("chat"),
        F.when(F.col("turn") % 5 < 4, F.concat(F.lit("u"), F.col("turn") % 3)).alias("u"), F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("order "), F.col("text"))).otherwise(F.col("text")).alias("t"),
    )
    allowed = ("u1", "u2")
    return rows.select("conv_id", "turn", may_use(F.lit("business"), F.col("chat"), F.col("u"), allowed).alias("business"), may_use(F.lit("web"), F.col("chat"), F.col("u"), ()).alias("web"), attaches_skill(True, F.col("chat"), F.col("u"), allowed, F.col("t")).alias("attached"))


_PERMISSIONS = f"""WITH r AS (SELECT conv_id, turn, conv_id % 3 = 0 AND turn % 5 < 4 AND turn % 3 > 0 AS business, CASE WHEN conv_id % 4 = 0 THEN 'order ' || text ELSE text END AS text FROM conversations)
    SELECT conv_id, turn, business, true AS web, business AND coalesce(regexp_matches(text, '{SKU}') OR regexp_matches(text, '{ORDER_NUMBER}') OR {_WORDS}, false) AS attached FROM r"""


def q_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are lanes of one worker and a queue of one; work takes five to twenty hours."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("lane"), "event_id", _seconds().alias("t"), ((F.col("event_id") % 4 + 1) * 18_000).cast("double").alias("seconds"))
    return admitted(rows, workers=1, queue=1).select("event_id", "admitted")


_ADMITTED = f"""WITH RECURSIVE c AS (SELECT user_id, event_id, {_T} AS t, (event_id % 4 + 1) * 18000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT user_id, event_id, i, true AS admitted, [t + s] AS ends FROM c WHERE i = 1
      UNION ALL SELECT user_id, event_id, i, len(busy) < 2 AS admitted, CASE WHEN len(busy) < 2 THEN list_append(busy, coalesce(list_max(busy), t) + s) ELSE busy END AS ends
        FROM (SELECT c.*, list_filter(r.ends, lambda e: e > c.t) AS busy FROM r JOIN c ON c.user_id = r.user_id AND c.i = r.i + 1))
    SELECT event_id, admitted FROM r"""


# Messages ------------------------------------------------------------------------
def q_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as message events of three shapes, in private and group chats, some addressed to the bot, some no texts."""
    said = table(spark, sf_dir, "conversations").withColumn("said", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("@Bot "), F.col("text"))).otherwise(F.col("text")))
    chat = F.when(F.col("conv_id") % 2 == 0, "p2p").otherwise("group")
    content = F.when(F.col("conv_id") % 5 == 0, F.col("said")).otherwise(F.to_json(F.struct(F.col("said").alias("text"))))
    kind = F.when(F.col("turn") % 7 == 6, "image").otherwise("text")
    inner = lambda *more: F.struct(F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("message_id"), *more, kind.alias("message_type"), content.alias("content"))
    user = F.concat(F.lit("u"), F.col("conv_id"))
    one = F.to_json(F.struct(inner(chat.alias("chat_type")).alias("message"), F.struct(F.struct(user.alias("open_id")).alias("sender_id")).alias("sender")))
    two = F.to_json(F.struct(chat.alias("chat_type"), inner().alias("message"), F.struct(user.alias("open_id")).alias("sender")))
    events = said.select(F.when(F.col("conv_id") % 3 == 0, one).otherwise(two).alias("event"), (F.col("turn") % 3 == 0).alias("addressed"))
    rows = events.select(normalised_event(F.col("event")).alias("e"), "addressed").select("e.*", "addressed")
    mentioned = F.when(F.col("addressed"), F.array(F.lit("bot"))).otherwise(F.array().cast("array<string>"))
    asked = question_of(F.col("message_type"), F.col("chat_type"), F.col("text"), mentioned, F.array(F.lit("@Bot")), "bot")
    return rows.select("message_id", "chat_type", "open_id", F.md5(asked.cast("binary")).alias("question_md5"))


_INTAKE = r"""WITH s AS (SELECT *, CASE WHEN turn % 3 = 0 THEN '@Bot ' || text ELSE text END AS said FROM conversations),
    p AS (SELECT *, regexp_replace(said, '^\s+|\s+$', '', 'g') AS private, regexp_replace(regexp_replace(regexp_replace(replace(said, '@Bot', ''), '<at[^>]*>.*?</at>', '', 'g'), '^\s*@\S+\s*', ''), '^\s+|\s+$', '', 'g') AS bare FROM s)
    SELECT 'm-' || conv_id || '-' || turn AS message_id, CASE WHEN conv_id % 2 = 0 THEN 'p2p' ELSE 'group' END AS chat_type, 'u' || conv_id AS open_id,
      md5(CASE WHEN turn % 7 <> 6 THEN CASE WHEN conv_id % 2 = 0 THEN nullif(private, '') WHEN turn % 3 = 0 THEN bare END END) AS question_md5 FROM p"""


def q_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as arguments of calls, a fifth each broken, no object or missing."""
    part = table(spark, sf_dir, "part")
    n = F.col("p_partkey") % 5
    said = F.when(n == 0, F.concat(F.lit("{oops "), "p_partkey")).when(n == 1, F.concat(F.lit("["), F.col("p_partkey"), F.lit("]"))).when(n > 2, F.to_json(F.struct(F.col("p_name").alias("sku"), F.col("p_size").alias("size"))))
    return part.select("p_partkey", tool_call(said, "sku string, size int").alias("c")).select("p_partkey", F.col("c.arguments.sku").alias("sku"), F.col("c.arguments.size").alias("size"), "c.error")


_CALLS = """SELECT p_partkey, CASE WHEN p_partkey % 5 > 2 THEN p_name END AS sku, CASE WHEN p_partkey % 5 > 2 THEN p_size END AS size,
    CASE p_partkey % 5 WHEN 0 THEN 'invalid arguments: {oops ' || p_partkey WHEN 1 THEN 'invalid arguments: [' || p_partkey || ']' WHEN 2 THEN 'invalid arguments: null' END AS error FROM part"""


def q_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as messages: files (each twice), pictures with links, plain texts with links, and none."""
    n, i = F.col("page_id") % 4, F.col("page_id")
    file = F.to_json(F.named_struct(F.lit("file_key"), F.concat(F.lit("f"), i), F.lit("file_name"), F.concat(F.lit("a/"), i, F.when(i % 8 == 0, ".pdf").otherwise(".exe"))))
    post = F.concat(F.lit('{"body": [{"image_key": "i'), i, F.lit('"}, {"text": "see https://x.example/wiki/T'), i % 10, F.lit("?from=a and https://x.example/sheets/S"), i, F.lit('"}]}'))
    text = F.concat(F.lit("plain https://y.example/docx https://y.example/wiki/T"), i % 10)
    content, kind = F.when(n == 0, file).when(n == 1, post).when(n == 2, text), F.when(n == 0, "file").when(n == 1, "post").otherwise("text")
    twice = F.explode(F.when(n == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    messages = table(spark, sf_dir, "pages").select((i * 2).alias("at"), F.concat(F.lit("m"), i).alias("message_id"), kind.alias("msg_type"), content.alias("content"), twice.alias("again"))
    return attachment_candidates(messages.withColumn("pos", F.col("at") + F.col("again")))


_ATTACHED = """WITH p AS (SELECT page_id AS i, 'm' || page_id AS m FROM pages), w AS (SELECT i % 10 AS k, min(i) AS i FROM p WHERE i % 4 IN (1, 2) GROUP BY 1)
    SELECT m AS message_id, 'file' AS kind, 'f' || i AS key, 'a_' || i || CASE WHEN i % 8 = 0 THEN '.pdf' ELSE '.exe' END AS filename, i % 8 = 0 AS supported FROM p WHERE i % 4 = 0
    UNION ALL SELECT m, 'image', 'i' || i, m || '_image_i' || i || '.jpg', true FROM p WHERE i % 4 = 1
    UNION ALL SELECT m, 'linked sheet', 'S' || i, m || '_sheet_S' || i, true FROM p WHERE i % 4 = 1
    UNION ALL SELECT 'm' || i, 'linked wiki', 'T' || k, 'm' || i || '_wiki_T' || k, true FROM w"""


def object_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    place = F.element_at(F.array(*map(F.lit, ("raw/", "", "markdown/", "raw/", "logs/", "chunks/x/", "raw/."))), (i % 7 + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, (".PDF", ".exe", ".tar.md", "/", "", ".docx"))), (i % 6 + 1).cast("int"))
    key = F.when(i % 23 > 0, F.concat(place, i, ending))
    return table(spark, sf_dir, "pages").select("page_id", is_source_key(key).alias("wanted"), is_source_key(key, extensions=None).alias("staged"))


_PRUNED = """SELECT page_id, i % 23 > 0 AND i % 7 NOT IN (2, 4, 5) AND i % 6 <> 3 AND ((i % 6 IN (0, 2, 5))) AS wanted, i % 23 > 0 AND i % 7 NOT IN (2, 4, 5) AND i % 6 <> 3 AS staged FROM (SELECT page_id, page_id AS i FROM pages)"""


def q_safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages as names: between separators and blanks, and some too long or empty."""
    i, url = F.col("page_id"), F.col("url")
    name = F.when(i % 5 == 0, F.concat(F.lit(' /"'), url, F.lit("*. "))).when(i % 5 == 1, F.repeat(url, 9)).when(i % 5 == 2, F.lit(" ")).otherwise(url)
    return table(spark, sf_dir, "pages").select("page_id", safe_filename(name).alias("file"), path_part(name).alias("part"))


_NAMED = r"""WITH n AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN ' /"' || url || '*. ' WHEN 1 THEN repeat(url, 9) WHEN 2 THEN ' ' ELSE url END AS name FROM pages)
    SELECT page_id, coalesce(nullif(substr(trim(regexp_replace(name, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), ' .'), 1, 180), ''), 'download') AS file,
      coalesce(nullif(regexp_replace(trim(trim(coalesce(name, ''), ' ' || chr(9) || chr(13) || chr(10)), '/\'), '[<>:"\\|?*\x00]', '_', 'g'), ''), 'unknown') AS part FROM n"""


def q_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as hits whose sources and files name chats (their sources) and documents (nations)."""
    i = F.col("doc_id")
    file = F.when(i % 4 == 0, F.concat(F.lit("om_9_wiki_T"), i % 30, F.lit(".md"))).when(i % 4 == 1, F.concat(F.lit("om_9_om_8_plan"), i, F.lit(".txt"))).when(i % 4 == 2, "")
    hits = table(spark, sf_dir, "documents").select("doc_id", F.when(i % 3 > 0, F.concat(F.lit("raw/oc_"), "source", F.lit("/x"))).alias("source"), file.alias("filename"), F.when(i % 8 < 7, F.concat(F.lit("d"), i)).alias("doc_uuid"))
    chats = table(spark, sf_dir, "documents").select(F.concat(F.lit("oc_"), "source").alias("id"), F.upper("source").alias("name")).where("name > 'SRC1'").distinct()
    names = table(spark, sf_dir, "nation").select(F.concat(F.lit("T"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"))
    return display_label(hits, chats, names).select("doc_id", "label")


_LABELS = """WITH h AS (SELECT doc_id AS i, CASE WHEN doc_id % 3 > 0 AND upper(source) > 'SRC1' THEN upper(source) END AS chat,
      CASE doc_id % 4 WHEN 0 THEN 'om_9_wiki_T' || doc_id % 30 || '.md' WHEN 1 THEN 'om_9_om_8_plan' || doc_id || '.txt' WHEN 2 THEN '' END AS file FROM documents),
    d AS (SELECT i, chat, file, CASE i % 4 WHEN 0 THEN coalesce(n_name, '.md') WHEN 1 THEN 'plan' || i || '.txt' END AS doc FROM h LEFT JOIN nation ON i % 4 = 0 AND n_nationkey = i % 30)
    SELECT i AS doc_id, coalesce(nullif(concat_ws(' / ', chat, doc), ''), nullif(file, ''), CASE WHEN i % 8 < 7 THEN 'd' || i END, '未知来源') AS label FROM d"""


def q_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's first turns as history, its last question, and its long texts as blocks."""
    pairs = conversation_turns(spark, sf_dir).withColumn("answer", F.coalesce("answer", F.lit("")))
    turn = F.struct("turn", "question", "answer")
    own = pairs.groupBy("session_key").agg(
        F.array_sort(F.collect_list(F.when(F.col("turn") < 4, turn))).alias("said"), F.max_by("question", "turn").alias("q"), F.array_sort(F.collect_list(F.when(F.length("question") > 60, turn))).alias("long")
    )
    history = F.transform("said", lambda t: F.struct(t["question"].alias("question"), t["answer"].alias("answer")))
    text = prompt(F.when(F.col("session_key") % 2 == 0, F.concat(F.lit("conversation "), "session_key")), history, F.col("q"), F.transform("long", lambda t: t["question"]))
    return own.select("session_key", F.md5(text.cast("binary")).alias("prompt_md5"))


_PROMPT = """WITH p AS (SELECT conv_id AS k, turn, text AS q, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS a FROM conversations),
    t AS (SELECT k, string_agg('Q: ' || q || chr(10) || 'A: ' || a, chr(10) ORDER BY turn) FILTER (turn < 4) AS said, arg_max(q, turn) AS last FROM p WHERE turn % 2 = 0 GROUP BY 1),
    b AS (SELECT k, string_agg('[' || n || '] ' || q, chr(10) || chr(10) ORDER BY turn) AS listed FROM (SELECT k, turn, q, row_number() OVER (PARTITION BY k ORDER BY turn) AS n FROM p WHERE turn % 2 = 0 AND length(q) > 60) GROUP BY 1)
    SELECT k AS session_key, md5(array_to_string(list_filter([CASE WHEN k % 2 = 0 THEN 'conversation ' || k END, said, last, listed], lambda x: coalesce(x, '') <> ''), chr(10) || chr(10))) AS prompt_md5 FROM t LEFT JOIN b USING (k)"""


# Memory --------------------------------------------------------------------------
BUDGET = 700


def q_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations trimmed, summarised with facts, and with a summariser that fails."""
    turns = conversation_turns(spark, sf_dir).withColumn("session_key", F.col("session_key").cast("string"))
    ways = {"trim": fold_memory(turns, BUDGET), "sum": fold_memory(turns, BUDGET, digest_summary, lambda t: ["!"] * len(t)), "fail": fold_memory(turns, BUDGET, lambda s, t, f: None)}
    out = None
    for name, states in ways.items():
        rows = states.select(F.lit(name).alias("way"), "session_key", F.size("turns").alias("kept"), "summary", "summarised")
        out = rows if out is None else out.unionByName(rows)
    return out


_CUT = f"(len(held) - greatest(1, len(list_filter(range(1, len(held) + 1), lambda j: list_sum(held[j:]) <= {BUDGET}))))::INT"
_FOLDED = f"""WITH RECURSIVE p AS (SELECT conv_id AS k, turn, length(text) + length(coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '')) AS n FROM conversations),
    c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn) AS i FROM p WHERE turn % 2 = 0),
    r AS (SELECT way, k, i, [n]::BIGINT[] AS held, '' AS summary, 0 AS summarised FROM c, (VALUES ('trim'), ('sum'), ('fail')) v(way) WHERE i = 1
      UNION ALL SELECT way, k, i, held[cut + 1:] AS held, CASE WHEN way = 'sum' AND cut > 0 THEN summary || '+' || cut || ':' || list_sum(held[1:cut])::BIGINT ELSE summary END AS summary, CASE WHEN way = 'sum' THEN summarised + cut ELSE summarised END::INT AS summarised
        FROM (SELECT *, CASE WHEN way = 'fail' AND list_sum(held) <= {3 * BUDGET} THEN 0 ELSE {_CUT} END AS cut
          FROM (SELECT r.way, c.k, c.i, list_append(r.held, c.n) AS held, r.summary, r.summarised FROM r JOIN c ON c.k = r.k AND c.i = r.i + 1)))
    SELECT way, k::VARCHAR AS session_key, len(held)::INT AS kept, summary, summarised FROM r QUALIFY row_number() OVER (PARTITION BY way, k ORDER BY i DESC) = 1"""


def q_live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state saved after every turn, some of them no JSON and some sessions deleted at the end; those that a start recovers."""
    turns = conversation_turns(spark, sf_dir)
    k, turn = F.col("session_key"), F.col("turn")
    held = F.to_json(F.transform(F.sequence(F.lit(0), (turn / 2).cast("int")), lambda i: F.struct(i.cast("string").alias("question"), F.lit("a").alias("answer"))))
    saved = turns.select(k.cast("string").alias("session_key"), F.when((k + turn) % 5 == 0, "{broken").otherwise(held).alias("turns"), F.concat(F.lit("s"), turn).alias("summary"), turn.cast("int").alias("summarised"), F.col("t").alias("last_active"), turn.cast("double").alias("saved_at"), F.lit(False).alias("deleted"))
    gone = turns.where(k % 6 == 0).groupBy(k.cast("string").alias("session_key")).agg(F.lit(None).cast("string").alias("turns"), F.lit(None).cast("string").alias("summary"), F.lit(0).alias("summarised"), F.lit(0.0).alias("last_active"), F.lit(1e9).alias("saved_at"), F.lit(True).alias("deleted"))
    return live_sessions(saved.unionByName(gone), 1_700_002_500.0).select("session_key", F.size("turns").alias("kept"), "summary", "summarised")


_LIVE = """WITH s AS (SELECT conv_id AS k, turn, 1700000000 + turn * 360 + CASE WHEN conv_id % 5 = 0 AND turn >= 4 THEN 3600 ELSE 0 END + conv_id % 7 AS t FROM conversations WHERE turn % 2 = 0 AND (conv_id + turn) % 5 <> 0),
    l AS (SELECT * FROM s WHERE k % 6 <> 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY turn DESC) = 1)
    SELECT k::VARCHAR AS session_key, (turn // 2 + 1)::INT AS kept, 's' || turn AS summary, turn::INT AS summarised FROM l WHERE 1700002500 - t <= 1800"""
QUERIES = {
    "metadata_filter_tags": (metadata_filter_tags, _FILTERS),
    "scroll_by_document": (scroll_pages, _PAGES),
    "ingest_resume_plan": (ingest_resume_plan, _RESUME),
    "merged_index": (q_merged_index, _MERGED),
    "business_guard_chain": (q_guard_chain, _GUARDS),
    "tool_permissions": (q_permissions, _PERMISSIONS),
    "admission_control": (q_admission, _ADMITTED),
    "message_intake": (q_intake, _INTAKE),
    "tool_call_arguments": (q_tool_calls, _CALLS),
    "attachment_candidates": (q_attachments, _ATTACHED),
    "object_pruning": (object_pruning, _PRUNED),
    "safe_names": (q_safe_names, _NAMED),
    "display_labels": (q_labels, _LABELS),
    "prompt_assembly": (q_prompt, _PROMPT),
    "memory_summary": (q_memory, _FOLDED),
    "session_recovery": (q_live_sessions, _LIVE),
}
