"""Worked examples of operators: freshly written rows and what is due for them."""

import duckdb
import pytest

from skeinmill.operators.assistant import *  # noqa: F403
from skeinmill.operators.ingest import *  # noqa: F403
from skeinmill.operators.retrieval import *  # noqa: F403
from skeinmill.operators.structure import values_sql
from skeinmill.sources.objects import *  # noqa: F403

_CALLS: list[tuple[int, str, float, dict[str, str], str]] = [
    (1, "a", 0.0, {"start_date": "2024-01-01", "end_date": "2024-01-31"}, "ALLOW"), (2, "a", 1.0, {"start_date": "2024-01-01", "end_date": "2024-02-01"}, "TIME_RANGE_TOO_LARGE"),
    (3, "a", 2.0, {"from_time": "2024-01-02T00:00:00Z", "to_time": "2024-01-01T23:59:59+08:00"}, "INVALID_TIME_RANGE"), (4, "a", 3.0, {"start_date": "soon", "end_date": "2024-02-01"}, "ALLOW"),
    (5, "a", 4.0, {"updated_at_start": "2024-01-01 00:00", "updated_at_end": "2024-01-31T00:00:00.000001"}, "TIME_RANGE_TOO_LARGE"), (6, "a", 5.0, {}, "ALLOW"), (7, "a", 6.0, {}, "RATE_LIMIT_EXCEEDED"),
    (8, "a", 60.0, {}, "ALLOW"), (9, "b", 6.0, {"created_start": "2024-02-30", "created_end": "2024-03-01", "begin_date": "2024-03-01"}, "ALLOW"),
]


def q_guard_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = spark.createDataFrame([(i, {"a": 1, "b": 2}[u], t, a) for i, u, t, a, _ in _CALLS], "event_id long, user_id long, t double, arguments map<string,string>")
    return guarded_calls(calls).select("event_id", "code")


_EVENTS = [
    ('{"message": {"message_id": "m1", "chat_type": "p2p", "message_type": "text", "content": "{\\"text\\": \\" hi \\"}"}, "sender": {"sender_id": {"open_id": "u1"}}}', "m1", "p2p", "u1", "hi"),
    ('{"chat_type": "group", "message": {"message_id": "m2", "message_type": "text", "content": "@Bot what now"}, "sender": {"open_id": "u2"}}', "m2", "group", "u2", "what now"),
    ('{"message": {"message_id": "m3", "chat_type": "p2p", "message_type": "image", "content": null}}', "m3", "p2p", None, None),
]


def q_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(e[0],) for e in _EVENTS], "event string").select(normalised_event(F.col("event")).alias("e")).select("e.*")
    return rows.select("message_id", "chat_type", "open_id", question_of(F.col("message_type"), F.col("chat_type"), F.col("text"), F.array(F.lit("bot")), F.array(F.lit("@Bot")), "bot").alias("question"))


_MEMORY = [("a", i, "q" * 10, "r" * 20, float(i)) for i in range(6)] + [("b", 0, "x" * 250, "y" * 250, 7.0), ("c", 0, "one", "two", 8.0)]


def _joined(summary: str, turns: list[tuple[str, str]], found: list[str]) -> str:
    return f"{summary}+{len(turns)}" + "".join(found)


def q_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed, summarised with facts, and with a summariser that fails."""
    turns = spark.createDataFrame(_MEMORY, "session_key string, turn int, question string, answer string, t double")
    ways = {"trim": fold_memory(turns, 100), "sum": fold_memory(turns, 100, _joined, lambda t: ["!"] * len(t)), "fail": fold_memory(turns, 50, lambda s, t, f: None)}
    out = None
    for name, states in ways.items():
        rows = states.select(F.lit(name).alias("way"), "session_key", F.size("turns").alias("kept"), "summary", "summarised")
        out = rows if out is None else out.unionByName(rows)
    return out


def q_live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = '[{"question": "q", "answer": "a"}]'
    saved = [("a", one, "old", 0, 10.0, 1.0, False), ("a", one, "new", 2, 20.0, 2.0, False), ("b", "{broken", "", 0, 20.0, 1.0, False), ("c", one, "", 0, 20.0, 1.0, False), ("c", None, None, 0, 0.0, 2.0, True), ("d", one, "", 0, -1781.0, 1.0, False), ("e", one, "", 0, -1780.0, 1.0, False)]
    states = live_sessions(spark.createDataFrame(saved, "session_key string, turns string, summary string, summarised int, last_active double, saved_at double, deleted boolean"), 20.0)
    after = fold_memory(spark.createDataFrame([("a", 5, "q2", "a2", 30.0)], "session_key string, turn int, question string, answer string, t double"), 100, initial=states)
    return after.select("session_key", F.size("turns").alias("kept"), "summary", "summarised")


def q_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, '{"sku": "A-1"}'), (2, "{oops"), (3, "[1]"), (4, None)], "n int, j string")
    return rows.select("n", tool_call(F.col("j"), "sku string").alias("c")).select("n", F.col("c.arguments.sku").alias("sku"), "c.error")


def q_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "p2p", "u1", "库存 SKU-9"), (2, "group", "u1", "库存"), (3, "p2p", "u2", "order SO-20240001"), (4, "p2p", "u1", "good morning"), (5, None, None, None)], "n int, chat string, u string, t string")
    return rows.select("n", may_use(F.lit("business"), F.col("chat"), F.col("u"), ("u1",)).alias("business"), may_use(F.lit("web"), F.col("chat"), F.col("u"), ()).alias("web"), attaches_skill(True, F.col("chat"), F.col("u"), ("u1",), F.col("t")).alias("attached"))


def q_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("x", i, float(t), 10.0) for i, t in enumerate([0, 0, 1, 2, 10, 10, 25])], "lane string, event_id long, t double, seconds double")
    return admitted(rows, workers=1, queue=1).select("event_id", "admitted")


def q_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = spark.createDataFrame([(1, "raw/oc_ab1/om_9_wiki_T1.md", "om_9_wiki_T1.md", "d1"), (2, "raw/x", "om_9_om_8_plan.md", "d2"), (3, None, None, "d3"), (4, None, "", None)], "n int, source string, filename string, doc_uuid string")
    names = lambda rows: spark.createDataFrame(rows, "id string, name string")
    return display_label(hits, names([("oc_ab1", "Team")]), names([("T1", "Handbook")])).select("n", "label")


def q_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "head", [("q", "a")], "now?", ["x", "y"]), (2, None, [], "now?", [])], "n int, h string, t array<struct<question:string,answer:string>>, q string, b array<string>")
    return rows.select("n", prompt(F.col("h"), F.col("t"), F.col("q"), F.col("b")).alias("prompt"))


_KEY_CASES = [("raw/a.PDF", True, True), ("raw/", False, False), ("", False, False), (None, False, False), ("markdown/a.md", False, False), ("raw/x.exe", False, True), ("raw/.md", False, True), ("raw/b.tar.md", True, True)]


def object_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame([(i, k) for i, (k, _, _) in enumerate(_KEY_CASES)], "n int, key string")
    return keys.select("n", is_source_key(F.col("key")).alias("wanted"), is_source_key(F.col("key"), extensions=None).alias("staged"))


_MESSAGES = [
    (1, "m1", "file", '{"file_key": "f1", "file_name": "a/b.pdf"}'), (2, "m1", "file", '{"file_key": "f1", "file_name": "a/b.pdf"}'), (3, "m2", "post", '{"body": [{"image_key": "i1"}, {"text": "see https://x.example/wiki/T1?from=a and https://x.example/sheets/S1"}]}'),
    (4, "m3", "text", "plain https://y.example/wiki/T1 https://y.example/docx"), (5, "m4", "file", '{"file_key": "f2", "file_name": "run.exe"}'), (6, "m5", "text", None),
]
_FOUND = [("m1", "file", "f1", "a_b.pdf", True), ("m2", "image", "i1", "m2_image_i1.jpg", True), ("m2", "linked wiki", "T1", "m2_wiki_T1", True), ("m2", "linked sheet", "S1", "m2_sheet_S1", True), ("m4", "file", "f2", "run.exe", False)]


def q_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attachment_candidates(spark.createDataFrame(_MESSAGES, "pos long, message_id string, msg_type string, content string"))


_NAMES = [(' a<b>:"/c. ', "a_b____c", ' a_b___/c. '.strip()), ("", "download", "unknown"), (None, "download", "unknown"), ("/x/y\\", "_x_y_", "x/y"), ("n" * 200, "n" * 180, "n" * 200)]


def q_safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, n) for i, (n, _, _) in enumerate(_NAMES)], "n int, name string")
    return rows.select("n", safe_filename(F.col("name")).alias("file"), path_part(F.col("name")).alias("part"))


def q_merged_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = lambda rows: spark.createDataFrame(rows, "key string, pos long, stage string, etag string")
    return merged_index([log([("a", 1, "raw", "e1"), ("b", 2, "raw", "e1"), ("b", 9, "raw", "e2"), (None, 3, "raw", "x")]), log([("a", 1, "markdown", "e1")]), log([("c", 5, "chunk", None), ("a", 0, "chunk", "e0")])])


_POINTS = [
    ("d", 0, "p0", "pdf", "a.pdf", ["x", "y"], None, "t1"), ("d", 1, "p1", "pdf", "a.pdf", ["x"], False, "t1"), ("d", 2, "p2", "pdf", "a.pdf", ["y", "x", "z"], True, "t1"),
    ("e", 0, "p3", "md", "b.md", None, None, "t1"), ("e", 1, "p4", "pdf", "a.pdf", ["y", "x"], None, "t2"), ("e", 2, "p5", "pdf", None, ["x", "y"], None, None),
]


def _sample_points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_POINTS, "doc_uuid string, chunk_index int, id string, doc_type string, filename string, tags array<string>, is_deleted boolean, tenant_id string")


def metadata_filter_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filter over sample points: one row a filter and point that passes."""
    asked = {
        "base": base_filter("t1"), "deleted": base_filter("t1", include_deleted=True), "any": base_filter(), "tags": base_filter() & metadata_filter(tags=("x", "y")),
        "all": base_filter("t1") & metadata_filter("d", "pdf", "a.pdf", ("x",)), "file": metadata_filter(filename="a.pdf"),
    }
    rows = _sample_points(spark).select("id", F.explode(F.array(*[F.when(c, n) for n, c in asked.items()])).alias("filter"))
    return rows.where("filter IS NOT NULL")


def scroll_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scroll_by_doc(_sample_points(spark), 2).select("id", "page")


LOG = [(1, "a", "e1", "markdown"), (2, "a", "e1", "raw"), (3, "b", "e1", "chunk"), (4, "b", "e2", "raw"), (5, "c", "e1", "chunk"), (6, "c", "e1", "chunk"), (7, "d", None, "raw"), (8, "d", None, "markdown"), (9, "e", "e1", "vectorized")]


def ingest_resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources against the log: skip what is vectorised, chunk what is converted, convert the rest."""
    current = best_record(spark.createDataFrame(LOG, "pos long, key string, etag string, stage string"))
    sources = spark.createDataFrame([(k, "e1") for k in "abcdef"], "key string, now string")
    action = resume_action(F.col("stage"), F.col("etag"), F.col("now"))  # noqa: F405
    return sources.join(current, "key", "left").select("key", "stage", action.alias("action"))


_LOG = ", ".join(f"({p}, '{k}', {repr(e) if e else 'NULL'}, '{s}')" for p, k, e, s in LOG)

EXAMPLES = {
    "ingest_resume_plan": (ingest_resume_plan, f"""WITH g AS (SELECT *, CASE WHEN etag IS NOT DISTINCT FROM lag(etag) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM (VALUES {_LOG}) v(pos, key, etag, stage) WINDOW w AS (PARTITION BY key ORDER BY pos)),
        e AS (SELECT *, sum(c) OVER (PARTITION BY key ORDER BY pos) AS epoch FROM g),
        b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY epoch DESC, list_position(['raw', 'markdown', 'chunk', 'vectorized'], stage) DESC, pos DESC) = 1)
        SELECT s.key, b.stage, CASE WHEN etag IS NOT NULL AND etag <> 'e1' THEN 'full' WHEN stage = 'vectorized' THEN 'skip' WHEN stage = 'chunk' THEN 'vectorize' WHEN stage = 'markdown' THEN 'chunk' ELSE 'full' END AS action
        FROM (SELECT unnest(['a', 'b', 'c', 'd', 'e', 'f']) AS key) s LEFT JOIN b USING (key)"""),
    "business_guard_chain": (q_guard_chain, values_sql(("event_id", "code"), [(i, c) for i, _, _, _, c in _CALLS])),
    "message_intake": (q_intake, values_sql(("message_id", "chat_type", "open_id", "question"), [e[1:] for e in _EVENTS])),
    "memory_summary": (q_memory, values_sql(("way", "session_key", "kept", "summary", "summarised"), [
        ("trim", "a", 3, "", 0), ("trim", "b", 1, "", 0), ("trim", "c", 1, "", 0), ("sum", "a", 3, "+1!+1!+1!", 3), ("sum", "b", 1, "", 0), ("sum", "c", 1, "", 0), ("fail", "a", 1, "", 0), ("fail", "b", 1, "", 0), ("fail", "c", 1, "", 0)])),
    "session_recovery": (q_live_sessions, values_sql(("session_key", "kept", "summary", "summarised"), [("a", 2, "new", 2), ("e", 1, "", 0)])),
    "tool_call_arguments": (q_tool_calls, values_sql(("n", "sku", "error"), [(1, "A-1", None), (2, None, "invalid arguments: {oops"), (3, None, "invalid arguments: [1]"), (4, None, "invalid arguments: null")])),
    "tool_permissions": (q_permissions, "SELECT * FROM (VALUES (1, true, true, true), (2, false, true, false), (3, false, true, false), (4, true, true, false), (5, false, true, false)) v(n, business, web, attached)"),
    "admission_control": (q_admission, "SELECT * FROM (VALUES (0, true), (1, true), (2, false), (3, false), (4, true), (5, false), (6, true)) v(event_id, admitted)"),
    "display_labels": (q_labels, values_sql(("n", "label"), [(1, "Team / Handbook"), (2, "plan.md"), (3, "d3"), (4, "未知来源")])),
    "prompt_assembly": (q_prompt, values_sql(("n", "prompt"), [(1, "head\n\nQ: q\nA: a\n\nnow?\n\n[1] x\n\n[2] y"), (2, "now?")])),
    "object_pruning": (object_pruning, "SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (_, a, b) in enumerate(_KEY_CASES)) + ") v(n, wanted, staged)"),
    "attachment_candidates": (q_attachments, "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{k}', '{x}', '{f}', {s})" for m, k, x, f, s in _FOUND) + ") v(message_id, kind, key, filename, supported)"),
    "safe_names": (q_safe_names, values_sql(("n", "file", "part"), [(i, f, p) for i, (_, f, p) in enumerate(_NAMES)])),
    "merged_index": (q_merged_index, "SELECT * FROM (VALUES ('a', 'chunk', 'e0'), ('b', 'raw', 'e2'), ('c', 'chunk', NULL)) v(key, stage, etag)"),
    "metadata_filter_tags": (metadata_filter_tags, values_sql(("filter", "id"), [(f, i) for f, ids in {"base": "013", "deleted": "0123", "any": "01345", "tags": "045", "all": "01", "file": "0124"}.items() for i in (f"p{n}" for n in ids)])),
    "scroll_by_document": (scroll_pages, values_sql(("id", "page"), [("p0", 0), ("p1", 0), ("p2", 1), ("p3", 0), ("p4", 0), ("p5", 1)])),
}


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_example(spark, name):
    query, sql = EXAMPLES[name]
    df = query(spark, "")
    found = duckdb.connect().execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr([r[c] for c in names]) for r in df.collect()) == sorted(repr(list(r)) for r in found.fetchall())
