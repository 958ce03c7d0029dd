"""Secret scan with corpus-wide ownership frequency, in DataFrame expressions only.

Patterns find candidates in every text. The hash of each candidate's value is
then counted over the whole corpus by distinct owners and repositories: a value
that many owners share is a widely copied example; one that stays with an owner
looks live. The base patterns' spans are always reported; weaker candidates
(opaque mixed-case tokens) are added as spans only if their frequency says that
they belong to one owner.

Positions come from pairing all matches with the gaps between them, which one
find and one split of the same pattern give, so they are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.runtime import settle, table

#: kind, pattern, group with the value, least characters of the value; fixed values of the task.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
WEAK = (("opaque", r"[A-Za-z0-9_-]{32,}", 0, 32),)
_RUN = 1000
_SPAN = "array<struct<start:long,order:int,end:long,kind:string,hash:string>>"


def _starts(lengths: str) -> str:
    """SQL for the running sums before each element of an array of longs, in runs so that no long array is copied often."""
    run = "(acc, x) -> array_append(acc, element_at(acc, -1) + x)"
    chunks = f"transform(sequence(0, (size({lengths}) - 1) div {_RUN}), c -> slice({lengths}, c * {_RUN} + 1, {_RUN}))"
    offsets = f"aggregate(transform({chunks}, ch -> aggregate(ch, 0L, (a, x) -> a + x)), array(0L), {run})"
    return f"transform(array({offsets}), o -> flatten(transform({chunks}, (ch, c) -> slice(aggregate(ch, array(o[c]), {run}), 1, size(ch)))))[0]"


def _spans(df: DataFrame, kinds, first: int, out: str) -> DataFrame:
    """Adds the array ``out`` of spans (start, order, end, kind, hash of the value) of ``kinds`` in column text, by start then kind."""
    found = []
    for i, (kind, pattern, group, least) in enumerate(kinds):
        hit, gap, value, lens = (f"{out}_{kind}_{x}" for x in ("hit", "gap", "value", "len"))
        p = F.lit(pattern)
        df = df.withColumn(hit, F.regexp_extract_all("text", p, F.lit(0)))
        some = F.size(hit) > 0
        df = df.withColumn(gap, F.when(some, F.split("text", pattern, -1)))
        df = df.withColumn(value, F.col(hit) if group == 0 else F.when(some, F.regexp_extract_all("text", p, F.lit(group))))
        df = df.withColumn(lens, F.when(some, F.expr(f"zip_with({hit}, slice({gap}, 1, size({hit})), (m, g) -> cast(length(m) + length(g) AS long))")))
        df = df.withColumn(f"{lens}_at", F.when(some, F.expr(_starts(lens))))
        each = f"""transform({hit}, (m, i) -> struct({lens}_at[i] + length({gap}[i]) AS start, {first + i} AS order,
            {lens}_at[i] + {lens}[i] AS end, '{kind}' AS kind, {value}[i] AS value))"""
        kept = f"filter({each}, s -> length(s.value) >= {least})"
        hashed = f"transform({kept}, s -> struct(s.start AS start, s.order AS order, s.end AS end, s.kind AS kind, sha2(s.value, 256) AS hash))"
        if kind == "opaque":
            hashed = hashed.replace(f"length(s.value) >= {least}", "s.value rlike '[0-9]' AND s.value rlike '[A-Z]' AND s.value rlike '[a-z]'")
        found.append(F.coalesce(F.when(some, F.expr(hashed)).cast(_SPAN), F.array().cast(_SPAN)))
    return df.withColumn(out, F.array_sort(F.concat(*found)))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _evidence(docs: DataFrame, owner: Column, repository: Column, id_col: str, text_col: str, max_owners: int, max_repositories: int) -> tuple[DataFrame, DataFrame]:
    """All candidates per row (doc_id, t, base, weak), and per id and text (by its hash t) with any a map from the hashes of
    its live ones to their owners' number. So a map holds what one text does, however many rows share an id or have none."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), name(owner).alias("owner"), name(repository).alias("repository"))
    found = _spans(_spans(own, BASE, 0, "base"), WEAK, len(BASE), "weak").select("doc_id", F.xxhash64("text").alias("t"), "owner", "repository", "base", "weak")
    found = settle(found, "secret-spans")
    held = found.where((F.size("base") > 0) | (F.size("weak") > 0)).select("doc_id", "t", "owner", "repository", F.explode(F.concat("base", "weak")).alias("s"))
    held = held.select("doc_id", "t", "owner", "repository", F.col("s.hash").alias("hash"))
    spread = held.select("hash", "owner", "repository").distinct()
    owners = spread.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("n_owners"))
    repositories = spread.select("hash", "repository").distinct().groupBy("hash").agg(F.count("*").alias("n_repositories"))
    live = owners.join(repositories, "hash").where((F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories))
    per_doc = held.select("doc_id", "t", "hash").distinct().join(live, "hash").groupBy("doc_id", "t").agg(
        F.map_from_entries(F.collect_list(F.struct("hash", "n_owners"))).alias("live")
    )
    return found, per_doc.select(F.col("doc_id").alias("live_id"), F.col("t").alias("live_t"), "live")


def scan_secrets(
    docs: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text", max_owners: int = 2, max_repositories: int = 4
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, live_spans.

    ``spans`` lists kind:start:end of base spans and added ones by start, then
    kind. A candidate is live if at most ``max_owners`` owners and
    ``max_repositories`` repositories hold its value, else an example; weak
    candidates are added if live and held by one owner. ``live_spans`` has the
    places of the live ones. Null texts are empty; a null owner or repository is
    one of its own; rows are judged by themselves, so repeated and null ids give
    a row each. An empty table gives an empty result.
    """
    found, per_doc = _evidence(docs, owner, repository, id_col, text_col, max_owners, max_repositories)
    joined = found.join(per_doc, F.col("doc_id").eqNullSafe(F.col("live_id")) & (F.col("t") == F.col("live_t")), "left")
    joined = joined.withColumn("live", F.coalesce("live", F.create_map().cast("map<string,bigint>")))
    joined = joined.withColumn("added", F.filter("weak", lambda s: F.col("live")[s["hash"]] == 1))
    joined = joined.withColumn("all", F.array_sort(F.concat("base", "added")))
    is_live = lambda s: F.map_contains_key("live", s["hash"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return joined.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("all")).alias("spans"),
        F.size(F.filter("all", is_live)).cast("long").alias("n_live"),
        F.size(F.filter("all", lambda s: ~is_live(s))).cast("long").alias("n_example"),
        F.transform(F.filter("all", is_live), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("live_spans"),
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span (by start; they may overlap) replaced by ``mark``."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.when(s["start"] >= acc["at"], mark).otherwise("")).alias("out"))
        return F.when(s["end"] <= acc["at"], acc).otherwise(fresh)

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))


def redact_live(
    docs: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text", max_owners: int = 2, max_repositories: int = 4, mark: str = "[SECRET]"
) -> DataFrame:
    """All rows and columns of ``docs`` with the live secrets of ``text_col`` replaced by ``mark``; examples stay."""
    _, per_doc = _evidence(docs, owner, repository, id_col, text_col, max_owners, max_repositories)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col(f"row.{text_col}")
    same = F.col(f"row.{id_col}").eqNullSafe(F.col("live_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("live_t"))
    joined = row.join(settle(per_doc, "secret-live"), same, "left")
    joined = joined.withColumn("text", F.when(F.col("live").isNotNull(), F.coalesce(text, F.lit(""))).otherwise(""))
    spans = _spans(_spans(joined, BASE, 0, "base"), WEAK, len(BASE), "weak")
    live = F.concat(F.filter("base", lambda s: F.map_contains_key("live", s["hash"])), F.filter("weak", lambda s: F.col("live")[s["hash"]] == 1))
    clean = F.when(F.col("live").isNotNull() & text.isNotNull(), redact(F.col("text"), F.array_sort(live), mark)).otherwise(text)
    done = spans.withColumn("clean", clean)
    return done.select(*[F.col("clean").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners are the sources; a repository is a source's documents in one language."""
    repository = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return scan_secrets(table(spark, sf_dir, "documents"), F.col("source"), repository).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example")


ORACLE = None
