"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Every ``window`` consecutive words have window - gram + 1 overlapping grams, and
the smallest gram hash of each such run is kept as a fingerprint (with all its
ties). A passage of ``window`` words that training and test text share has the
same smallest hash in both, so a join of the fingerprints misses none of them,
while far fewer positions than words are joined. A hit is extended to the
windows that hold its position, and each of those is looked up by the digest of
its words among the distinct windows of the test items.

No step multiplies: test fingerprints and windows are distinct before they are
joined, so a document gives at most a row for each of its positions, however many
items share a passage and however many documents hold it. The ids of items
are attached to distinct sets of windows' owners, not document by document.

Items of fewer words than a window are one window of their own length; for every
such length that occurs (fewer than ``window``) all word runs of it are
fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.runtime import settle, table

#: What parts words, after A-Z are lower-cased; fixed by the task.
SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of ``text`` in order; none for null. Only A-Z are lower-cased."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    none = F.array().cast("array<string>")
    return _let(F.btrim(F.coalesce(low, F.lit("")), F.lit(SEPARATORS)), lambda s: F.when(s == "", none).otherwise(F.split(s, _SEPARATOR)))


def _upto(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _run_hash(w: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(w, at + i) for i in range(n)])


def _fingerprints(w: Column, window: int, gram: int, short: list[int]) -> Column:
    """Structs (fp, at, n): the winnowed grams of a text's words (n = window), and all runs of each length in ``short``."""
    span = window - gram + 1
    kind = "array<struct<fp:bigint,at:int,n:int>>"

    def kept(g: Column) -> Column:
        least = F.transform(_upto(F.size(g) - span + 1), lambda j: F.least(*[F.get(g, j + i) for i in range(span)]))
        return _let(least, lambda m: F.filter(_upto(F.size(g)), lambda i: F.get(g, i) == F.greatest(*[F.get(m, i - k) for k in range(span)])))

    def made(g: Column) -> Column:
        return F.transform(kept(g), lambda i: F.struct(F.get(g, i).alias("fp"), i.alias("at"), F.lit(window).alias("n")))

    grams = F.transform(_upto(F.size(w) - gram + 1), lambda i: _run_hash(w, i, gram))
    long = F.when(F.size(w) >= window, _let(grams, made)).otherwise(F.array()).cast(kind)
    runs = lambda n: F.transform(_upto(F.size(w) - n + 1), lambda i: F.struct(_run_hash(w, i, n).alias("fp"), i.alias("at"), F.lit(n).alias("n"))).cast(kind)
    return F.concat(long, *map(runs, short)) if short else long


def _digest(window_text: Column) -> Column:
    return F.unhex(F.md5(window_text))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 10, gram: int = 5) -> DataFrame:
    """Distinct windows of the items: wid, n (words), fps (its fingerprints: hash, n), items (ids as sorted strings), gid (digest of ``items``)."""
    cut = lambda w: F.when(F.size(w) >= window, F.transform(_upto(F.size(w) - window + 1), lambda i: F.array_join(F.slice(w, i + 1, window), " "))).when(F.size(w) > 0, F.array(F.array_join(w, " ")))
    each = items.select(F.col(id_col).cast("string").alias("item"), F.explode(_let(words(F.col(text_col)), cut)).alias("window"))
    by_window = each.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("run", F.split("window", " "))
    n = F.size("run")
    fps = reduce(lambda rest, k: F.when(n == k, F.array(_run_hash(F.col("run"), F.lit(0), k))).otherwise(rest), range(1, window), F.array(_least_gram(F.col("run"), window, gram)))
    return by_window.select(_digest(F.col("window")).alias("wid"), n.alias("n"), F.explode(fps).alias("fp"), "items", F.md5(F.to_json("items")).alias("gid"))


def _least_gram(run: Column, window: int, gram: int) -> Column:
    return F.least(*[_run_hash(run, F.lit(i), gram) for i in range(window - gram + 1)])


def _merged(x: Column, window: int) -> Column:
    """Disjoint spans covered by windows ``x``, structs (start, end) sorted by start, at most one a start and ``window`` long.

    Only the window - 1 intervals before one can reach into it."""
    size = F.size(x)
    before = lambda i: F.greatest(*[F.get(x, i - k)["end"] for k in range(1, max(3, window))])
    reach = lambda i: F.greatest(F.get(x, i)["end"], before(i))
    opens = F.filter(_upto(size), lambda i: before(i).isNull() | (F.get(x, i)["start"] > before(i)))
    closes = F.filter(_upto(size), lambda i: (i + 1 == size) | (F.get(x, i + 1)["start"] > reach(i)))
    return F.zip_with(opens, closes, lambda a, b: F.struct(F.get(x, a)["start"].alias("start"), reach(b).alias("end")))


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, gram: int = 5
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans, item_ids.

    ``spans`` are the disjoint runs (start, end exclusive, counted in words) that
    occurrences of item windows cover; ``item_ids`` are the ids, as strings in
    order, of items with an occurring window. Null and empty texts have no
    words; an item without words has no window. An item without an id marks words
    but cannot be listed. Repeated documents give a row each, repeated items one
    id; empty tables give no hits. Nothing else of either table is read, so extra
    columns do not matter.
    """
    if not 0 < gram < window:
        raise ValueError("a gram has to be shorter than a window")
    known = settle(item_windows(items, item_id_col, item_text_col, window, gram), "decontamination-windows")
    short = sorted(r.n for r in known.select("n").distinct().collect() if r.n < window)  # fewer rows than words in a window
    # One pass over the texts: what it finds, and for every row itself (n = 0) its number of words.
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"), F.spark_partition_id().alias("part"))
    itself = lambda w: F.array(F.struct(F.hash("t").cast("long").alias("fp"), F.size(w).alias("at"), F.lit(0).alias("n")))
    fps = own.select("doc_id", "t", "part", F.explode(_let(words(F.col("text")), lambda w: F.concat(itself(w), _fingerprints(w, window, gram, short)))).alias("f"))
    fps = fps.select("doc_id", "t", "part", "f.*").join(known.select(F.col("fp").alias("known_fp")).distinct(), F.col("fp") == F.col("known_fp"), "left")
    met = fps.where("n = 0 OR known_fp IS NOT NULL").groupBy("doc_id", "t", "part").agg(
        F.count_if(F.col("n") == 0).alias("copies"), F.max(F.when(F.col("n") == 0, F.col("at"))).alias("n_words"), F.collect_set(F.when(F.col("n") > 0, F.struct("at", "n"))).alias("hits")
    )
    every = settle(met, "decontamination-hits")

    hits = every.where(F.size("hits") > 0).groupBy("doc_id", "t").agg(F.first("hits").alias("hits"))
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("t") == F.col("hit_t"))
    text = own.where("text IS NOT NULL").join(hits.withColumnsRenamed({"doc_id": "hit_id", "t": "hit_t"}), same)
    around = lambda h, w: F.when(
        h["n"] == window,
        F.transform(F.sequence(F.greatest(h["at"] - (window - gram), F.lit(0)), F.least(h["at"], F.size(w) - window)), lambda j: F.struct(j.alias("start"), h["n"].alias("n"))),
    ).otherwise(F.array(F.struct(h["at"].alias("start"), h["n"].alias("n"))))
    looked = lambda w: F.transform(
        F.array_distinct(F.flatten(F.transform("hits", lambda h: around(h, w)))),
        lambda r: F.struct(r["start"].alias("start"), r["n"].alias("n"), _digest(F.array_join(F.slice(w, r["start"] + 1, r["n"]), " ")).alias("wid")),
    )
    tried = text.select("doc_id", "t", F.explode(_let(words(F.col("text")), looked)).alias("r")).select("doc_id", "t", "r.*")
    found = tried.join(known.select("wid", "gid").distinct(), "wid")
    by_start = found.groupBy("doc_id", "t", "start").agg(F.max("n").alias("n"), F.collect_set("gid").alias("gids"))
    window_of = F.struct("start", (F.col("start") + F.col("n")).alias("end"))
    by_doc = by_start.groupBy("doc_id", "t").agg(F.array_sort(F.collect_list(window_of)).alias("x"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("gids")))).alias("gids"))
    hit = settle(by_doc.select("doc_id", "t", _let(F.col("x"), lambda x: _merged(x, window)).alias("spans"), "gids"), "decontamination-spans")

    owners = known.groupBy("gid").agg(F.first("items").alias("items"))
    sets = hit.select("gids").distinct().select("gids", F.explode("gids").alias("gid")).join(owners, "gid")
    listed = sets.select("gids", F.explode_outer("items").alias("item")).groupBy("gids").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    hit = hit.join(listed, "gids").select(F.col("doc_id").alias("hit_id"), F.col("t").alias("hit_t"), "spans", "item_ids")
    rows = every.select("doc_id", "t", F.col("n_words").cast("long").alias("n_words"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    joined = rows.join(hit, same, "left")
    return joined.select(
        "doc_id", "n_words",
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_at AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0),
item_window AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS x FROM item_at),
lengths AS (SELECT DISTINCT n FROM item_window),
doc_at AS (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n),
doc_window AS (SELECT k, n, s, array_to_string(w[s:s + n - 1], ' ') AS x FROM doc_at),
hit AS (SELECT k, s, doc_window.n AS n, item_id FROM doc_window JOIN item_window USING (x)),
word AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT k, unnest(range(s, s + n)) AS p FROM hit) GROUP BY k),
item AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (k) LEFT JOIN item USING (k)
"""
