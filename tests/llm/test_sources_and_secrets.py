import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from skeinmill.llm import mixing, secret_scan


def test_every_source_stays_within_a_block_of_its_weight(spark):
    rng = np.random.default_rng(4)
    shares = {"a": 70, "b": 7, "c": 21, "d": 2}
    rows = [(i, str(rng.choice(list(shares), p=[0.5, 0.2, 0.2, 0.1])), "x" * int(rng.integers(0, 40))) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix_sources(docs, shares, block_chars=20, period=100).select("source_key", "share", "period", "block", "slot").distinct().collect()
    period = got[0].period
    plan = mixing.pfair_plan(docs.groupBy(F.concat(F.lit("="), "source").alias("source_key")).agg(F.sum(F.length("text")).alias("size")), shares, period=100).collect()
    assert sorted(r.slot for r in plan) == list(range(period))
    total = {r.source_key: r.share for r in plan}
    assert sum(total.values()) == period
    done = dict.fromkeys(total, 0)
    for t, r in enumerate(sorted(plan, key=lambda r: r.slot), 1):
        done[r.source_key] += 1
        assert all(abs(done[k] - w * t / period) < 1 for k, w in total.items())
    slots = {}
    for r in got:
        assert slots.setdefault(r.slot, (r.source_key, r.block)) == (r.source_key, r.block)
        assert r.slot // r.period == r.block // r.share


def test_the_schedule_holds_the_stated_weights(spark):
    hot = {"hot": 100} | {f"s{i:03}": 1 for i in range(200)}
    for weights in ({"a": 70, "b": 7, "c": 21, "d": 2}, hot, {"a": 5000, "b": 50}, {"a": 3000, "b": 1}):
        supply = spark.createDataFrame([(f"={k}", 10) for k in weights], "source_key string, size long")
        plan = mixing.pfair_plan(supply, weights, period=100).collect()
        total, period, done = sum(weights.values()), plan[0].period, dict.fromkeys(weights, 0)
        assert sorted(r.slot for r in plan) == list(range(period))
        for t, r in enumerate(sorted(plan, key=lambda r: r.slot), 1):
            done[r.source_key[1:]] += 1
            assert all(abs(done[k] * total - w * t) < total for k, w in weights.items())
        assert all(done[k] * total == w * period for k, w in weights.items())  # so no repeat adds to the deviation
    docs = spark.createDataFrame([(i, "ab"[i % 2], "x" * 10) for i in range(400)], "doc_id long, source string, text string")
    got = mixing.mix_sources(docs, {"a": 100_000, "b": 70_000}, block_chars=10).select("source_key", "slot").collect()
    assert len({r.slot for r in got}) == 400
    for t in (10, 100, 300):
        assert all(abs(sum(r.slot < t for r in got if r.source_key == k) - w * t / 17) < 1 for k, w in (("=a", 10), ("=b", 7)))
    sizes = mixing.mix_sources(docs, block_chars=10)  # 2000 characters each: equal targets
    assert {(r.share, r.period) for r in sizes.select("share", "period").collect()} == {(1, 2)}


def test_rows_without_ids_are_dealt_out_by_length(spark):
    """Starts of rows without ids are running sums in the order of their lengths, before all others of the source."""
    rows = [(None, "s", "x" * (i % 9)) for i in range(90)] + [(i, "s", "y" * 5) for i in range(20)] + [(None, None, "z"), (None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix_sources(docs, block_chars=50).select("row.*", "source_key", "start").collect()
    sizes = sorted(len(r[2] or "") for r in rows if r[0] is None and r[1])
    assert sorted(r.start for r in got if r.doc_id is None and r.source) == [sum(sizes[:i]) for i in range(len(sizes))]
    assert min(r.start for r in got if r.doc_id is not None) == sum(sizes) and len(got) == len(rows)


def test_mixing_keeps_every_row_once(odd_docs, no_docs):
    got = mixing.mix_sources(odd_docs)
    assert sorted(map(repr, got.select("row.*").collect())) == sorted(map(repr, odd_docs.collect()))
    assert got.where("slot IS NULL").count() == 0
    assert mixing.mix_sources(no_docs).count() == 0


KINDS = [
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def brute(text):
    found = sorted((m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m))
    return [f"{k}:{a}:{b}" for a, _, b, k in found]


def test_base_spans_match_brute_force(spark):
    rng = np.random.default_rng(9)
    bits = ["password", "TOKEN", "api_key", "apikey", "Secret", "=", ": ", "'", '"', " ", "\n", "abc", "0123456789abcdef", "deadbeef", "AKIA", "ABCDEFGH", "1234567890", "\u00e9", "\U0001f600", "passwd=", "a_b-c.d"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 60))) for _ in range(300)] + ["token=token: abcdefgh", None, "", "x=" + "token=abcdefg " * 2500]
    docs = spark.createDataFrame([(i, t, f"s{i % 7}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in secret_scan.scan_secrets(docs, F.col("source"), F.col("source")).collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k, _, _ in KINDS]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans) and all(s in want or s.startswith("opaque") for s in spans)


def test_ownership_separates_examples_from_live_ones(spark):
    opaque = "Zx9" + "q8W" * 12
    rows = [(i, "token = 'EXAMPLEKEY12'", f"o{i}", f"o{i}/r") for i in range(6)] + [(10, f"token = 'mine-alone-99' and {opaque}", "o1", "o1/r"), (11, "nothing", "o1", "o1/r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string")
    got = {r.doc_id: r for r in secret_scan.scan_secrets(docs, F.col("owner"), F.col("repo")).collect()}
    assert (got[0].n_live, got[0].n_example) == (0, 1) and (got[10].n_live, got[10].n_example) == (2, 0)
    assert "opaque" in got[10].spans
    clean = {r.doc_id: r.text for r in secret_scan.redact_live(docs, F.col("owner"), F.col("repo")).collect()}
    assert clean[0] == rows[0][1] and clean[10] == "[SECRET]' and [SECRET]" and clean[11] == "nothing"


def test_added_spans_and_counts_match_brute_force(spark):
    """Ownership counted by hand over all candidates, ids null and repeated, against every column."""
    rng = np.random.default_rng(11)
    weak = re.compile(r"[A-Za-z0-9_-]{32,}")
    pool = ["token = 'shared-example-1'", "AKIA" + "Q7" * 9, "deadbeef" * 4, "".join(rng.choice(list("abcXYZ0189_-"), 40)), "Kq9" * 14, "password: lone-secret"]
    rows = []
    for i in range(240):
        text = " ".join([*rng.choice(pool, rng.integers(0, 4)), f"secret={'v%02d' % rng.integers(12)}-zzzz", "Wx" * 14 + f"{rng.integers(300):06d}"])
        owner = f"o{min(8, int(rng.exponential(2)))}"
        rows.append((None if i % 7 == 0 else i // 2, text if i % 11 else None, owner, f"{owner}/r{rng.integers(3)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string")

    def candidates(text):
        found = [(m.start(), i, m.end(), k, m[2] if k == "assign" else m[0]) for i, (k, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m)]
        return sorted(found), sorted((m.start(), 3, m.end(), "opaque", m[0]) for m in weak.finditer(text or "") if all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]")))

    owners, repos = {}, {}
    for _, t, o, r in rows:
        for part in candidates(t):
            for *_, value in part:
                owners.setdefault(value, set()).add(o)
                repos.setdefault(value, set()).add(r)
    live = {v for v in owners if len(owners[v]) <= 2 and len(repos[v]) <= 4}
    want = []
    for i, t, _, _ in rows:
        base, extra = candidates(t)
        whole = sorted([*base, *(c for c in extra if c[4] in live and len(owners[c[4]]) == 1)])
        want.append((str(i), ",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in whole), sum(c[4] in live for c in whole), sum(c[4] not in live for c in whole)))
    got = secret_scan.scan_secrets(docs, F.col("owner"), F.col("repo")).collect()
    assert sorted((str(r.doc_id), r.spans, r.n_live, r.n_example) for r in got) == sorted(want)
    assert any("opaque" in w[1] for w in want) and any(w[3] for w in want)


def test_odd_documents(odd_docs, no_docs):
    got = secret_scan.scan_secrets(odd_docs, F.col("source"), F.col("lang")).collect()
    assert len(got) == odd_docs.count() and sum(r.n_assign for r in got) == 1
    back = secret_scan.redact_live(odd_docs, F.col("source"), F.col("lang"))
    assert back.columns == odd_docs.columns and back.count() == odd_docs.count()
    assert secret_scan.scan_secrets(no_docs, F.col("source"), F.col("lang")).count() == 0
