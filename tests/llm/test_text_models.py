import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinmill.llm import language_id, packing, quality


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = language_id.ByteGru(["a", "b", "c"], hidden=3)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, y = rng.integers(97, 103, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, grad = model.gradients(x, y)
    for name, w in model.w.items():
        rows = range(97, 103) if w.shape[0] == 256 else range(w.shape[0])
        at = (rows[1], *([1] * (w.ndim - 1)))
        keep = w[at]
        w[at] = keep + 1e-2
        up, _ = model.gradients(x, y)
        w[at] = keep - 1e-2
        down, _ = model.gradients(x, y)
        w[at] = keep
        assert grad[name][at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(1)
    syllables = {"aa": ["tha", "ing", "er", "ou"], "bb": ["\u00e9lu", "eau", "\u00e7on", "que"], "cc": ["sch", "\u00fcng", "ein", "zu"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[k], 2)) for _ in range(rng.integers(3, 200))), k) for i, k in enumerate(np.array(["aa", "bb", "cc"])[rng.integers(0, 3, 400)].tolist())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_language_model(docs.where(~language_id.held_out(F.col("doc_id"))), steps=120)
    got = language_id.predict_language(docs.where(language_id.held_out(F.col("doc_id"))), model).select("row.lang", "lang_pred", "score").collect()
    assert len(got) > 80 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(odd_docs, no_docs):
    model = language_id.fit_language_model(odd_docs, steps=5)
    got = language_id.predict_language(odd_docs, model).select("row.doc_id", "row.text", "lang_pred").collect()
    assert len(got) == odd_docs.count()
    assert {r.lang_pred for r in got if r.doc_id in (4, 5, 6, 11)} == {"und"}
    assert all(r.lang_pred in ("aa", "bb") for r in got if r.doc_id in (1, 7, 10))
    assert language_id.fit_language_model(no_docs) is None
    assert {r.lang_pred for r in language_id.predict_language(odd_docs, None).collect()} == {"und"}
    assert language_id.predict_language(no_docs, model).count() == 0


def test_pooling_covers_every_position():
    model = language_id.ByteGru(["a", "b"], hidden=4)
    size = 3 * language_id.WINDOW + 17
    text = np.random.default_rng(0).integers(97, 123, size).astype(np.uint8)
    offsets = np.array([0, 0, size, size, size + 5])
    pooled = model.pooled(np.concatenate([text, np.full(5, 120, np.uint8)]), offsets)
    total, seen = np.zeros(2), 0
    for s in range(0, size, language_id.WINDOW):
        x = np.full((language_id.LENGTH, 1), 32, np.uint8)
        low, high = max(0, s - language_id.CONTEXT), min(size, s + language_id.WINDOW + language_id.CONTEXT)
        x[low - s + language_id.CONTEXT : high - s + language_id.CONTEXT, 0] = text[low:high]
        own = min(language_id.WINDOW, size - s)
        total += model.positions(x)[language_id.CONTEXT : language_id.CONTEXT + own, 0].sum(axis=0)
        seen += own
    assert seen == size and np.allclose(pooled[1], total / size, atol=1e-5) and not pooled[[0, 2]].any() and abs(pooled[3].sum() - 1) < 1e-5


def test_masked_positions_give_no_gradient():
    rng = np.random.default_rng(0)
    model = language_id.ByteGru(["a", "b"], hidden=3)
    x, y = rng.integers(97, 103, (7, 4)).astype(np.uint8), np.array([0, 1, 1, 0])
    counts = np.ones((7, 4), bool)
    counts[:, 3] = False
    loss, grad = model.gradients(x, y, counts)
    alone, same = model.gradients(x[:, :3], y[:3])
    assert abs(loss - alone) < 1e-5 and all(np.allclose(grad[k], same[k], atol=1e-5) for k in grad)


def test_short_and_long_texts_of_close_languages(spark):
    """Two languages with the same letters and most of the same syllables, by texts of a few words and of thousands."""
    rng = np.random.default_rng(4)
    shared = ["ta", "ri", "mo", "ne", "sul"]
    own = {"xx": ["tar", "iso", "eno"], "yy": ["rat", "osi", "one"]}
    rows = []
    for i in range(900):
        k = "xy"[i % 2] * 2
        size = (4, 40, 3000)[0 if i % 3 else 1 if i % 60 else 2]
        rows.append((i, " ".join("".join(rng.choice([*shared, *own[k]], 3)) for _ in range(size)), k, size))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, size int")
    model = language_id.fit_language_model(docs.where(~language_id.held_out(F.col("doc_id"))))
    got = language_id.predict_language(docs.where(language_id.held_out(F.col("doc_id"))), model).select("row.lang", "row.size", "lang_pred").collect()
    right = lambda least, most: np.mean([r.lang == r.lang_pred for r in got if least <= r["size"] <= most])
    assert right(0, 4) > 0.85 and right(40, 3000) > 0.97


def test_query_rows_with_null_and_repeated_ids(spark, tmp_path):
    rows = [(i, f"{'alpha beta' if i % 2 else 'gamma delta'} {i} " * 9, "ab"[i % 2], "s", 1) for i in range(60)]
    rows += [(None, "alpha beta", "b", "s", 1), (None, None, None, None, None), (7, "alpha beta", "b", "s", 1), (7, "alpha beta", "b", "s", 1), (8, "", "a", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = language_id.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.held_out for r in got if r.doc_id is None)
    assert sum(r.doc_id == 7 for r in got) == 3 and sum(r.lang_pred == "und" for r in got) == 2


def check_packing(docs, got, tokens, longest=1024):
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert [i for p in pieces for i in p.ids] == tokens[doc]
        assert all(p.doc_tokens == len(tokens[doc]) for p in pieces)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        size = 0
        for p in pieces:
            assert p.offset == size
            size += p.length
        assert size <= longest and size & (size - 1) == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rng = np.random.default_rng(2)
    bits = ["the ", "don't", " \n\n  ", "\u00e9t\u00e9", "\U0001f600", "12345", "<|endoftext|>", "x", "\t", "___", " zzz", "\u4f60\u597d"]
    texts = {i: "".join(rng.choice(bits, rng.integers(0, 900))) for i in range(150)} | {200: "", 201: None, 202: "word " * 20_000, 203: "a" * 50_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tokens = {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts.items()}
    got = packing.pack_documents(docs, packing.default_tokenizer(), pool=32).collect()
    assert {r.doc_id for r in got} == set(texts)
    check_packing(docs, got, tokens)
    assert len({r.sequence_id for r in got}) <= sum(map(len, tokens.values())) / 256 + 64


def test_step_groups_are_equal(spark):
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(i, "word " * int(rng.integers(0, 700))) for i in range(700)], "doc_id long, text string").repartition(6)
    got = packing.pack_documents(docs, packing.default_tokenizer(), step_tokens=4096, emit_ids=False).collect()
    groups, sizes = {}, {}
    for r in got:
        groups[r.step_group] = groups.get(r.step_group, 0) + r.length
        sizes.setdefault(r.step_group, {}).setdefault(r.sequence_id, 0)
        sizes[r.step_group][r.sequence_id] += r.length
    assert sorted(groups) == list(range(len(groups))) and len(groups) > 20
    assert {groups[g] for g in sorted(groups)[:-1]} == {4096} and groups[len(groups) - 1] <= 4096
    assert sum(len(set(s.values())) > 1 for s in sizes.values()) <= 11
    assert len({(r.sequence_id, r.step_group) for r in got}) == len({r.sequence_id for r in got})
    with pytest.raises(ValueError):
        packing.pack_documents(docs, packing.default_tokenizer(), step_tokens=1000)


def test_long_white_space_has_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok, enc = Tokenizer.from_file(path), packing.Encoder(path)
    n = 1_000_000
    texts = [" " * n, "\n" * n, "\t" * n, "a" + " \n\t\r" * (n // 4) + "b", "x" * n, "\u3000" * 200_000 + "\u3000\x1c.", "\x1c" * 60_000 + "a"]
    texts += [f"a{' ' * 60_000}b\n{chr(10) * 60_001}<|endoftext|>{chr(9) * 50_000}c {' ' * 49_999}d{' ' * 50_000}"]
    texts += [f"\u00e9{kind * size}{after}" for kind in " \n\xa0\u2003" for size in (49_999, 50_000, 50_001) for after in ("", "a", " b", "1", "'s", ".")]
    for t in texts:
        assert tok.encode(t, add_special_tokens=False).ids == enc(t).tolist(), (t[:2], len(t), t[-2:])
    docs = spark.createDataFrame([(0, " " * 5_000_000), (1, "\n" * n)], "doc_id long, text string")
    got = packing.pack_documents(docs, path, emit_ids=False).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {0: 5_000_001, 1: len(enc("\n" * n)) + 1}


def test_other_tokenizer_files_go_to_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(packing.default_tokenizer()))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "prefixed.json")
    json.dump(spec, open(path, "w"))
    assert packing.Encoder(path)("hello  you").tolist() == Tokenizer.from_file(path).encode("hello  you", add_special_tokens=False).ids


def test_packing_of_odd_rows(odd_docs, no_docs):
    got = packing.pack_documents(odd_docs, packing.default_tokenizer()).collect()
    assert sum(r.length for r in got if r.doc_id == 4) == 1
    assert sum(r.length for r in got if r.doc_id is None) > 100
    assert packing.pack_documents(no_docs, packing.default_tokenizer()).count() == 0


def test_quality_separates_and_shrinks(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(500)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = " ".join(["same"] * 80) if bad else " ".join(rng.choice(vocabulary, 80))
        rows.append((i, text, "good.site" if i < 300 else "other.site", "p"))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    got = quality.classify_quality(docs, spark.createDataFrame(labels, "doc_id long, good int"), F.col("host"), F.col("path")).collect()
    assert len(got) == 600 and np.mean([r.kept == (r.doc_id % 4 != 0) for r in got]) > 0.99


def test_site_rates_leave_the_own_label_out(spark, monkeypatch):
    """Rates against a reckoning by hand, broadcast and by salted keys alike; a site without labels has its host's or the global rate."""
    rng = np.random.default_rng(5)
    rows = [(i, f"text {rng.integers(9)}", f"h{min(3, int(rng.exponential(1)))}", f"p{rng.integers(3)}") for i in range(300)]
    rows += [(300, "text", "new", "p0"), (301, "text", "h0", "none"), (None, "text", "h0", "p0"), (5, "again", "h0", "p1")]
    good = {i: int(rng.random() < (0.9 if rows[i][2] == "h0" else 0.4)) for i in range(0, 300, 3)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame(list(good.items()), "doc_id long, good int")
    tags = spark.createDataFrame([(f"={h}", f"={p}", good[i]) for i, _, h, p in rows if i in good], "host string, path string, good long")
    _, _, at = quality.site_posteriors(tags)
    known = [(h, p, good[i]) for i, _, h, p in rows if i in good]

    def rates(i, h, p):
        rest = list(known)
        if i in good:
            rest.remove((h, p, good[i]))
        rate = (sum(y for *_, y in rest) + 1) / (len(rest) + 2)
        on_host, on_path = [y for a, _, y in rest if a == h], [y for a, b, y in rest if (a, b) == (h, p)]
        host = (sum(on_host) + at["s_h"] * rate) / (len(on_host) + at["s_h"])
        return host, (sum(on_path) + at["s_p"] * host) / (len(on_path) + at["s_p"])

    want = sorted((str(i), h, p, *np.round(rates(i, h, p), 9)) for i, _, h, p in rows)
    for size in (quality.SITE_BYTES, 0):
        monkeypatch.setattr(quality, "SITE_BYTES", size)
        got = quality.classify_quality(docs, labels, F.col("host"), F.col("path")).collect()
        assert sorted((str(r.doc_id), r.host, r.path, *np.round((r.host_rate, r.path_rate), 9)) for r in got) == want


def test_words_tell_quality_of_texts_that_were_not_learned(spark):
    """Texts alike in every statistic whose words differ: labelled two thirds teach, the others test."""
    rng = np.random.default_rng(6)
    kinds = {1: ["amber", "cedar", "delta", "ember", "fjord", "grove"], 0: ["winner", "casino", "bonus", "clicks", "offers", "prizes"]}
    both = ["plain", "words", "about", "things"]
    rows = [(i, " ".join(rng.choice([*both, *kinds[i % 2]], 60))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(900) if i % 3], "doc_id long, good int")
    got = quality.classify_quality(docs, labels, F.lit("h"), F.lit("p")).collect()
    assert np.mean([r.kept == bool(r.doc_id % 2) for r in got if r.doc_id % 3 == 0]) > 0.98


def test_a_hot_host_without_labels(spark):
    docs = spark.createDataFrame([(None if i % 5 == 0 else i, f"t {i}", "hot" if i % 3 == 0 else f"h{i}", "p") for i in range(200)], "doc_id long, text string, host string, path string")
    got = quality.classify_quality(docs, spark.createDataFrame([], "doc_id long, good int"), F.col("host"), F.col("path")).collect()
    assert len(got) == 200 and {(r.quality, r.host_rate, r.path_rate) for r in got} == {(0.5, 0.5, 0.5)}


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, None), (None, 1), (7, 1)], "doc_id long, good int")
    got = quality.classify_quality(odd_docs, labels, F.col("source"), F.col("lang")).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.quality <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, good int")
    assert {r.doc_score for r in quality.classify_quality(odd_docs, none, F.col("source"), F.col("lang")).collect()} == {0.5}
    assert quality.classify_quality(no_docs, labels, F.col("source"), F.col("lang")).count() == 0


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok, enc = Tokenizer.from_file(path), packing.Encoder(path)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 8192):
        text = "".join(f"a{chr(c)}b {chr(c)}1 \n" for c in points[at : at + 8192])
        assert tok.encode(text, add_special_tokens=False).ids == enc(text).tolist()


def test_repeated_labelled_rows_leave_no_copy_of_their_label(spark):
    base = [(i, f"word{i % 3} text", "h" if i < 6 else "k", "p") for i in range(12)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, good int")
    rate = lambda rows: {r.doc_id: (r.host_rate, r.path_rate) for r in quality.classify_quality(spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), labels, F.col("host"), F.col("path")).collect()}
    assert rate(base + [base[1]] * 3) == rate(base)
