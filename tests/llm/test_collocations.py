import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from skeinmill.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_count, longest, percent, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if len(p) > 1 and c >= min_count}
        gone = set()
        for p, c in often.items():
            gone.update(q for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * c >= percent * often[q := p[i : i + k]])
        scored = []
        for p, a in often.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), (" ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score)))
        out += [(lang, rank, *x[3]) for rank, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def found(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    vocab = ["The", "of", "new", "york", "times", "é", "É", "a.b", "x;", "y\tz", "end.\n", "rare%d"]
    rows = []
    for i in range(150):
        words = [w % rng.integers(1000) if "%" in w else w for w in rng.choice(vocab, rng.integers(0, 80))]
        if i % 3 == 0:
            words += ["new york times square today"] * int(rng.integers(0, 6))
        rows.append((["en", "de", None, "und"][i % 4], " ".join(words)))
    return [*rows, ("en", None), ("xx", ""), (None, "  \n\t "), ("en", "a a a a a a a a"), *[("fr", "mot pour mot")] * 40]


@pytest.mark.parametrize(("min_count", "percent", "top", "longest"), [(5, 100, 2000, 5), (5, 60, 7, 5), (20, 100, 2000, 3), (1, 100, 50, 2), (300, 100, 2000, 5)])
def test_matches_a_plain_version(spark, texts, min_count, percent, top, longest):
    docs = spark.createDataFrame([(i, lang, t, 1, "x", "y") for i, (lang, t) in enumerate(texts)], "doc_id long, lang string, text string, f int, phrase string, `odd name:x` string").repartition(5)
    got = co.collocations(docs, min_count=min_count, longest=longest, subsume_percent=percent, top=top)
    assert found(got) == plain(texts, min_count, longest, percent, top)


def test_narrow_sketches_and_full_tasks_change_nothing(spark, texts, monkeypatch):
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(4)
    monkeypatch.setattr(co, "HELD", 20)
    want = plain(texts, 5, 5, 100, 2000)
    assert found(co.collocations(docs, min_count=5)) == want
    monkeypatch.setattr(co, "_reached", lambda h, passed, bits: np.ones(len(h), dtype=bool))  # as if every cell were full
    assert found(co.collocations(docs, min_count=5)) == want


def test_empty_table_and_large_numbers(spark, monkeypatch):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    big = 10**13
    rows = [("en", "a b", 2, big // 7), ("en", "a", 1, big + 1), ("en", "b", 1, big // 3), ("en", None, 0, 9 * big)]
    monkeypatch.setattr(co, "frequent_phrases", lambda *a: spark.createDataFrame(rows, "lang string, phrase string, size int, f long"))
    got = co.collocations(spark.createDataFrame([], "lang string, text string")).first()
    assert got.score == 1000 * (big // 7) * 9 * big // ((big + 1) * (big // 3))


def test_rare_phrases_stay_out_of_the_exact_pass(spark, monkeypatch):
    """However many phrases share a cell, only frequent ones are counted by text."""
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([("en", " ".join(f"w{x}" for x in rng.integers(0, 12, 200))) for _ in range(100)], "lang string, text string").repartition(2)
    handed, plain_map = [], type(docs).mapInArrow

    def map_in_arrow(self, f, schema, *a, **b):
        out = plain_map(self, f, schema, *a, **b)
        if "phrase" in out.columns:
            handed.append(out.count())
        return out

    monkeypatch.setattr(type(docs), "mapInArrow", map_in_arrow)
    monkeypatch.setattr(co, "CELL_BITS", 9)
    got = co.frequent_phrases(docs, min_count=100)
    n = Counter(r["size"] for r in got.collect())
    assert n[1] == 12 and n[2] > 100 and not n[4] and handed and max(handed) <= 2 * (1 + 12 + 144 + n[3])
