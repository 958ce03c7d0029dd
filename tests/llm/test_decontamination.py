import hashlib
import re

import numpy as np

from skeinmill.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, window=10):
    """Every window of every item looked for at every place of every document."""
    for _, text in docs:
        w, hit, ids = plain_words(text), set(), set()
        for item, item_text in items:
            x = plain_words(item_text)
            n = min(len(x), window)
            for run in {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else ():
                at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) == run]
                hit.update(p for i in at for p in range(i, i + n))
                ids.update([str(item)] if at and item is not None else [])
        yield len(w), sorted(hit), sorted(ids)


def found(df):
    return {r.doc_id: (r.n_words, [p for s in r.spans for p in range(s.start, s.end)], r.item_ids, [(s.start, s.end) for s in r.spans]) for r in df.collect()}


def test_every_shared_window_is_found(spark):
    rng = np.random.default_rng(8)
    vocab = ["Aa", "b", "cé", "d1", "É", "é", "zz"]
    say = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, say(int(rng.integers(1, 25)))) for i in range(12)]
    items += [(20, "one two"), (21, "Solo"), (22, items[0][1]), (22, say(14)), (23, None), (24, ""), (25, "..."), (None, "no name but words that mark eleven places of any text"), (26, "q " * 30)]
    passages = [t for _, t in items if t]
    docs = []
    for i in range(60):
        parts = [say(int(rng.integers(0, 30)))]
        for _ in range(int(rng.integers(0, 3))):
            x = passages[int(rng.integers(len(passages)))].split()
            a = int(rng.integers(0, len(x)))
            parts += [" ".join(x[a : a + int(rng.integers(1, 20))]).upper() if i % 2 else "; ".join(x[a:]), say(int(rng.integers(0, 9)))]
        docs.append((i, " -- ".join(parts)))
    docs += [(100, None), (101, ""), (102, "?!"), (103, "solo SOLO"), (104, "q " * 25), (105, " ".join(passages) * 3)]
    frame = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id long, text string, fp int, `my col:x` string, n int").repartition(3)
    got = found(dc.find_contamination(frame, spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, gid int")))
    for (i, _), (n, hit, ids) in zip(docs, plain(docs, items), strict=True):
        assert got[i][:3] == (n, hit, ids), i
        assert all(a[1] < b[0] for a, b in zip(got[i][3], got[i][3][1:], strict=False))
    assert sum(bool(v[1]) for v in got.values()) > 20


def test_repeated_null_ids_and_empty_tables(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, text), (1, text), (1, "other"), (None, text), (None, text), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([("b,1", text), ("a", text), ("a", text)], "item_id string, text string")
    got = sorted((r.doc_id or 0, r.n_words, len(r.spans), tuple(r.item_ids)) for r in dc.find_contamination(docs, items).collect())
    assert got == [(0, 0, 0, ()), (0, 11, 1, ("a", "b,1")), (0, 11, 1, ("a", "b,1")), (1, 1, 0, ()), (1, 11, 1, ("a", "b,1")), (1, 11, 1, ("a", "b,1"))]
    assert dc.find_contamination(docs, items.limit(0)).where("size(spans) > 0").count() == 0
    assert dc.find_contamination(docs.limit(0), items).count() == 0


def test_a_hot_passage_and_other_windows(spark):
    """A third of the documents hold a passage that many items share; the join gives a row a place, not a row a pair."""
    passage = " ".join(f"w{i}" for i in range(14))
    docs = [(i, f"x{i} {passage} y{i}" if i % 3 == 0 else f"x{i} y{i}") for i in range(300)]
    items = [(i, f"i{i} {passage}") for i in range(40)]
    for window, gram in ((10, 5), (4, 2), (3, 1)):
        got = found(dc.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=window, gram=gram))
        for i, _ in docs:
            assert got[i][3] == ([(1, 15)] if i % 3 == 0 else [])
            assert len(got[i][2]) == (40 if i % 3 == 0 else 0)


def test_query_columns(spark):
    got = dc.query(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and {r.items_sha256 for r in got if not r.contaminated} == {hashlib.sha256(b"").hexdigest()}
    assert any(r.contaminated for r in got) and all((r.n_hit > 0) == r.contaminated for r in got)
