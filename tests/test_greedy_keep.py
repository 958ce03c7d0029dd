"""Greedy selection in rounds against one pass, and the exact set join against all pairs."""

import json
import random
import re

import pytest

from skeinmill.operators import neardup
from skeinmill.operators.graph import greedy_dropped


def one_pass(nodes, links):
    near = {n: set() for n in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    kept = []
    for n in sorted(nodes):
        if not near[n] & set(kept):
            kept.append(n)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_rounds_decide_as_one_pass_does(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range((20, 60, 200)[seed])] + [(100 + i, 101 + i) for i in range(9)] + [(200, 200 + i) for i in range(1, 30)]
    links = [(a, b) for a, b in links if a != b]
    frame = spark.createDataFrame([*links, *links[:5], (7, 7), (None, 3)], "src long, dst long")
    dropped = {r.node for r in greedy_dropped(frame).collect()}
    nodes = {n for link in links for n in link}
    assert sorted(nodes - dropped) == one_pass(nodes, links)


def test_kept_documents(spark, tmp_path):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(25):
        words = rng.choices(vocab, k=rng.randrange(1, 30))
        docs.append((rng.randrange(10**6), " ".join(words)))
        for _ in range(rng.randrange(3)):
            near = words.copy()
            near[rng.randrange(len(near))] = rng.choice(vocab)
            docs.append((rng.randrange(10**6), " ".join(near)))
    docs += [(-1, "one"), (-2, "one"), (-3, ""), (-4, None), (-5, "a b c"), (-6, docs[0][1].upper())]
    frame = spark.createDataFrame([*docs, (None, "w1 w2")], "doc_id long, text string").repartition(3)

    def pairs(text):
        t = [x for x in re.findall(r"[^\W_]+", (text or "").lower()) if len(x) > 1]
        return set(zip(t, t[1:], strict=False)) if len(t) > 1 else set(t)

    sets = {d: pairs(t) for d, t in docs}
    links = [(a, b) for a in sets for b in sets if a > b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])]
    kept = neardup.greedy_keep(frame)
    assert sorted(r.doc_id for r in kept.collect()) == one_pass(sets, links)
    neardup.write_survivors(frame.unionByName(frame), kept, str(tmp_path / "out"))
    rows = [json.loads(line) for f in (tmp_path / "out").glob("*.json") for line in f.read_text().splitlines()]
    assert sorted(r["doc_id"] for r in rows) == one_pass(sets, links)
    assert neardup.greedy_keep(frame.limit(0)).count() == 0


def test_sets_are_stored_once_a_class(spark, monkeypatch):
    from skeinmill.operators import neardup

    stored, plain = [], neardup.settle

    def settle(df, label):
        out = plain(df, label)
        stored.append(out.count() if "f" in out.columns else 0)
        return out

    monkeypatch.setattr(neardup, "settle", settle)
    docs = spark.createDataFrame([(i, f"one text of {'abcd'[i % 4] * 3} words") for i in range(40)] + [(40, None), (41, "!")], "doc_id long, text string")
    members, links = neardup.similar_classes(docs)
    assert sorted((r.doc_id, r.rep) for r in members.collect()) == [(i, i % 4) for i in range(40)]
    assert links.count() == 0 and max(stored) == 4


def test_groups_store_sets_of_compared_texts_alone(spark, monkeypatch):
    """Unlike texts are told apart by a few bytes each; only sets that may be similar are stored."""
    stored, plain = [], neardup.settle

    def settle(df, label):
        out = plain(df, label)
        stored.append(out.count() if "f" in out.columns else 0)
        return out

    monkeypatch.setattr(neardup, "settle", settle)
    texts = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(40)]
    rows = [*enumerate(texts), (100, texts[3] + " more"), (101, texts[5]), (102, None)]
    links = neardup.similar_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.a, r.b) for r in links) == [(100, 3), (101, 5)] and 2 <= max(stored) <= 6


def test_equal_minima_lose_next_to_no_link():
    least = neardup._least_equal(0.6, 192)
    rng = random.Random(7)
    assert 60 < least < 90 and neardup._least_equal(0.6, 3) == 0
    assert min(sum(rng.random() < 0.6 for _ in range(192)) for _ in range(3000)) > least


def test_kept_texts_shuffle_rare_elements_and_compare_with_kept_ones(spark, monkeypatch):
    """Of unlike texts no set is stored, and of a group of variants only pairs with its kept text are compared."""
    stored, compared, plain, compare = {}, [], neardup.settle, neardup._compared

    def settle(df, label):
        out = plain(df, label)
        stored[label] = out
        return out

    def count(pairs, sets, threshold):
        compared.append(pairs.count())
        return compare(pairs, sets, threshold)

    monkeypatch.setattr(neardup, "settle", settle)
    monkeypatch.setattr(neardup, "_compared", count)
    unlike = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(20)]
    base = [f"v{k}" for k in range(60)]
    variants = [" ".join(base[:i] + [f"y{i}"] + base[i + 1 :]) for i in range(30)]
    frame = spark.createDataFrame([*enumerate(unlike + variants)], "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.greedy_keep(frame).collect()) == list(range(21))
    assert stored["neardup-sets"].count() == 30 and stored["neardup-candidates"].count() == 30 * 29 // 2
    assert sum(compared) == 29


def test_sets_of_hashes_are_those_of_the_pairs(spark):
    """Letters, digits and lower case of any script, rows cut anywhere, against sets of strings."""
    import numpy as np
    import pyarrow as pa

    from skeinmill.operators import pairsets

    rng = random.Random(3)
    texts = ["".join(rng.choices("aBc9 ._-\u00c9\u00e9\u03a3\u0416\u4e2d\U00010400\u0301\t", k=rng.randrange(60))) for _ in range(400)]
    texts += [None, "", "one", " One! ", "x y z", "ab cd ab cd", "x" * pairsets.CHUNK_BYTES + " end end", *["\u4e2d\u6587 text"] * 3]

    def pairs(text):
        t = [x for x in re.findall(r"[^\W_]+", (text or "").lower().replace("\u03c2", "\u03c3")) if len(x) > 1]
        return frozenset(zip(t, t[1:], strict=False)) if len(t) > 1 else frozenset(t)

    column = pa.array(["cut", *texts]).slice(1)
    got = [f for _, sets in pairsets.pair_sets(column) for f in sets]
    want = [pairs(t) for t in texts]
    assert [len(f) for f in got] == [len(w) for w in want] and all((np.diff(f.astype(object)) > 0).all() for f in got)
    by_set = {}
    assert all(by_set.setdefault(w, f.tobytes()) == f.tobytes() for w, f in zip(want, got, strict=True))
    assert len(set(by_set.values())) == len(by_set)
    without = [f for _, sets in pairsets.pair_sets(pa.array(["the cat the hat", "cat hat"]), ("the", "The")) for f in sets]
    assert without[0].tobytes() == without[1].tobytes()


def test_groups_compare_next_to_no_pair_inside_a_group(spark, monkeypatch):
    """All variants of a text are candidates of each other; one comparison each connects them."""
    compared, compare = [], neardup._compared

    def count(pairs, sets, threshold):
        compared.append(pairs.count())
        return compare(pairs, sets, threshold)

    monkeypatch.setattr(neardup, "_compared", count)
    base = [f"v{k}" for k in range(60)]
    variants = [" ".join(base[:i] + [f"y{i}"] + base[i + 1 :]) for i in range(30)]
    frame = spark.createDataFrame([*enumerate(variants)], "doc_id long, text string")
    assert sorted((r.a, r.b) for r in neardup.similar_links(frame).collect()) == [(i, 0) for i in range(1, 30)]
    assert sum(compared) == 29
