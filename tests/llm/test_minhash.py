import re

import numpy as np
import pyarrow as pa
import pytest

from skeinmill.llm import minhash as M
from skeinmill.llm.shingles import shingle_sets
from tests.llm.conftest import words


def brute_sets(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)}


def brute(texts, width, percent):
    ids = list(texts)
    sets = {i: brute_sets(texts[i], width) for i in ids}
    label = {i: i for i in ids}
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in ids}


@pytest.mark.parametrize("width,percent,bands", [(3, 85, 40), (5, 80, 60)])
def test_components_match_brute_force(spark, width, percent, bands):
    rng = np.random.default_rng(3)
    texts, n = {}, 0
    for size in (40, 150, 400):
        for _ in range(6):
            base = words(rng, size)
            for edits in range(12):
                own = base.copy()
                for at in rng.choice(size, edits, replace=False):
                    own[at] = "".join(rng.choice(list("xyz"), 5))
                texts[n] = " ".join(own)
                n += 1
    crowd = words(rng, 150)
    for _ in range(60):
        own = crowd.copy()
        for at in rng.choice(150, rng.integers(0, 9), replace=False):
            own[at] = "".join(rng.choice(list("xyz"), 5))
        texts[n] = " ".join(own)
        n += 1
    want = brute(texts, width, percent)
    got = M.minhash_near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width=width, percent=percent, bands=bands).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def brute_ids(rows, width, percent):
    """Smallest id reachable of every id, over all texts of each."""
    sets = [(i, brute_sets(t, width)) for i, t in rows]
    label = {i: i for i, _ in rows}
    for _ in rows:
        for a, s in sets:
            for b, t in sets:
                if s and t and 100 * len(s & t) >= percent * len(s | t):
                    label[a] = label[b] = min(label[a], label[b])
    return label


def test_an_id_with_several_texts_links_through_each(spark):
    rng = np.random.default_rng(6)
    a, b, c = (words(rng, 60) for _ in range(3))
    near = lambda w: [*w[:59], "changed"]
    base = [(1, a), (1, b), (2, near(b)), (3, near(a)), (5, b), (5, c), (7, near(c)), (9, words(rng, 60))]
    rows = [(i, " ".join(w)) for i, w in base]
    want = brute_ids(rows, 3, 85)
    assert want == {1: 1, 2: 1, 3: 1, 5: 1, 7: 1, 9: 9}
    for turn in range(3):
        own = [*rows[turn * 3 :], *rows[: turn * 3]][:: -1 if turn else 1]
        got = M.minhash_near_duplicates(spark.createDataFrame(own, "doc_id long, text string").repartition(2), width=3, percent=85, bands=40).collect()
        assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want


def test_crowded_buckets_are_compared_tile_by_tile(spark, monkeypatch):
    """Forty texts of eight groups and ids with two texts, in one bucket of many small blocks and tiles."""
    monkeypatch.setattr(M, "BLOCK_ROWS", 4)
    monkeypatch.setattr(M, "TILE_BYTES", 4000)
    rng = np.random.default_rng(7)
    bases = [words(rng, 60) for _ in range(8)]
    rows = [(i // 2 if i < 20 else i, " ".join([*bases[i % 8][:58], f"x{i}", "end"])) for i in range(40)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(M._digester(3), "doc_id long, t long, text string").cache()
    crowd = texts.selectExpr("1 AS band", "2L AS key", "doc_id", "t", "doc_id AS component", "40L AS members")
    links = M._block_links(crowd, texts, 3, 85).collect()
    label = {i: i for i, _ in rows}
    for _ in rows:
        for r in links:
            label[r.a] = label[r.b] = min(label[r.a], label[r.b])
    assert label == brute_ids(rows, 3, 85) and len(links) < 400


def test_odd_rows(odd_docs, no_docs):
    rows = M.minhash_near_duplicates(odd_docs, width=3, percent=85).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].component_id == by_id[2].component_id == by_id[3].component_id == 1
    assert by_id[8].component_id == by_id[9].component_id == 8 and by_id[8].n_shingles == 1
    assert all(by_id[i].n_shingles == 0 and by_id[i].kept for i in (4, 5, 6))
    assert by_id[None].component_id is None and not by_id[None].kept
    assert M.minhash_near_duplicates(no_docs).count() == 0


def test_shingles_do_not_depend_on_batching():
    texts = ["", None, "A b", " a  B\tc d\x0be ", "\u00e9t\u00e9 \u00e9t\u00e9 x", "x" * 3_000_000 + " y z"]
    together = [s for _, run in shingle_sets(pa.array(texts), 3) for s in run]
    alone = [next(shingle_sets(pa.array([t], pa.string()), 3))[1][0] for t in texts]
    assert all((a == b).all() for a, b in zip(together, alone, strict=True))
    assert [len(s) for s in together] == [len(brute_sets(t, 3)) for t in texts]


def test_common_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (1, 50, 4000, 8000)]
    got = M.common_counts(sets, sets[:3])
    assert [[int(x) for x in r] for r in got] == [[len(np.intersect1d(a, b)) for b in sets[:3]] for a in sets]


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    sig = M.circulant_signatures([np.unique(a[:600]), np.unique(a[100:700])], 512)
    assert abs((sig[0] == sig[1]).mean() - 500 / 700) < 0.08
