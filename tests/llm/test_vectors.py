import numpy as np
import pytest

from skeinmill.llm import ann, embedding_join

SCHEMA = "vec_id long, embedding array<float>, node long, k1 long, class_id long, rank int, leaf long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5) for i, v in rows], SCHEMA)


def vectors(n=700, d=16):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(n, d))
    m[100:200] = m[100] + rng.normal(size=(100, d)) * np.linspace(0, 0.5, 100)[:, None]
    m[300:330] = m[300]
    m[330:340] = 2.5 * m[300]
    return m.astype(np.float32)


def brute(m, t=0.9):
    x = m.astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= t
    np.fill_diagonal(link, False)
    label = np.arange(len(m))
    while True:
        new = np.minimum(label, np.where(link, label, len(m)).min(axis=1))
        if (new == label).all():
            return link.sum(axis=1), label
        label = new


def test_join_matches_brute_force(spark):
    m = vectors()
    links, label = brute(m)
    got = embedding_join.epsilon_grid_join(frame(spark, [(i, v.tolist()) for i, v in enumerate(m)]), block_rows=64).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in sorted(got, key=lambda r: r.vec_id)] == [(int(k), int(c), c == i) for i, (k, c) in enumerate(zip(links, label))]


def test_join_prunes_far_blocks(spark):
    m = np.eye(8, dtype=np.float32).repeat(64, axis=0) + np.random.default_rng(0).normal(size=(512, 8)).astype(np.float32) * 0.01
    links, label = brute(m)
    got = sorted(embedding_join.epsilon_grid_join(frame(spark, [(i, v.tolist()) for i, v in enumerate(m)]), block_rows=32).collect())
    assert [r.n_links for r in got] == links.tolist() and [r.component_id for r in got] == label.tolist()


def test_odd_vectors(spark):
    a = [1.0, 0.0, 0.5]
    rows = [(1, a), (2, a), (2, a), (3, None), (4, [0.0, 0.0, 0.0]), (5, [float("nan"), 1.0, 0.0]), (6, [None, 1.0, 0.0]), (7, [float("inf"), 0.0, 0.0]), (8, []), (9, [1.0, 0.0]), (11, [1.0, 0.01]), (12, [3.0]), (13, [0.5]), (None, a), (10, [-1.0, 0.0, -0.5])]
    got = embedding_join.epsilon_grid_join(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert (by[1].n_links, by[2].n_links, by[2].component_id) == (1, 1, 1)
    assert all(by[i].n_links == 0 and by[i].kept for i in (3, 4, 5, 6, 7, 8, 10))
    assert all((by[i].n_links, by[i].component_id) == (1, c) for i, c in ((9, 9), (11, 9), (12, 12), (13, 12)))
    assert by[None].component_id is None and not by[None].kept
    assert embedding_join.epsilon_grid_join(frame(spark, [])).count() == 0
    found = ann.search_nearest(frame(spark, rows), frame(spark, rows), 3).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in found} == {(1, 1, 2), (1, 2, 10), (2, 1, 1), (2, 2, 10), (10, 1, 1), (10, 2, 2), (9, 1, 11), (11, 1, 9), (12, 1, 13), (13, 1, 12)}
    assert ann.search_nearest(frame(spark, []), frame(spark, []), 3).count() == 0


@pytest.mark.parametrize("sizes", [(300, 290, 40), (500, 30, 3)])
def test_join_and_search_with_several_lengths(spark, sizes):
    """Lengths in near-equal and in unequal numbers, ids dealt over them, against brute force in each."""
    mats = [vectors(350, 16)[: sizes[0]] if sizes[0] <= 350 else vectors(700, 16)[: sizes[0]], vectors(350, 12)[60 : 60 + sizes[1]], vectors(350, 3)[90 : 90 + sizes[2]]]
    rows = [(len(mats) * i + j, v) for j, m in enumerate(mats) for i, v in enumerate(m)]
    df = frame(spark, [(i, v.tolist()) for i, v in rows]).repartition(3)
    got = {r.vec_id: r for r in embedding_join.epsilon_grid_join(df, block_rows=32).collect()}
    found = {}
    for r in ann.search_nearest(df, df.where("vec_id % 5 = 0"), 7, leaf_rows=100, block_rows=16, target_recall=1.0).collect():
        found.setdefault(r.query_id, []).append(r)
    for j, m in enumerate(mats):
        links, label = brute(m)
        own = [got[len(mats) * i + j] for i in range(len(m))]
        assert [r.n_links for r in own] == links.tolist() and [r.component_id for r in own] == (len(mats) * label + j).tolist()
        x, ids = m.astype(float), len(mats) * np.arange(len(m)) + j
        hits = asked = 0
        for i in np.flatnonzero(ids % 5 == 0):
            s = (x * x[i]).sum(axis=1)
            s[i] = -np.inf
            want = ids[np.lexsort((ids, -s))[: min(7, len(m) - 1)]].tolist()
            mine = [r.vec_id for r in sorted(found.get(ids[i], []), key=lambda r: r.rank)]
            assert len(mine) == len(want)
            hits, asked = hits + len(set(mine) & set(want)), asked + len(want)
        assert hits >= (0.95 if len(m) > 100 else 1) * asked


def test_an_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.1]), (4, [0.1, 1.0]), (5, [-1.0, 0.0])]
    got = {(r.vec_id, r.n_links, r.component_id) for r in embedding_join.epsilon_grid_join(frame(spark, rows)).collect()}
    assert got == {(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 1), (5, 0, 5)}
    for turned in (rows, rows[::-1]):
        found = ann.search_nearest(frame(spark, turned), frame(spark, turned).where("vec_id = 1"), 2).collect()
        assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank)] == [(4, 1.0), (3, float(np.float32(0.1)))]


def test_search_recall_scores_and_ties(spark):
    m = vectors(3000, 16)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(m)])
    got = ann.search_nearest(df, df.where("vec_id % 20 = 0"), 20, block_rows=256, leaf_rows=64).collect()
    x, ids, hit = m.astype(float), np.arange(len(m)), 0
    by = {}
    for r in sorted(got):
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 3000, 20))
    for q, rows in by.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.lexsort((ids, -s))[:20].tolist()) & {r.vec_id for r in rows})
        assert [r.rank for r in rows] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        assert np.allclose([r.score for r in rows], s[[r.vec_id for r in rows]], rtol=1e-12)
    assert hit >= 0.9 * 20 * len(by)
