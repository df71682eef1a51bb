import numpy as np
import pytest

from lattica.llm.vptree import Tree, nearest


def brute(ids, vectors, queries, k):
    wide = np.asarray(vectors, dtype=np.float64)
    out = {}
    for q in queries:
        scores = [(-(wide[q] * v).sum() / (np.sqrt((wide[q] ** 2).sum()) * np.sqrt((v**2).sum())), i) for i, v in zip(ids, wide) if i != ids[q]]
        out[ids[q]] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("dim, n", [(2, 500), (8, 700), (3, 5), (4, 1)])
def test_exact_at_factor_one(dim, n):
    draw = np.random.default_rng(dim)
    vectors = draw.normal(size=(n, dim)).astype(np.float32)
    vectors[: n // 3] = vectors[n // 2]  # many copies
    ids = draw.permutation(n) + 10
    queries = list(range(0, n, 7))
    tree = Tree.from_bytes(Tree.build(ids, vectors, leaf=8).to_bytes())
    got, scores, work = tree.search(ids[queries], vectors[queries], 5)
    want = brute(ids.tolist(), vectors, queries, 5)
    for q, i, s in zip(queries, got, scores):
        assert i.tolist() == [x for x, _ in want[ids[q]]] and np.allclose(s, [x for _, x in want[ids[q]]])


def test_a_larger_factor_does_less():
    draw = np.random.default_rng(9)
    vectors = draw.normal(size=(4000, 3))
    tree = Tree.build(np.arange(4000), vectors, leaf=16)
    found = [tree.search(np.arange(50), vectors[:50], 5, f) for f in (1.0, 2.0)]
    assert found[1][2] < found[0][2] < 50 * 4000
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found[0][0], found[1][0])]) > 0.8


def test_frame(spark):
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(300, 6)).astype(np.float32).tolist()
    rows = [(k, v, 1, 2) for k, v in enumerate(vectors)]
    rows += [(350, None, 1, 2), (400, [0.0] * 6, 1, 2), (401, [1.0, None] + [0.0] * 4, 1, 2), (450, [float("nan")] + [1.0] * 5, 1, 2), (None, vectors[0], 1, 2), (500, [1.0, 2.0], 1, 2), (501, [2.0, 1.0], 1, 2), (250, vectors[3], 1, 2)]
    rows += [(0, [3.0, 1.0], 1, 2)]  # one id, two lengths
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim int, number int"), shard_rows=64).collect()
    ids = [r[0] for r in rows[:300]] + [250]
    every = vectors + [vectors[3]]
    want = brute(ids, every, [0, 50, 100, 150, 200], 5)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(i for _, i, s in by[0] if i in (500, 501)) == [500, 501] and len(by[0]) == 7
    by[0] = [x for x in by[0] if x[1] not in (500, 501)]
    for q, found in want.items():
        assert [i for _, i, _ in sorted(by[q])] == [i for i, _ in found]
    assert [i for _, i, _ in sorted(by[500])] == [501, 0] and len(by[250]) == 10 and not {350, 400, 450} & set(by)
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_ties_beyond_what_is_kept_go_to_the_smaller_ids():
    draw = np.random.default_rng(3)
    scale = 2.0 ** draw.permutation(np.arange(40))  # forty different points in one direction, and others
    vectors = np.concatenate([scale[:, None] * np.array([1.0, 2.0]), draw.normal(size=(200, 2))])
    ids = draw.permutation(240)
    tree = Tree.build(ids, vectors, leaf=8)
    (got,), _, _ = tree.search(np.array([10_000]), np.array([[2.0, 4.0]]), 5)
    assert got.tolist() == sorted(ids[:40].tolist())[:5]
