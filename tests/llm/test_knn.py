import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.llm import knn

DIM = 12
SIZES = {"sample": 400, "leaf": 8, "branch": 6, "cell": 150, "calibration": 150}


def table(spark, x, numbers=None):
    numbers = list(range(len(x))) if numbers is None else numbers
    return spark.createDataFrame([(int(n), None if v is None else [float(t) for t in v]) for n, v in zip(numbers, x, strict=True)], "number bigint, embedding array<float>")


def brute(x, numbers, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in range(len(u)):
        s = np.round(u @ u[i], 7)
        order = sorted((j for j in range(len(u)) if j != i), key=lambda j: (-s[j], numbers[j]))[:k]
        out[numbers[i]] = [(numbers[j], s[j]) for j in order]
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, DIM))
    x = (centres[rng.integers(0, 60, 900)] + 0.15 * rng.normal(size=(900, DIM))).astype(np.float32)
    return x


def test_recall(spark, clustered):
    numbers = list(range(len(clustered)))
    want = brute(clustered.astype(np.float64), numbers, 5)
    rows = knn.nearest(knn.usable(table(spark, clustered), "number", "embedding", DIM), DIM, 5, 0.95, **SIZES).collect()
    got = {}
    for r in rows:
        got.setdefault(r.number, {})[r["rank"]] = r.other
    assert all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values()) and len(got) == len(numbers)
    hit = sum(len(set(got[n].values()) & {o for o, _ in want[n]}) for n in numbers)
    assert hit / (5 * len(numbers)) >= 0.9


def test_pairs_above_a_cosine(spark, clustered):
    numbers = [n * 7 for n in range(len(clustered))]
    want = {tuple(sorted((n, o))) for n, those in brute(clustered.astype(np.float64), numbers, 5).items() for o, s in those if s >= 0.9}
    got = {tuple(r) for r in knn.similar_pairs(knn.usable(table(spark, clustered, numbers), "number", "embedding", DIM), DIM, 5, 0.9, **SIZES).collect()}
    assert len(got & want) / len(want) >= 0.97 and len(got & want) / len(got) >= 0.97


def test_every_twentieth(spark, clustered):
    rows = knn.nearest(knn.usable(table(spark, clustered), "number", "embedding", DIM), DIM, 3, 0.95, every=20, **SIZES).collect()
    assert {r.number for r in rows} == set(range(0, 900, 20))


def test_close_pairs_that_no_sampled_query_has(spark):
    """Where close pairs are so rare that the calibration meets none, it widens all the same."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, DIM)).astype(np.float32)
    x[2960:] = x[:40] + 0.2 * rng.normal(size=(40, DIM))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(int(a), int(b)) for a, b in np.argwhere(np.triu(u @ u.T, 1) >= 0.95)}
    sizes = SIZES | {"calibration": 20}
    vectors = knn.usable(table(spark, x), "number", "embedding", DIM)
    index = knn.Index(knn.classes(vectors, 5), DIM, 5, 0.998, 0.95, **sizes)
    assert index.recall >= 0.998 and index.visits > 2
    got = {tuple(r) for r in knn.similar_pairs(vectors, DIM, 5, 0.95, **sizes).collect()}
    assert len(want) > 20 and got == want


def test_copies_ties_and_a_hot_group(spark):
    """A third of the rows are the same vector; copies of another length are the same direction; of equals the smaller number."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, DIM)).astype(np.float32)
    x[:100] = x[0]
    x[100:103] = x[100]
    x[103] = x[100] * 3
    numbers = rng.permutation(300).tolist()
    want = brute(x.astype(np.float64), numbers, 5)
    rows = knn.nearest(knn.usable(table(spark, x, numbers), "number", "embedding", DIM), DIM, 5, 1.0, **SIZES).collect()
    got = {}
    for r in rows:
        got.setdefault(r.number, []).append((r["rank"], r.other))
    for i, n in enumerate(numbers):
        if i < 104:
            assert [o for _, o in sorted(got[n])][: 3 if i >= 100 else 5] == [o for o, _ in want[n]][: 3 if i >= 100 else 5]
    hit = sum(len({o for _, o in got[n]} & {o for o, _ in want[n]}) for n in numbers)
    assert hit / 1500 >= 0.95


def test_a_leaf_too_large_for_a_cell_is_dealt_out(spark):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(1, DIM)) + 1e-3 * rng.normal(size=(500, DIM))).astype(np.float32)
    want = brute(x.astype(np.float64), list(range(500)), 2)
    rows = knn.nearest(knn.usable(table(spark, x), "number", "embedding", DIM), DIM, 2, 1.0, sample=20, leaf=20, branch=2, cell=60, calibration=50).collect()
    near = sum(r.cosine >= want[r.number][1][1] - 1e-6 for r in rows)
    assert len(rows) == 1000 and near / 1000 > 0.99


def test_bad_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    x = [[1.0] * DIM, [1.0] * (DIM - 1) + [2.0], None, [0.0] * DIM, [1.0] * 3, [nan] * DIM, [inf] * DIM, [1e30] * DIM, []]
    df = table(spark, x).unionByName(table(spark, x[:2]))
    df = df.unionByName(spark.createDataFrame([(None, [1.0] * DIM), (50, [None] * DIM)], "number bigint, embedding array<float>")).withColumn("vec", F.lit("clash")).withColumn("rep", F.lit(1))
    vectors = knn.usable(df, "number", "embedding", DIM)
    assert sorted(r.number for r in vectors.collect()) == [0, 1, 7]
    pairs = {tuple(r) for r in knn.similar_pairs(vectors, DIM, 5, 0.8, **SIZES).collect()}
    assert pairs == {(0, 1), (0, 7), (1, 7)}


def test_none_and_one(spark):
    none = knn.usable(table(spark, [[1.0] * DIM]).limit(0), "number", "embedding", DIM)
    assert knn.similar_pairs(none, DIM, **SIZES).count() == 0
    assert knn.similar_pairs(knn.usable(table(spark, [[1.0] * DIM]), "number", "embedding", DIM), DIM, **SIZES).count() == 0


def test_block_order_is_that_of_the_queue():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, DIM)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = knn.fit_tree(x, 8, 12)
    for q in x[:20]:
        queue = list(tree.order(q))
        assert sorted(queue) == list(range(len(tree.leaves)))
        assert [int(i) for i in tree.visits(q[None], len(queue))[0]][:10] == queue[:10]


@pytest.mark.parametrize(("n", "leaf", "branch"), [(1, 4, 3), (500, 8, 12), (500, 3, 50), (40, 100, 10), (300, 2, 5)])
def test_opened_branches_hold_what_all_do(n, leaf, branch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, DIM)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = knn.fit_tree(x, leaf, branch)
    for k in (1, 3, 17, 1000):
        p = tree.priorities(x)
        got = np.take_along_axis(p, tree.visits(x, k), 1)
        assert np.allclose(got, np.sort(p, axis=1)[:, :k], atol=1e-6)
