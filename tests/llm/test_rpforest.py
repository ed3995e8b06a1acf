import numpy as np
import pytest
from corpusloom.llm.rpforest import near_vectors, op5_rp_forest_near_dedup

VECTORS = "vec_id long, embedding array<double>, leaf string"


def brute(ids, rows, threshold=0.95):
    fine = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in rows]
    x = np.array([v if f else [0.0] * 16 for v, f in zip(rows, fine, strict=True)], np.float64)
    n = np.linalg.norm(x, axis=1)
    g = (x @ x.T) / np.where(n == 0, 1, n)[:, None] / np.where(n == 0, 1, n)[None, :] >= threshold
    np.fill_diagonal(g, False)
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[g[i]]]) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    return sorted((i, int(m.sum()), int(c), i == c) for i, m, c in zip(ids, g, label, strict=True))


@pytest.mark.parametrize("sizes", [(1024, 4096), (32, 48)])
def test_equals_brute_force(spark, sizes):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    x[100:200] = x[0] + rng.normal(size=(100, 16)) * 0.15
    x[200:260] = x[rng.integers(0, 100, 60)] + rng.normal(size=(60, 16)) * 0.05
    x[300:340] = x[5]
    x[340:345] = x[5] * 2
    rows = [*x.tolist(), None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows)], VECTORS).repartition(3)
    got = sorted(tuple(r) for r in near_vectors(df, leaf_rows=sizes[0], max_leaf=sizes[1]).collect())
    want = brute(list(range(len(rows))), rows)
    right = sum(g == w for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and right > 0.97 * len(want)


def test_empty_and_repeated(spark):
    assert near_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    df = spark.createDataFrame([(1, [1.0, 2.0], ""), (1, [1.0, 2.0], ""), (2, [2.0, 4.0], ""), (3, [1.0], ""), (None, [1.0, 2.0], "")], VECTORS)
    assert sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()) == [(0, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_repeated_ids_odd_lengths_and_sizes(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 2.0, 0.0]), (4, [0.0, 1e-200, 0.0]), (5, [0.0, 1e300, 1e299]), (6, [1.0, 1.0]), (7, [2.0, 2.0]), (8, [1.0])]
    df = spark.createDataFrame([(i, v, "") for i, v in rows], VECTORS)
    got = sorted(tuple(r) for r in near_vectors(df, leaf_rows=2, max_leaf=2).collect())
    assert got == [(1, 1, 1, True), (1, 3, 1, True), (2, 1, 1, False), (3, 3, 1, False), (4, 3, 1, False), (5, 3, 1, False), (6, 1, 6, True), (7, 1, 6, False), (8, 0, 8, True)]


def test_recall_of_the_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    n = len(table)
    x = np.array([r.embedding for r in table], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = int((x @ x.T >= 0.95).sum()) - n
    got = op5_rp_forest_near_dedup(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == n and 0.99 * want <= sum(r.n_links for r in got) <= want
