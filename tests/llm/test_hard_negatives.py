import math
import struct

import numpy as np
import pytest
from corpusloom.llm.hard_negatives import OP13_SQL, Lists, mine, op13_threshold_hard_negatives
from pyspark.sql import functions as F


def brute(rows, positives=5, negatives=3, low=50, high=95, every=10):
    fit = [(i, v, [math.floor(256 * x) for x in e], label) for i, (v, e, label) in enumerate(rows) if v is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, v, e, label in fit:
        if v % every:
            continue
        scored = [(-sum(map(int.__mul__, e, f)), w, own == label) for j, w, f, own in fit if j != i and len(e) == len(f)]
        for p, w, _ in sorted(s for s in scored if s[2])[:positives]:
            window = sorted((n, u) for n, u, same in scored if not same and low * -p <= 100 * -n <= high * -p)
            out += [(v, w, rank, u, -p, -n) for rank, (n, u) in enumerate(window[:negatives], 1)]
    return sorted(out)


def result(frame):
    return sorted(map(tuple, frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def single(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def table(rng, n=160, dim=6):
    rows = [(int(i), [single(x) for x in rng.normal(size=dim) + (1 if i % 3 else -1)], int(rng.integers(0, 4))) for i in range(n)]
    rows += [(i, rows[i][1], rows[i][2]) for i in (0, 10, 33)]  # repeated rows
    rows += [(i, rows[20][1], (rows[20][2] + i) % 4) for i in range(1000, 1060)]  # copies of one vector under every label
    rows += [(i, [0.0] * dim, 1) for i in (2000, 2001, 2005)] + [(2010, [0.0] * dim, 2)]
    rows += [(3000, None, 1), (3010, rows[0][1], None), (None, rows[0][1], 1), (3020, [None, *rows[0][1][1:]], 1), (3030, [float("nan"), *rows[0][1][1:]], 1), (3040, [float("inf"), *rows[0][1][1:]], 1)]
    rows += [(4000 + i, [1.0 + i, 2.0], i % 2) for i in range(0, 40, 5)] + [(5000, [], 1), (5001, [], 1), (5002, [], 2)]  # other lengths
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("cells", [1 << 19, 300])
def test_equals_brute_force(spark, cells):
    rows = table(np.random.default_rng(8))
    frame = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA + ", score int, part string").repartition(3)
    got = mine(frame, F.col("vec_id") % 10 == 0, part_cells=cells, block_cells=cells // 4)
    want = brute(rows)
    assert result(got) == want and len(want) > 100
    assert {r[0] for r in want} >= {0, 10, 20, 2000, 4000, 5000}


def test_other_bounds(spark):
    rows = table(np.random.default_rng(9), 80, 4)
    got = mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, positives=2, negatives=4, low=-20, high=100, part_cells=200)
    assert result(got) == brute(rows, 2, 4, -20, 100)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-(1 << 22), 1 << 22, 3)], i % 2) for i in range(40)]
    got = mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, part_cells=50)
    assert result(got) == brute(rows)


def test_empty_and_lonely(spark):
    assert result(mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0)) == []
    assert result(mine(spark.createDataFrame([(10, [1.0], 1), (11, [0.7], 2)], SCHEMA), F.col("vec_id") % 10 == 0)) == []


def test_reading_stops_before_the_end_and_misses_nothing():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(4000, 3)))
    lists, anchor = Lists(x, np.arange(4000)), np.floor(256 * rng.normal(size=3))
    allowed = rng.random(4000) < 0.9
    scores = x @ anchor
    low, high = np.quantile(scores, 0.99), np.quantile(scores, 0.999)
    found, depth = lists.best(anchor, [(low, high), (None, None)], 3, allowed)
    order = np.lexsort((np.arange(4000), -scores))
    for (rows, got), fits in zip(found, [(scores >= low) & (scores <= high) & allowed, allowed], strict=True):
        assert rows.tolist() == [i for i in order if fits[i]][:3] and (got == scores[rows]).all()
    assert depth < 1000


def test_query_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    assert result(op13_threshold_hard_negatives(spark, sf)) == sorted(con.execute(OP13_SQL).fetchall())
