import random

import duckdb
import pytest
from corpusloom.llm import hamming
from corpusloom.llm.hamming import OP1_SQL, nearest_codes, op1_multi_index_hamming, sign_codes

CODES = "id long, code long, n string"


def brute(queries, index, k):
    out = []
    for q, c in queries:
        near = sorted(((c ^ d) & (2**64 - 1)).bit_count() * 10**9 + i for i, d in index if i != q)[:k]
        out += [(q, r + 1, v % 10**9, v // 10**9) for r, v in enumerate(near)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.rank, r.id, r.distance) for r in df.collect())


@pytest.mark.parametrize(("segments", "bucket"), [(4, 4096), (8, 4096), (5, 16), (None, 16)])
def test_equals_brute_force(spark, segments, bucket):
    rng = random.Random(segments or 1)
    signed = lambda: rng.getrandbits(64) - 2**63
    centre = [signed() for _ in range(4)]
    near = lambda c, n: ((c ^ sum(1 << b for b in rng.sample(range(64), n))) + 2**63) % 2**64 - 2**63
    index = [(i, near(centre[i % 4], rng.randrange(0, 12))) for i in range(300)] + [(1000 + i, centre[0]) for i in range(40)] + [(2000, -1), (2001, 0), (2002, -(2**63))]
    queries = index[::25] + [(1005, centre[0]), (5000, centre[1])]
    df = lambda rows: spark.createDataFrame([(i, c, "x") for i, c in rows], CODES)
    assert got(nearest_codes(df(queries), df(index), 5, segments, bucket)) == brute(queries, index, 5)


def test_odd_tables(spark):
    df = lambda rows: spark.createDataFrame(rows, CODES)
    some = df([(1, 5, ""), (2, 5, ""), (3, None, ""), (None, 5, "")])
    assert got(nearest_codes(some, some, 10)) == [(1, 1, 2, 0), (2, 1, 1, 0)]
    assert got(nearest_codes(some, df([]), 3)) == [] and got(nearest_codes(df([]), some, 3)) == []
    vectors = spark.createDataFrame([(1, [1.0, -1.0, 0.0, 2.0]), (2, None), (3, [1.0, None]), (4, [1.0] * 65), (5, [-1.0] * 63 + [1.0])], "vec_id long, embedding array<double>")
    assert {r.id: r.code for r in sign_codes(vectors).collect()} == {1: 9, 2: None, 3: None, 4: None, 5: -(2**63)}


def test_query_equals_its_sql(spark):
    duckdb.sql("CREATE OR REPLACE VIEW embeddings AS FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = sorted(duckdb.sql(OP1_SQL).fetchall())
    assert got(op1_multi_index_hamming(spark, "/root/testdata/sf0.001")) == want and len(want) > 100


def test_repeated_ids_count_each(spark):
    df = lambda rows: spark.createDataFrame([(i, c, "x") for i, c in rows], CODES)
    many = [(1, 5)] * 12 + [(i, 5) for i in range(2, 8)] + [(i, 2**40 - i) for i in range(20, 40)]
    queries = [(1, 5), (3, 5), (25, 2**40 - 25), (99, -1)]
    assert got(nearest_codes(df(queries), df(many), 5)) == brute(queries, many, 5)
    few = [(1, 5)] * 4 + [(1, 6), (2, 5), (2, -1)] + [(2, 7)] * 3
    assert got(nearest_codes(df(queries), df(few), 10)) == brute(queries, few, 10)


@pytest.mark.parametrize("twice", [False, True])
def test_a_probe_meets_a_value_as_one_row(spark, monkeypatch, twice):
    rng, seen = random.Random(7), {}
    codes = [(i, rng.getrandbits(50)) for i in range(400)] + [(1000 + i, (5 << 40) + i) for i in range(400)]
    codes += [(i, rng.getrandbits(50)) for i in range(100)] if twice else []
    write = hamming.materialize
    monkeypatch.setattr(hamming, "materialize", lambda df, name: seen.setdefault(name, write(df, name)) if name == "segments" else write(df, name))
    df = lambda rows: spark.createDataFrame([(i, c, "x") for i, c in rows], CODES)
    queries = codes[::40]
    assert got(nearest_codes(df(queries), df(codes), 3, 4)) == brute(queries, codes, 3)
    rows = seen["segments"].select("key").collect()
    assert len(rows) == len({r.key for r in rows})
