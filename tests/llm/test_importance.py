import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpusloom.llm import importance
from corpusloom.llm.importance import OP12_SQL, draw, grams, op12_importance_resampling, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def features(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent, longest, buckets, least, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, longest))
    t = Counter(bucket(f) for x in target for f in features(x, longest))
    size, total, rows = s.total(), t.total(), []
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (size + buckets) / ((s[b] + 1.0) * (total + buckets))))
    for doc_id, text in docs:
        f = features(text, longest)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(f), weight, score, None, len(words(text))])
    fit = sorted((r for r in rows if r[3] is not None and r[5] >= least), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for rank, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]


def key(row):
    return tuple((v is None, v or 0) for v in row)


def table():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "straße", "Ünter", "漢字", "a1b2"]
    docs = [(int(i), " ".join(rng.choice(vocabulary, rng.integers(0, 50)))) for i in range(120)]
    docs += [(None, "w1 w2 " * 20), (7, docs[7][1]), (8, "w3 " * 30), (500, None), (501, ""), (502, "--- ...\x00,"), (503, "A\x00b C-d_e f é9Z"), (504, "w1 w9. " * 300)]
    return docs, [None, "", "w1 w2 w3 É", "W1, w1; w5 straße w6 w6"]


@pytest.mark.parametrize(("longest", "block"), [(1, 1 << 20), (3, 1 << 20), (3, 40)])
def test_equals_brute_force(spark, monkeypatch, longest, block):
    docs, target = table()
    monkeypatch.setattr(importance, "BLOCK", block)
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, score string, rank int").repartition(3)
    out = resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), percent=30, longest=longest, buckets=97, least_words=10, seed=5)
    want = brute(docs, target, 30, longest, 97, 10, 5)
    assert sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=key) == sorted(want, key=key)


def test_n_grams_stay_in_their_text_across_blocks(monkeypatch):
    texts = ["one two three", "", "four", "five six\x00seven é", "x" * 100, "a b c d"]
    for block in (1, 7, 1000):
        monkeypatch.setattr(importance, "BLOCK", block)
        got = Counter((n, int(o), int(b)) for n, owner, found in grams([t.encode() for t in texts], 3, 1000) for o, b in zip(owner, found, strict=True))
        want = Counter((n, i, zlib.crc32(f.encode()) % 1000) for i, t in enumerate(texts) for n in (1, 2, 3) for f in [" ".join(words(t)[j : j + n]) for j in range(len(words(t)) - n + 1)])
        assert got == want


def test_ties_go_to_the_smaller_id_and_copies_are_ranked_one_by_one(spark):
    rows = [(i % 40, 1, 0, (i % 40) // 10 * 1000, True) for i in range(200)] + [(99, 1, 0, 9000, False), (98, 1, 0, None, True)]
    out = draw(spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long, takes_part boolean"), 33).collect()
    ranked = sorted((r.rank, r.doc_id) for r in out if r.rank)
    order = sorted((-s, d) for d, _, _, s, part in rows if part and s is not None)
    assert len(out) == 202 and ranked == [(i, d) for i, (_, d) in enumerate(order[: 200 * 33 // 100], 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20), (2, "b c " * 20)], "doc_id long, text string")
    assert resample(none, some).collect() == []
    assert {(r.doc_id, r.n_features) for r in resample(some, none).collect()} == {(1, 40), (2, 40)}


def test_query_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS FROM '{sf}/{name}.parquet'")
    want = con.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({OP12_SQL})").fetchall()
    got = op12_importance_resampling(spark, sf).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
