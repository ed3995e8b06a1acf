import random
import re

import pyarrow as pa
import pytest
from corpusloom.llm.minhash import near_duplicates, op9_minhash_near_dedup, shingle_sets, signature
from corpusloom.llm.shared import connected_components

DOCS = "doc_id long, text string, keys string"


def sets_of(docs, size):
    out = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def brute(docs, size, percent=80):
    sets = sets_of(docs, size)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    where = {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    for x in ids:
        for y in {y for s in sets[x] for y in where[s] if y > x}:
            both = len(sets[x] & sets[y])
            if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((root(x), root(y)))
                up[b] = a
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def varied(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("small", "block"), [(16, 128), (2, 4)])
def test_equals_brute_force(spark, small, block):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, varied(rng, base, rng.randrange(0, 8))) for i in range(40)]
    rows += [(100 + i, " ".join(f"x{rng.randrange(30)}" for _ in range(rng.randrange(0, 6)))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "One"), (204, "one"), (205, "a b"), (206, "A\tB"), (207, "a b c"), (208, " ".join(base) * 3), (209, "É b"), (210, "é b"), (211, "w" * 100_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS).repartition(3)
    assert got(near_duplicates(df, 2, 80, small_bucket=small, block_rows=block)) == brute(rows, 2)


def test_empty_null_and_repeated_rows(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(None, "a b c d e f", "x"), (3, "a b c d e f", "x"), (3, "a b c d e f", "x"), (5, "a b c d e f", None)]
    out = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert [r for r in out if r[0]] == [(3, 3, True), (3, 3, True), (5, 3, False)] and out[0][2]


def test_rows_of_one_id_are_one_document(spark):
    rng = random.Random(9)
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    near = a[:-1] + ["other"]
    texts = {"A": a, "A'": near, "B": b, "C": c}
    cases = [
        [(3, "A"), (5, "A"), (5, "B"), (7, "B")],
        [(3, "A'"), (5, "A"), (5, "B"), (7, "B")],
        [(4, "B"), (9, "A"), (9, "B"), (10, "A'"), (12, "C")],
        [(5, ""), (5, "A"), (3, "A'"), (6, ""), (6, "")],
        [(1, "A"), (2, "B"), (3, "C"), (8, "A"), (8, "B"), (9, "B"), (9, "C")],
    ]
    rows = []
    for n, case in enumerate(cases):  # each with words and ids of its own
        rows += [(100 * n + i, " ".join(f"{n}{w}" for w in texts.get(t, []))) for i, t in case]
    up = {i: i for i, _ in rows}
    for i, s in rows:
        for j, t in rows:
            one, other = (set(zip(x.split(), x.split()[1:], strict=False)) for x in (s, t))
            if one and other and 100 * len(one & other) >= 80 * len(one | other):
                low, high = sorted((up[i], up[j]))
                up = {k: low if v == high else v for k, v in up.items()}
    rng.shuffle(rows)
    out = near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], DOCS), 2, 80).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out) == sorted((i, up[i], up[i] == i) for i, _ in rows)


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    one, other = shingle_sets(pa.array([" ".join(words), varied(rng, words, 150)], pa.large_string()), 1)
    both = len(set(one.tolist()) & set(other.tolist()))
    true = both / (len(one) + len(other) - both)
    assert abs((signature(one, 1024) == signature(other, 1024)).mean() - true) < 0.05


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (5, 9), (9, 5), (None, 3)] + [(rng.randrange(400), rng.randrange(400)) for _ in range(180)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    out = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: root(i) for i in up}


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got(op9_minhash_near_dedup(spark, "/root/testdata/sf0.001")) == brute(rows, 2)
