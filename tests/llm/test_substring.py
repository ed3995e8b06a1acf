import hashlib
import re

import pytest
from corpusloom.llm.substring import op7_substring_dedup, remove_repeats

DOCS = "doc_id long, text string, kept string"


def brute(docs, window=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone |= set(range(j, j + window))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())


@pytest.mark.parametrize("size", [1 << 23, 4096])
def test_equals_brute_force_in_one_or_many_groups(spark, size):
    share = " ".join(f"s{i}" for i in range(20))
    rows = [(1, share), (2, f"a b {share} c\td"), (3, None), (4, ""), (5, " \n "), (6, "x " * 40), (7, "x " * 12), (8, "x " * 13), (9, share.replace(" ", "\n")), (9, share), (10, "é " + share + " ü"), (11, "A" + share), (12, "w" * 100_000)]
    rows += [(20 + i, f"{share} u{i} " + " ".join(f"t{j}" for j in range(i))) for i in range(60)]
    rows += [(200 + i, " ".join(f"r{(i * 7 + j) % 97}" for j in range(50))) for i in range(120)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS)
    assert got(remove_repeats(df, group_bytes=size)) == brute(rows)
    assert got(remove_repeats(df, window=3, group_bytes=size, cells_per_window=1, depth=3)) == brute(rows, 3)


def test_texts_keep_their_white_space_and_other_columns(spark):
    share = "\n".join(f"s{i}" for i in range(14))
    rows = [(1, f"a\n{share}\tend", "k"), (2, f" x\ty\n{share}  z\n\nw ", None), (3, share, "m"), (4, None, "n"), (5, " keep\n me ", "o")]
    names = ["g", "kept", "n_words", "carried", "a b.c"]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, g string, kept int, n_words int, carried int, `a b.c` int")
    out = {r.doc_id: (r.kept, r.carried.g, r.n_removed) for r in remove_repeats(df, carry=names).collect()}
    assert out == {1: (rows[0][1], "k", 0), 2: (" x\ty\nz\n\nw ", None, 14), 3: ("", "m", 14), 4: ("", "n", 0), 5: (" keep\n me ", "o", 0)}
    assert list(remove_repeats(df, carry=names).schema["carried"].dataType.names) == names


def test_rows_without_an_id_keep_their_words(spark):
    share = " ".join(f"s{i}" for i in range(14))
    df = spark.createDataFrame([(None, share), (3, share), (4, share), (None, f"{share} x")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in remove_repeats(df).collect()) == [(0, 0), (0, 0), (3, 0), (4, 14)]


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], DOCS)).collect() == []
    assert got(remove_repeats(spark.createDataFrame([(1, None, None)], DOCS))) == [(1, 0, 0, "")]


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in brute(rows)]
    assert sorted(tuple(r) for r in op7_substring_dedup(spark, "/root/testdata/sf0.001").collect()) == want
