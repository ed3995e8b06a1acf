import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm.pii import redacted, spans_of

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or {tuple(w)}


def test_each_stage_against_brute_force(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def done(name, docs):
        stages[name](spark, docs, SF).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    good = done("quality", docs)
    assert good.schema == docs.schema and good.exceptAll(docs).isEmpty()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = rows(good)
    fine = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in fine) / len(fine) > 0.95

    one = done("near_dedup", good)
    assert one.schema == docs.schema
    sets = {i: shingles(r.text.lower()) for i, r in kept.items()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                up[b] = a
    assert sorted(rows(one)) == [i for i in ids if root(i) == i]

    cut = done("substring_dedup", one)
    seen, texts = {}, {}
    before = rows(one)
    for i in sorted(before):
        parts = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", before[i].text)]
        words = [before[i].text[a:b] for a, b in parts]
        gone = set()
        for j in range(len(words) - 12):
            if seen.setdefault(tuple(words[j : j + 13]), i) < i:
                gone |= set(range(j, j + 13))
        text, at = "", 0
        for j, (a, _) in enumerate(parts):
            if j in gone:
                text += before[i].text[at:a]
                at = parts[j + 1][0] if j + 1 < len(parts) else len(before[i].text)
        texts[i] = text + before[i].text[at:]
    after = rows(cut)
    assert {i: r.text for i, r in after.items()} == texts
    assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (before[i].lang, before[i].source) for i, r in after.items())

    clean = done("pii", cut)
    assert {i: r.text for i, r in rows(clean).items()} == {i: redacted(t, spans_of(t)[1]) for i, t in texts.items()}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = done("packing", clean).collect()
    assert {r.doc_id for r in packed} == set(texts)
    full = {i: np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1], "<u4") for i, r in rows(clean).items()}
    for r in packed:
        assert r.ids_crc32 == zlib.crc32(full[r.doc_id][r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in packed) == sum(map(len, full.values()))


def test_run_equals_its_stages_and_takes_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10_000, None, None, None, None), (10_001, "", "en", "s", 0), (None, "some words here", "en", "s", 15), (10_002, "same text twice", "en", "s", 15), (10_002, "same text twice", "en", "s", 15), (10_002, "other text", "en", "s", 10)]
    some = docs.where("doc_id < 80").union(spark.createDataFrame(odd, docs.schema))
    some.selectExpr("*", "1 AS g", "2 AS kept", "3 AS row", "4 AS place", "5 AS n_words", "6 AS start").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = step.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, step, str(tmp_path)).write.parquet(str(tmp_path / name))
        step = spark.read.parquet(str(tmp_path / name))
        assert step.columns == columns
    left = step.collect()
    assert sum(r.doc_id == 10_002 for r in left) <= 2
    sizes = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens, r.start == 0) for r in rows if r.start == 0)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, len(LIBRARY.encode(r.text or "", add_special_tokens=False).ids) + 1, True) for r in left)
    assert sizes(got) == want and len(want) > 20
    assert sum(r.length for r in got) == sum(w[2] for w in want)


def test_run_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_dedup_of_repeated_ids(spark):
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(40))
    rows = [(1, text(1), "b"), (1, text(1), "a"), (1, text(2), "c"), (2, text(2), "d"), (3, text(3), "e"), (3, text(1), "f"), (None, text(1), "g"), (3, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = corpus_pipeline.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(r.lang for r in out.collect()) == ["a", "c", "e", "g", "h"]
