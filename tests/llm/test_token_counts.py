import public_tokenizers
import pyarrow.parquet as pq
import pytest
from corpusloom.llm import token_counts
from corpusloom.llm.token_counts import Counter, count_tokens, op11_whole_token_counts, prove
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(PATH)

ODD = [
    None, "", " ", "\x00\x01 \x1c\x1d\x85", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|end oftext|> <|endoftext|", "don't I'LL 'tis can't 12,5 x'y ''s",
    "É. é É, éé.. ªº. µ, ×÷ ÜßÿŸ naïve café ȩ́ ́x", "ΣΑΣ Σ ﬁ İstanbul ǅ ⅷ ² ½ 漢字かな 한국 🙂🙂 x​y", "x y z　w­v", "$5 &amp; %ab *x* #!/bin ~`^ a_b-c|d <|x|>", "Hello,  World's\tend\n" * 9,
]


def plain(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_library(spark):
    texts = [*ODD, "ab12" * 40_000, "z" * 20_000 + "é" * 70_000, "word " * 30_000]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(None, "same text", "n"), (3, "same text", "n"), (3, "same text", "n")]
    out = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3), limit=5).collect()
    want = sorted((-1 if i is None else i, len((t or "").encode()), plain(t), plain(t) > 5) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == want
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_query_equals_the_library_over_the_whole_table(spark):
    table = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    want = sorted((d, len((t or "").encode()), n := plain(t), n > 2048) for d, t in zip(table["doc_id"], table["text"], strict=True))
    assert sorted(tuple(r) for r in op11_whole_token_counts(spark, SF).collect()) == want


def test_a_string_is_whole_only_if_the_model_makes_it():
    whole = prove(PATH)
    for piece in [*sorted(whole)[::500], "the", "."]:
        assert piece in whole and len(LIBRARY.model.tokenize(piece)) == 1
    vocabulary = {t.removesuffix("</w>") for t in LIBRARY.get_vocab(with_added_tokens=False) if t.endswith("</w>")}
    assert whole <= vocabulary
    assert all(len(LIBRARY.model.tokenize(p)) > 1 for p in vocabulary - whole if p)


def test_whole_pre_tokens_are_not_merged(monkeypatch):
    counter, merged = Counter(PATH, prove(PATH)), []
    monkeypatch.setattr(counter, "tokenize", lambda p: merged.append(p) or LIBRARY.model.tokenize(p))
    assert counter.count([b"The people, the world and zzxqy."]) == [plain("The people, the world and zzxqy.")]
    assert merged == ["zzxqy"]


@pytest.mark.parametrize("remembered", [10, 400_000])
def test_memory_is_bounded(monkeypatch, remembered):
    monkeypatch.setattr(token_counts, "REMEMBERED", remembered)
    counter = Counter(PATH, prove(PATH))
    texts = [" ".join(f"word{i + j} often É{i}. {'q' * 100}{i}" for j in range(5)) for i in range(0, 60, 7)]
    assert [counter.count([t.encode()])[0] for t in texts] == [plain(t) for t in texts]
    assert all(len(w) <= token_counts.LONGEST for w in counter.known)
