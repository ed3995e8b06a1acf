import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
import pyarrow.parquet as pq
from corpusloom.llm.packing import Packer, pack, word_ids
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, start string"


LIBRARY = Tokenizer.from_file(PATH)


def plain(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_word_ids_equal_the_library_on_whole_texts():
    texts = ["x. x.. x... X. É. é É, éé.. ªº. µ, ×÷ ÜßÿŸ, naïve naïve. \u00e9\u0301 caf\u00e9 cafe\u0301.", "Hello,  World's\tend\n", "", " été ́x  y 　 z", "<|endoftext|> a", "don't I'LL 12,5", "ΣΑΣ Σ ﬁ İstanbul", "x y\x85z"]
    texts += ["Foo foo. FOO, foo., foo.. ,. , . a.b I. x' 'tis can't. x", *(t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist())]
    assert [np.frombuffer(b, "<u4").tolist() for b in word_ids(texts, PATH)] == [plain(t) for t in texts]


@pytest.mark.parametrize("max_open", [8192, 3])
def test_every_id_is_in_one_piece_and_nothing_is_padded(spark, max_open):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["word"] * int(n)), "x") for i, n in enumerate(rng.integers(0, 700, 60))]
    rows += [(100, None, "x"), (101, "", "x"), (102, "a b " * 9000, "x"), (103, "same", "x"), (103, "same", "x"), (104, "x" * 50_000, "x")]
    out = pack(spark.createDataFrame(rows, DOCS).repartition(3), size=256, max_open=max_open).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, text, _ in rows:
        if doc_id == 103:
            continue
        ids = np.array([*plain(text), 1], "<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in by_doc[103]) == 2 * (len(plain("same")) + 1)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 256 or at & (at - 1) == 0
    assert pack(spark.createDataFrame([], DOCS)).collect() == []


def test_levels_follow_the_sum_of_squares():
    rng = np.random.default_rng(5)
    packer, counts = Packer(32, 0, 8192), [0] * 33
    for doc_id in range(400):
        s = int(rng.integers(1, 32))
        best = []
        for h in range(0, 32 - s + 1):
            if h and not counts[h]:
                continue
            after = counts[:]
            if h:
                after[h] -= 1
            if h + s < 32:
                after[h + s] += 1
            best.append((sum(c * c for c in after[1:32]), -h, after))
        counts = min(best)[2]
        packer.add(doc_id, b"\1\0\0\0" * s)
        assert [int(c) for c in packer.levels[1:32]] == counts[1:32]


def test_words_that_are_still_met_stay_in_memory(monkeypatch):
    monkeypatch.setattr("corpusloom.llm.packing.REMEMBERED", 40)
    texts = [" ".join(f"word{i + j} often É{i}." for j in range(12)) for i in range(0, 400, 7)]
    assert [np.frombuffer(word_ids([t], PATH)[0], "<u4").tolist() for t in texts] == [plain(t) for t in texts]


def test_names_of_special_tokens_are_those_tokens():
    texts = ["a<|endoftext|>b <|startoftext|><|endoftext|>.", "<|ENDOFTEXT|> <|end oftext|> <|endoftext|", "x <|endoftext|>, É<|startoftext|>́"]
    got = [np.frombuffer(b, "<u4").tolist() for b in word_ids(texts, PATH)]
    assert got == [plain(t) for t in texts] and 49407 in got[0] and 49406 in got[0] and 49407 not in got[1]


def test_completing_the_fullest_keeps_the_other_levels():
    packer = Packer(16, 0, 6)
    for doc_id in range(40):
        packer.add(doc_id, bytes([doc_id, 0, 0, 0]) * 9)  # no two fit into one window
        held = {h: len(w) for h, w in packer.open.items() if w}
        assert packer.n_open == sum(held.values()) <= 6 and all(packer.levels[h] == n for h, n in held.items())
        assert all(sum(len(ids) // 4 for _, _, ids, _ in w) == h for h, ws in packer.open.items() for w in ws)
    packer.finish()
    rows = sorted((doc_id, start, length) for doc_id, start, length, *_ in packer.rows)
    for doc_id in range(40):
        at = 0
        for _, start, length in [r for r in rows if r[0] == doc_id]:
            assert start == at
            at += length
        assert at == 9
