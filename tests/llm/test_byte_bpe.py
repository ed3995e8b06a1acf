import base64
import hashlib
import random

import public_tokenizers as P
import pyarrow.parquet as pq
import tiktoken
from corpusloom.llm.byte_bpe import _codec, _path, decode, digests, encode

DOCS = "doc_id long, text string, ids string"


def library():
    with open(_path(None), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "  a", "a  b", "a\n b\n\n  c ", "\t x", "a  b", "　 x", "it's I'LL 'd 's", "日本語 テキスト", "👩‍👩‍👧 ok", "éé è́", "aaaaaaaaaaaaaaaaaaaaaaa", "=====----=====", "x\x1c y\x85 z​ w", "123 4567", "<|endoftext|>"]


def test_ids_equal_tiktoken():
    rng = random.Random(1)
    letters = "ab é日\n\t  '.s1 😀_ñA"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    texts += [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    codec, lib = _codec(_path(None), P.PATTERN), library()
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == lib.encode_ordinary(text), text
        assert codec.decode_bytes(ids) == text.encode()


def test_query_round_trip_and_offsets(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(90, None, None), (91, "same", ""), (91, "same", "")]
    df, lib = spark.createDataFrame(rows, DOCS), library()
    got = sorted(tuple(r) for r in digests(df).collect())
    want = []
    for i, t, _ in rows:
        ids = lib.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    back = {r.doc_id: (r.text, bytes(r.raw)) for r in decode(encode(df)).collect()}
    assert all(back[i] == ((t or ""), (t or "").encode()) for i, t, _ in rows)
    for r in encode(df).collect():
        text = dict((i, t) for i, t, _ in rows)[r.doc_id] or ""
        for token, a, b in zip(r.ids, r.starts, r.ends, strict=True):
            assert lib.decode_single_token_bytes(token) in text[a:b].encode()
    assert digests(spark.createDataFrame([], DOCS)).collect() == []
