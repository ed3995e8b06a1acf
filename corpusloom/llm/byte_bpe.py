"""Byte-level BPE with the tokenizers library over Arrow batches, from a table of ranks."""

from __future__ import annotations

import base64
import codecs
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

#: Pieces whose ids a worker remembers; the memory is emptied when full.
REMEMBERED = 400_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        table.setdefault(b, chr(0x100 + len(table) - len(plain)))
    return [table[b] for b in range(256)]


class Codec:
    """Encodes as the ranks and the pattern say; every token is known by its bytes."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        chars = byte_characters()
        shown = {token: "".join(map(chars.__getitem__, token)) for token in ranks}
        merges = []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if token[:cut] in ranks and token[cut:] in ranks:
                    merges.append((rank, cut, shown[token[:cut]], shown[token[cut:]]))
        merges.sort()
        self.tokenizer = Tokenizer(models.BPE({shown[t]: r for t, r in ranks.items()}, [m[2:] for m in merges], ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = max(ranks.values()) + 1
        back = {c: b for b, c in enumerate(chars)}
        self.bytes = [b""] * size
        for token, rank in ranks.items():
            self.bytes[rank] = bytes(back[c] for c in shown[token])
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.decimal = [str(i).encode() for i in range(size)]
        self.known: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[str]:
        """The text cut before spaces that follow a character that is no white space: tokens never cross there."""
        parts = text.split(" ")
        if "" not in parts and not any(p[-1].isspace() or p[-1] < "!" for p in parts):
            return [parts[0], *[" " + p for p in parts[1:]]]
        out, at, end = [], 0, len(parts[0])
        for before, part in zip(parts, parts[1:], strict=False):
            if before and not before[-1].isspace() and before[-1] >= "!":
                out.append(text[at:end])
                at = end
            end += 1 + len(part)
        out.append(text[at:])
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self._pieces(text) for text in texts]
        fresh = list(set().union(*split).difference(self.known))
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = list(set().union(*split))
        for at in range(0, len(fresh), 4096):
            part = fresh[at : at + 4096]
            encoded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update((p, array("I", e.ids).tobytes()) for p, e in zip(part, encoded, strict=True))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.uint32) for pieces in split]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of each token; a token that holds part of a character spans it all."""
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        return character[starts], character[ends - 1] + 1


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def decode_stream(pieces: list[bytes]) -> str:
    """Text from token bytes; a character split over tokens is kept back until its last byte is there."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    return "".join([*map(decoder.decode, pieces), decoder.decode(b"", final=True)])


def _path(ranks: str | None) -> str:
    return ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[list, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def encode(docs: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, ids, starts, ends (character offsets of each token).

    A null text counts as empty and has no ids; repeated rows give repeated rows; other
    columns are not read; an empty table gives no rows.
    """
    path = _path(ranks)

    def run(batches):
        for doc_ids, texts in _parts(batches):
            codec, texts = _codec(path, pattern), [t or "" for t in texts]
            ids = codec.encode(texts)
            spans = [codec.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
            kinds = [pa.list_(pa.int32())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *[pa.array(x, k) for x, k in zip((ids, [s[0] for s in spans], [s[1] for s in spans]), kinds, strict=True)]], ["doc_id", "ids", "starts", "ends"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``encoded(doc_id, ids)`` -> doc_id, text, raw (the exact bytes). Null ids count as none."""
    path = _path(ranks)

    def run(batches):
        for doc_ids, ids in _parts(batches):
            codec = _codec(path, pattern)
            pieces = [[codec.bytes[i] for i in x or ()] for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(map(decode_stream, pieces), pa.string()), pa.array(map(b"".join, pieces), pa.binary())], ["doc_id", "text", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string, raw binary")


def digests(docs: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode and decode every text in one pass: doc_id, n_tokens and the SHA-256 of ids and of decoded bytes.

    Cases as for ``encode``.
    """
    path = _path(ranks)

    def run(batches):
        for doc_ids, texts in _parts(batches):
            codec = _codec(path, pattern)
            rows = []
            for ids in codec.encode([t or "" for t in texts]):
                numbers = ids.tolist()
                decimal = b",".join(map(codec.decimal.__getitem__, numbers))
                rows.append((len(numbers), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(b"".join(map(codec.bytes.__getitem__, numbers))).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
