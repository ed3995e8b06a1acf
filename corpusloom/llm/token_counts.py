"""Token counts by a whole-token shortcut.

``prove`` runs the model over its own vocabulary once and keeps the strings that encode,
as a pre-token of their own, as exactly one token. A text's pre-tokens that are among
them count one each without any merging; only the others go through the merges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.byte_bpe import byte_characters

#: Words whose counts a worker remembers, of the newest and of the last generation each; longer words than LONGEST are not kept.
REMEMBERED, LONGEST = 400_000, 64
#: A longer word is counted in parts, cut before ASCII digits: those are pre-tokens of their own and join nothing before them.
PART = 1 << 16
DIGIT = re.compile(rb"[0-9]")
#: Words of printable ASCII but the apostrophe, and of Latin-1 letters: normal forms leave them alone, and their pre-tokens
#: are runs of letters, single digits and runs of the rest.
SIMPLE = re.compile("[!-&(-~\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
PIECES = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+")
BYTES = dict(enumerate(byte_characters()))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def prove(path: str) -> frozenset[str]:
    """The pre-tokens, in the byte-level characters of the vocabulary, that the model encodes as one token.

    A vocabulary string only counts if the merges reach it: some are never made.
    """
    tokenizer = _tokenizer(path)
    model, end = tokenizer.model, tokenizer.model.end_of_word_suffix or ""
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    found = set()
    for token in tokenizer.get_vocab(with_added_tokens=False):
        piece = token.removesuffix(end)
        if token not in special and piece and (piece != token or not end) and len(model.tokenize(piece)) == 1:
            found.add(piece)
    return frozenset(found)


class Counter:
    """Counts the tokens of words that white space parts; a tokenizer that drops white space joins nothing across it."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tokenizer, self.whole = _tokenizer(path), whole
        if self.tokenizer.encode("a b", add_special_tokens=False).ids != [i for w in "ab" for i in self.tokenizer.encode(w, add_special_tokens=False).ids]:
            raise ValueError("the tokenizer joins characters across white space")
        self.names = re.compile(b"|".join(re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()) or b"(?!)")
        self.tokenize = self.tokenizer.model.tokenize
        self.known: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def _pieces(self, word: bytes) -> int:
        """Pre-tokens that are proved whole count one, only the others are merged."""
        if self.names.search(word):  # the library's own way with names of special tokens
            return len(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)
        text, whole, n = word.decode("utf-8", "replace"), self.whole, 0
        if SIMPLE.fullmatch(text):
            pieces = PIECES.findall(text.lower())
            if not word.isascii():
                pieces = [p.encode().decode("latin-1").translate(BYTES) for p in pieces]
        else:
            pieces = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]
        for piece in pieces:
            n += 1 if piece in whole else len(self.tokenize(piece))
        return n

    def _word(self, word: bytes) -> int:
        if len(word) <= PART:
            return self._pieces(word)
        total, at = 0, 0
        while at < len(word):
            cut = DIGIT.search(word, at + PART)
            stop = cut.start() if cut else len(word)
            total += self._pieces(word[at:stop])
            at = stop
        return total

    def count(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text; a few texts at a time, as their distinct words are held."""
        split = [text.split() for text in texts]
        met = set().union(*split)
        fresh = met.difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known, self.old = {}, self.known
            fresh = met
        known, old, passing = self.known, self.old, []
        for word in fresh:
            n = old.get(word)
            known[word] = self._word(word) if n is None else n
            if len(word) > LONGEST:
                passing.append(word)
        counts = [sum(map(known.__getitem__, words)) for words in split]
        for word in passing:
            del known[word]
        return counts


def count_tokens(docs: DataFrame, limit: int = 2048, path: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``path`` names a tokenizer of the tokenizers library with the normaliser and
    pre-tokenizer of the public word_bpe_49k vocabulary, which is the default. Counts are those of the
    library without added special tokens; a special token's name inside a text is that
    token, as by the library's default. Each task counts the rows that it reads, without
    a shuffle. What the driver sends out is bounded by the vocabulary.

    A null or empty text has no bytes and no tokens; a null doc_id stays null; repeated
    rows give repeated rows; texts of any length are counted whole; other columns are not
    read; an empty table gives no rows.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    whole = docs.sparkSession.sparkContext.broadcast(prove(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(path, whole.value)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = counter.count(part.column(1).to_pylist())
                sizes = part.column(1).cast(pa.large_binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pc.binary_length(sizes).cast(pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
