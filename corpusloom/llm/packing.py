"""Sum-of-squares online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.byte_bpe import byte_characters

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words whose ids a worker remembers, of the newest and of the last generation each: some 40 MB a generation.
REMEMBERED = 200_000
#: A character that parts words in one call; words that hold it are encoded one by one.
MARK = "\x01"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_known: dict[str, list[dict[bytes, bytes]]] = {}
BYTES = {b: c for b, c in enumerate(byte_characters())}


def _encoded(words: list[str], path: str) -> list[bytes]:
    """The ids of each word, in one call: the words are joined by a mark, whose one id then parts them."""
    tokenizer = _tokenizer(path)
    mark = tokenizer.encode(MARK, add_special_tokens=False).ids
    text = f" {MARK} ".join(words)
    if len(mark) != 1 or text.count(MARK) != len(words) - 1:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
    cuts = np.nonzero(ids == mark[0])[0]
    if len(cuts) != len(words) - 1:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    raw, starts, ends = ids.tobytes(), [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
    return [raw[4 * i : 4 * j] for i, j in zip(starts, ends, strict=True)]


def _latin(letters: bytes) -> str | None:
    """The word lower-cased, one character a byte as the model wants it, if all of it is Latin-1 letters; normal forms leave those alone."""
    try:
        word = letters.decode()
        word.encode("latin-1")
    except UnicodeError:
        return None
    return word.lower().encode().decode("latin-1").translate(BYTES) if word.isalpha() else None


def _plain(words: list[bytes], known: dict[bytes, bytes], path: str) -> list[bytes]:
    """Encodes Latin-1 words with at most a full stop or comma after them; returns the others.

    Such a word passes the normaliser and the splitter as its lower-cased letters and its
    mark, so its letters go straight to the library's model.
    """
    tokenizer, others = _tokenizer(path), []
    tokenize = tokenizer.model.tokenize
    ends = {chr(c).encode(): array("I", tokenizer.encode(chr(c), add_special_tokens=False).ids).tobytes() for c in b".,"}
    for word in words:
        end = ends.get(word[-1:], b"")
        bare = word[:-1] if end else word
        if bare.isalpha():
            lower = bare.lower()
            ids = known.get(lower)
            letters = None if ids else lower.decode()
        else:
            ids, letters = None, _latin(bare)
        if letters:
            ids = array("I", [t.id for t in tokenize(letters)]).tobytes()
        if ids:
            known[word] = ids + end
        else:
            others.append(word)
    return others


def word_ids(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers.

    The tokenizer never joins characters across ASCII white space, so each distinct
    word goes through the tokenizers library once and its ids are then looked up; the
    name of a special token inside a text is that token, as by the library. When the
    memory is full, words that are still met move on and the others are forgotten.
    """
    memory = _known.setdefault(path, [{}, {}])
    split = [text.encode("utf-8", "replace").split() for text in texts]
    met = set().union(*split)
    fresh = met.difference(memory[0])
    if len(memory[0]) + len(fresh) > REMEMBERED:
        memory[:] = {}, memory[0]
        fresh = met
    known, old = memory
    again = old.keys() & fresh
    known.update((word, old[word]) for word in again)
    fresh = _plain(list(fresh - again), known, path)
    for at in range(0, len(fresh), 512):
        part = fresh[at : at + 512]
        known.update(zip(part, _encoded([word.decode() for word in part], path), strict=True))
    return [b"".join(map(known.__getitem__, words)) for words in split]


class Packer:
    """Windows of ``size`` ids. ``levels[h]`` counts the open windows that hold h ids.

    A remainder of s ids goes to the level h that makes the sum of squared counts
    smallest (h = 0: a new window), the fullest such level on a tie. Windows that are
    still open at the end are merged by cutting pieces of the emptiest into the fullest;
    the ids of the last one are laid out in sequences whose lengths are powers of two.
    Whenever more than ``max_open`` are open, only the fullest is completed in that way;
    all others keep their levels, so placement goes on as before.
    """

    def __init__(self, size: int, first_id: int, max_open: int):
        self.size, self.next_id, self.max_open = size, first_id, max_open
        self.levels = np.zeros(size + 1)
        self.levels[size] = -0.5  # a full window leaves the sum
        self.open: dict[int, list[list]] = {}
        self.n_open = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // 4
        whole = n - n % self.size
        for start in range(0, whole, self.size):
            self._close([(doc_id, start, ids[4 * start : 4 * (start + self.size)], n)])
        if whole < n:
            self._place((doc_id, whole, ids[4 * whole :], n), n - whole)
        while self.n_open > self.max_open:
            self._complete_fullest()

    def _place(self, piece: tuple, s: int) -> None:
        n = self.levels
        below = n[1 : self.size - s + 1]
        gain = np.where(below > 0, 2 * n[1 + s : self.size + 1] - 2 * below + 2, np.inf)
        h = len(gain) - int(np.argmin(gain[::-1])) if len(gain) else 0
        if not len(gain) or gain[h - 1] > 2 * n[s] + 1:
            h, window = 0, []
        else:
            window = self._take(h)
        window.append(piece)
        if h + s == self.size:
            self._close(window)
        else:
            self._reopen(h + s, window)

    def _close(self, window: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in window:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1

    def _take(self, level: int) -> list[tuple]:
        self.levels[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _complete_fullest(self) -> None:
        """Fill the fullest open window with pieces cut from the emptiest; what is left of those stays open."""
        held = np.nonzero(self.levels[: self.size] > 0)[0]
        fill = int(held[-1])
        target = self._take(fill)
        while fill < self.size and self.n_open:
            left = int(np.argmax(self.levels[: self.size] > 0))
            source = self._take(left)
            while source and fill < self.size:
                doc_id, start, ids, n = source.pop()
                take = min(self.size - fill, len(ids) // 4)
                target.append((doc_id, start, ids[: 4 * take], n))
                fill, left = fill + take, left - take
                if 4 * take < len(ids):
                    source.append((doc_id, start + take, ids[4 * take :], n))
            if source:
                self._reopen(left, source)
        if fill == self.size:
            self._close(target)
        else:
            self._reopen(fill, target)

    def _reopen(self, level: int, window: list[tuple]) -> None:
        self.open.setdefault(level, []).append(window)
        self.levels[level] += 1
        self.n_open += 1

    def finish(self) -> None:
        windows = [(h, w) for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.open, self.n_open = {}, 0
        self.levels[: self.size] = 0
        i, j = 0, len(windows) - 1
        while i < j:
            fill, target = windows[i]
            left, source = windows[j]
            doc_id, start, ids, n = source.pop()
            take = min(self.size - fill, len(ids) // 4)
            target.append((doc_id, start, ids[: 4 * take], n))
            if 4 * take < len(ids):
                source.append((doc_id, start + take, ids[4 * take :], n))
            windows[i], windows[j] = (fill + take, target), (left - take, source)
            if not source:
                j -= 1
            if fill + take == self.size:
                self._close(target)
                i += 1
        if i == j:
            self._powers_of_two(windows[i][1], windows[i][0])

    def _powers_of_two(self, pieces: list[tuple], fill: int) -> None:
        pieces = pieces[::-1]
        while fill:
            want = 1 << (fill.bit_length() - 1)
            fill -= want
            part = []
            while want:
                doc_id, start, ids, n = pieces.pop()
                take = min(want, len(ids) // 4)
                part.append((doc_id, start, ids[: 4 * take], n))
                if 4 * take < len(ids):
                    pieces.append((doc_id, start + take, ids[4 * take :], n))
                want -= take
            self._close(part)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [field.split()[0] for field in SCHEMA.split(", ")]
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(docs: DataFrame, size: int = 2048, end_id: int = 1, max_open: int = 8192) -> DataFrame:
    """Pack every document of ``docs(doc_id, text)`` into sequences of at most ``size`` ids.

    One row a piece: doc_id, start (ids of its document before it), length, ids_crc32,
    doc_tokens, sequence_id, offset. Each task packs the rows that it reads, online and
    without a shuffle; sequence ids hold the task's number. No sequence needs padding:
    it is full, or its length is a power of two. A task holds at most ``max_open`` windows
    open (4 * ``size`` bytes each); beyond that it completes the fullest with ids of the
    emptiest, and all other levels stay. Ids are those of the public word_bpe_49k vocabulary.

    A null or empty text is the one id ``end_id``. A null doc_id stays null. Repeated
    rows are packed as often as they occur. Texts of any length are cut into windows.
    An empty table gives no rows; other columns of ``docs`` are not read.
    """
    path = public_tokenizers.path("word_bpe_49k.json")
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, TaskContext.get().partitionId() << 40, max_open)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                part = [text or "" for text in texts.slice(at, 256).to_pylist()]
                for doc_id, encoded in zip(ids[at : at + 256], word_ids(part, path), strict=True):
                    packer.add(doc_id, encoded + end)
                yield packer.taken()
        packer.finish()
        yield packer.taken()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
