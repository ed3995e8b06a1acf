"""Substring dedup: a count-min sketch picks the word windows that may repeat, a second pass groups exactly those.

Documents are dealt once into groups of bounded size. Each group sends a sparse sketch of
its windows, cut into blocks of cells; each block adds up the sketches of all groups, a
group counting once a cell and sums stopping at two, for "repeated" is all that is asked
of them, and answers, to each group, which of its cells others hold too. Windows whose
every cell others hold, or that the group holds twice, are then grouped exactly, by 128-bit hashes, in shards that
answer which windows start in an earlier document of another group. Answers are bit
arrays, so that neither windows nor sketches ever meet in one place, and the sketch
grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.llm.words import Words, distinct, mix, numbered, slices, texts_of, words_of

MESSAGE = "g long, kind int, part long, keys binary, more binary, mins binary"
SEEDS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)]
BLOCK_BITS = 22
TURN = [np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95)]


class Group:
    """The windows of one group's documents that have an id: two hash lanes, and the row of the document that each starts in."""

    def __init__(self, table: pa.Table, window: int):
        ids = table.column("doc_id").combine_chunks()
        self.ids, self.window = ids, window
        known = np.asarray(ids.is_valid())
        self.id_values = np.asarray(ids.fill_null(0), np.int64)
        self.texts = texts_of(table.column("text"))
        lanes, docs, ats, base = [[], []], [], [], 0
        for a, b, words in self.words():
            doc_of = np.repeat(np.arange(a, b, dtype=np.int32), np.diff(words.first))
            n = len(words.starts) - window + 1
            docs.append(doc_of)
            inside = np.zeros(len(doc_of), bool)
            if n > 0:
                inside[:n] = (doc_of[:n] == doc_of[window - 1 :]) & known[doc_of[:n]]
            for lane in (0, 1):
                h = words.hashes(lane)
                key = np.zeros(len(doc_of), np.uint64)
                if n > 0:
                    for j in range(window):
                        key[:n] = key[:n] * TURN[lane] + h[j : j + n]
                lanes[lane].append(mix(key)[inside])
            ats.append((np.nonzero(inside)[0] + base).astype(np.int32))
            base += len(doc_of)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.word_doc, self.at = join(docs, np.int32), join(ats, np.int32)
        self.a, self.b = (join(lane, np.uint64) for lane in lanes)

    def words(self) -> Iterator[tuple[int, int, Words]]:
        """The words of a slice of rows at a time; found anew each time, so that they are never all in memory."""
        for a, b in slices(self.texts):
            yield a, b, words_of(self.texts.slice(a, b - a))

    def doc(self, rows: np.ndarray) -> np.ndarray:
        """The doc_id in which each of some windows starts."""
        return self.id_values[self.word_doc[self.at[rows]]]

    def cells(self, keys: np.ndarray, row: int, bits: int) -> np.ndarray:
        return mix(keys * SEEDS[row]) >> np.uint64(64 - bits)


def _packed(cells: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted distinct cells of one block as 16-bit steps, with the few larger steps listed apart."""
    steps = np.diff(cells, prepend=np.uint64(0))
    large = steps >= 0xFFFF
    return np.where(large, 0xFFFF, steps).astype("<u2").tobytes(), steps[large].astype("<u4").tobytes()


def _unpacked(keys: bytes, more: bytes) -> np.ndarray:
    steps = np.frombuffer(keys, "<u2").astype(np.int64)
    steps[steps == 0xFFFF] = np.frombuffer(more, "<u4")
    return np.cumsum(steps)


def _messages(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["g", "kind", "part", "keys", "more", "mins"])


def _split(values: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) for the runs of equal high bits in sorted values."""
    if len(values):
        parts = values >> np.uint64(shift)
        cuts = np.concatenate([[0], np.nonzero(np.diff(parts))[0] + 1, [len(parts)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(parts[a]), int(a), int(b)


def _sketch(group: Group, g: int, depth: int, bits: int) -> pa.Table:
    rows, low = [], np.uint64((1 << BLOCK_BITS) - 1)
    for row in range(depth):
        cells = distinct(group.cells(group.a, row, bits))
        for block, a, b in _split(cells, BLOCK_BITS):
            rows.append((g, 0, (row << 48) | block, *_packed(cells[a:b] & low), b""))
    return _messages(rows)


def _merge_block(table: pa.Table) -> pa.Table:
    """Adds up the groups' sketches of one block; a set bit answers a cell that more than one group holds."""
    counts = np.zeros(1 << BLOCK_BITS, np.uint8)
    rows = table.to_pydict()
    for keys, more in zip(rows["keys"], rows["more"], strict=True):
        cells = _unpacked(keys, more)
        counts[cells] += counts[cells] < 2
    out = []
    for g, part, keys, more in zip(rows["g"], rows["part"], rows["keys"], rows["more"], strict=True):
        out.append((g, 0, part, np.packbits(counts[_unpacked(keys, more)] > 1).tobytes(), b"", b""))
    return _messages(out)


class Candidates:
    """The windows of a group that may repeat: their distinct keys, and the smallest document of the group for each."""

    def __init__(self, group: Group, answers: dict, depth: int, bits: int):
        keys, inverse = numbered(group.a)
        counts = np.bincount(inverse, minlength=len(keys))
        elsewhere = np.ones(len(keys), bool)
        for row in range(depth):
            cells, number = numbered(group.cells(keys, row, bits))
            held = np.zeros(len(cells), bool)
            for block, a, b in _split(cells, BLOCK_BITS):
                held[a:b] = np.unpackbits(np.frombuffer(answers[(0, (row << 48) | block)], np.uint8), count=b - a)
            elsewhere &= held[number]
        self.rows = np.nonzero((elsewhere | (counts > 1))[inverse])[0]
        a, b, doc = group.a[self.rows], group.b[self.rows], group.doc(self.rows)
        order = np.lexsort((doc, b, a))
        a, b, doc = a[order], b[order], doc[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.number = np.empty(len(a), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.a, self.b, self.least = a[new], b[new], doc[new]
        self.elsewhere = elsewhere[np.searchsorted(keys, self.a)]


def _exact(group: Group, answers: dict, g: int, depth: int, bits: int, shard_bits: int) -> pa.Table:
    found = Candidates(group, answers, depth, bits)
    sent = found.elsewhere
    a, b, least = found.a[sent], found.b[sent], found.least[sent]
    shift = 64 - shard_bits
    cuts = _split(a, shift) if shard_bits else ([(0, 0, len(a))] if len(a) else [])
    return _messages([(g, 1, part, a[i:j].tobytes(), b[i:j].tobytes(), least[i:j].tobytes()) for part, i, j in cuts])


def _merge_shard(table: pa.Table) -> pa.Table:
    """Groups the windows of one shard exactly; a set bit answers that an earlier document of another group has it."""
    rows = table.to_pydict()
    a, b, least = (np.frombuffer(b"".join(rows[c]), kind) for c, kind in (("keys", np.uint64), ("more", np.uint64), ("mins", np.int64)))
    order = np.lexsort((least, b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    smallest = np.empty(len(a), np.int64)
    smallest[order] = least[order][new][np.cumsum(new) - 1]
    earlier, out, at = smallest < least, [], 0
    for g, part, keys in zip(rows["g"], rows["part"], rows["keys"], strict=True):
        n = len(keys) // 8
        out.append((g, 1, part, np.packbits(earlier[at : at + n]).tobytes(), b"", b""))
        at += n
    return _messages(out)


def _cut(words: Words, gone: np.ndarray) -> list[bytes]:
    """The texts without the words that are gone and the white space after each."""
    n = len(words.starts)
    bounds = words.bounds
    last = np.zeros(n, bool)
    last[words.first[1:][words.first[1:] > words.first[:-1]] - 1] = True
    stops = np.append(words.starts[1:], len(words.data))
    stops[last] = bounds[1:][words.first[1:] > words.first[:-1]]
    change = np.zeros(len(words.data) + 1, np.int32)
    np.add.at(change, words.starts[gone], 1)
    np.add.at(change, stops[gone], -1)
    keep = np.cumsum(change[:-1]) == 0
    raw = words.data[keep].tobytes()
    ends = np.concatenate([[0], np.cumsum(keep)])[bounds]
    return [raw[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _remove(group: Group, table: pa.Table, answers: dict, depth: int, bits: int, shard_bits: int, whole: bool) -> pa.Table:
    found = Candidates(group, answers, depth, bits)
    flags = np.zeros(len(found.a), bool)
    sent = np.nonzero(found.elsewhere)[0]
    keys = found.a[sent]
    cuts = _split(keys, 64 - shard_bits) if shard_bits else ([(0, 0, len(keys))] if len(keys) else [])
    for part, i, j in cuts:
        flags[sent[i:j]] = np.unpackbits(np.frombuffer(answers[(1, part)], np.uint8), count=j - i)
    again = flags[found.number] | (group.doc(found.rows) > found.least[found.number])
    at = group.at[found.rows[again]]
    depth_at = np.zeros(len(group.word_doc) + 1, np.int32)
    np.add.at(depth_at, at, 1)
    np.add.at(depth_at, at + group.window, -1)
    gone = np.cumsum(depth_at[:-1]) > 0
    n_words, n_removed, kept, base = [], [], [], 0
    for _, _, words in group.words():
        n = len(words.starts)
        keep = ~gone[base : base + n]
        total = np.concatenate([[0], np.cumsum(~keep)])
        n_words.append(np.diff(words.first))
        n_removed.append(total[words.first[1:]] - total[words.first[:-1]])
        base += n
        if whole:
            kept += _cut(words, ~keep)
            continue
        sizes = np.where(keep, words.ends - words.starts + 1, 0)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        picked = words.starts[keep]
        lengths = sizes[keep]
        where = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(picked, lengths)
        out = np.where(where < len(words.data), words.data[np.minimum(where, len(words.data) - 1)], 32).astype(np.uint8) if len(where) else np.zeros(0, np.uint8)
        out[np.cumsum(lengths) - 1] = 32
        raw, bounds = out.tobytes(), ends[words.first]
        kept += [raw[i : max(i, j - 1)] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    counts = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (n_words, n_removed)]
    columns = {"doc_id": group.ids, "n_words": counts[0], "n_removed": counts[1], "kept": pa.array(kept, pa.binary()).cast(pa.string())}
    if "carried" in table.column_names:
        columns["carried"] = table.column("carried")
    return pa.table(columns)


def remove_repeats(docs: DataFrame, window: int = 13, group_bytes: int = 6 << 20, cells_per_window: int = 4, depth: int = 2, carry: list[str] | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    With a list ``carry``, ``kept`` is the text itself without the words that go, white
    space otherwise as it was, and a struct ``carried`` (if any are named) holds the
    columns named, whatever their names.

    A word ``[^\\x20\\x09-\\x0D]+`` goes if a window of ``window`` words of its document
    covers it whose words also start, somewhere, in a document with a smaller doc_id.
    All windows are judged on the input. ``cells_per_window`` and ``depth`` set the
    count-min sketch: its estimates are never too low, so no window is lost, and a
    smaller sketch only sends more windows to the exact pass. One aggregate over the
    text sizes first sets the numbers of groups, cells, shards and partitions. What a
    block or shard gets grows, for a window that every group holds, by a row a group.

    A null or empty text has no words. A document shorter than a window stays. A row
    without a doc_id keeps its words and takes none from others. Rows that repeat a
    doc_id are each judged against smaller ids only. Texts of any length stay whole. Other columns
    are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, ceil(total / group_bytes))
    bits = BLOCK_BITS + max(0, ceil(log2(max(1, cells_per_window * total / 6 / (1 << BLOCK_BITS)))))
    shard_bits = max(0, ceil(log2(max(1, total / 6 / 1.5e6))))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(groups / 64))
    carried = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("g"), *carried).repartition(partitions, "g")
    out = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept string")
    if carry:
        out.add(dealt.schema["carried"])

    def answers_of(table: pa.Table) -> dict:
        rows = table.to_pydict()
        return {(k, p): bits for k, p, bits in zip(rows["kind"], rows["part"], rows["keys"], strict=True)}

    def number(left: pa.Table) -> int:
        return left.column("g")[0].as_py()

    def sketch(left: pa.Table) -> pa.Table:
        return _sketch(Group(left, window), number(left), depth, bits)

    def exact(left: pa.Table, right: pa.Table) -> pa.Table:
        return _exact(Group(left, window), answers_of(right), number(left), depth, bits, shard_bits)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        return _remove(Group(left, window), left, answers_of(right), depth, bits, shard_bits, carry is not None)

    blocks = dealt.groupBy("g").applyInArrow(sketch, MESSAGE).groupBy("part").applyInArrow(_merge_block, MESSAGE)
    shards = dealt.groupBy("g").cogroup(blocks.groupBy("g")).applyInArrow(exact, MESSAGE).groupBy("part").applyInArrow(_merge_shard, MESSAGE)
    return dealt.groupBy("g").cogroup(blocks.union(shards).groupBy("g")).applyInArrow(remove, out)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
