"""Words and their hashes over Arrow text columns, as numpy arrays without one Python object a word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
KEEP_CASE = np.arange(256, dtype=np.uint8)
LOWER = KEEP_CASE.copy()
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of text that are worked on at once; arrays of eight bytes a byte of text exist for one such block.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for large integer arrays much faster than numpy's own."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and for each element the number of its value."""
    order = np.argsort(x)
    x = x[order]
    new = np.append(True, x[1:] != x[:-1]) if len(x) else np.zeros(0, bool)
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    return x[new], number


def _table(lane: int) -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64) + np.uint64((1 + 1000 * lane) * 0x9E3779B97F4A7C15 % 2**64))


TABLES = [_table(1), _table(2)]
STEPS = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]


def _powers(lane: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.multiply.accumulate(np.full(n - 1, STEPS[lane]), out=out[1:])
    return out


POWERS = [_powers(0, 1024), _powers(1, 1024)]


def powers(lane: int, n: int) -> np.ndarray:
    """The first n powers of a lane's step; those for very long words are made anew each time."""
    return POWERS[lane] if n <= len(POWERS[lane]) else _powers(lane, n)


@dataclass
class Words:
    """``data[starts[i]:ends[i]]`` is word i; document d has the words ``first[d]:first[d + 1]`` and the bytes ``bounds[d]:bounds[d + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    bounds: np.ndarray

    def hashes(self, lane: int = 0, fold: np.ndarray = KEEP_CASE) -> np.ndarray:
        """A 64-bit hash of each word's bytes, folded by a table first."""
        out = np.empty(len(self.starts), np.uint64)
        table, at = TABLES[lane][fold], 0
        while at < len(out):
            stop = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + BLOCK, "right")))
            s, n = self.starts[at:stop], self.ends[at:stop] - self.starts[at:stop]
            firsts = np.concatenate([[0], np.cumsum(n)[:-1]])
            inside = np.arange(int(n.sum())) - np.repeat(firsts, n)
            where = inside + np.repeat(s, n)
            values = table[self.data[where]]
            values *= powers(lane, int(n.max()))[inside]
            out[at:stop] = np.add.reduceat(values, firsts)
            at = stop
        return mix(out)


def texts_of(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One string array without nulls: a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    return column.cast(pa.large_string()).fill_null("")


def slices(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or of one row."""
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(stop, len(texts))
        at = stop


def words_of(texts: pa.Array) -> Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each text of a large_string array without nulls."""
    if not len(texts):
        return Words(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    solid = ~SPACE[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edges] = solid[edges]
    end[edges - 1] = solid[edges - 1]
    starts, ends = np.nonzero(begin)[0], np.nonzero(end)[0] + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), offsets)
