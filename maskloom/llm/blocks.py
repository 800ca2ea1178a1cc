"""Texts of an Arrow column as NumPy byte buffers, and their words, without a Python loop over words.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D; in UTF-8 these bytes only occur as those
characters, so bytes and code points cut alike. Words get 64-bit hashes from prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII that is neither letter nor digit.
SIGNS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

BLOCK = 1 << 21
_STEP = 1 << 19
_ODD = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


@dataclass
class Block:
    """Consecutive rows: their bytes, and where each text starts and ends."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def blocks(column: pa.Array | pa.ChunkedArray, most: int = BLOCK) -> Iterator[Block]:
    """Cut a column into blocks of about `most` bytes (one longer text makes its own block); null reads as empty."""
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        part = pc.fill_null(part.cast(pa.large_binary()), b"")
        if not len(part):
            continue
        _, places, values = part.buffers()
        offsets = np.frombuffer(places, dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
        row = 0
        while row < len(part):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
            base = offsets[row]
            yield Block(row, data[base : offsets[end]], offsets[row:end] - base, offsets[row + 1 : end + 1] - base)
            row = end
    pa.default_memory_pool().release_unused()  # else workers keep what their largest batch took


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        with np.errstate(over="ignore"):
            for p in (_ODD, pow(_ODD, -1, 1 << 64)):
                a = np.full(_STEP + 1, p, dtype=np.uint64)
                a[0] = 1
                _POWERS.append(np.multiply.accumulate(a))
    return _POWERS


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(31))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte values times powers over at most `_STEP` bytes; two of them give the hash of what lies between."""
    up = _powers()[0]
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for ascending runs that do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    down = _powers()[1]
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            low = starts[i]
            j = int(np.searchsorted(ends, low + _STEP, side="right"))
            if j <= i:  # one run is longer than a step: chain the hashes of its steps
                h = np.uint64(0)
                for k in range(low, ends[i], _STEP):
                    h = mixed(h * np.uint64(_ODD) + prefix_sums(data[k : min(k + _STEP, ends[i])])[-1])
                out[i] = h + np.uint64(ends[i] - low)
                i += 1
                continue
            s, e = starts[i:j] - low, ends[i:j] - low
            sums = prefix_sums(data[low : ends[j - 1]])
            out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
            i = j
    return mixed(out)


@dataclass
class Words:
    """Words of a block in order: byte range, document (row in the block) and hash."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    counts: np.ndarray


def words(block: Block, lower: bool = False, hashes: bool = True, breaks: np.ndarray = SPACE) -> Words:
    """`breaks` marks the byte values that end a word; they are ASCII."""
    data = LOWER[block.data] if lower else block.data
    space = breaks[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64), np.zeros(len(block), np.int64))
    edge = np.zeros(n + 1, dtype=bool)
    edge[block.starts] = True
    edge[block.ends] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    doc = np.searchsorted(block.ends, starts, side="right")
    h = hash_runs(data, starts, ends) if hashes else np.zeros(0, np.uint64)
    return Words(starts, ends, doc, h, np.bincount(doc, minlength=len(block)))


def joined_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n neighbours in a row; entry i covers i to i + n - 1, so the last n - 1 are missing."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = mixed(out * np.uint64(_ODD) + h[k : len(h) - n + 1 + k])
    return out
