"""Words of many texts at once, as 64-bit hashes, with numpy on the Arrow buffers.

A text column is one run of UTF-8 bytes, so word starts, ends and polynomial
hashes of all words of a block come from a few array passes and cost no Python
object per word.  ASCII capitals are folded while hashing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from touchline.llm.shared import mix64

BLOCK_BYTES = 1 << 20

#: ASCII white space ends a word; or everything ASCII but letters and digits does.
SPACE_ENDED = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
ALNUM_ONLY = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])

_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_exact = np.arange(256, dtype=np.uint64)
_EXACT_VALUES = mix64((_exact + np.uint64(1)) * np.uint64(0x2545F4914F6CDD1D))
_FOLDED_VALUES = _EXACT_VALUES.copy()
_FOLDED_VALUES[65:91] = _EXACT_VALUES[97:123]
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, factor: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), factor, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= 4 * BLOCK_BYTES:  # a huge single text does not stay in the table
            _powers[kind] = have
    return have[:n]


@dataclass
class Block:
    """Consecutive rows of a column: their bytes, joined, and where each row begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray  # index of each row's first word, and the number of words at the end


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The rows in blocks of at most ``limit`` bytes, or one longer row; null counts as empty."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield Block(row, data[offsets[row]: offsets[end]], offsets[row: end + 1] - offsets[row])
        row = end


def words(block: Block, separators: np.ndarray, folded: bool = True) -> Words:
    """All words of a block with their hashes and byte positions; ASCII capitals are small letters if ``folded``."""
    data, offsets = block.data, block.offsets
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64))
    inside = ~separators[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < n]  # an empty row shares its edge with the next row
    starts[edges] = inside[edges]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    first, stop = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(span_hashes(data, first, stop, folded), first, stop, np.searchsorted(first, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool) -> np.ndarray:
    """64-bit hashes of byte spans, with ASCII capitals as small letters if ``folded``."""
    n = len(data)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_FOLDED_VALUES if folded else _EXACT_VALUES)[data] * _power("up", _FACTOR, n), out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * _power("down", _INVERSE, n)[starts])


def row_of(counts_from: np.ndarray) -> np.ndarray:
    """The row number of every item, from the index of each row's first item."""
    return np.repeat(np.arange(len(counts_from) - 1), np.diff(counts_from))
