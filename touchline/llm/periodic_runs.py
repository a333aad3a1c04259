"""Periodic runs of words: stretches that repeat a period at least four times.

The diagonal of lag q holds the words that equal the word q before them; a run
of period q is a stretch of matches on it.  Going over the words, each one's
earlier occurrence makes the match length of its lag grow by one, and a lag that
the next word does not continue ends and gives its run at once.

Of all earlier occurrences only few can matter, so the diagonals stay sparse.
Lags go by octaves, 2^j <= q < 2^(j+1), and in an octave a word counts together
with its context, the k = 2^(j+1) words that begin with it.  Inside a run of
smallest period q, two equal contexts less than q apart would give the run a
smaller period (q and their distance add up to no more than their stretch), so
the *latest* earlier occurrence of the context is exactly q before; one lag for
a word and octave is all there is to follow.  As q < k and a run has 4 q words
or more, its first contexts fit, and the lag changes exactly where the run
begins and ends.  A lag that is no smallest period never shows up over a whole
run, for the smaller one is nearer.  Contexts that occur once cannot be part of
longer ones that recur and leave before the next octave: n words take
O(n log n), also where one word is all of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.byteblocks import SPACE_ENDED, Block, Words, blocks, row_of, words
from touchline.llm.shared import mix64

#: The least length of a run, and how often its period must fit.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Kept words whose bytes are gathered at once.
GATHERED = 1 << 17

RUNS_DDL = "array<struct<start:bigint,length:bigint,period:bigint>>"


def diagonal_runs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period; rows begin at the places ``first``, the last one ends there."""
    stop = np.repeat(first[1:], np.diff(first))
    begin = np.repeat(first[:-1], np.diff(first))
    context = mix64(hashes ^ mix64(begin.astype(np.uint64) + np.uint64(1)))  # equal in one row only
    open_, reach = np.ones(len(hashes), bool), 1
    found = []
    while True:
        # Contexts of twice the length, where both halves recur, fit in the row, and four such lags would fit, too.
        low, reach = reach, 2 * reach
        at = np.flatnonzero(open_ & (stop - np.arange(len(stop)) >= reach) & (stop - begin >= LEAST_PERIODS * low))
        at = at[open_[at + low]]
        if not len(at):
            break
        joined = mix64(context[at] + mix64(context[at + low] ^ np.uint64(reach)))
        order = np.argsort(joined, kind="stable")
        same = np.flatnonzero(joined[order[1:]] == joined[order[:-1]])
        later, earlier = at[order[same + 1]], at[order[same]]
        context[at] = joined
        open_ = np.zeros(len(hashes), bool)
        open_[later] = open_[earlier] = True
        lag = np.zeros(len(hashes), np.int64)
        lag[later] = later - earlier
        active = np.flatnonzero((lag >= low) & (lag < reach))
        if len(active):
            goes_on = (np.diff(active) == 1) & (np.diff(lag[active]) == 0)
            begins = active[np.concatenate([[True], ~goes_on])]
            ends = active[np.concatenate([~goes_on, [True]])]
            period = lag[begins]
            start, length = begins - period, ends + reach - (begins - period)
            enough = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
            found.append((start[enough], length[enough], period[enough]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(part) for part in zip(*found))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _kept(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """False for the words that a run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:n]) == 0


def _joined(block: Block, found: Words, keep: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The kept words of each row, joined by one space: pieces of bytes, and the length of each row."""
    rows = row_of(found.rows)[keep]
    starts, ends = found.starts[keep], found.ends[keep]
    lead = np.zeros(len(rows), np.int64)
    lead[1:] = rows[1:] == rows[:-1]
    size = ends - starts + lead
    pieces = []
    for at in range(0, len(rows), GATHERED):
        part = slice(at, at + GATHERED)
        out = np.cumsum(size[part]) - size[part]
        place = np.arange(int(size[part].sum())) + np.repeat(starts[part] - lead[part] - out, size[part])
        piece = block.data[place]
        piece[out[lead[part] == 1]] = 0x20
        pieces.append(piece)
    return pieces, np.bincount(rows, size, block.rows).astype(np.int64)


def _runs_and_rest(column: pa.Array) -> pa.Array:
    """Runs and collapsed text of each row."""
    parts, counts, pieces, sizes = [], [], [], []
    for block in blocks(column):
        found = words(block, SPACE_ENDED, folded=False)
        start, length, period = diagonal_runs(found.hashes, found.rows)
        row = np.searchsorted(found.rows, start, side="right") - 1
        parts.append((start - found.rows[row], length, period))
        counts.append(np.bincount(row, minlength=block.rows))
        more, size = _joined(block, found, _kept(len(found.hashes), start, length, period))
        pieces += more
        sizes.append(size)

    def offsets(lengths: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([[0], *lengths]).cumsum().astype(np.int32)

    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
    runs = pa.ListArray.from_arrays(pa.array(offsets(counts)), pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["start", "length", "period"]))
    data = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)
    collapsed = pa.StringArray.from_buffers(len(column), pa.py_buffer(offsets(sizes)), pa.py_buffer(data))
    return pa.StructArray.from_arrays([runs, collapsed], names=["runs", "collapsed"])


def found_runs(text: Column) -> Column:
    """runs (by start, then period) and collapsed: a struct.  Only the text goes to Python, all else stays in the JVM."""
    @F.arrow_udf(f"struct<runs:{RUNS_DDL},collapsed:string>")
    def search(column: pa.Array) -> pa.Array:
        return _runs_and_rest(column)

    return search(text)


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, and runs and collapsed, which replace columns of these names.

    Words are what white space of ASCII leaves, compared byte by byte (as 64-bit
    hashes).  ``runs`` has start (word number from 0), length and period of each
    stretch with smallest period q and at least max(6, 4 q) words that no
    neighbouring word extends; ``collapsed`` has the words that no run contains
    after its first period, joined by one space.  A null or empty text, or one
    without words, has no run and an empty rest.  Rows are independent: repeated
    ones and rows with nulls elsewhere get their own results.  A text is one
    task's work, in memory of some 100 bytes a word.
    """
    found = docs.drop("runs", "collapsed").withColumn("__found", found_runs(F.col(f"`{text}`")))
    return found.select("*", "__found.runs", "__found.collapsed").drop("__found")


def longest(runs: Column) -> Column:
    """The run with the greatest length; of such, the first, and then the one with the smallest period; null if there is none."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("rank"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(ranked)


def listed(runs: Column) -> Column:
    """``start,length,period`` and a line feed for each run."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return F.array_join(lines, "")
