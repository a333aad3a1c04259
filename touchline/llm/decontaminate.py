"""Benchmark passages in training texts, found with a generalised suffix automaton.

The automaton accepts every run of words of every benchmark item.  A text's
words are streamed through it; at each word it holds the longest run ending
there that occurs in some item.  Where that run has at least ``window`` words,
or contains a whole item of fewer words, the words of the window are hit, and
the state tells which items have it.

Items are dealt by hash into parts of bounded size.  Tasks build the automaton of
each part and write it, as flat sorted arrays, to the shared folder, beside one
index of all parts: which two words are neighbours in some item, and in which
part.  Workers map these files, so no item passes through the driver and texts
are read once, however many items there are.

Most words of a text cannot be part of a run: only stretches in which every two
neighbours are neighbours in some item of a part, too, are streamed, through
that part's automaton.  A run ends where such a stretch ends, so nothing is lost.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm import byteblocks
from touchline.llm.shared import append_columns, blob_rows, mix64, packed, unpacked
from touchline.llm.shared_files import mapped, write_arrays
from touchline.runtime import scratch_path

WINDOW = 10
#: Item texts of one automaton; a longer item has one of its own.
MAX_ITEM_BYTES = 1 << 20
#: A text loses its hit spans; if they hold a larger share of its words, it goes as a whole.
MAX_COVERAGE = 0.5
SPAN = "array<struct<begin:int,end:int>>"
FIELDS = [("n_words", "long"), ("word_spans", SPAN), ("byte_spans", SPAN), ("item_ids", "array<string>")]
_SPAN_TYPE = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
#: What makes the key of an item of one word differ from those of neighbours.
_ALONE = np.uint64(0xA0761D6478BD642F)
_KEY = np.dtype([("key", "<u8"), ("part", "<u4")])
#: Arrays of an automaton's file, behind their lengths.
_ARRAYS = [("vocabulary", "<u8"), ("first", "<i8"), ("words", "<i8"), ("next", "<i8"), ("link", "<i8"), ("length", "<i8"),
           ("window_first", "<i8"), ("window_items", "<i8"), ("whole_first", "<i8"), ("whole_items", "<i8"), ("whole_words", "<i8"),
           ("id_first", "<i8"), ("ids", "<u1")]


def _neighbour_keys(hashes: np.ndarray) -> np.ndarray:
    """A key of each two words that follow each other."""
    return mix64(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) if len(hashes) > 1 else np.zeros(0, np.uint64)


def _alone_keys(hashes: np.ndarray) -> np.ndarray:
    return mix64(hashes ^ _ALONE) if len(hashes) else np.zeros(0, np.uint64)


class _Builder:
    """Suffix automaton of the items of a part; word ids are places in ``vocabulary``, the sorted word hashes."""

    def __init__(self, texts: list[str], window: int):
        self.window = window
        self.hashes = []
        for block in byteblocks.blocks(pa.array(texts, pa.string())):
            found = byteblocks.words(block, byteblocks.ALNUM_ONLY)
            self.hashes += [found.hashes[a:b] for a, b in zip(found.rows[:-1], found.rows[1:])]
        self.vocabulary = np.unique(np.concatenate(self.hashes)) if self.hashes else np.zeros(0, np.uint64)
        items = [np.searchsorted(self.vocabulary, h).tolist() for h in self.hashes]
        self.steps, self.link, self.length = [{}], [-1], [0]
        for item in items:
            state = 0
            for word in item:
                state = self._extend(state, word)
        self.windows: dict[int, set[int]] = {}  # state that holds a window -> its items
        self.wholes: dict[int, set[tuple[int, int]]] = {}  # state that holds a short item -> (item, words)
        for number, item in enumerate(items):
            state = 0
            for at, word in enumerate(item):
                state = self.steps[state][word]
                if at + 1 >= window:
                    self.windows.setdefault(self._holder(state, window), set()).add(number)
            if 0 < len(item) < window:
                self.wholes.setdefault(self._holder(state, len(item)), set()).add((number, len(item)))

    def _extend(self, last: int, word: int) -> int:
        steps, link, length = self.steps, self.link, self.length
        there = steps[last].get(word)
        if there is not None:
            return there if length[there] == length[last] + 1 else self._split(last, word, there)
        new = self._state({}, length[last] + 1)
        at = last
        while at >= 0 and word not in steps[at]:
            steps[at][word] = new
            at = link[at]
        if at < 0:
            link[new] = 0
        else:
            there = steps[at][word]
            link[new] = there if length[there] == length[at] + 1 else self._split(at, word, there)
        return new

    def _state(self, steps: dict, length: int) -> int:
        self.steps.append(steps)
        self.length.append(length)
        self.link.append(0)
        return len(self.link) - 1

    def _split(self, at: int, word: int, there: int) -> int:
        """A state for the shorter runs of ``there``, which end at more places."""
        short = self._state(dict(self.steps[there]), self.length[at] + 1)
        self.link[short] = self.link[there]
        self.link[there] = short
        while at >= 0 and self.steps[at].get(word) == there:
            self.steps[at][word] = short
            at = self.link[at]
        return short

    def _holder(self, state: int, words: int) -> int:
        """The state of the run's last ``words`` words."""
        while self.length[self.link[state]] >= words:
            state = self.link[state]
        return state

    def keys(self) -> np.ndarray:
        """Of all neighbours, and of windows of one word."""
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *map(_neighbour_keys, self.hashes), *[_alone_keys(h) for h in self.hashes if min(len(h), self.window) == 1]]))

    def arrays(self, item_ids: list[str]) -> list[np.ndarray]:
        """The automaton as flat arrays, each state's words and items one after another in order."""
        states = range(len(self.link))
        words = [sorted(step) for step in self.steps]
        windows = [sorted(self.windows.get(state, ())) for state in states]
        wholes = [sorted(self.wholes.get(state, ())) for state in states]
        ids = [i.encode() for i in item_ids]
        flat = {
            "vocabulary": self.vocabulary, "first": _firsts(words), "words": _flat(words),
            "next": np.array([step[w] for step, own in zip(self.steps, words) for w in own], np.int64), "link": self.link, "length": self.length,
            "window_first": _firsts(windows), "window_items": _flat(windows), "whole_first": _firsts(wholes),
            "whole_items": _flat([[i for i, _ in w] for w in wholes]), "whole_words": _flat([[n for _, n in w] for w in wholes]),
            "id_first": _firsts(ids), "ids": np.frombuffer(b"".join(ids), np.uint8)}
        parts = [np.asarray(flat[name], kind) for name, kind in _ARRAYS]
        return [np.array([len(x) for x in parts], "<i8"), *parts]


def _firsts(lists: list) -> np.ndarray:
    return np.cumsum([0] + [len(x) for x in lists])


def _flat(lists: list) -> np.ndarray:
    return np.array([x for own in lists for x in own], np.int64)


class ItemAutomaton:
    """The automaton of one part, mapped from its file."""

    def __init__(self, path: str, window: int):
        self.window = window
        raw = mapped(path)
        sizes, start = raw[: 8 * len(_ARRAYS)].view("<i8").tolist(), 8 * len(_ARRAYS)
        arrays = {}
        for (name, kind), size in zip(_ARRAYS, sizes):
            end = start + size * np.dtype(kind).itemsize
            arrays[name] = raw[start:end].view(kind)
            start = end
        self.vocabulary = arrays["vocabulary"]
        # Single numbers come faster from a memory view than from an array.
        self.flat = {name: memoryview(arrays[name]) for name, _ in _ARRAYS[1:]}
        self.found: dict[tuple[int, int], tuple[int, frozenset[str]]] = {}  # what ends at a state, as met

    def word_ids(self, hashes: np.ndarray) -> list[int]:
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[place] == hashes, place, -1).tolist()

    def _item_id(self, number: int) -> str:
        first = self.flat["id_first"]
        return bytes(self.flat["ids"][first[number]: first[number + 1]]).decode()

    def _hits(self, state: int, length: int) -> tuple[int, frozenset[str]]:
        """Words hit before here, and the items; ``length`` is the matched run's, the window's at most."""
        link, lengths, reach, items = self.flat["link"], self.flat["length"], 0, set()
        if length >= self.window:
            reach, at, first = self.window, state, self.flat["window_first"]
            while lengths[link[at]] >= self.window:
                at = link[at]
            items.update(self.flat["window_items"][first[at]: first[at + 1]])
        at, first = state, self.flat["whole_first"]
        while at > 0:
            for k in range(first[at], first[at + 1]):
                words = self.flat["whole_words"][k]
                if words <= length:
                    reach = max(reach, words)
                    items.add(self.flat["whole_items"][k])
            at = link[at]
        return reach, frozenset(map(self._item_id, items))

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int, frozenset[str]]]:
        """(place of the last word, words hit, items) wherever something ends."""
        first, words, following, link, length = (self.flat[name] for name in ("first", "words", "next", "link", "length"))
        state = size = 0
        for place, word in enumerate(ids):
            while True:
                low, high = first[state], first[state + 1]
                at = bisect_left(words, word, low, high)
                if at < high and words[at] == word:
                    state = following[at]
                    size += 1
                    break
                if state == 0:  # a word that no item has
                    size = 0
                    break
                state = link[state]
                size = length[state]
            key = (state, min(size, self.window))
            hits = self.found.get(key)
            if hits is None:
                hits = self.found[key] = self._hits(state, min(size, self.window))
            if hits[0]:
                yield place, hits[0], hits[1]


@dataclass
class Items:
    """Where the automata of all parts and the index of their neighbours are."""

    folder: str
    window: int
    bits: int  # files of the index are the leading bits of keys
    alone: bool  # whether some window is one word
    shortest: int  # words of a window of the other ones, at least
    open_parts: dict = field(default_factory=dict, repr=False)
    open_files: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "open_parts": {}, "open_files": {}}

    def part(self, number: int) -> ItemAutomaton:
        if number not in self.open_parts:
            self.open_parts[number] = ItemAutomaton(f"{self.folder}/part-{number}", self.window)
        return self.open_parts[number]

    def _index(self, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys and the part of each; a key of several parts is there for each."""
        if bucket not in self.open_files:
            raw = mapped(f"{self.folder}/keys-{bucket}")
            n = len(raw) // 12
            self.open_files[bucket] = raw[: 8 * n].view("<u8"), raw[8 * n:].view("<u4")
        return self.open_files[bucket]

    def _parts_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among ``keys``, part) for every part that has the key."""
        order = np.argsort(keys) if self.bits else np.arange(len(keys))
        keys, places, parts = keys[order], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        buckets = (keys >> np.uint64(63 - self.bits) >> np.uint64(1)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(keys)]
        for start, end in zip(cuts, cuts[1:]):
            if start < end:
                known, owner = self._index(int(buckets[start]))
                if not len(known):
                    continue
                low = np.searchsorted(known, keys[start:end])
                met = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == keys[start:end])
                low = low[met]
                n = np.searchsorted(known, keys[start:end][met], side="right") - low
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                places.append(order[start + np.repeat(met, n)])
                parts.append(owner[np.repeat(low, n) + within].astype(np.int64))
        return np.concatenate(places), np.concatenate(parts)

    def _stretches(self, found: byteblocks.Words) -> Iterator[tuple[int, int, int]]:
        """(part, first word, word behind) of runs, long enough for a window, whose neighbours are neighbours in some item of the part, and of words that are a window."""
        if self.alone:
            places, parts = self._parts_of(_alone_keys(found.hashes))
            yield from zip(parts.tolist(), places.tolist(), (places + 1).tolist())
        inside = np.ones(max(len(found.hashes) - 1, 0), bool)  # both words in one row
        edges = found.rows[1:-1] - 1
        inside[edges[(edges >= 0) & (edges < len(inside))]] = False
        at = np.flatnonzero(inside)
        places, parts = self._parts_of(_neighbour_keys(found.hashes)[at])
        places = at[places]
        order = np.lexsort((places, parts))
        places, parts = places[order], parts[order]
        cuts = np.flatnonzero((np.diff(places) != 1) | (np.diff(parts) != 0)) + 1
        firsts, lasts = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(places)]]) - 1
        if len(places):
            long = lasts - firsts + 2 >= self.shortest
            firsts, lasts = firsts[long], lasts[long]
            yield from zip(parts[firsts].tolist(), places[firsts].tolist(), (places[lasts] + 2).tolist())

    def search(self, block: byteblocks.Block):
        """For each row of a block: its number of words, word spans, byte spans and item ids."""
        found = byteblocks.words(block, byteblocks.ALNUM_ONLY)
        row_words = np.diff(found.rows)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(block.rows)]
        items: list[set[str]] = [set() for _ in range(block.rows)]
        for number, begin, end in self._stretches(found):
            row = int(np.searchsorted(found.rows, begin, side="right")) - 1
            part = self.part(number)
            for place, reach, ids in part.stream(part.word_ids(found.hashes[begin:end])):
                last = begin + place + 1
                _add(spans[row], last - reach, last)
                items[row] |= ids
        for row in range(block.rows):
            base, low, own = int(found.rows[row]), int(block.offsets[row]), []
            for first, last in sorted(spans[row]):  # parts come one after another
                if own and own[-1][1] > first:
                    first, last = own[-1][0], max(own.pop()[1], last)
                own.append((first, last))
            yield (int(row_words[row]),
                   [{"begin": a - base, "end": b - base} for a, b in own],
                   [{"begin": int(found.starts[a]) - low, "end": int(found.ends[b - 1]) - low} for a, b in own],
                   sorted(items[row]))


def _add(spans: list[tuple[int, int]], first: int, last: int) -> None:
    """A span that ends behind those added from the same stretch before; a longer window may reach back over several."""
    while spans and first < spans[-1][1] <= last:
        first = min(first, spans.pop()[0])
    spans.append((first, last))


def index_items(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES) -> Items | None:
    """Automata of all items with an id and a text, written by Spark's tasks; None if there are none."""
    usable = items.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text")).dropna()
    total = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not total:
        return None
    count = -(-total // max_item_bytes)
    bits = (count - 1).bit_length()
    folder = scratch_path(items.sparkSession, "items")

    def build(table: pa.Table) -> pa.Table:
        number = table["part"][0].as_py()
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        automaton = _Builder(table["text"].to_pylist(), window)
        write_arrays(f"{folder}/part-{number}", automaton.arrays(table["id"].to_pylist()))
        keys = np.zeros(len(automaton.keys()), _KEY)
        keys["key"], keys["part"] = automaton.keys(), number
        rows = list(blob_rows((keys["key"] >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64), keys)) or [(0, b"")]
        words = [len(h) for h in automaton.hashes]
        shortest = min((min(n, window) for n in words if n > 1), default=window)
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "alone": [any(min(n, window) == 1 for n in words)] * len(rows), "shortest": pa.array([shortest] * len(rows), pa.int64()),
                         "keys": pa.array([k for _, k in rows], pa.binary())})

    def write(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        keys = np.sort(np.concatenate([np.frombuffer(k.as_buffer(), _KEY) for chunk in table["keys"].chunks for k in chunk]), order=["key", "part"])
        write_arrays(f"{folder}/keys-{bucket}", [keys["key"], keys["part"]])
        return pa.table({"alone": [any(table["alone"].to_pylist())], "shortest": pa.array([min(table["shortest"].to_pylist())], pa.int64())})

    dealt = usable.distinct().withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(count)))
    built = dealt.groupBy("part").applyInArrow(build, "bucket long, alone boolean, shortest long, keys binary")
    written = built.groupBy("bucket").applyInArrow(write, "alone boolean, shortest long")
    return Items(folder, window, bits, *written.agg(F.max("alone"), F.min("shortest")).first())


def find_passages(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """Adds n_words, word_spans and byte_spans (hit, half-open, ascending) and item_ids (sorted).

    A null text has no words.  Items without id or text are left out, those of
    the same id count once.  Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index_items(items, item_id, item_text, window, max_item_bytes))

    def start():
        known = shared.value or Items("", window, 0, False, window, open_files={0: (np.zeros(0, np.uint64), np.zeros(0, np.uint32))})

        def compute(column: pa.Array) -> list:
            rows = [row for block in byteblocks.blocks(column) for row in known.search(block)]
            words, spans, places, found = zip(*rows)
            return [pa.array(words, pa.int64()), pa.array(spans, _SPAN_TYPE), pa.array(places, _SPAN_TYPE), pa.array(found, pa.list_(pa.string()))]

        return compute

    return append_columns(docs, text, FIELDS, start)


def words_hit(spans: str = "word_spans") -> Column:
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                   window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """The texts without their hit spans; texts with a larger share of hit words than ``max_coverage`` are gone."""
    found = find_passages(packed(docs, text), items, text, item_id, item_text, window)
    kept = found.filter(words_hit() <= F.col("n_words") * max_coverage)
    clean = kept.withColumn(text, F.when(F.size("byte_spans") > 0, without_spans(F.col(text), F.col("byte_spans"))).otherwise(F.col(text)))
    return unpacked(clean, docs.columns, text)


def without_spans(text: Column, spans: Column) -> Column:
    """A text without spans of its bytes; these begin and end with words, so no character is cut."""
    raw = text.cast("binary")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"].cast("long")))
    ends = F.concat(F.transform(spans, lambda s: s["begin"].cast("long")), F.array(F.octet_length(text).cast("long")))
    pieces = F.zip_with(begins, ends, lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    return F.array_join(pieces, "")
