"""Interpolated modified Kneser-Ney n-grams of any order, counted in Spark and scored from memory-mapped arrays.

A text is its words (white space ends them, ASCII capitals folded) and one end,
behind one begin.  With h the k - 1 tokens before w and h' all but the first of
them, for k from 2 to the order,

    P(w | h) = max(c(h w) - D(c(h w)), 0) / c(h) + g(h) * P(w | h')
    P1(w)    = max(n(w) - d(n(w)), 0) / B + g1 / (V + 1)

where c(h w) is how often h w occurs if it has the full order or starts with the
begin, else how many different tokens stand before it; c(h) sums c(h w) over w.
n(w) counts the different tokens before w, B the different bigrams and V the
different training tokens; g(h) and g1 hand on what the discounts D (of each k)
and d took (by count: 1, 2, 3 or more).  A token that training lacks has n = 0,
and behind an h that training lacks P is P(w | h').  All probabilities after a h
add up to 1, one unknown token included.

Training is one aggregation for tokens and one for each length of n-grams, each a job
over hash buckets of what tasks have summed already, whose shuffle files go before
the next one starts:

1. tokens: each bucket writes its sorted 64-bit word hashes and their counts;
   a token's id is its place in all buckets;
2. n-grams of ids, from 2 to the full order, in buckets by their first two tokens:
   a pair is a whole number, a bijection, and a longer one is the number of all but
   its last token with that token, so no n-gram can be taken for another; each
   bucket writes the sorted whole numbers, without the bytes that their order tells,
   and counts; an n-gram's number is its place in all buckets.  A bucket of the next
   length writes how many successors have count 1, 2 and more and their sum.
   Below the full order tasks pass the n-grams with each different token before
   them, which are summed in the bucket; pairs pass what they say of tokens on to
3. the same of tokens, and their predecessors, one array of each for up to 16
   buckets of tokens, so that the pieces that pass between buckets stay few.

What follows one pair of tokens is in one bucket, each different n-gram of it once
a task; a single token with any share of all tokens is spread.

The files are in the shared folder.  Workers map them and look up sorted queries,
so a batch goes through each file once, in order, and reads only the pages that
it needs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import byteblocks
from touchline.llm.shared import append_columns, blob_rows, mix64
from touchline.llm.shared_files import mapped, write_arrays
from touchline.runtime import scratch_path

#: Tokens that a task counts together; it scores a quarter of them at once.
CHUNK_TOKENS = 2_000_000
#: Hash of the end of a text.
END = np.uint64(0x5851F42D4C957F2D)
FIELDS = [("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double"), ("perplexity", "double")]
_TOKEN = np.dtype([("h", "<u8"), ("c", "<u4")])
_FACTS = np.dtype([("id", "<u8"), ("one", "<u4"), ("two", "<u4"), ("more", "<u4"), ("total", "<u8"), ("before", "<u4")])
#: Of an n-gram as a context.
_SUCCESSORS = ("one", "two", "more", "total")


@dataclass
class Model:
    """Where the files are, and the few numbers that belong to all of them."""

    folder: str
    bits: int  # buckets are the leading bits of hashes
    first_id: np.ndarray  # of each token bucket, and the number of all tokens at the end
    tokens: int
    texts: int
    order: int
    bigrams: int
    high: dict  # by length of n-grams from 2, their discounts for counts 0 to 3
    low: np.ndarray  # discounts of predecessor counts
    rest: float  # g1
    begin_facts: np.ndarray  # successors of the begin with count 1, 2, more, and their sum
    first_gram: dict = field(default_factory=dict)  # as first_id, by length of n-grams
    open_files: dict = field(default_factory=dict, repr=False)

    @property
    def types(self) -> int:
        return int(self.first_id[-1])

    @property
    def width(self) -> int:
        """Bytes that hold any id and count."""
        return 4 if max(self.tokens, self.types + 1) < 1 << 32 else 8

    @property
    def pair_bits(self) -> int:
        """Bits that hold any pair of ids, and tell all buckets apart."""
        return min(64, max(((self.types + 1) ** 2 - 1).bit_length(), self.bits + 8))

    @property
    def shift(self) -> int:
        """So many bits more tell the buckets of tokens apart than those of facts."""
        return min(4, self.bits - 4)

    def id_range(self, bucket: int) -> tuple[int, int]:
        """The ids of a bucket of facts; the last one behind all tokens has the begin."""
        if bucket == 1 << (self.bits - self.shift):
            return self.types, self.types + 1
        return int(self.first_id[bucket << self.shift]), int(self.first_id[(bucket + 1) << self.shift])

    def bucket_of(self, ids: np.ndarray) -> np.ndarray:
        """The bucket of facts of known ids; buckets of tokens without any share an edge with the next one."""
        place = (np.searchsorted(self.first_id, ids, side="right") - 1) >> self.shift
        return np.where(ids == self.types, 1 << (self.bits - self.shift), place)

    def __getstate__(self):
        return {**self.__dict__, "open_files": {}}


def discounts(types_by_count: np.ndarray) -> np.ndarray:
    """D(0) to D(3 or more) from how many types have count 1, 2, 3 and 4; 1/2 of the count where some are none."""
    n1, n2, n3, n4 = (float(x) for x in types_by_count[:4])
    if min(n1, n2, n3) <= 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(d, 0.0), float(k)) for k, d in enumerate(found, 1))])


# Files.

def _open(model: Model, kind: str, bucket: int) -> np.ndarray:
    key = (kind, bucket)
    if key not in model.open_files:
        model.open_files[key] = np.asarray(mapped(f"{model.folder}/{kind}-{bucket}"))  # slices of a memmap itself are slow
    return model.open_files[key]


# Texts as token hashes.

def token_hashes(block: byteblocks.Block) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all rows with their ends, and where each row begins."""
    found = byteblocks.words(block, byteblocks.SPACE_ENDED)
    offsets = found.rows + np.arange(len(found.rows))
    tokens = np.full(len(found.hashes) + block.rows, END)
    inside = np.ones(len(tokens), bool)
    inside[offsets[1:] - 1] = False
    tokens[inside] = found.hashes
    return tokens, offsets


def _chunks(column: pa.Array, most: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens, offsets) of about ``most`` tokens, CHUNK_TOKENS by default, whole rows."""
    most = most or CHUNK_TOKENS
    held, first, size, row = [], 0, 0, 0
    for block in byteblocks.blocks(column):
        held.append(token_hashes(block))
        size += len(held[-1][0])
        row += block.rows
        if size >= most:
            yield first, *_joined(held)
            held, first, size = [], row, 0
    if held:
        yield first, *_joined(held)


def _joined(parts) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.cumsum([0] + [len(t) for t, _ in parts])
    return np.concatenate([t for t, _ in parts]), np.concatenate([[0], *[o[1:] + s for (_, o), s in zip(parts, sizes)]]).astype(np.int64)


def _lookup(model: Model, kind: str, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, places of sorted distinct ``hashes`` that the bucket has, their places in it)."""
    buckets = (hashes >> np.uint64(64 - model.bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    for at, part in zip(np.concatenate([[0], cuts]), np.split(hashes, cuts)):
        if len(part):
            bucket = int(buckets[at])
            known = _hashes_of(model, kind, bucket)
            if len(known):
                place = np.minimum(np.searchsorted(known, part), len(known) - 1)
                hit = np.flatnonzero(known[place] == part)
                yield bucket, hit + at, place[hit]


def _hashes_of(model: Model, kind: str, bucket: int) -> np.ndarray:
    raw = _open(model, kind, bucket)
    return raw[: len(raw) // 12 * 8].view("<u8")


def _counts_of(model: Model, kind: str, bucket: int) -> np.ndarray:
    raw = _open(model, kind, bucket)
    return raw[len(raw) // 12 * 8:].view("<u4")


def _ids(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of sorted distinct token hashes; -1 and 0 for unknown ones."""
    ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
    for bucket, at, place in _lookup(model, "tokens", hashes):
        ids[at] = model.first_id[bucket] + place
        counts[at] = _counts_of(model, "tokens", bucket)[place]
    return ids, counts


_ODD = 0x94D049BB133111EB


def _scrambled(x: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of the numbers of so many bits that spreads them over all leading bits."""
    half, mask = np.uint64((bits + 1) // 2), np.uint64((1 << bits) - 1)
    for _ in range(3):
        x = ((x ^ (x >> half)) * np.uint64(_ODD & int(mask))) & mask
    return x ^ (x >> half)


def _unscrambled(x: np.ndarray, bits: int) -> np.ndarray:
    half, mask = np.uint64((bits + 1) // 2), np.uint64((1 << bits) - 1)
    for _ in range(3):
        x = ((x ^ (x >> half)) * np.uint64(pow(_ODD, -1, 1 << bits))) & mask
    return x ^ (x >> half)


def _pairs(model: Model, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Each pair of ids as a whole number of ``pair_bits``, whose leading bits are its bucket."""
    return _scrambled(before.astype(np.uint64) * np.uint64(model.types + 1) + after.astype(np.uint64), model.pair_bits)


def _pair_keys(model: Model, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each pair, and its key: the rest, below ``_top(model, 2, bucket)``."""
    rest = model.pair_bits - model.bits
    return (pairs >> np.uint64(rest)).astype(np.int64), (pairs & np.uint64((1 << rest) - 1)).astype(np.int64)


def _pair_of(model: Model, bucket: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = keys.astype(np.uint64) | np.uint64(bucket << (model.pair_bits - model.bits))
    before, after = np.divmod(_unscrambled(x, model.pair_bits), np.uint64(model.types + 1))
    return before.astype(np.int64), after.astype(np.int64)


def _longer_keys(model: Model, size: int, context: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of n-grams of ``size``, at least three, from the numbers of all but their last tokens."""
    first = model.first_gram[size - 1]
    bucket = np.searchsorted(first, context, side="right") - 1
    return bucket, (context - first[bucket]) * (model.types + 1) + last


def _top(model: Model, size: int, bucket: int) -> int:
    """A bound above all keys of a bucket."""
    if size == 2:
        return 1 << (model.pair_bits - model.bits)
    first = model.first_gram[size - 1]
    return max(1, int(first[bucket + 1] - first[bucket]) * (model.types + 1))


def _unmixed(hashes: np.ndarray) -> np.ndarray:
    """The inverse of mix64."""
    x = hashes ^ (hashes >> np.uint64(31)) ^ (hashes >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _previous(ids: np.ndarray, offsets: np.ndarray, begin: int) -> np.ndarray:
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[offsets[:-1]] = begin
    return before


# Training.

def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def _blob_batch(keys: np.ndarray, items: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    rows = list(blob_rows(keys, items))
    for at in range(0, len(rows), 256):
        part = rows[at: at + 256]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int64()), pa.array([kind] * len(part), pa.int32()), pa.array([b for _, b in part], pa.binary())],
                                         names=["bucket", "kind", "items"])


_BLOBS = "bucket long, kind int, items binary"


def _planes(columns: list[np.ndarray], width: int) -> bytes:
    """Numbers, sorted by the first columns, byte by byte and compressed: sorted and high bytes shrink to little."""
    table = np.stack(columns).astype(f"<u{width}")
    raw = table.view(np.uint8).reshape(*table.shape, width).transpose(0, 2, 1).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _from_planes(blob: pa.Buffer, columns: int, width: int) -> np.ndarray:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8].to_pybytes(), "little"), "zstd")
    table = np.frombuffer(raw, np.uint8).reshape(columns, width, -1).transpose(0, 2, 1)
    return np.ascontiguousarray(table).view(f"<u{width}")[..., 0].astype(np.int64)


def _distinct(columns: Iterable[np.ndarray], tops: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct rows of numbers below ``tops``, and how often each occurs."""
    bits = [max(1, int(top - 1).bit_length()) for top in tops]
    if sum(bits) > 64:
        columns = list(columns)
        table = np.stack(columns)[:, np.lexsort(columns[::-1])]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, table.shape[1]), bool), (table[:, 1:] != table[:, :-1]).any(axis=0)]))
        return list(table[:, first]), np.diff(np.append(first, table.shape[1]))
    keys = np.uint64(0)
    for column, b in zip(columns, bits):
        keys = (keys << np.uint64(b)) | column.astype(np.uint64)
    keys, counts = np.unique(keys, return_counts=True)
    out = []
    for b in reversed(bits):
        out.append((keys & np.uint64((1 << b) - 1)).astype(np.int64 if b > 31 else np.int32))
        keys = keys >> np.uint64(b)
    return out[::-1], counts


def _gram_blobs(model: Model, kind: int, columns: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, items) of sorted n-grams, by the first two tokens."""
    bucket = _pair_keys(model, _pairs(model, columns[0], columns[1]))[0]
    order = np.argsort(bucket.astype(np.uint16) if model.bits <= 16 else bucket, kind="stable")
    bucket, columns = bucket[order], [c[order].astype(f"<u{model.width}") for c in columns]
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for start, end in zip(cuts, cuts[1:]):
        if start < end:
            yield int(bucket[start]), kind, _planes([c[start:end] for c in columns], model.width)


def _back(ids: np.ndarray, offsets: np.ndarray, steps: int, begin: int) -> np.ndarray:
    """The ids so many places before; what is before a row's begin has no meaning."""
    for _ in range(steps):
        ids = _previous(ids, offsets, begin)
    return ids


#: Kinds of blobs: n-grams with their count, and with a token before them.
_COUNTED, _PRECEDED = 1, 2


def _text_grams(model: Model, size: int, words: np.ndarray, which: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Of full order, n-grams with their counts; of shorter ones those that start with the begin, the others with what is before them.

    ``words`` are sorted ids, ``which`` the place in them of each token.
    """
    which = which.astype(np.int32) if len(words) < (1 << 31) - 1 else which
    place = np.arange(len(which), dtype=np.int32) - np.repeat(offsets[:-1], np.diff(offsets)).astype(np.int32)
    back = [_back(which, offsets, k, len(words)) for k in range(min(size + 1, model.order))]
    ids = np.append(words, model.types).astype(f"<u{model.width}")

    def found(columns, at):
        rows, counts = _distinct((c[at] for c in columns), [len(ids)] * len(columns))
        for k, r in enumerate(rows):
            rows[k] = ids[r]
        return rows, counts

    grams, counts = found(back[size - 1::-1], np.flatnonzero(place >= size - 2 if size == model.order else place == size - 2))
    yield from _gram_blobs(model, _COUNTED, [*grams, counts])
    if size < model.order:
        grams, _ = found([*back[size - 1::-1], back[size]], np.flatnonzero(place >= size - 1))
        yield from _gram_blobs(model, _PRECEDED, grams)


def _columns_of(table: pa.Table, kind: int, columns: int, width: int) -> np.ndarray:
    rows = zip(table["kind"].to_pylist(), (b for chunk in table["items"].chunks for b in chunk))
    return np.concatenate([np.zeros((columns, 0), np.int64), *[_from_planes(b.as_buffer(), columns, width) for k, b in rows if k == kind]], axis=1)


def _sums(group: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, group, values)
    return out


def _successor_facts(group: np.ndarray, counts: np.ndarray, size: int) -> list[np.ndarray]:
    return [np.bincount(group[mine], minlength=size) for mine in (counts == 1, counts == 2, counts > 2)] + [_sums(group, counts, size)]


def _coded(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Up to four columns as one byte a row, the place of its numbers among the 255 most frequent; 255 for others, which follow."""
    table = np.stack(columns).astype("<u8")
    small = np.flatnonzero((table < 1 << 16).all(axis=0))
    packed = np.zeros(len(small), np.uint64)
    for k, column in enumerate(table):
        packed |= column[small] << np.uint64(16 * k)
    values, which, counts = np.unique(packed, return_inverse=True, return_counts=True)
    frequent = np.argsort(-counts, kind="stable")[:255]
    code_of = np.full(len(values), 255, np.uint8)
    code_of[frequent] = np.arange(len(frequent))
    codes = np.full(table.shape[1], 255, np.uint8)
    codes[small] = code_of[which]
    rare = np.flatnonzero(codes == 255)
    return [np.array([len(codes), len(columns), len(frequent), len(rare)], "<u8"), values[frequent].astype("<u8"),
            rare.astype("<u8"), table[:, rare].T.astype("<u8"), codes]


def _decoded(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """One row for each column of ``_coded``."""
    n, columns, frequent, rare = raw[:32].view("<u8").astype(np.int64).tolist()
    values = np.append(raw[32: 32 + 8 * frequent].view("<u8"), np.uint64(0))
    start = 32 + 8 * frequent
    rare_at = raw[start: start + 8 * rare].view("<u8").astype(np.int64)
    start += 8 * rare
    table = raw[start: start + 8 * rare * columns].view("<u8").reshape(rare, columns)
    codes = raw[start + 8 * rare * columns:][places]
    at = np.flatnonzero(codes == 255)
    packed = values[np.minimum(codes, frequent)]
    out = np.stack([(packed >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(columns)]).astype(np.int64)
    if len(at):
        out[:, at] = table[np.searchsorted(rare_at, places[at])].T
    return out


def _write_grams(path: str, keys: np.ndarray, top: int, counts: np.ndarray) -> None:
    """Sorted distinct keys below ``top``, of each the low bytes, behind where each value of the higher bits begins; and counts."""
    n = len(keys)
    width = max(0, -(-((top - 1).bit_length() - n.bit_length() + 4) // 8))
    slots = ((top - 1) >> 8 * width) + 1
    index = np.searchsorted(keys >> 8 * width, np.arange(slots + 1))
    low = keys.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    write_arrays(path, [np.array([n, width, slots], "<u8"), index.astype("<u4"), low, *_coded([counts])])


def _gram_parts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index, low bytes (with what follows them, as 8 bytes) and codes of a file of n-grams."""
    n, width, slots = raw[:24].view("<u8").astype(np.int64).tolist()
    start = 24 + 4 * (slots + 1)
    low = np.ndarray((n,), "<u8", raw, start, (width,))  # codes are longer than 8 bytes
    return raw[24:start].view("<u4"), low, raw[start + n * width:]


def _places(raw: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a file of n-grams, -1 for those that it lacks; all keys halve what is left of their slots at once."""
    if not len(raw) or not raw[:8].view("<u8")[0]:
        return np.full(len(keys), -1, np.int64)
    index, low, _ = _gram_parts(raw)
    n, width = len(low), low.strides[0]
    slot, rest = keys >> 8 * width, keys & ((1 << 8 * width) - 1)
    inside = slot < len(index) - 1
    slot = np.minimum(slot, len(index) - 2)
    left, right = index[slot].astype(np.int64), index[slot + 1].astype(np.int64)
    end = right.copy()

    def at(places):
        return (low[np.minimum(places, n - 1)] & np.uint64((1 << 8 * width) - 1)).astype(np.int64)

    open_ = np.flatnonzero(left < right)
    while len(open_):
        middle = (left[open_] + right[open_]) >> 1
        below = at(middle) < rest[open_]
        left[open_] = np.where(below, middle + 1, left[open_])
        right[open_] = np.where(below, right[open_], middle)
        open_ = open_[left[open_] < right[open_]]
    return np.where(inside & (left < end) & (at(left) == rest), left, -1)


def _grams(model: Model, size: int, bucket: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of n-grams by sorted bucket and key, -1 for those that training lacks; their counts; and facts about their successors."""
    numbers, counts = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    after = np.zeros((len(_SUCCESSORS) if size < model.order else 0, len(keys)), np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keys)]
    for start, end in zip(cuts, cuts[1:]):
        if start < end:
            b = int(bucket[start])
            raw = _open(model, f"grams{size}", b)
            place = _places(raw, keys[start:end])
            hit = np.flatnonzero(place >= 0)
            if len(hit):
                place, at = place[hit], hit + start
                numbers[at] = model.first_gram[size][b] + place
                counts[at] = _decoded(_gram_parts(raw)[2], place)[0]
                if len(after) and len(facts := _open(model, f"after{size}", b)):
                    after[:, at] = _decoded(facts, place)
    return numbers, counts, after


def _counted(hashes: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Blobs of distinct hashes: kind 0 those that occur once, kind 1 the other ones with their counts."""
    keys, counts = np.unique(hashes, return_counts=True)
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    once = counts == 1
    yield from _blob_batch(bucket[once], keys[once], 0)
    many = np.empty(int((~once).sum()), _TOKEN)
    many["h"], many["c"] = keys[~once], counts[~once]
    yield from _blob_batch(bucket[~once], many, 1)


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and counts of a bucket's blobs."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for kind, blob in zip(table["kind"].to_pylist(), (b for chunk in table["items"].chunks for b in chunk)):
        if kind == 0:
            keys.append(np.frombuffer(blob.as_buffer(), "<u8"))
            counts.append(np.ones(len(keys[-1]), np.int64))
        else:
            many = np.frombuffer(blob.as_buffer(), _TOKEN)
            keys.append(many["h"])
            counts.append(many["c"].astype(np.int64))
    return _summed(np.concatenate(keys), np.concatenate(counts))


def _bucket_grams(model: Model, size: int, bucket: int, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a bucket's n-grams, and their counts or numbers of different tokens before them."""
    def keys_of(columns: np.ndarray) -> np.ndarray:
        keys = _pair_keys(model, _pairs(model, columns[0], columns[1]))[1]
        for k in range(3, size + 1):
            keys = _places(_open(model, f"grams{k - 1}", bucket), keys) * (model.types + 1) + columns[k - 1]
        return keys

    counted = _columns_of(table, _COUNTED, size + 1, model.width)
    keys, counts = _summed(keys_of(counted[:size]), counted[size])
    if size == model.order:
        return keys, counts
    preceded = _columns_of(table, _PRECEDED, size + 1, model.width)
    (found, _), _ = _distinct([keys_of(preceded[:size]), preceded[size]], [_top(model, size, bucket), model.types + 1])
    found, before = np.unique(found, return_counts=True)
    return _summed(np.concatenate([keys, found]), np.concatenate([counts, before]))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind; each must run once only."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def train(docs: DataFrame, learn: Column, text: str = "text", order: int = 2) -> Model | None:
    """A model of this order (2 or more) of the texts of the rows where ``learn`` holds (null texts count as empty); None if there are none."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    rows = docs.filter(learn).select(F.col(text).alias("text"))
    texts = rows.count()
    if texts == 0:
        return None
    bits = max(4, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    folder = scratch_path(spark, "ngrams")

    def emit_tokens(batches):
        for batch in batches:
            for _, tokens, _ in _chunks(batch.column("text")):
                yield from _counted(tokens, bits)

    def write_tokens(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        keys, counts = _gathered(table)
        write_arrays(f"{folder}/tokens-{bucket}", [keys.astype("<u8"), counts.astype("<u4")])
        return pa.table({"bucket": [bucket], "types": [len(keys)], "n": [int(counts.sum())]})

    with shuffles_removed(spark):
        found = rows.mapInArrow(emit_tokens, _BLOBS).groupBy("bucket").applyInArrow(write_tokens, "bucket long, types long, n long").collect()
    types = np.zeros((1 << bits) + 1, np.int64)  # one number a bucket
    for row in found:
        types[row["bucket"] + 1] = row["types"]
    model = Model(folder, bits, np.cumsum(types), sum(r["n"] for r in found), texts, order, 0, {}, np.zeros(4), 0.0, np.zeros(4))

    def gram_job(size: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(model)

        def emit(batches):
            model = shared.value
            for batch in batches:
                for _, tokens, offsets in _chunks(batch.column("text")):
                    words, which = np.unique(tokens, return_inverse=True)  # ids have the order of hashes
                    yield _rows(_text_grams(model, size, _ids(model, words)[0], which, offsets))

        def write(table: pa.Table) -> pa.Table:
            model = shared.value
            bucket = table["bucket"][0].as_py()
            keys, counts = _bucket_grams(model, size, bucket, table)
            if len(keys):
                _write_grams(f"{folder}/grams{size}-{bucket}", keys, _top(model, size, bucket), counts)
            by_count = np.bincount(np.minimum(counts, 5), minlength=6)[1:6]
            numbers = [(bucket >> model.shift if size == 2 else bucket, 0, np.array([size, bucket, len(keys), *by_count], "<i8").tobytes())]
            if size == 2:
                return pa.Table.from_batches([_rows([*_facts(model, *_pair_of(model, bucket, keys), counts), *numbers])])
            group = keys // (model.types + 1)
            contexts = int(model.first_gram[size - 1][bucket + 1] - model.first_gram[size - 1][bucket])
            write_arrays(f"{folder}/after{size - 1}-{bucket}", _coded(_successor_facts(group, counts, contexts)))
            return pa.Table.from_batches([_rows(numbers)])

        return rows.mapInArrow(emit, _BLOBS).groupBy("bucket").applyInArrow(write, _BLOBS)

    shared = spark.sparkContext.broadcast(model)

    def write_facts(table: pa.Table) -> pa.Table:
        model = shared.value
        bucket = table["bucket"][0].as_py()
        blobs = list(zip(table["kind"].to_pylist(), (b for chunk in table["items"].chunks for b in chunk)))
        items = np.concatenate([np.zeros(0, _FACTS)] + [np.frombuffer(b.as_buffer(), _FACTS) for kind, b in blobs if kind == 1])
        grams = [b.as_py() for kind, b in blobs if kind == 0]
        base, end = model.id_range(bucket)
        at = (items["id"] - np.uint64(base)).astype(np.int64)
        sums = {name: _sums(at, items[name].astype(np.int64), end - base) for name in (*_SUCCESSORS, "before")}
        own, begin = np.zeros(5, np.int64), [0] * len(_SUCCESSORS)
        if end > model.types:
            begin = [int(sums[name][0]) for name in _SUCCESSORS]
        else:
            write_arrays(f"{folder}/facts-{bucket}", [x.astype("<u8" if model.width == 8 else "<u4") for x in sums.values()])
            own = np.bincount(np.minimum(sums["before"], 5), minlength=6)[1:6]
        return pa.table({"grams": pa.array([grams], pa.list_(pa.binary())), "own": pa.array([own.tolist()], pa.list_(pa.int64())), "begin": pa.array([begin], pa.list_(pa.int64()))})

    def take(size: int, numbers) -> None:
        """What buckets say of their n-grams: how many there are, and how many have each count."""
        firsts, types_by_count = np.zeros((1 << bits) + 1, np.int64), np.zeros(5, np.int64)
        for _, bucket, n, *by_count in (np.frombuffer(b, "<i8").tolist() for b in numbers):
            firsts[bucket + 1] = n
            types_by_count += by_count
        model.first_gram[size] = np.cumsum(firsts)
        model.high[size] = discounts(types_by_count)
        if size < order and int(firsts.max()) * (model.types + 1) >= 1 << 63:
            raise ValueError("more n-grams than numbers of 64 bits: raise spark.sql.shuffle.partitions")

    with shuffles_removed(spark):
        done = gram_job(2).groupBy("bucket").applyInArrow(write_facts, "grams array<binary>, own array<long>, begin array<long>").collect()
    take(2, [b for r in done for b in r["grams"]])
    own, begin = (np.sum([r[name] for r in done], axis=0) for name in ("own", "begin"))
    for size in range(3, order + 1):
        with shuffles_removed(spark):
            take(size, [r["items"] for r in gram_job(size).collect()])  # one row a bucket
    model.bigrams = int(model.first_gram[2][-1])
    model.low = discounts(own)
    model.rest = float((model.low[1] * own[0] + model.low[2] * own[1] + model.low[3] * own[2:].sum()) / model.bigrams)
    model.begin_facts = np.asarray(begin, np.float64)
    return model


def _rows(rows) -> pa.RecordBatch:
    rows = list(rows)
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "kind", "items"])


def _facts(model: Model, before: np.ndarray, after: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, bytes]]:
    """What the bigrams of a bucket say about tokens, by bucket of token."""
    ids, which = np.unique(np.concatenate([before, after]), return_inverse=True)
    left, right = which[: len(before)], which[len(before):]
    out = np.zeros(len(ids), _FACTS)
    out["id"] = ids
    for name, values in zip(_SUCCESSORS, _successor_facts(left, counts, len(ids))):
        out[name] = values
    out["before"] = np.bincount(right, minlength=len(ids))
    return [(k, 1, b) for k, b in blob_rows(model.bucket_of(ids), out)]


# Scoring.

def _distinct_longer(model: Model, size: int, context: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and keys, sorted, of the distinct n-grams of ``size``, and the place of each among them."""
    top = model.types + 1
    if int(model.first_gram[size - 1][-1]) * top < 1 << 63:
        grams, which = np.unique(context * top + last, return_inverse=True)
        context, last = np.divmod(grams, top)
    else:
        (context, last), which = np.unique(np.stack([context, last]), axis=1, return_inverse=True)
    return *_longer_keys(model, size, context, last), which.ravel()


def _token_facts(model: Model, ids: np.ndarray) -> np.ndarray:
    """[one, two, more, total, before] of sorted distinct known ids."""
    out = np.zeros((5, len(ids)))
    bucket = model.bucket_of(ids)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for at, part in zip(np.concatenate([[0], cuts]), np.split(ids, cuts)):
        if len(part):
            b = int(bucket[at])
            raw = _open(model, "facts", b)
            if len(raw):
                table = raw.view("<u8" if model.width == 8 else "<u4").reshape(5, -1)
                out[:, at: at + len(part)] = table[:, part - model.id_range(b)[0]]
    return out


def _handed_on(model: Model, size: int, after: np.ndarray) -> np.ndarray:
    """Of contexts of n-grams of ``size``, by facts about their successors: the sum of counts, and what discounts took of it."""
    _, one, two, more = model.high[size]
    return np.stack([after[3].astype(np.float64), one * after[0] + two * after[1] + more * after[2]])


def log_scores(model: Model, tokens: np.ndarray, offsets: np.ndarray):
    """For each row: tokens, known tokens, log10 under the base, log10 under the model."""
    words, which = np.unique(tokens, return_inverse=True)
    ids, counts = _ids(model, words)
    known = np.flatnonzero(ids >= 0)
    order = known[np.argsort(ids[known])]
    facts = np.zeros((5, len(words)))
    facts[:, order] = _token_facts(model, ids[order])
    single = np.maximum(facts[4] - model.low[np.minimum(facts[4], 3).astype(int)], 0) / model.bigrams + model.rest / (model.types + 1)
    base = np.log10((counts + 1) / (model.tokens + model.types + 1))

    at = ids[which]
    p = single[which]
    place = np.arange(len(at)) - np.repeat(offsets[:-1], np.diff(offsets))
    before = _previous(at, offsets, model.types)
    total, rest = _handed_on(model, 2, facts[:4])[:, which]  # of all tokens before that count
    total, rest = np.concatenate([[0.0], total[:-1]]), np.concatenate([[0.0], rest[:-1]])
    total[offsets[:-1]], rest[offsets[:-1]] = _handed_on(model, 2, model.begin_facts[:, None])[:, 0]
    for size in range(2, model.order + 1):
        known = np.flatnonzero((at >= 0) & (before >= 0))
        if size == 2:
            pairs, which_gram = np.unique(_pairs(model, before[known], at[known]), return_inverse=True)
            bucket, keys = _pair_keys(model, pairs)
        else:
            bucket, keys, which_gram = _distinct_longer(model, size, before[known], at[known])
        numbers, c, after = _grams(model, size, bucket, keys)
        share = np.maximum(c - model.high[size][np.minimum(c, 3)], 0)
        own = np.zeros(len(at))
        own[known] = share[which_gram]
        p = np.where(total > 0, (own + rest * p) / np.maximum(total, 1), p)
        if size < model.order:  # each place takes what the one before has found
            found = np.full(len(at), -1)
            found[known] = numbers[which_gram]
            inside = place >= size - 1
            before = np.where(inside, np.concatenate([[-1], found[:-1]]), -1)
            handed = np.zeros((2, len(at)))
            handed[:, known] = _handed_on(model, size + 1, after)[:, which_gram]
            total, rest = np.where(inside, np.concatenate([np.zeros((2, 1)), handed[:, :-1]], axis=1), 0)
    logs = np.log10(p)
    row = byteblocks.row_of(offsets)
    rows = len(offsets) - 1
    return (np.diff(offsets), np.bincount(row, counts[which] > 0, rows).astype(np.int64),
            np.bincount(row, base[which], rows), np.bincount(row, logs, rows))


def score(docs: DataFrame, model: Model | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds n_tokens, n_known, base_score, score and perplexity (10 ^ (-score / n_tokens)).

    A null text is empty: one token, the end.  Without a model all tokens are
    unknown, base_score is 0 (one token type, the unknown) and so is score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value

        def compute(column: pa.Array) -> list:
            parts = []
            for _, tokens, offsets in _chunks(column, CHUNK_TOKENS // 4):
                if model is None:
                    zero = np.zeros(len(offsets) - 1)
                    parts.append((np.diff(offsets), zero.astype(np.int64), zero, zero))
                else:
                    parts.append(log_scores(model, tokens, offsets))
            tokens, known, base, logs = (np.concatenate(x) for x in zip(*parts))
            return [pa.array(tokens.astype(np.int64)), pa.array(known), pa.array(base), pa.array(logs), pa.array(10.0 ** np.minimum(-logs / tokens, 300))]

        return compute

    return append_columns(docs, text, FIELDS, start, keep_text)
