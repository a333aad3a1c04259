"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes segments: runs of spaces with the letters after them, ended also
after line feeds.  No piece of a supported model has a space inside or after
other letters, or a line feed, so segments are encoded on their own, and each
different one (by a 64-bit hash of its bytes) only once a task.

The symbols of all new segments lie in one flat array.  In every round each
segment finds its best pair rank by one segmented minimum, merges its leftmost
occurrences of that rank, and the array is compacted, until no segment has a
pair left.  The library merges one pair at a time, the best first and the
leftmost among equals.  Merging all occurrences at once is the same unless a
merged piece can itself pair up at that rank or better; such pieces (``alone``)
are merged one per round.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from touchline.llm import byteblocks
from touchline.llm.shared import append_columns

NO_RANK = np.int32(2**31 - 1)
NO_PAIR = np.uint64(2**64 - 1)
PAIR_BITS = 19
SPACE = "▁"
#: Different segments that a task remembers before it starts afresh.
MEMO = 1_000_000
DIGEST_FIELDS = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]


class PieceModel:
    """The tables of one model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        pieces = {model.id_to_piece(i): i for i in range(size) if i not in special}
        if any(SPACE in piece.lstrip(SPACE) or "\n" in piece or model.is_unused(i) for piece, i in pieces.items()):
            raise ValueError("pieces that cross segments are not supported")
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in special if model.is_byte(i)}
        if len(self.bytes) != 256 or model.encode(" a ") != model.encode(" a ") or model.decode(model.encode("  ÀＡ ")) != "  ÀＡ ":
            raise ValueError("a model with byte fallback and without normalisation is needed")
        self.byte_ids = np.array([self.bytes[b] for b in range(256)], np.int32)
        self.size = size
        scores = np.array([model.get_score(i) for i in range(size)])
        rank = np.zeros(size, np.int32)
        for place, score in enumerate(sorted({scores[i] for i in pieces.values()}, reverse=True)):
            rank[scores == score] = place
        pairs, alone = {}, np.zeros(size, bool)
        for piece, i in pieces.items():
            for cut in range(1, len(piece)):
                a, b = pieces.get(piece[:cut]), pieces.get(piece[cut:])
                for part in (a, b):
                    if part is not None and rank[part] >= rank[i]:
                        alone[part] = True
                if a is not None and b is not None:
                    pairs[a * size + b] = i
        self.alone = alone
        self.rank = rank
        self._hash_pairs(np.array(sorted(pairs), np.uint64), np.array([pairs[k] for k in sorted(pairs)], np.int32))
        # Each character of its own is a symbol: its piece, or (no piece) itself beyond all ids.
        points = [(ord(p), i) for p, i in pieces.items() if len(p) == 1]
        self.char_symbols = np.arange(0x110000, dtype=np.int64) + size
        self.char_symbols[[c for c, _ in points]] = [i for _, i in points]
        # Decoding: the bytes of each piece; control pieces give nothing.
        texts = [b"" if i in special else model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
        for b, i in self.bytes.items():
            texts[i] = bytes([b])
        if self.unknown >= 0:
            texts[self.unknown] = " ⁇ ".encode()
        self.is_byte = np.zeros(size, bool)
        self.is_byte[self.byte_ids] = True
        self.controls = {i for i in special if model.is_control(i)}
        self.texts = texts

    def _hash_pairs(self, keys: np.ndarray, merged: np.ndarray) -> None:
        """Two tables: a pair is in its slot of the first one, or else in the second one, which has no clashes."""
        slot = _slot(keys, 1, PAIR_BITS)
        _, first = np.unique(slot, return_index=True)
        late = np.ones(len(keys), bool)
        late[first] = False
        self.pairs = np.full((2, 1 << PAIR_BITS), NO_PAIR), np.zeros((2, 1 << PAIR_BITS), np.int32)
        for turn in range(1, 1000):
            again = _slot(keys[late], 2 * turn + 1, PAIR_BITS)
            if len(np.unique(again)) == len(again):
                break
        self.turn = 2 * turn + 1
        for table, place, which in ((0, slot[~late], ~late), (1, again, late)):
            self.pairs[0][table, place], self.pairs[1][table, place] = keys[which], merged[which]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; NO_RANK where there is none."""
        key = (left * self.size + right).astype(np.uint64)
        key[(left >= self.size) | (right >= self.size)] = NO_PAIR - np.uint64(1)
        slot = _slot(key, 1, PAIR_BITS)
        merged, missing = self.pairs[1][0, slot], self.pairs[0][0, slot] != key
        rest = np.flatnonzero(missing)
        slot = _slot(key[rest], self.turn, PAIR_BITS)
        found = self.pairs[0][1, slot] == key[rest]
        merged[rest[found]] = self.pairs[1][1, slot[found]]
        missing[rest[found]] = False
        return np.where(missing, NO_RANK, self.rank[merged]), merged


def _slot(keys: np.ndarray, turn: int, bits: int) -> np.ndarray:
    return ((keys * np.uint64((0x9E3779B97F4A7C15 * turn | 1) % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64)


@lru_cache(maxsize=4)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def merge_rounds(model: PieceModel, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols and their owners; owner numbers the segments in ascending order."""
    done_symbols, done_owner = [], []
    rank = np.full(len(symbols), NO_RANK, np.int32)  # of each symbol with the next one
    target = np.zeros(len(symbols), np.int32)
    same = np.flatnonzero(owner[:-1] == owner[1:])
    rank[same], target[same] = model.pair_ranks(symbols[same], symbols[same + 1])
    while len(symbols):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        best = np.minimum.reduceat(rank, first)
        sizes = np.diff(np.append(first, len(symbols)))
        finished = best == NO_RANK
        if finished.any():
            gone = np.repeat(finished, sizes)
            done_symbols.append(symbols[gone])
            done_owner.append(owner[gone])
            stay = ~gone
            symbols, owner, rank, target = symbols[stay], owner[stay], rank[stay], target[stay]
            sizes, best = sizes[~finished], best[~finished]
            if not len(symbols):
                break
            first = np.cumsum(sizes) - sizes
        hit = np.flatnonzero(rank == np.repeat(best, sizes))
        # Of hits side by side every second one counts, from the left; ``alone`` pieces merge once a segment.
        chain = np.concatenate([[True], (np.diff(hit) != 1) | (target[hit[1:]] != target[hit[:-1]])])
        place = np.arange(len(hit))
        since = place - np.maximum.accumulate(np.where(chain, place, 0))
        hit = hit[since % 2 == 0]
        one = model.alone[target[hit]]
        if one.any():
            leftmost = np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])
            only = np.zeros(int(owner[-1]) + 1, bool)
            only[owner[hit[one]]] = True
            hit = hit[leftmost | ~only[owner[hit]]]
        # Overlaps that remain (equal ranks, different pieces) keep the left one.
        hit = hit[np.concatenate([[True], np.diff(hit) != 1])]
        symbols[hit] = target[hit]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        rank[hit] = NO_RANK
        before = hit - 1
        after_merge = np.cumsum(keep) - 1
        new_at = after_merge[hit]
        symbols, owner, rank, target = symbols[keep], owner[keep], rank[keep], target[keep]
        mark = np.zeros(len(symbols), bool)
        mark[new_at] = True
        mark[after_merge[before[before >= 0]]] = True
        changed = np.flatnonzero(mark)
        rank[changed] = NO_RANK
        changed = changed[changed + 1 < len(symbols)]
        changed = changed[owner[changed] == owner[changed + 1]]
        rank[changed], target[changed] = model.pair_ranks(symbols[changed], symbols[changed + 1])
    if not done_symbols:
        return symbols, owner
    owner = np.concatenate(done_owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(done_symbols)[order], owner[order]


def encode_segments(model: PieceModel, raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments, one after another, and how many each has; ``lengths`` in characters of ``raw``."""
    points = np.frombuffer(raw.decode().replace(" ", SPACE).encode("utf-32-le"), "<u4")
    symbols, owner = merge_rounds(model, model.char_symbols[points], np.repeat(np.arange(len(lengths)), lengths))
    ids, owner = _with_bytes(model, symbols, owner)
    return ids.astype(np.uint32), np.bincount(owner, minlength=len(lengths))


def _with_bytes(model: PieceModel, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters without a piece become the pieces of their UTF-8 bytes."""
    strange = np.flatnonzero(symbols >= model.size)
    if not len(strange):
        return symbols, owner
    point = symbols[strange] - model.size
    wide = np.ones(len(symbols), np.int64)
    wide[strange] = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
    starts = np.cumsum(wide) - wide
    out = np.repeat(symbols, wide)
    raw = np.frombuffer("".join(map(chr, point.tolist())).encode(), np.uint8)
    places = np.repeat(starts[strange] - (np.cumsum(wide[strange]) - wide[strange]), wide[strange]) + np.arange(len(raw))
    out[places] = model.byte_ids[raw]
    return out, np.repeat(owner, wide)


class Encoder:
    """Encodes texts of one task and remembers its segments: hash, first id, number of ids."""

    def __init__(self, model: PieceModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.count, self.ids = np.zeros(0, np.int64), [np.zeros(0, np.uint32)]

    def encode(self, column: pa.Array):
        """For each block of rows: its ids without begin and end, and where each row begins and ends."""
        column = pc.replace_substring(column.fill_null(""), SPACE, " ")
        prefix = pc.if_else(pc.equal(pc.binary_length(column), 0), "", " ")
        for block in byteblocks.blocks(pc.binary_join_element_wise(prefix, column, "")):
            yield self._block(block)

    def _block(self, block: byteblocks.Block) -> tuple[np.ndarray, np.ndarray]:
        data, n = block.data, len(block.data)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(block.rows + 1, np.int64)
        space, feed = data == 0x20, data == 0x0A
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[1:] |= feed[:-1] & ~feed[1:] & ~space[1:]
        start[block.offsets[:-1][block.offsets[:-1] < n]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)
        found, example, which = np.unique(byteblocks.span_hashes(data, starts, ends, folded=False), return_index=True, return_inverse=True)
        place = self._places(found, data, starts[example], ends[example])
        counts = self.count[place][which]
        after = np.concatenate([[0], np.cumsum(counts)])
        flat = self.ids[0]
        ids = flat[np.repeat(self.first[place][which] - after[:-1], counts) + np.arange(after[-1])]
        return ids, after[np.searchsorted(starts, block.offsets)]

    def _places(self, found: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the memory has each hash, after encoding those that it lacks."""
        if len(self.hashes) + len(found) > MEMO and len(self.hashes):
            self._forget()
        place = np.searchsorted(self.hashes, found)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == found[known]
        new = np.flatnonzero(~known)
        if len(new):
            sizes = ends[new] - starts[new]
            at = np.repeat(starts[new] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            raw = data[at]
            heads = (raw & 0xC0) != 0x80
            chars = np.diff(np.concatenate([[0], np.cumsum(heads)])[np.concatenate([[0], np.cumsum(sizes)])])
            ids, counts = encode_segments(self.model, raw.tobytes(), chars)
            begin = len(self.ids[0])
            self.ids[0] = np.concatenate([self.ids[0], ids])
            self.hashes = np.insert(self.hashes, place[new], found[new])
            self.first = np.insert(self.first, place[new], begin + np.cumsum(counts) - counts)
            self.count = np.insert(self.count, place[new], counts)
            place = np.searchsorted(self.hashes, found)
        return place


def encode_texts(path: str, texts: list[str | None]) -> list[list[int]]:
    """The ids of each text without begin and end, as the library gives them."""
    out = []
    for ids, offsets in Encoder(load(path)).encode(pa.array(texts, pa.string())):
        out += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    return out


def decode_ids(model: PieceModel, ids: list[int]) -> bytes:
    """The UTF-8 text of ids: control pieces give nothing and the first space is dropped."""
    raw = b"".join(map(model.texts.__getitem__, ids))
    try:
        if not model.controls.isdisjoint(ids[1:-1]):
            raise ValueError  # a control piece may stand inside a run of bytes
        raw.decode()
    except ValueError:  # also: bytes that form no character
        raw = _repaired(model, ids)
    first = next((i for i in ids if i not in model.controls), None)
    if first is not None and raw[:1] == b" " and not model.is_byte[first] and first != model.unknown:
        return raw[1:]  # the space that encoding put in front
    return raw


def _repaired(model: PieceModel, ids: list[int]) -> bytes:
    """Bytes of a run of byte pieces that form no UTF-8 character become U+FFFD each."""
    out, run = [], bytearray()
    for i in [*ids, model.begin]:
        if model.is_byte[i]:
            run += model.texts[i]
            continue
        while run:
            size = next((n for n in range(1, min(4, len(run)) + 1) if _is_character(bytes(run[:n]))), 0)
            out.append(bytes(run[:size]) or "\ufffd".encode())
            del run[: max(size, 1)]
        out.append(model.texts[i])
    return b"".join(out)


def _is_character(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def encoded_digests(docs: DataFrame, path: str, text: str = "text", keep_text: bool = False, with_ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256: all ids with begin and end, and what they decode to.

    ``with_ids`` adds token_ids, too.  A null text counts as empty and has the
    two ids begin and end.
    """

    def start():
        model = load(path)
        encoder = Encoder(model)
        begin, end = (np.array([i], "<u4").tobytes() for i in (model.begin, model.end))

        def compute(column: pa.Array) -> list:
            counts, ids_digest, text_digest, rows = [], [], [], []
            for ids, offsets in encoder.encode(column):
                raw, numbers = ids.astype("<u4").tobytes(), ids.tolist()
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    counts.append(b - a + 2)
                    ids_digest.append(hashlib.sha256(begin + raw[4 * a: 4 * b] + end).hexdigest())
                    whole = [model.begin, *numbers[a:b], model.end]
                    text_digest.append(hashlib.sha256(decode_ids(model, whole)).hexdigest())
                    if with_ids:
                        rows.append(np.array(whole, np.int32))
            out = [pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())]
            return out + [pa.array(rows, pa.list_(pa.int32()))] * with_ids

        return compute

    return append_columns(docs, text, DIGEST_FIELDS + [("token_ids", "array<int>")] * with_ids, start, keep_text)


def encoded(docs: DataFrame, path: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds token_ids (array<int>, with begin and end) of every text; null counts as empty."""

    def start():
        encoder = Encoder(load(path))
        begin, end = encoder.model.begin, encoder.model.end

        def compute(column: pa.Array) -> list:
            rows = [np.concatenate([[begin], ids[a:b], [end]]).astype(np.int32)
                    for ids, offsets in encoder.encode(column) for a, b in zip(offsets[:-1], offsets[1:])]
            return [pa.array(rows, pa.list_(pa.int32()))]

        return compute

    return append_columns(docs, text, [("token_ids", "array<int>")], start, keep_text)


def decoded(docs: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """Adds decoded_text from a column of ids; null ids give null."""

    def start():
        model = load(path)

        def compute(column: pa.Array) -> list:
            return [pa.array([None if v is None else decode_ids(model, v).decode() for v in column.to_pylist()], pa.string())]

        return compute

    return append_columns(docs, ids, [("decoded_text", "string")], start)
