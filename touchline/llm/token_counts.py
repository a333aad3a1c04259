"""Token counts with a tokenizers file, for texts of any length.

A boundary between an ASCII white-space character and what follows is *stable*
for a tokenizer that drops white space and whose normaliser, special tokens and
pre-tokenizer never look across it: what stands on either side is then encoded
alike with or without the other side.  ``StableTokenizer`` refuses files whose
parts are not of the kinds for which this holds.  So is a *turn* between letters,
digits and punctuation of which no character can join its neighbour when text is
composed (ASCII; Chinese and Japanese letters and punctuation), as the pattern
puts no two of these kinds, nor two digits, into one piece: but for letters
behind an apostrophe, and where a special token might reach across.

* Huge texts are encoded in overlapping chunks with offsets.  In each overlap
  the last stable boundary at which both encodings have the same tokens around
  it is the seam; an overlap without a stable boundary is doubled until it has
  one, and a chunk without any is doubled, too, so time grows with the text.
* Other texts are sums over their words, cut at stable boundaries; each
  different word (by a 64-bit hash of its bytes) is encoded once a task.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from touchline.llm import byteblocks
from touchline.llm.shared import append_columns

#: Texts of more characters are encoded in chunks of so many, overlapping by ``OVERLAP``.
CHUNK = 48 * 1024
OVERLAP = 512
LIMIT = 2048
#: Words that a task remembers before it starts afresh, and words encoded in one call.
MEMO = 2_000_000
CALL_WORDS = 20_000
FIELDS = [("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")]

_STABLE = re.compile("[\x20\x09-\x0d]+")
#: Letters, digits and punctuation that composition (NFC) leaves apart; kana may be voiced by what follows, which stays with them.
_LETTER, _DIGIT = "A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff", "0-9"
_MARK = "!-&(-/:-@\\[-`{-~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"  # all but the apostrophe
_TURN = re.compile(f"(?<=[{_LETTER}])(?=[{_DIGIT}{_MARK}'])|(?<=[{_DIGIT}])(?=[{_LETTER}{_DIGIT}{_MARK}'])|(?<=[{_MARK}])(?=[{_LETTER}{_DIGIT}])|(?<=')(?=[{_DIGIT}])")
#: Punctuation that is split off the end of a word where it follows an ASCII letter or digit.
_TRAILING = np.isin(np.arange(256), list(b".,;:!?"))
_ALNUM = np.array([b < 0x80 and chr(b).isalnum() for b in range(256)])


class StableTokenizer:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        normal = {n["type"] for n in _parts(parts["normalizer"], "normalizers")}
        before = _parts(parts["pre_tokenizer"], "pretokenizers")
        special = [t["content"] for t in parts["added_tokens"]]
        split = before[0] if before else {"type": None}
        fine = (
            normal <= {"NFC", "Replace", "Lowercase"}
            and all(n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in _parts(parts["normalizer"], "normalizers") if n["type"] == "Replace")
            and split["type"] == "Split" and split["invert"] and split["behavior"] == "Removed"
            and split["pattern"]["Regex"] == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            and all(b["type"] == "ByteLevel" and not b["add_prefix_space"] and not b["use_regex"] for b in before[1:])
            and not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in parts["added_tokens"])
            and not any(_STABLE.search(t) for t in special) and all(t.startswith("<") and t.endswith(">") for t in special)
        )
        if not fine:
            raise ValueError("a tokenizer without stable boundaries at white space")
        self.longest_special = max(map(len, special), default=0)
        self.library.no_truncation()
        self.library.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        out = []
        for at in range(0, len(texts), CALL_WORDS):
            out += map(len, self.library.encode_batch_fast(texts[at: at + CALL_WORDS], add_special_tokens=False))
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the character at which each token begins."""
        found = self.library.encode(text, add_special_tokens=False)
        return np.array(found.ids, np.int64), np.array([start for start, _ in found.offsets], np.int64)

    def encode_huge(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
        """All ids of a text, from overlapping chunks."""
        if len(text) <= chunk:
            return self.encode(text)[0]
        done = []
        begin, end, since = 0, chunk, 0  # since: the last seam
        ids, starts = self.encode(text[:end])
        while end < len(text):
            seam, wide = None, min(overlap, end - begin)
            while (stops := self.stable(text, max(end - wide, since), end)) is None and end - wide > max(begin, since):
                wide = min(2 * wide, end - begin)
            while stops is not None:
                next_begin, next_end = end - wide, min(len(text), end - wide + max(chunk, 2 * wide))
                next_ids, next_starts = self.encode(text[next_begin:next_end])
                seam = _seam(stops, (ids, starts, begin), (next_ids, next_starts, next_begin))
                if seam is not None or next_begin <= max(begin, since):
                    break
                wide = min(2 * wide, end - begin)
                stops = self.stable(text, max(end - wide, since), end)
            if seam is None:  # no stable boundary in all of this chunk: one of twice the length
                end = min(len(text), end + max(chunk, end - since))
                ids, starts = self.encode(text[since:end])
                begin = since
                continue
            done.append(ids[starts + begin < seam])
            # Later seams lie behind this one, so what stands before it may go.
            keep = next_starts + next_begin >= seam
            ids, starts, begin, end, since = next_ids[keep], next_starts[keep], next_begin, next_end, seam
        return np.concatenate([*done, ids])

    def stable(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """The first and last stable boundary from ``low`` on, before ``high``; at ``high`` white space may go on."""
        first = last = None
        for pattern in (_STABLE, _TURN):
            for met in pattern.finditer(text, low, high):
                at = met.end()
                # A special token begins with "<" and might reach across a turn.
                if at == high or pattern is _TURN and "<" in text[max(at - self.longest_special, 0): at]:
                    continue
                first = at if first is None else min(first, at)
                last = at if last is None else max(last, at)
        return None if first is None else (first, last)


def _parts(part: dict | None, name: str) -> list[dict]:
    if part is None:
        return []
    return part[name] if part["type"] == "Sequence" else [part]


def _seam(stops: tuple[int, int], left, right) -> int | None:
    """The last of these stable boundaries if both sides have equal tokens from the first one on."""
    ids, starts, begin = left
    next_ids, next_starts, next_begin = right
    first, last = stops
    mine = (starts + begin >= first) & (starts + begin < last)
    theirs = (next_starts + next_begin >= first) & (next_starts + next_begin < last)
    if np.array_equal(ids[mine], next_ids[theirs]) and np.array_equal(starts[mine] + begin, next_starts[theirs] + next_begin):
        return last
    return None


@lru_cache(maxsize=4)
def load(path: str) -> StableTokenizer:
    return StableTokenizer(path)


class WordCounts:
    """Token counts of words by hash, for the texts of one task."""

    def __init__(self, tokenizer: StableTokenizer):
        self.tokenizer = tokenizer
        self.hashes, self.tokens = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def block(self, block: byteblocks.Block) -> np.ndarray:
        """The number of tokens of every row of a block."""
        data = block.data
        found = byteblocks.words(block, byteblocks.SPACE_ENDED)
        if not len(found.starts):
            return np.zeros(block.rows, np.int64)
        starts, ends = found.starts, found.ends
        # A trailing run of punctuation after an ASCII letter or digit is a word of its own.
        cut = ends.copy()
        moving = np.flatnonzero(_TRAILING[data[cut - 1]])
        while len(moving):
            cut[moving] -= 1
            moving = moving[cut[moving] > starts[moving]]
            moving = moving[_TRAILING[data[cut[moving] - 1]]]
        cut = np.where((cut > starts) & _ALNUM[data[np.maximum(cut - 1, 0)]], cut, ends)
        tail = np.flatnonzero(cut < ends)
        starts = np.concatenate([starts, cut[tail]])
        ends = np.concatenate([cut, ends[tail]])
        row = byteblocks.row_of(found.rows)
        row = np.concatenate([row, row[tail]])
        # Capitals do not matter but in special tokens, which begin with "<".
        hashes = byteblocks.span_hashes(data, starts, ends, folded=True)
        if (data == 0x3C).any():
            below = np.concatenate([[0], np.cumsum(data == 0x3C)])
            odd = below[ends] > below[starts]
            hashes[odd] = byteblocks.span_hashes(data, starts[odd], ends[odd], folded=False) ^ np.uint64(1)
        keys, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        counts = self._counts(keys, data, starts[example], ends[example])
        return np.bincount(row, counts[which], block.rows).astype(np.int64)

    def _counts(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.hashes) + len(keys) > MEMO:
            self.hashes, self.tokens = self.hashes[:0], self.tokens[:0]
        place = np.searchsorted(self.hashes, keys)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            self.tokens = np.insert(self.tokens, place[new], self.tokenizer.counts(texts))
            self.hashes = np.insert(self.hashes, place[new], keys[new])
            place = np.searchsorted(self.hashes, keys)
        return self.tokens[place]


def count_texts(tokenizer: StableTokenizer, memo: WordCounts, column: pa.Array, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """The number of tokens of each text of a column; null counts as empty."""
    column = column.fill_null("")
    huge = np.flatnonzero(pc.greater(pc.utf8_length(column), chunk).to_numpy(zero_copy_only=False))
    rest = column if not len(huge) else pc.if_else(pc.greater(pc.utf8_length(column), chunk), "", column)
    out = np.zeros(len(column), np.int64)
    for block in byteblocks.blocks(rest):
        out[block.first: block.first + block.rows] = memo.block(block)
    for row in huge.tolist():
        out[row] = len(tokenizer.encode_huge(column[row].as_py(), chunk, overlap))
    return out


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP,
                 keep_text: bool = False) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit); a null text counts as empty.

    Every row is counted by itself, so repeated rows and null keys stay as they
    are; a column with the name of a new one is replaced.
    """

    def start():
        tokenizer = load(path)
        memo = WordCounts(tokenizer)

        def compute(column: pa.Array) -> list:
            tokens = count_texts(tokenizer, memo, column, chunk, overlap)
            return [pc.binary_length(column.fill_null("")).cast(pa.int64()), pa.array(tokens), pa.array(tokens > limit)]

        return compute

    return append_columns(docs, text, FIELDS, start, keep_text)


def token_ids(docs: DataFrame, path: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Adds token_ids (array<int>) of every whole text; null counts as empty."""

    def start():
        tokenizer = load(path)

        def compute(column: pa.Array) -> list:
            return [pa.array([tokenizer.encode_huge(t or "", chunk, overlap).astype(np.int32) for t in column.to_pylist()], pa.list_(pa.int32()))]

        return compute

    return append_columns(docs, text, [("token_ids", "array<int>")], start)
