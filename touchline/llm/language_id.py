"""Language identification by prediction by partial matching.

For every language the bytes of its training texts (ASCII capitals folded) fill
a context tree of orders 0 to ``order``.  Under these frozen statistics a byte
costs, in its longest context that the tree knows, -log2(c / (n + q)) if it was
seen there c times (n bytes and q different ones followed that context); else
the escape, -log2(q / (n + q)), and then its cost in the context one shorter.
Below order 0 all 256 bytes are alike.  The language with the fewest bits for
the whole text wins, the alphabetically first among equals.

The trees of all languages become flat sparse tables, one set for each length of
contexts: a row for a context that some language knows, a bit for each symbol
seen there, and for each seen symbol its cost in every language.  All contexts of
the training texts are in them, and nothing else, so their size is bounded by
these texts, whatever the alphabet and the number of languages.  A text is scored
by array look-ups: all bytes in their longest contexts at once, what those do not
know in the next shorter ones, and so on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import byteblocks
from touchline.llm.shared import append_columns

UNDETERMINED = "und"
ORDER = 3
#: The longest contexts that fit in the integers of grams and context codes.
MOST_ORDER = 5
#: Context codes up to this are looked up in a table of all, larger ones by search.
DENSE_CODES = 1 << 24
#: Bytes that are scored at once; each has a cost in every language.
SCORED_BYTES = 1 << 18
FIELDS = [("lang_pred", "string"), ("score", "double"), ("bits_per_byte", "double")]

_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32


@dataclass
class Level:
    """All contexts of one length, in the order of their codes."""

    codes: np.ndarray
    index: np.ndarray | None  # code -> row + 1, where codes are small
    first: np.ndarray         # the row's first cost
    seen: np.ndarray          # [row, 64 symbols each] bits
    before: np.ndarray        # [row, 64 symbols each] symbols seen in the words before
    costs: np.ndarray         # [seen symbol of a row, language]
    escape: np.ndarray        # [row, language]

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """The row of each context, -1 if no language knows it."""
        if self.index is not None:
            return self.index[codes] - 1
        place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[place] == codes, place, -1)


@dataclass
class ByteModel:
    """Symbols of bytes (0: in no training text) and one level for each length of contexts, from 0."""

    languages: list[str]
    symbols: np.ndarray
    levels: list[Level]

    @property
    def width(self) -> int:
        return int(self.symbols.max()) + 1

    @property
    def order(self) -> int:
        return len(self.levels) - 1

    def costs(self, contexts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Bits [byte, language] of symbols in contexts of full length, the newest symbol being the code's last digit."""
        out = np.zeros((len(symbols), len(self.languages)))
        left, contexts = np.arange(len(symbols)), contexts.astype(np.int64)
        for length in reversed(range(len(self.levels))):
            level = self.levels[length]
            if not len(level.codes):
                continue
            row = level.rows(contexts[left] % self.width ** length)
            there = np.flatnonzero(row >= 0)
            row, symbol = row[there], symbols[left[there]]
            word, bit = symbol >> 6, (symbol & 63).astype(np.uint64)
            bits = level.seen[row, word]
            hit = (bits >> bit) & np.uint64(1) == 1
            rank = np.bitwise_count(bits[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[there[hit]]] += level.costs[level.first[row[hit]] + level.before[row[hit], word[hit]] + rank]
            out[left[there[~hit]]] += level.escape[row[~hit]]
            stays = np.ones(len(left), bool)
            stays[there[hit]] = False
            left = left[stays]
        out[left] += 8.0  # below order 0
        return out


def _counts_of_texts(column: pa.Array, langs: pa.Array, order: int):
    """(language, gram length, gram, count) of a batch, grams as integers of 9-bit symbols."""
    for block in byteblocks.blocks(column):
        data = _fold[block.data].astype(np.int64) + 1
        row = byteblocks.row_of(block.offsets)
        names, codes = np.unique(np.array(langs.slice(block.first, block.rows).to_pylist(), dtype=object).astype(str), return_inverse=True)
        lang = codes[row]
        for length in range(1, order + 2):
            if len(data) < length:
                break
            gram = np.zeros(len(data) - length + 1, np.int64)
            for k in range(length):
                gram = (gram << 9) | data[k: len(data) - length + 1 + k]
            whole = row[: len(gram)] == row[length - 1:]
            here, gram = lang[: len(gram)][whole], gram[whole]
            for code, name in enumerate(names):
                keys, counts = np.unique(gram[here == code], return_counts=True)
                yield name, length, keys, counts


def training_grams(texts: DataFrame, order: int) -> DataFrame:
    """Summed gram counts per language of (text, lang) rows."""

    def count(batches):
        for batch in batches:
            for lang, length, grams, counts in _counts_of_texts(batch.column("text"), batch.column("lang"), order):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array(np.full(len(grams), length), pa.int32()), pa.array(grams), pa.array(counts)],
                    names=["lang", "length", "gram", "n"])

    grams = texts.select("text", "lang").mapInArrow(count, "lang string, length int, gram long, n long")
    return grams.groupBy("lang", "length", "gram").agg(F.sum("n").alias("n"))


def _usable(docs: DataFrame, text: str, lang: str, learn) -> DataFrame:
    """text and lang of all rows to learn from."""
    return docs.filter(learn & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))


def fit(docs: DataFrame, learn, text: str = "text", lang: str = "lang", order: int = ORDER) -> ByteModel | None:
    """Trees of contexts of up to ``order`` bytes from all rows where ``learn`` holds; None if there are none.

    Spark counts; what comes to the driver is one row for each different gram of a language.
    """
    if not 0 <= order <= MOST_ORDER:
        raise ValueError(f"contexts have 0 to {MOST_ORDER} bytes")
    rows = training_grams(_usable(docs, text, lang, learn), order).toArrow()
    if rows.num_rows == 0:
        return None
    return build(rows["lang"], rows["length"].to_numpy(), rows["gram"].to_numpy(), rows["n"].to_numpy(), order)


def build(langs: pa.ChunkedArray, lengths: np.ndarray, grams: np.ndarray, counts: np.ndarray, order: int) -> ByteModel:
    """Tables from gram counts."""
    coded = langs.combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    languages = sorted(names)
    lang = np.array([languages.index(name) for name in names])[coded.indices.to_numpy()]
    seen = np.unique(grams[lengths == 1])  # folded byte + 1
    symbols = np.zeros(256, np.int64)
    symbols[seen - 1] = np.arange(1, len(seen) + 1)
    symbols[65:91] = symbols[97:123]
    model = ByteModel(languages, symbols, [])
    for length in range(1, order + 2):
        mine = lengths == length
        full = np.zeros(int(mine.sum()), np.int64)
        for k in reversed(range(length)):
            full = full * model.width + symbols[((grams[mine] >> (9 * k)) & 511) - 1]
        model.levels.append(_level(model, length - 1, full, lang[mine], counts[mine].astype(np.float64)))
    return model


def _level(model: ByteModel, length: int, full: np.ndarray, lang: np.ndarray, counts: np.ndarray) -> Level:
    """The level of contexts of ``length`` symbols from their grams, one symbol longer, above the levels that the model has."""
    width, n_lang = model.width, len(model.languages)
    keys, place = np.unique(full, return_inverse=True)
    codes, first, row = np.unique(keys // width, return_index=True, return_inverse=True)
    slot = row[place] * n_lang + lang
    total = np.bincount(slot, counts, len(codes) * n_lang).reshape(-1, n_lang)
    kinds = np.bincount(slot, minlength=len(codes) * n_lang).reshape(-1, n_lang).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):  # a tree that lacks the context costs nothing to leave
        escape = np.where(kinds > 0, np.log2((total + kinds) / kinds), 0.0)
    costs = escape[row] + model.costs(keys // width, keys % width)
    costs[place, lang] = np.log2((total + kinds)[row[place], lang]) - np.log2(counts)
    words = (width + 63) // 64
    seen = np.zeros((len(codes), words), np.uint64)
    symbol = keys % width
    np.bitwise_or.at(seen, (row, symbol >> 6), np.uint64(1) << (symbol & 63).astype(np.uint64))
    held = np.bitwise_count(seen).astype(np.int64)
    index = None
    if width ** length <= DENSE_CODES:
        index = np.zeros(width ** length, np.int32)
        index[codes] = np.arange(1, len(codes) + 1)
    return Level(codes, index, first, seen, (np.cumsum(held, axis=1) - held).astype(np.int16), costs.astype(np.float32), escape.astype(np.float32))


def code_lengths(model: ByteModel, block: byteblocks.Block) -> np.ndarray:
    """Bits of every row in every language.

    A row begins as if bytes unknown to all trees stood before it.
    """
    rows, n_lang = block.rows, len(model.languages)
    if len(block.data) == 0:
        return np.zeros((rows, n_lang))
    s, begins = model.symbols[block.data], block.offsets[:-1]
    contexts = np.zeros(len(s), np.int64)
    for k in reversed(range(model.order)):
        back = np.zeros(len(s), np.int64)
        back[k + 1:] = s[: len(s) - k - 1]
        for near in range(k + 1):  # the first bytes of a row have no byte so far back
            at = begins + near
            back[at[(at < len(s)) & (at < block.offsets[1:])]] = 0
        contexts = contexts * model.width + back
    sums = np.zeros((len(s) + 1, n_lang))
    np.cumsum(model.costs(contexts, s), axis=0, out=sums[1:])
    return sums[block.offsets[1:]] - sums[begins]


def predict(docs: DataFrame, model: ByteModel | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds lang_pred, score and bits_per_byte to every row.

    A null text, one without a letter and any text under an empty model are
    ``und`` with score 0 and null bits.  The score is the winner's share of
    2^-bits over all languages.  Equal texts get equal rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value

        def compute(column: pa.Array) -> list:
            lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if model is None:
                lettered = np.zeros(len(column), bool)
            names = np.full(len(column), UNDETERMINED, dtype=object)
            score, bits = np.zeros(len(column)), np.full(len(column), np.nan)
            for block in byteblocks.blocks(column, SCORED_BYTES) if model else ():
                lengths = code_lengths(model, block)
                best = lengths.argmin(axis=1)
                least = lengths[np.arange(block.rows), best]
                at = slice(block.first, block.first + block.rows)
                names[at] = np.array(model.languages, dtype=object)[best]
                score[at] = 1.0 / np.exp2(np.maximum(least[:, None] - lengths, -1000.0)).sum(axis=1)
                bits[at] = least / np.maximum(np.diff(block.offsets), 1)
            names[~lettered], score[~lettered] = UNDETERMINED, 0.0
            return [pa.array(names, pa.string()), pa.array(score), pa.array(bits, mask=~lettered)]

        return compute

    return append_columns(docs, text, FIELDS, start, keep_text)


def own_bits(docs: DataFrame, model: ByteModel, learn, text: str = "text", lang: str = "lang") -> dict[str, float]:
    """Bits that a byte of each language's training texts takes in its own tree, on average over their bytes.

    What a language should cost, whatever the length of a text; a language none
    of whose texts it wins has no entry.
    """
    judged = predict(_usable(docs, text, lang, learn), model)
    size = F.octet_length("text")
    won = judged.filter("lang_pred = lang").groupBy("lang").agg((F.sum(F.col("bits_per_byte") * size) / F.sum(size)).alias("bits"))
    return {r["lang"]: r["bits"] for r in won.collect()}
