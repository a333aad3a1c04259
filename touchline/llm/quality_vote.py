"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a bag of terms: its words (hashed into buckets) and their shapes, such
as capitals only, a symbol at the end, or the same word for the third time in a row.  Log counts,
weighted by inverse document frequency and scaled, are projected
on the leading singular directions of a bounded training sample, and scaled
again.  The sample's vectors with their labels are broadcast (their number and
width are parameters); the cosine of every text with every one of them comes
from blocked matrix products.  The ``neighbours`` most similar ones, and all
that tie with the last of them, vote with their similarity, each class weighted
back to its share of the labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import byteblocks
from touchline.llm.shared import append_columns

WORD_BUCKETS = 704
SHAPE_BUCKETS = 320
TERMS = WORD_BUCKETS + SHAPE_BUCKETS
#: Length of the word part of a bag; the part of the shapes has length 1.
WORD_SHARE = 0.4
#: Training texts of one class; they are those with the smallest hashes of their keys.
MAX_PER_CLASS = 1500
DIMENSIONS = 32
NEIGHBOURS = 25
THRESHOLD = 0.3
#: Similarities that are computed at once.
BLOCK_ROWS = 512
FIELDS = [("score", "double"), ("predicted", "int")]

#: Byte classes: 0 small letter, 1 capital, 2 digit, 3 beyond ASCII, then one for each ASCII symbol.
_kind = np.zeros(256, np.int64)
_kind[48:58] = 2
_kind[128:] = 3
_symbols = [b for b in range(33, 127) if not chr(b).isalnum()]
_kind[_symbols] = np.arange(4, 4 + len(_symbols))
_kind[65:91] = 1


@dataclass
class Voters:
    """The projection of terms and the labelled vectors."""

    weight: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    class_weight: np.ndarray
    base: float
    neighbours: int


def term_counts(block: byteblocks.Block) -> np.ndarray:
    """Counts [row, term] of a block."""
    found = byteblocks.words(block, byteblocks.SPACE_ENDED)
    row = byteblocks.row_of(found.rows)
    if not len(row):
        return np.zeros((block.rows, TERMS))
    kind = _kind[block.data]
    word = (found.hashes % np.uint64(WORD_BUCKETS)).astype(np.int64)
    size = found.ends - found.starts
    last, before = kind[found.ends - 1], kind[np.maximum(found.ends - 2, found.starts)]
    small = np.concatenate([[0], np.cumsum(kind == 0)])
    large = np.concatenate([[0], np.cumsum(kind == 1)])
    shout = (small[found.ends] == small[found.starts]) & (large[found.ends] - large[found.starts] > 1)
    again = np.zeros(len(row), bool)
    same = found.hashes[1:] == found.hashes[:-1]
    again[2:] = same[1:] & same[:-1] & (row[2:] == row[:-2])
    ending = np.where(last < 4, 0, 1 + 2 * (last - 4) + (last == before) * (size > 1))  # which symbol, and whether twice
    shape = np.where(ending > 0, ending + 8, np.minimum(size, 8) % 4)
    shape = np.where(shout, 120 + np.minimum(ending, 90), shape)
    shape = np.where((ending > 0) & (kind[found.starts] >= 4), 216 + np.minimum(ending, 90), shape)
    terms = [row * TERMS + word, row * TERMS + WORD_BUCKETS + shape]
    terms.append(row[again] * TERMS + WORD_BUCKETS + 310)
    return np.bincount(np.concatenate(terms), minlength=block.rows * TERMS).reshape(block.rows, TERMS).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _bags(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted log counts; words and shapes are scaled to fixed lengths, so that neither drowns the other."""
    logs = np.log1p(counts) * weight
    return np.concatenate([WORD_SHARE * _unit(logs[:, :WORD_BUCKETS]), _unit(logs[:, WORD_BUCKETS:])], axis=1)


def training_sample(docs: DataFrame, labels: DataFrame, learn, key: str = "doc_id", text: str = "text", label: str = "quality",
                    max_per_class: int = MAX_PER_CLASS):
    """Labels 0 or 1 and term counts of a bounded sample; and the labelled rows of each class.

    Only rows with ``learn`` on the label side are used; a key labelled twice
    has its smaller label.  Null labels and null texts teach nothing.
    """
    known = labels.filter(learn & F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("__label"))
    totals = {int(r[0]): r[1] for r in known.groupBy("__label").count().collect()}
    if len(totals) < 2:
        return np.zeros(0), np.zeros((0, TERMS)), totals
    share = F.when(F.col("__label") == 1, min(1.0, max_per_class / totals[1])).otherwise(min(1.0, max_per_class / totals[0]))
    spread = F.pmod(F.xxhash64(F.lit(2), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    picked = known.filter(spread < share)  # about 2 * max_per_class short rows
    rows = docs.select(key, text).filter(F.col(text).isNotNull())
    rows = rows.join(F.broadcast(picked), key).select("__label", F.col(text).alias("__text"))

    def count(batches):
        for batch in batches:
            for block in byteblocks.blocks(batch.column("__text")):
                counts = term_counts(block).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__label").slice(block.first, block.rows).cast(pa.int32()),
                     pa.array([r.tobytes() for r in counts], pa.binary())], names=["label", "counts"])

    got = rows.mapInArrow(count, "label int, counts binary").toArrow()
    counts = np.frombuffer(b"".join(got["counts"].to_pylist()), np.float32).reshape(-1, TERMS)
    order = np.lexsort([*counts.T[:8], got["label"].to_numpy()])  # a fixed order, however the tasks ended
    return got["label"].to_numpy()[order], counts[order].astype(np.float64), totals


def fit(docs: DataFrame, labels: DataFrame, learn, key: str = "doc_id", text: str = "text", label: str = "quality",
        max_per_class: int = MAX_PER_CLASS, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> Voters | None:
    """The voters; None if a class has no labelled text."""
    classes, counts, totals = training_sample(docs, labels, learn, key, text, label, max_per_class)
    sizes = np.bincount(classes.astype(int), minlength=2) if len(classes) else np.zeros(2)
    if not sizes.all():
        return None
    weight = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0)))
    bags = _bags(counts, weight)
    # Right singular vectors from the small square matrix; the sample is never decomposed itself.
    values, vectors = np.linalg.eigh(bags.T @ bags)
    directions = vectors[:, np.argsort(-values)[:dimensions]]
    share = np.array([totals[0], totals[1]]) / (totals[0] + totals[1])
    return Voters(weight, directions, _unit(bags @ directions).astype(np.float32), classes.astype(np.int8),
                  share / (sizes / sizes.sum()), float(share[1]), neighbours)


def project(voters: Voters, block: byteblocks.Block) -> np.ndarray:
    return _unit(_bags(term_counts(block), voters.weight) @ voters.directions)


def vote(voters: Voters, vectors: np.ndarray) -> np.ndarray:
    """Share of label 1 in the weighted votes of the nearest labelled vectors."""
    out = np.full(len(vectors), voters.base)
    k = min(voters.neighbours, len(voters.labels))
    weight = voters.class_weight[voters.labels]
    for at in range(0, len(vectors), BLOCK_ROWS):
        part = vectors[at: at + BLOCK_ROWS].astype(np.float32)
        cosine = part @ voters.vectors.T
        bar = np.partition(cosine, len(voters.labels) - k, axis=1)[:, len(voters.labels) - k]
        row, near = np.nonzero(cosine >= bar[:, None])
        votes = np.maximum(cosine[row, near], 0.0).astype(np.float64) ** 2 * weight[near]
        total = np.bincount(row, votes, len(part))
        good = np.bincount(row, votes * voters.labels[near], len(part))
        some = total > 0
        out[at: at + BLOCK_ROWS][some] = good[some] / total[some]
    return out


def score(docs: DataFrame, voters: Voters | None, text: str = "text", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= threshold).

    A text without words, and every text if there are no voters, gets the share
    of label 1 among the labelled rows (1.0 without any).
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def start():
        voters = shared.value

        def compute(column: pa.Array) -> list:
            scores = np.ones(len(column))
            for block in byteblocks.blocks(column) if voters else ():
                scores[block.first: block.first + block.rows] = np.concatenate(
                    [vote(voters, project(voters, part)) for part in _slices(block)])
            return [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]

        return compute

    return append_columns(docs, text, FIELDS, start, keep_text)


def _slices(block: byteblocks.Block):
    """A block of many short rows in parts, as each row takes a full line of term counts."""
    for at in range(0, block.rows, BLOCK_ROWS):
        offsets = block.offsets[at: at + BLOCK_ROWS + 1]
        yield byteblocks.Block(at, block.data[offsets[0]: offsets[-1]], offsets - offsets[0])
