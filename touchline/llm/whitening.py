"""Whitening of embeddings by spectral divide-and-conquer.

Entries become whole numbers, so that equal vectors are found, sums are exact
and no copy counts twice.  Counts, sums and the centred second moments of the
distinct vectors are added up by Spark; only the d x d covariance comes to the
driver (d is the width of a vector).  There it is taken apart without an
eigensolver: the polar factor U of V - s I, found by QDWH iterations, turns into
the projector (U + I) / 2 on all eigenvectors above the shift s; its range and
the range of the rest are invariant, and both smaller blocks are split again
until they are diagonal.  The few leading components go back to all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.runtime import written_table

#: Entry c counts as floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Scaled entries end here on both sides, far beyond any embedding, so that the sums of a batch fit in 64 bits.
LARGEST = 1 << 40
#: Rows whose centred values are held at once.
STRIP = 4096
EPS = float(np.finfo(np.float64).eps)


# --- polar decompositions and splitting -------------------------------------------------

def polar_sign(a: np.ndarray, most: int = 40) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH: 1 on its positive eigenvectors, -1 on the negative.

    ``low`` bounds the smallest singular value from below; the weights of each
    step follow from it, and it reaches 1 in about six steps.
    """
    size = np.abs(a).sum(axis=0).max()
    if size == 0:
        return np.eye(len(a))
    x, low, unit = a / size, EPS / 4, np.eye(len(a))
    for _ in range(most):
        square = low * low
        h = np.cbrt(4 * (1 - square) / square ** 2)
        root = np.sqrt(1 + h)
        alpha = root + 0.5 * np.sqrt(max(8 - 4 * h + 8 * (2 - square) / (square * root), 0.0))
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(gamma) * x, unit]))
        new = beta / gamma * x + (alpha - beta / gamma) / np.sqrt(gamma) * (q[: len(a)] @ q[len(a):].T)
        new = (new + new.T) / 2
        low = min(low * (alpha + beta * square) / (1 + gamma * square), 1.0)
        step, x = np.abs(new - x).max(), new
        if 1 - low < 10 * EPS and step < 10 * np.cbrt(EPS) ** 2:
            break
    return x


def _halves(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span what lies above a shift, both parts invariant; None if a is a multiple of I."""
    reach = np.abs(a).sum(axis=1) - np.abs(a.diagonal())
    low, high = (a.diagonal() - reach).min(), (a.diagonal() + reach).max()
    start = np.random.default_rng(len(a)).normal(size=a.shape)
    shift, unit, best = float(np.median(a.diagonal())), np.eye(len(a)), None
    for _ in range(80):
        if high - low <= EPS * scale:
            break
        above = (polar_sign(a - shift * unit) + unit) / 2
        k = int(round(np.trace(above)))
        if 0 < k < len(a):
            basis, _ = np.linalg.qr(np.hstack([above @ start[:, :k], start[:, k:] - above @ start[:, k:]]))
            basis, _ = np.linalg.qr(np.hstack([above @ basis[:, :k], basis[:, k:] - above @ basis[:, k:]]))
            left = np.abs(basis[:, k:].T @ a @ basis[:, :k]).max()
            if best is None or left < best[0]:
                best = left, basis, k
            if left <= 4 * len(a) * EPS * scale:
                break
            shift += 0.07 * (high - shift)  # the shift hit an eigenvalue
            continue
        low, high = (low, shift) if k <= 0 else (shift, high)
        shift = (low + high) / 2
    return None if best is None else best[1:]


def spectral_components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; each vector's largest entry is positive."""
    v = (v + v.T) / 2
    scale = np.abs(v).sum(axis=0).max()
    found, open_ = [], [np.eye(len(v))]
    while open_:
        basis = open_.pop()
        block = basis.T @ v @ basis
        block = (block + block.T) / 2
        halves = None if np.abs(block - np.diag(block.diagonal())).max() <= EPS * scale else _halves(block, scale)
        if halves is None:
            found.append(basis)
        else:
            turned = basis @ halves[0]
            open_ += [turned[:, : halves[1]], turned[:, halves[1]:]]
    vectors = np.hstack(found)
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values, vectors * np.where(sign == 0, 1.0, sign)


# --- exact counts and moments in Spark --------------------------------------------------

def finite(vector: Column) -> Column:
    """Not null and all entries finite; true for an empty vector."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    return F.coalesce(F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _whole(column: pa.Array, width: int) -> np.ndarray:
    """The entries of a column of vectors as whole numbers."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return np.clip(np.floor(SCALE * values), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest integers that hold it, so equal rows have equal bytes."""
    x = x - OFFSET
    out: list = [None] * len(x)
    reach = np.maximum(x.max(axis=1), -1 - x.min(axis=1))
    kinds = (np.int8, np.int16, np.int32, np.int64)
    kind_of = np.searchsorted([np.iinfo(k).max for k in kinds], reach)
    for i, kind in enumerate(kinds):
        rows = np.flatnonzero(kind_of == i)
        for row, code in zip(rows.tolist(), np.ascontiguousarray(x[rows].astype(kind))):
            out[row] = code.tobytes()
    return out


def _unpacked(codes: list[bytes], width: int) -> np.ndarray:
    out = np.empty((len(codes), width), np.int64)
    sizes = np.array([len(c) for c in codes]) // width
    for kind in (np.int8, np.int16, np.int32, np.int64):
        rows = np.flatnonzero(sizes == np.dtype(kind).itemsize)
        out[rows] = np.frombuffer(b"".join(codes[r] for r in rows.tolist()), kind).reshape(-1, width)
    return out + OFFSET


def distinct_codes(vectors: DataFrame, width: int) -> DataFrame:
    """``code``: each distinct vector once, a byte or two an entry.  A frequent one is collapsed before the shuffle."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_packed(_whole(batch.column("vector"), width)), pa.binary())], names=["code"])

    return vectors.select("vector").mapInArrow(encode, "code binary").distinct()


@dataclass(frozen=True)
class Center:
    """Number of distinct vectors and their sums, entry by entry."""

    n: int
    sums: tuple[int, ...]

    def shifted(self, x: np.ndarray) -> np.ndarray | None:
        """n x - S in 64 bits; None where that might not hold it."""
        peak = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums)))
        return self.n * x - np.array(self.sums, np.int64) if peak < 1 << 62 else None

    def away(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, rounded once where the difference fits in 64 bits."""
        shifted = self.shifted(x)
        return shifted / self.n if shifted is not None else x - np.array([s / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Squared length of n x - S, exact; null beyond 64 bits."""
        shifted = self.shifted(x)
        if shifted is None:
            return pa.nulls(len(x), pa.int64())
        about = (shifted.astype(np.float64) ** 2).sum(axis=1)
        return pa.array((shifted * shifted).sum(axis=1), mask=about > 9e18)


def center(codes: DataFrame, width: int) -> Center:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for batch in batches:
            x = _unpacked(batch.column("code").to_pylist(), width)
            n += len(x)
            sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))],
            names=["entry", "n", "total"])

    rows = codes.mapInArrow(add, "entry int, n long, total decimal(38,0)").groupBy("entry").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    got = sorted((r["entry"], int(r["n"]), int(r["total"])) for r in rows.collect())
    return Center(got[0][1] if got else 0, tuple(r[2] for r in got))


def covariance(codes: DataFrame, middle: Center, weights: np.ndarray) -> np.ndarray:
    """Covariance of (x - S/n) times ``weights`` over the codes, divisor n; tasks send their own sums, one row a row of it."""
    width, size = weights.shape

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            packed = batch.column("code").to_pylist()
            for at in range(0, len(packed), STRIP):
                z = middle.away(_unpacked(packed[at: at + STRIP], width)) @ weights
                total += z.T @ z
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array([part] * size, pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
            names=["row", "part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")  # one order of additions, however the tasks ended
        sums = np.array(table["sums"].to_pylist()).sum(axis=0)
        return pa.table({"row": table["row"][:1], "sums": pa.array([sums], pa.list_(pa.float64()))})

    rows = codes.mapInArrow(multiply, "row int, part int, sums array<double>").groupBy("row").applyInArrow(add, "row int, sums array<double>")
    got = dict((r["row"], r["sums"]) for r in rows.collect())
    return np.array([got[i] for i in range(size)]) / middle.n


# --- the operator -----------------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """What rows of one width are whitened by."""

    center: Center
    vectors: np.ndarray     # components as columns
    values: np.ndarray      # their variances, falling
    explained: list[float]  # shares of all variance
    rank: int               # components that have variance
    identity_error: float | None

    @property
    def weights(self) -> np.ndarray:
        return self.vectors[:, : self.rank] / np.sqrt(self.values[: self.rank])


def fit(vectors: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """The leading components of the distinct vectors of one width."""
    codes = written_table(distinct_codes(vectors, width), "vector-codes")
    middle = center(codes, width)
    v = covariance(codes, middle, np.eye(width))
    values, found = spectral_components(v)
    kept, trace = min(components, width), float(np.trace(v))
    rank = int((values[:kept] > width * EPS * max(values[0], 0.0)).sum())
    model = Whitening(middle, found[:, :kept], values[:kept], [float(e) / trace if trace > 0 else 0.0 for e in values[:kept]], rank, None)
    if rank == 0:
        return model
    error = float(np.abs(covariance(codes, middle, model.weights) - np.eye(rank)).max())
    return Whitening(middle, model.vectors, model.values, model.explained, rank, error)


def transform(vectors: DataFrame, model: Whitening, width: int) -> DataFrame:
    """(id, vector) rows as id, n, deviation, whitened, explained, identity_error."""
    missing = len(model.explained) - model.rank

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights
        for batch in batches:
            for at in range(0, batch.num_rows, STRIP):
                part = batch.slice(at, STRIP)
                x = _whole(part.column("vector"), width)
                z = [[*row, *[None] * missing] for row in (model.center.away(x) @ weights).tolist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), model.center.deviations(x), pa.array(z, pa.list_(pa.float64()))], names=["id", "deviation", "whitened"])

    kind = vectors.schema["id"].dataType.simpleString()
    rows = vectors.mapInArrow(project, f"id {kind}, deviation long, whitened array<double>")
    return rows.select(
        "id", F.lit(model.center.n).cast("long").alias("n"), "deviation", "whitened",
        F.lit(model.explained).cast("array<double>").alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))


def whitened(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, n, deviation, whitened (one value a component), explained, identity_error.

    One row for each row whose vector is neither null nor empty nor holds null
    or non-finite entries; other columns are left out.  Repeated rows and rows
    with a null key stay, each with its own row, while copies of a vector count
    once in every statistic.  Vectors of each length have their own components.
    A component without variance (all vectors equal, or fewer than components)
    has null for its values and 0 for its share.  Scaled entries end at LARGEST;
    a deviation beyond 64 bits is null.  An empty table gives no rows.
    """
    rows = table.select(F.col(key).alias("id"), F.col(vector).alias("vector")).filter(finite(F.col("vector")) & (F.size("vector") > 0))
    widths = sorted(r["w"] for r in rows.select(F.size("vector").alias("w")).distinct().collect())
    parts = []
    for width in widths:
        same = rows.filter(F.size("vector") == width)
        parts.append(transform(same, fit(same, width, components), width))
    if not parts:
        empty = [F.lit(None).cast(kind).alias(name) for name, kind in (
            ("n", "long"), ("deviation", "long"), ("whitened", "array<double>"), ("explained", "array<double>"), ("identity_error", "double"))]
        return rows.select(F.col("id").alias(key), *empty).limit(0)
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("id", key)


def by_component(rows: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row for each row and component, numbered from 1."""
    pairs = F.arrays_zip("whitened", "explained")
    return rows.select(key, F.posexplode(pairs).alias("place", "pair"), "n", "deviation", "identity_error").select(
        key, (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", F.col("pair.whitened").alias("whitened"),
        F.col("pair.explained").alias("explained"), "identity_error")
