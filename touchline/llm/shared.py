"""What the operators of this package share: row passing, folds, blobs, sampling."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ArrowMap = Callable[[pa.Array], list]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this library's modules to the executors, once an application; they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="touchline-")) / "touchline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent))
    context.addPyFile(str(archive))


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def append_columns(df: DataFrame, text: str, fields: list[tuple[str, str]], start: Callable[[], ArrowMap],
                   keep_text: bool = True) -> DataFrame:
    """Add columns computed batch by batch from one text column.

    ``start`` runs once in every task and returns a function from the column's
    Arrow array to one Arrow array per field.  All other columns pass through
    unchanged; an existing column with the name of a new one is replaced.  Where
    the text stays, it is all that goes to Python, and only the new columns come
    back; the rows wait in the JVM.
    """
    base = df.drop(*[name for name, _ in fields])
    if keep_text:
        return _beside_rows(base, text, fields, start)
    kept = [f for f in base.schema.fields if f.name != text]
    added = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in fields)).fields
    names = [f.name for f in kept] + [name for name, _ in fields]
    kept_names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            if batch.num_rows:
                new = compute(batch.column(text))
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept_names] + new, names=names)

    return base.mapInArrow(run, T.StructType(kept + added))


def _beside_rows(base: DataFrame, text: str, fields: list[tuple[str, str]], start: Callable[[], ArrowMap]) -> DataFrame:
    names = [name for name, _ in fields]

    @F.arrow_udf("struct<" + ",".join(f"{name}:{kind}" for name, kind in fields) + ">")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compute = start()
        for column in columns:
            yield pa.StructArray.from_arrays(compute(column), names=names)
        pa.default_memory_pool().release_unused()

    # Called non-deterministic, a filter on a result is not moved before it, where it would run a second time.
    rows = base.withColumn("__new", run.asNondeterministic()(F.col(f"`{text}`")))
    return rows.select(*[f"`{c}`" for c in base.columns], *[f"__new.{name}" for name in names])


#: Texts that go to Python at once in a chain of stages, whose workers share an executor with the shuffles of all of them.
FEW_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(FEW_ROWS))


def packed(docs: DataFrame, text: str) -> DataFrame:
    """The text and all other columns as one, out of the way of columns that an operator adds."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return docs.select(F.struct(F.lit(0).alias("__"), *others).alias("__row"), text)


def unpacked(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """``columns`` as they were before ``packed``, and no others."""
    return rows.select(*[F.col(f"`{c}`") if c == text else F.col(f"__row.`{c}`").alias(c) for c in columns])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = np.atleast_1d(np.asarray(x, dtype=np.uint64))  # arrays wrap around silently
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blob_rows(keys: np.ndarray, packed: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(key, bytes of its items) from items with small integer keys, in one stable sort."""
    order = np.argsort(keys, kind="stable")
    keys, packed = keys[order], packed[order]
    cuts = np.flatnonzero(np.diff(keys)) + 1
    for part_keys, part in zip(np.split(keys, cuts), np.split(packed, cuts)):
        if len(part_keys):
            yield int(part_keys[0]), part.tobytes()
