"""Shared-folder scratch space and size-checked lookups.

Small tables (one row per team, class or message pattern) are joined to very
large ones all over this package.  ``lookup_join`` broadcasts such a table only
after counting it; past the bound it spreads the join over salted keys instead,
so a team that owns a third of all matches never lands in one task.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup row is under 200 bytes, so the bound keeps a broadcast below ~20 MB.
MAX_BROADCAST_ROWS = 100_000
LOOKUP_SALTS = 32


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the checkpoint folder that was set on it.

    Only where neither is set and everything runs on this machine, a fresh local
    folder takes its place; on a cluster executors could not see such a one.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="touchline-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written_table(df: DataFrame, label: str, file_rows: int = 0) -> DataFrame:
    """Write a large intermediate once and read it back.

    The files outlive any executor, and their rows keep one order, which makes
    repeated passes (model training) see the same input after a lost task.  If
    ``file_rows`` bounds the rows of a file, files are read in the order of their
    tasks, not in that of a folder listing: equal tables are dealt alike.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    reader = df.sparkSession.read.schema(df.schema)
    if not file_rows:
        return reader.parquet(path)
    names = sorted(name.rsplit("/", 1)[1] for name in reader.parquet(path).inputFiles())
    return reader.parquet(*[f"{path}/{name}" for name in names] or [path])


def fits(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether ``df`` (already checkpointed) has at most ``max_rows`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


class Lookup:
    """A small keyed table whose size was checked once and may be joined often."""

    def __init__(self, table: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, salts: int = LOOKUP_SALTS):
        self.table = checkpointed(table)
        self.small = fits(self.table, max_rows)
        self.salts = salts

    def join(self, facts: DataFrame, on: dict[str, str], columns: dict[str, str], how: str = "left") -> DataFrame:
        """Add ``columns`` (lookup name -> new name) where ``on`` (fact name -> lookup name) match."""
        picked = self.table.select(
            *[F.col(key).alias(f"__{key}") for key in on.values()],
            *[F.col(name).alias(new) for name, new in columns.items()],
        )
        match = [F.col(fact) == F.col(f"__{key}") for fact, key in on.items()]
        drop = [f"__{key}" for key in on.values()]
        if self.small:
            return facts.join(F.broadcast(picked), _all(match), how).drop(*drop)
        salted = facts.withColumn("__salt", F.pmod(F.xxhash64(*[_hashable(facts, c) for c in facts.columns]), self.salts))
        every_salt = F.sequence(F.lit(0).cast("bigint"), F.lit(self.salts - 1).cast("bigint"))
        spread = picked.withColumn("__lsalt", F.explode(every_salt))
        match.append(F.col("__salt") == F.col("__lsalt"))
        return salted.join(spread, _all(match), how).drop("__salt", "__lsalt", *drop)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _hashable(df: DataFrame, name: str) -> Column:
    # xxhash64 refuses maps; their text form spreads rows just as well.
    column = F.col(f"`{name}`")
    return F.to_json(column) if df.schema[name].dataType.typeName() == "map" else column
