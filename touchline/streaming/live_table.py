"""A league table that grows with a stream, and fixtures scored with it as they arrive.

Rows with a result are absorbed, rows without one are fixtures.  The state is the
sums per (home, away) pair, one version for each micro-batch: version b is version
b - 1 and the results of batch b, and the fixtures of batch b are scored with it.
Versions and scores lie in folders named by batch and are never changed by later
ones, so a batch that is repeated after a failure reads the same state and writes
the same files again in place of its own.  A version is as large as there are
pairs of teams, however many matches they have played.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from touchline.operators import league
from touchline.operators.scoring import score_fixtures
from touchline.runtime import Lookup


class LiveTable:
    """The versions below one folder of the shared store."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, batch: int) -> str:
        return f"{self.root}/pairs/batch={batch}"

    def pairs(self, batch: int) -> DataFrame:
        """Pair sums after a batch."""
        return self.spark.read.parquet(self._folder(batch))

    def stats(self, batch: int) -> DataFrame:
        """The league table after a batch."""
        return league.stats_of_pairs(self.pairs(batch))

    def absorb(self, results: DataFrame, batch: int) -> None:
        """Writes the version of a batch; a second time, the same."""
        sums = league.pair_sums(results)
        if batch > 0:
            sums = league.added_pairs(self.pairs(batch - 1), sums)
        sums.write.mode("overwrite").parquet(self._folder(batch))

    def scores(self) -> DataFrame:
        """All scored fixtures, with the ``batch`` whose table they were scored with."""
        return self.spark.read.parquet(f"{self.root}/scores")

    def take(self, rows: DataFrame, batch: int, key: str = "match_id") -> None:
        """Absorbs the results of a batch, then scores its fixtures."""
        rows = rows.persist()  # both sides read it; lost parts come from the source again
        self.absorb(rows.where(F.col("FTR").isNotNull()), batch)
        stats = Lookup(self.stats(batch))
        scored = score_fixtures(rows.where(F.col("FTR").isNull()), stats, key)
        scored.write.mode("overwrite").parquet(f"{self.root}/scores/batch={batch}")
        rows.unpersist()


def start_live_table(matches: DataFrame, root: str, checkpoint: str, key: str = "match_id") -> StreamingQuery:
    """Takes what is there now, batch by batch, and stops; started again from its checkpoint, it goes on."""
    def take(rows: DataFrame, batch: int) -> None:
        LiveTable(rows.sparkSession, root).take(rows, batch, key)

    return matches.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
