"""Match tables derived from the TPC-H-style star schema in ``sf_dir``.

One match per ``lineitem`` row whose customer and supplier are in different
nations: the customer's nation plays at home.  ``orders`` takes its customers
first, so ``lineitem`` is shuffled once for both; that join is always a merge
join because both of its sides grow with the data.  The other joins carry no
hint: Catalyst broadcasts what its file sizes show to be small (nation, and
customer/supplier at small scale) and merges the rest, where AQE splits skewed
partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.parsing import to_number
from touchline.schema import MATCH_COLUMNS, MEASURES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _result(home: Column, away: Column) -> Column:
    return F.when(home > away, "H").when(home < away, "A").otherwise("D")


def keyed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed matches plus ``k``, the number the damage rules below are keyed on."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    home = nation.select(F.col("n_nationkey").alias("hn"), F.col("n_name").alias("HomeTeam"))
    away = nation.select(F.col("n_nationkey").alias("an"), F.col("n_name").alias("AwayTeam"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("hn"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("an"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ok"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
        F.col("l_linenumber").cast("bigint").alias("ln"), F.col("l_quantity").cast("bigint").alias("q"),
        F.col("l_shipdate").cast("date").alias("Date"),
    )
    homes = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "hn")
    rows = (
        line.join(homes.hint("merge"), F.col("ok") == F.col("o_orderkey"))
        .join(supplier, F.col("sk") == F.col("s_suppkey"))
        .where(F.col("hn") != F.col("an"))
        .join(home, "hn")
        .join(away, "an")
    )
    ok, pk, sk, ln, q, hn, an = (F.col(c) for c in ("ok", "pk", "sk", "ln", "q", "hn", "an"))
    # One layer per dependency, so that no formula is repeated inside another.
    shots = {
        "k": ok * 7 + ln * 13 + pk * 3 + sk,
        "AS": 5 + (pk * 5 + ok) % 10 + an % 4,
        "HTHG": (q + hn) % 3,
        "HTAG": (pk + q) % 3,
    }
    k = F.col("k")
    on_target = {
        "HS": 6 + k % 11 + hn % 4,
        "AST": F.least(F.col("AS"), 1 + (q + pk) % 6),
    }
    home_target = {"HST": F.least(F.col("HS"), 1 + q % 7)}
    goals = {
        "FTHG": F.col("HTHG") + F.when(F.col("HST") >= 5, 1).otherwise(0) + k % 2,
        "FTAG": F.col("HTAG") + F.when(F.col("AST") >= 5, 1).otherwise(0) + ok % 2,
    }
    rest = {
        "HTR": _result(F.col("HTHG"), F.col("HTAG")),
        "FTR": _result(F.col("FTHG"), F.col("FTAG")),
        "HC": pk % 11, "AC": (pk + sk) % 10,
        "HF": 6 + ok % 13, "AF": 6 + (ok + q) % 13,
        "HY": ok % 5, "AY": (pk + q) % 5,
        "HR": F.when(k % 13 == 0, 1).otherwise(0),
        "AR": F.when((k + q) % 11 == 0, 1).otherwise(0),
    }
    for layer in (shots, on_target, home_target, goals, rest):
        rows = rows.withColumns(layer)
    return rows.select(
        "k",
        F.concat_ws("-", ok, ln, pk, sk).alias("match_id"),
        *[F.col(c).cast("double").alias(c) if c in MEASURES else F.col(c) for c in MATCH_COLUMNS],
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed matches: ``match_id`` and the 21 match columns."""
    return keyed_matches(spark, sf_dir).drop("k")


def raw_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matches as untyped, damaged text, the way files deliver them."""
    rows = keyed_matches(spark, sf_dir)
    k = F.col("k")
    text = {name: F.col(name).cast("bigint").cast("string") for name in MEASURES}
    text |= {name: F.col(name) for name in ("HomeTeam", "AwayTeam", "HTR", "FTR")}
    text["Date"] = (
        F.when(k % 97 == 0, "n/a")
        .when(F.year("Date") % 2 == 1, F.date_format("Date", "dd/MM/yyyy"))
        .otherwise(F.date_format("Date", "yyyy-MM-dd"))
    )
    text["AwayTeam"] = F.when(k % 41 != 0, F.col("AwayTeam"))
    text["HS"] = F.when(k % 23 == 0, None).when(k % 29 == 0, "x").otherwise(text["HS"])
    text["FTR"] = F.when(k % 31 != 0, F.col("FTR"))
    text["HTR"] = F.when(k % 37 == 0, "NA").otherwise(F.col("HTR"))
    return rows.select("match_id", *[text[name].alias(name) for name in MATCH_COLUMNS])


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction requests: matches with gaps, bad values and blank or equal teams."""
    rows = keyed_matches(spark, sf_dir)
    k = F.col("k")
    text = {name: F.col(name).cast("bigint").cast("string") for name in MEASURES}
    text["HS"] = F.when(k % 23 == 0, None).when(k % 29 == 0, "x").otherwise(text["HS"])
    text["AS"] = F.when(k % 19 == 0, "61").otherwise(text["AS"])
    text["HC"] = F.when(k % 43 == 0, "-3").otherwise(text["HC"])
    text["HTAG"] = F.when(k % 47 == 0, "11").otherwise(text["HTAG"])
    text["AR"] = F.when(k % 53 == 0, "").otherwise(text["AR"])
    return rows.select(
        "match_id",
        F.when(k % 97 != 0, F.col("Date")).alias("Date"),
        F.when(k % 59 == 0, " ").otherwise(F.col("HomeTeam")).alias("HomeTeam"),
        F.when(k % 41 == 0, None).when(k % 61 == 0, F.col("HomeTeam")).otherwise(F.col("AwayTeam")).alias("AwayTeam"),
        F.when(k % 37 == 0, "X").when(k % 31 == 0, None).otherwise(F.col("HTR")).alias("HTR"),
        *[text[name].alias(name) for name in MEASURES if name not in ("FTHG", "FTAG")],
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def typed_requests(rows: DataFrame) -> DataFrame:
    """Requests with numbers parsed; what is not a number becomes null."""
    texts = [c for c in MEASURES if c in rows.columns]
    return rows.withColumns({c: to_number(F.col(c)) for c in texts})
