"""Evaluation of predictions, each in one aggregation over the scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.schema import RESULT_CODES


def accuracy(scored: DataFrame, label: str = "FTR", prediction: str = "prediction") -> DataFrame:
    hit = F.when(F.col(label) == F.col(prediction), 1.0).otherwise(0.0)
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.avg(hit).alias("accuracy"))


def confusion_matrix(scored: DataFrame, label: str = "FTR", prediction: str = "prediction", classes: tuple[str, ...] = RESULT_CODES) -> DataFrame:
    """One row per true class, one column per predicted class; absent cells are 0."""
    cells = scored.groupBy(F.col(label).alias("label")).agg(
        *[F.count_if(F.col(prediction) == c).alias(c) for c in classes]
    )
    return cells.orderBy("label")


def classification_report(scored: DataFrame, label: str = "FTR", prediction: str = "prediction", classes: tuple[str, ...] = RESULT_CODES) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and both averages.

    A ratio over nothing is 0.  The counts come from one global aggregate.
    """
    truth, guess = F.col(label), F.col(prediction)
    counters = [F.count(F.lit(1)).cast("double").alias("total")]
    for c in classes:
        counters += [
            F.count_if((truth == c) & (guess == c)).cast("double").alias(f"hit_{c}"),
            F.count_if(guess == c).cast("double").alias(f"said_{c}"),
            F.count_if(truth == c).cast("double").alias(f"true_{c}"),
        ]
    ratios = {}
    for c in classes:
        ratios[f"p_{c}"] = _ratio(F.col(f"hit_{c}"), F.col(f"said_{c}"))
        ratios[f"r_{c}"] = _ratio(F.col(f"hit_{c}"), F.col(f"true_{c}"))
    scores = {
        f"f_{c}": _ratio(F.col(f"p_{c}") * F.col(f"r_{c}") * 2, F.col(f"p_{c}") + F.col(f"r_{c}")) for c in classes
    }
    one = scored.agg(*counters).withColumns(ratios).withColumns(scores)

    def plus(parts: list[Column]) -> Column:
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        return total

    def row(name: str, values: list[Column], support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            *[F.round(v, 9).alias(n) for v, n in zip(values, ("precision", "recall", "f1"))],
            support.cast("bigint").alias("support"),
        )

    rows = [row(c, [F.col(f"{m}_{c}") for m in "prf"], F.col(f"true_{c}")) for c in classes]
    right = _ratio(plus([F.col(f"hit_{c}") for c in classes]), F.col("total"))
    rows.append(row("accuracy", [right, right, right], F.col("total")))
    plain = [plus([F.col(f"{m}_{c}") for c in classes]) / len(classes) for m in "prf"]
    rows.append(row("macro avg", plain, F.col("total")))
    weighted = [_ratio(plus([F.col(f"{m}_{c}") * F.col(f"true_{c}") for c in classes]), F.col("total")) for m in "prf"]
    rows.append(row("weighted avg", weighted, F.col("total")))
    return one.select(F.inline(F.array(*rows)))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def regression_metrics(scored: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """Mean absolute error and R squared from five sums."""
    rows = scored.select(truth.cast("double").alias("y"), guess.cast("double").alias("g"))
    error = F.col("y") - F.col("g")
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("yy"),
        F.sum(F.abs(error)).alias("absolute"), F.sum(error * error).alias("squared"),
    )
    spread = F.col("yy") - F.try_divide(F.col("y") * F.col("y"), F.col("n"))
    return sums.select(
        F.col("n").alias("rows"), F.try_divide("absolute", "n").alias("mae"),
        (1 - F.try_divide(F.col("squared"), spread)).alias("r2"),
    )
