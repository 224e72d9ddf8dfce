"""Scoring of predictions and the reports over it."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from optrace import constants as K
from optrace.functions import cleaning

PREVIEW_CHARS = 100


def score(
    predictions: DataFrame, expected: DataFrame | None = None, threshold: float = K.CORRECT_ABOVE,
    strip_token: bool = True, error: str | None = None,
) -> DataFrame:
    """Adds predicted (cleaned), similarity, correct and exact.

    predictions carries expected itself, or is joined to expected on example_id. A row whose
    error column is set counts as wrong, with similarity 0 and the error as its text."""
    rows = predictions if expected is None else expected.join(predictions, "example_id")
    failed = F.col(error).isNotNull() if error else F.lit(False)
    scored = cleaning.with_clean_prediction(rows)
    if error:
        message = F.concat(F.lit("Error: "), F.col(error))
        scored = scored.withColumn("predicted", F.when(failed, message).otherwise(F.col("predicted")))
    scored = scored.withColumn("_target", cleaning.expected_for_scoring(F.col("expected"), strip_token))
    scored = cleaning.with_similarity(scored, "predicted", "_target")
    return scored.withColumns({
        "similarity": F.when(failed, 0.0).otherwise(F.col("similarity")),
        "exact": ~failed & cleaning.exact_match(F.col("predicted"), F.col("_target")),
    }).withColumn("correct", F.col("similarity") > threshold).drop("_target")


def _share(flag: str) -> Column:
    return F.coalesce(F.avg(F.col(flag).cast("double")), F.lit(0.0))


def summarize(scored: DataFrame) -> DataFrame:
    """One row: total, correct, accuracy, exact accuracy and mean similarity; zeros for none."""
    return scored.agg(
        F.count(F.lit(1)).alias("total_examples"),
        F.count_if("correct").alias("correct_predictions"),
        _share("correct").alias("accuracy"),
        _share("exact").alias("exact_accuracy"),
        F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("average_similarity"),
    )


def summarize_by(scored: DataFrame, column: str, with_total: bool = False) -> DataFrame:
    """Totals per value of column; with_total adds the overall row, its value NULL."""
    groups = scored.rollup(column) if with_total else scored.groupBy(column)
    return groups.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("correct").alias("correct"),
        _share("correct").alias("accuracy"),
        F.avg("similarity").alias("avg_similarity"),
    )


def failures(scored: DataFrame, n: int = 3, order: str = "example_id") -> DataFrame:
    """The first n incorrect rows, with previews, and how many there are in all.

    Runs one job: every task hands on its first n rows, and all incorrect ones are counted as they pass."""
    seen = Observation()
    rows = scored.observe(seen, F.count_if(~F.col("correct")).alias("failure_count")).filter(~F.col("correct")).select(
        order, F.left("expected", F.lit(PREVIEW_CHARS)).alias("expected_preview"),
        F.left("predicted", F.lit(PREVIEW_CHARS)).alias("predicted_preview"), "similarity",
    )
    first = rows.orderBy(F.col(order).asc_nulls_last()).limit(max(n, 1)).collect()  # n rows
    found = scored.sparkSession.createDataFrame(first[: max(n, 0)], rows.schema)
    return found.withColumn("failure_count", F.lit(seen.get["failure_count"] or 0).cast("bigint")).orderBy(F.col(order).asc_nulls_last())


def limit_examples(df: DataFrame, n: int | None, order: str = "example_id") -> DataFrame:
    """First n examples by id; all of them for None."""
    return df if n is None else df.orderBy(order).limit(n)
