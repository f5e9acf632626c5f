"""How well predictions meet labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL = "id string, expected string, moved_later boolean"
PREDICTION = "id string, predicted string, confidence double"


def rows_of(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON lines (column ``line``); blank lines are passed over, a broken one is an error."""
    parsed = F.from_json("line", schema, {"mode": "FAILFAST"})
    return lines.where(F.trim("line") != "").select(parsed.alias("r")).select("r.*")


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Labels or predictions from files of JSON lines."""
    return rows_of(spark.read.text(path).withColumnRenamed("value", "line"), schema)


def confusion(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, missing) of each label.

    ``labels`` has id and expected, ``predictions`` id and predicted. A label
    without a prediction is a false negative of its class and no false positive.
    """
    met = labels.join(predictions, "id", "left")
    pairs = met.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    hit = F.col("expected").eqNullSafe(F.col("predicted"))
    by_expected = pairs.groupBy(F.col("expected").alias("label")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(~hit, F.col("n"))), F.lit(0)).alias("fn"), F.coalesce(F.sum(F.when(F.col("predicted").isNull(), F.col("n"))), F.lit(0)).alias("missing")
    )
    wrong = pairs.where(~hit & F.col("predicted").isNotNull()).groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("fp"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return by_expected.join(wrong, "label", "full").select("label", zero("tp"), zero("fp"), zero("fn"), zero("missing"))


def summary(labels: DataFrame, predictions: DataFrame, high_confidence: float = 0.8) -> DataFrame:
    """One row: total, correct, missing (labels without a prediction), accuracy and error_rate
    (0 without labels), and moved_percent: of what was predicted with a high confidence, the
    share that was moved later; null if nothing was.

    ``labels`` has id, expected and moved_later, ``predictions`` id, predicted and
    confidence, each id once.
    """
    met = labels.join(predictions.withColumn("_there", F.lit(True)), "id", "left")
    high = F.coalesce(F.col("confidence") >= high_confidence, F.lit(False))
    counts = met.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("predicted") == F.col("expected")).alias("correct"),
        F.count_if(F.col("_there").isNull()).alias("missing"),
        F.count_if(high).alias("high"),
        F.count_if(high & F.col("moved_later")).alias("moved"),
    )
    share = lambda n: F.coalesce(F.try_divide(n, F.col("total")), F.lit(0.0))
    return counts.select("total", "correct", "missing", share(F.col("correct")).alias("accuracy"), share(F.col("total") - F.col("correct")).alias("error_rate"), F.try_divide(100 * F.col("moved"), F.col("high")).alias("moved_percent"))


def scores(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each label; null where there is nothing to divide by."""
    p = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return matrix.select("label", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))
