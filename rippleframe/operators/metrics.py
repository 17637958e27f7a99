"""Score metrics, by slice and by out-of-distribution category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.functions.exprs import score_direction, unit_hash
from rippleframe.operators.splits import is_combination_ood, is_concept_ood, is_hard_ood, is_parameter_ood

NEUTRAL, STRONG, SMALL_SLICE = 0.05, 0.5, 20


def with_prediction(records: DataFrame, seed: int = 42) -> DataFrame:
    """A stand-in prediction: the target and hash noise of 0.2 at most."""
    noise = (unit_hash(seed, F.concat(F.lit("pred:"), F.col("id"))) - 0.5) * 0.4
    return records.withColumn("target", F.col("economic_impact")).withColumn("prediction", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("economic_impact") + noise)))


def metrics() -> list[Column]:
    """Aggregates over target and prediction; strong_mae is null where no target is strong."""
    error, strong = F.abs(F.col("target") - F.col("prediction")), F.abs(F.col("target")) >= STRONG
    hit = score_direction(F.col("target"), NEUTRAL) == score_direction(F.col("prediction"), NEUTRAL)
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(error).alias("mae"),
        F.avg(hit.cast("int")).alias("sign_accuracy"),
        F.count_if(strong).alias("strong_n"),
        F.avg(F.when(strong, error)).alias("strong_mae"),
    ]


def horizon_bucket() -> Column:
    return F.when(F.col("horizon_days") <= 30, "<=30d").when(F.col("horizon_days") <= 90, "31-90d").otherwise(">90d")


def impact_bucket() -> Column:
    a = F.abs(F.col("target"))
    return F.when(a <= NEUTRAL, "neutral").when(a < STRONG, "moderate").otherwise("strong")


DIMENSIONS = ["mechanism", "direction", "horizon", "impact", "source", "counterfactual"]


def sliced(scored: DataFrame) -> DataFrame:
    """dimension, value, metrics, small: all dimensions in one pass."""
    rows = scored.select(
        "mechanism", "direction", horizon_bucket().alias("horizon"), impact_bucket().alias("impact"), "source",
        F.when(F.col("base_record_id").isNull(), "no").otherwise("yes").alias("counterfactual"), "target", "prediction",
    )
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS])
    rows = rows.select(F.explode(pairs).alias("s"), "target", "prediction").select("s.*", "target", "prediction")
    return rows.groupBy("dimension", "value").agg(*metrics()).withColumn("small", F.col("n") < SMALL_SLICE)


def selected() -> Column:
    """Whether a record of a test split shows what the split is for."""
    split = F.col("split")
    return (
        F.when(split == "test_parameter_ood", is_parameter_ood())
        .when(split == "test_combination_ood", is_combination_ood())
        .when(split == "test_hard_ood", is_hard_ood())
        .when(split == "test_concept_ood", is_concept_ood())
        .otherwise(F.lit(True))
    )


def ood_filter(scored: DataFrame) -> DataFrame:
    """split, n, selected, held_out_only: of the out-of-distribution splits."""
    rows = scored.where(F.col("split").endswith("_ood"))
    found = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(selected()).alias("selected"))
    return found.withColumn("held_out_only", F.col("n") - F.col("selected"))


def ood_table(scored: DataFrame) -> DataFrame:
    """Metrics of each out-of-distribution split and of all, over selected records."""
    rows = scored.where(F.col("split").endswith("_ood")).where(selected())
    return rows.rollup("split").agg(*metrics()).withColumn("split", F.coalesce("split", F.lit("all")))
