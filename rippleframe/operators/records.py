"""Base records from the table events, and the projections that build them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.functions.exprs import ordinal_id, unit_hash
from rippleframe.operators.catalog import DIRECTIONS, FACTORS, HORIZONS, MECHANISMS, catalogue
from rippleframe.operators.labels import labelled

SEED, GENERATOR = 42, "events-adapter-v1"


def visible_factor(name: str, value: Column) -> Column:
    """A factor is known only where the mechanism requires it; unknown is null, not 0."""
    needs = [m.name for m in MECHANISMS if name in m.factors]
    return F.when(F.col("mechanism").isin(needs), value)


def spread(spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
    """The rows in as many partitions as there are cores to work on, at least."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, key)


def base_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled base record per event: flat columns, with the 21 factors as columns of their own.

    The catalogue has 15 rows and is broadcast. Only the four columns read are shuffled: a file is read by as few tasks as
    it has row groups, and all that follows, up to 60 variants a record, would be made by those alone.
    """
    events = spread(spark, spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value"), "event_id")
    rows = events.withColumn("ordinal", F.pmod("event_id", F.lit(len(MECHANISMS))).cast("int")).join(F.broadcast(catalogue(spark)), "ordinal")
    rows = rows.withColumn("chosen", F.element_at("classes", (F.pmod(F.expr("event_id div 30"), F.size("classes")) + 1).cast("int")))
    pooled = F.element_at("chosen.pool", (F.pmod("event_id", F.size("chosen.pool")) + 1).cast("int"))
    concept = F.col("chosen.concept").isNotNull() & (F.col("event_id") % 10 == 0)
    rows = rows.select(
        ordinal_id("case_", 6, F.col("event_id") + 1).alias("id"),
        "mechanism",
        F.col("chosen.subject_class").alias("subject_class"),
        F.when(concept, F.col("chosen.concept")).otherwise(pooled).alias("subject"),
        F.element_at(F.array(*map(F.lit, DIRECTIONS)), (F.pmod(F.expr("event_id div 15"), F.lit(2)) + 1).cast("int")).alias("direction"),
        F.least(F.lit(1.0), F.floor(F.col("value") + 0.5) / 100.0).alias("magnitude"),
        ordinal_id("synthetic_", 5, F.col("user_id")).alias("entity_id"),
        F.element_at(F.array(*map(F.lit, HORIZONS)), (F.pmod("event_id", F.lit(len(HORIZONS))) + 1).cast("int")).alias("horizon_days"),
        F.lit(0.9).alias("confidence"),
        F.lit("synthetic").alias("source"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
        (F.col("ts").cast("timestamp") + F.make_dt_interval(hours=F.pmod("event_id", F.lit(48)).cast("int"))).alias("observed_at"),
        *[visible_factor(f, unit_hash(SEED, F.concat(F.lit("ctx:"), F.col("user_id").cast("string"), F.lit(f":{f}")))).alias(f) for f in FACTORS],
    )
    return labelled(rows)


def shaped(rows: DataFrame) -> DataFrame:
    """The nested record of flat rows."""
    from rippleframe.operators.catalog import STATES

    return rows.select(
        "id",
        F.struct("mechanism", "subject_class", "subject", "direction", "magnitude").alias("event"),
        F.struct("entity_id").alias("target"),
        F.struct(*FACTORS).alias("context"),
        "horizon_days",
        F.struct(*STATES).alias("state_delta"),
        "economic_impact",
        "confidence",
        F.struct("source", F.lit(GENERATOR).alias("generator_version"), F.lit(SEED).cast("long").alias("seed")).alias("metadata"),
    )
