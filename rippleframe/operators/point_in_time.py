"""Bi-temporal views: what was known at a time, what was valid then, and what came before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def observed(hours: int = 48) -> Column:
    return F.col("ts").cast("timestamp") + F.make_dt_interval(hours=F.pmod("event_id", F.lit(hours)).cast("int"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, subject, predicate, value, valid_from, valid_to, observed_at: a fact holds until the next of its kind."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    kind = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return events.select(
        "event_id", F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), "value", F.col("ts").cast("timestamp").alias("valid_from"),
        F.lead(F.col("ts").cast("timestamp")).over(kind).alias("valid_to"), observed().alias("observed_at"),
    )


def visible(rows: DataFrame, cutoff: Column) -> DataFrame:
    return rows.where(F.col("observed_at") <= cutoff)


def valid_at(at: Column) -> Column:
    return F.coalesce(F.col("valid_from") <= at, F.lit(True)) & F.coalesce(at <= F.col("valid_to"), F.lit(True))


def latest_before(events: DataFrame, states: DataFrame, keys: list[str], at: str, known: str, columns: list[str]) -> DataFrame:
    """As-of join: each event with the newest state of its keys that was known before; null where there is none.

    Events and states are merged and sorted once by key and time, and the newest state is carried forward: no pair of an
    event and an older state is ever made, so a key with many rows on both sides costs one sort.
    """
    left = events.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*[c for c in events.columns]).alias("_row"))
    right = states.select(*keys, F.col(known).alias("_at"), F.lit(0).alias("_kind"), F.struct(*columns).alias("_state"))
    merged = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("_at", "_kind", F.col("_state").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    found = merged.withColumn("_found", F.last("_state", ignorenulls=True).over(order)).where("_kind = 1")
    return found.select("_row.*", *[F.col(f"_found.{c}").alias(f"latest_{c}") for c in columns])


def history(events: DataFrame, key: str, at: str, id_column: str) -> DataFrame:
    """How many events of the same key came strictly before, and the last of them, by one sorted pass."""
    earlier = Window.partitionBy(key).orderBy(F.unix_micros(at)).rangeBetween(Window.unboundedPreceding, -1)
    newest = F.max(F.struct(at, id_column)).over(earlier)
    return events.select(key, id_column, at, F.count(F.lit(1)).over(earlier).alias("n_before"), newest[id_column].alias("previous"))
