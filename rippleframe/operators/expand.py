"""Counterfactual families: each record with exactly one input replaced by the values of a grid, and labelled anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.functions.exprs import unit_hash
from rippleframe.operators.catalog import DIRECTIONS, FACTORS, HORIZON_GRID, MAGNITUDE_GRID, MECHANISMS, RATIO_GRID, STATES
from rippleframe.operators.labels import labelled

VARIED = [*FACTORS, "magnitude", "direction", "horizon_days"]


def _grid(field: str) -> list:
    return {"magnitude": MAGNITUDE_GRID, "direction": DIRECTIONS, "horizon_days": HORIZON_GRID}.get(field, RATIO_GRID)


def _choices(with_base: bool = False) -> Column:
    """For a record's mechanism, all (field, index, number, text, suffix of the id) by which one input is replaced. with_base:
    before them one without a field, for the record as it is."""
    kind = "array<struct<field:string,index:int,number:double,text:string,suffix:string>>"
    own = [F.struct(F.lit(None).alias("field"), F.lit(None).alias("index"), F.lit(None).alias("number"), F.lit(None).alias("text"), F.lit("").alias("suffix"))] if with_base else []

    def one(fields: list[str]) -> Column:
        made = [
            F.struct(
                F.lit(f).alias("field"), F.lit(k).alias("index"), F.lit(None if f == "direction" else float(v)).cast("double").alias("number"), F.lit(v if f == "direction" else None).cast("string").alias("text"),
                F.lit(f"__cf_{f}_{k:02}").alias("suffix"),
            )
            for f in fields
            for k, v in enumerate(_grid(f))
        ]
        return F.array(*[x.cast(kind[6:-1]) for x in [*own, *made]])

    out = F.array(*[x.cast(kind[6:-1]) for x in own]) if with_base else F.lit(None).cast(kind)
    for m in MECHANISMS:
        out = F.when(F.col("mechanism") == m.name, one([f for f in FACTORS if f in m.factors] + ["magnitude", "direction", "horizon_days"])).otherwise(out)
    return out


def _changes() -> dict[str, Column]:
    """The inputs after one is replaced by the number or text of a choice."""
    field, number = F.col("choice.field"), F.col("choice.number")
    changes = {f: F.when(field == f, number).otherwise(F.col(f)) for f in [*FACTORS, "magnitude"]}
    changes["horizon_days"] = F.when(field == "horizon_days", number.cast("int")).otherwise(F.col("horizon_days"))
    changes["direction"] = F.when(field == "direction", F.col("choice.text")).otherwise(F.col("direction"))
    return changes


def counterfactuals(base: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Variants only, with base_record_id, group_id, varied_field, variant_index. 5k + 12 of each record with k factors.

    A generator inside one stage: the family of a record stays in its task, so nothing is shuffled. Values that equal the
    base's are kept. Fields that a mechanism does not require are not varied.
    """
    rows = base.drop(*STATES, "economic_impact").withColumn("choice", F.explode(_choices()))
    if fields is not None:
        unknown = set(fields) - set(VARIED)
        if unknown:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        rows = rows.where(F.col("choice.field").isin(fields))
    field = F.col("choice.field")
    rows = rows.withColumns(_changes()).withColumns(
        {
            "base_record_id": F.col("id"),
            "group_id": F.concat(F.lit("cf:"), F.col("id"), F.lit(":"), field),
            "varied_field": field,
            "variant_index": F.col("choice.index"),
            "id": F.concat(F.col("id"), F.col("choice.suffix")),
        }
    )
    return labelled(rows.drop("choice"))


def with_families(base: DataFrame, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """All base records, and the variants of those that the hash sample takes."""
    chosen = base if fraction >= 1 else base.where(unit_hash(seed, F.concat(F.lit("counterfactual:"), F.col("id"))) < fraction)
    return base.unionByName(counterfactuals(chosen), allowMissingColumns=True)


def inputs_of_families(base: DataFrame) -> DataFrame:
    """with_families() without labels, group and field, in one pass over base: a record is one of its own choices. A filter on
    the id is applied before any other column of a variant is made."""
    rows = base.drop(*STATES, "economic_impact").withColumn("choice", F.explode(_choices(with_base=True)))
    names = {"base_record_id": F.when(F.col("choice.field").isNotNull(), F.col("id")), "id": F.concat(F.col("id"), F.col("choice.suffix"))}
    return rows.withColumns(_changes()).withColumns(names).drop("choice")
