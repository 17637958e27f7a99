"""Violations of records of which a few have moved, by their families' counts and by every record."""

import pytest
from pyspark.sql import functions as F

from rippleframe.functions.exprs import unit_hash
from rippleframe.operators import splits
from rippleframe.operators.expand import counterfactuals, inputs_of_families, with_families
from rippleframe.operators.records import base_records
from rippleframe.plans.catalog_of_queries import QUERIES


def test_records_are_made_once(spark, sf_dir):
    """Not once for each rule and copy, with labels: one generator makes ids, the other what is asked of those that count."""
    plan = QUERIES["split_tamper_violations"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2 and "Union" not in plan and "exp(" not in plan


def test_inputs_of_families(spark, sf_dir):
    base = base_records(spark, sf_dir).limit(30).localCheckpoint()
    rows, names = with_families(base), ["id", "base_record_id", "entity_id", "mechanism", "subject", "direction", "magnitude", "horizon_days", *splits.OOD_PAIRS[0], *splits.OOD_PAIRS[2]]
    assert sorted(map(str, rows.select(names).collect())) == sorted(map(str, inputs_of_families(base).select(names).collect()))
    assert counterfactuals(base).where("id <> base_record_id || '__cf_' || varied_field || '_' || lpad(variant_index, 2, '0')").count() == 0


@pytest.mark.parametrize("case", ["as split", "all train", "unknown and null", "id twice", "id of a variant"])
def test_violations_after(spark, sf_dir, case):
    base = base_records(spark, sf_dir).limit(60)
    if case == "id twice":
        base = base.union(base.limit(3))
    if case == "id of a variant":
        base = base.union(base.limit(1).withColumn("id", F.concat("id", F.lit("__cf_magnitude_00"))))
    base = base.localCheckpoint()
    bases = splits.split_bases(base, flags=True).localCheckpoint()
    if case == "all train":
        bases = bases.withColumn("split", F.lit("train"))
    if case == "unknown and null":
        bases = bases.withColumn("split", F.when(F.col("id") < "case_000010", "nowhere").when(F.col("id") > "case_000020", F.col("split")))
    draw, split, family = unit_hash(5, F.col("id")), F.col("split"), F.substring_index("id", "__cf_", 1)
    one, other, gone = (r.id for r in base.orderBy("id").limit(3).collect())
    touched = (draw < 0.05) | family.isin(one, other, gone)
    after = F.when(family == one, F.array(F.lit("validation"))).when(family == gone, F.array().cast("array<string>"))
    after = after.when((draw >= 0.01) & (draw < 0.02), F.array(split, split)).when((draw >= 0.02) & (draw < 0.025), F.array(split, F.lit("test_entity_ood")))
    after = after.when(draw < 0.01, F.array(F.lit("train"))).when(draw < 0.03, F.array(F.lit("elsewhere"))).when(draw < 0.035, F.array(F.lit("test_entity_ood"))).otherwise(F.array(split))
    every = with_families(bases).withColumn("split", F.explode(F.when(touched, after).otherwise(F.array(split))))
    want = sorted(map(tuple, splits.violations(every).collect()))
    assert sorted(map(tuple, splits.violations_after(base, touched, after, bases=bases).collect())) == want
    assert {"family_leak", "entity_leak", "duplicate_id", "unknown_split"} <= {k for k, _, _ in want}
