"""Companies, their contexts, and scenarios."""

import random

import pytest
from pyspark.sql import functions as F

from rippleframe.operators import scenarios, splits
from rippleframe.operators.catalog import BY_NAME, FACTORS
from rippleframe.operators.records import base_records
from rippleframe.sources import companies, frozen


def test_companies_do_not_depend_on_order_or_tasks(spark):
    rows = {r.company_id: r.asDict() for r in companies.companies(spark, 60, 7).repartition(5).collect()}
    assert len(rows) == 60 and rows["synthetic_00033"] == companies.company(7, 33) and rows["synthetic_00033"] != companies.company(8, 33) | {"company_id": "x"}
    assert companies.companies(spark, 60, 7).where(F.size(companies.problems()) > 0).count() == 0
    assert companies.companies(spark, 0).count() == 0
    assert companies.derived_seed(42, 1) < 2**128 and companies.derived_seed(42, 1) != companies.derived_seed(42, 2)
    with pytest.raises(ValueError):
        companies.company(42, 0)


def test_ratio_rules():
    rng = random.Random(1)
    assert companies.Beta(2, 2, 0.3, 0.3).draw(rng, {}) == 0.3 and companies.Normal(0.4, 0.0).draw(rng, {}) == 0.4
    assert companies.Near(lambda k: 0.9, -1.0, 0.5, 0.1).draw(rng, {}) == pytest.approx(0.1)
    assert all(0.2 <= companies.Normal(0.25, 2.0, 0.2, 0.3, 1).draw(rng, {}) <= 0.3 for _ in range(50))
    with pytest.raises(ValueError):
        companies.Normal(0.9, 0.1, 0.0, 0.5).draw(rng, {})


def test_context_of_an_event_has_what_it_needs(spark):
    rows = spark.createDataFrame([("tax_change", "synthetic_00002"), ("unheard", "synthetic_00001"), ("tax_change", "nobody")], "mechanism string, company_id string")
    got = companies.context_for(rows, companies.companies(spark, 3)).collect()
    known = {(r.mechanism, r.company_id): {f for f in FACTORS if r[f] is not None} for r in got}
    assert known == {("tax_change", "synthetic_00002"): set(BY_NAME["tax_change"].factors), ("unheard", "synthetic_00001"): set(), ("tax_change", "nobody"): set()}


def test_publishing_checks_records_splits_and_companies(spark, sf_dir, tmp_path):
    base = base_records(spark, sf_dir).limit(30).withColumn("base_record_id", F.lit(None).cast("string"))
    rows = base.join(splits.assigned(base).select(F.col("family_key").alias("id"), "split"), "id").cache()
    owners = companies.companies(spark, 5)
    manifest = frozen.publish(spark, rows, f"file://{tmp_path}/d", "1", companies=owners)
    assert sum(manifest["totals"].values()) == manifest["total_examples"] == 30 and manifest["companies"]["examples"] == 5
    assert sorted(frozen.load_companies(spark, f"file://{tmp_path}/d").collect()) == sorted(owners.collect())
    with pytest.raises(frozen.FrozenDatasetError, match="economic_impact"):
        frozen.publish(spark, rows.withColumn("economic_impact", F.lit(0.9)), f"file://{tmp_path}/e", "1")
    with pytest.raises(frozen.FrozenDatasetError, match="unknown_split"):
        frozen.publish(spark, rows.withColumn("split", F.lit("nowhere")), f"file://{tmp_path}/e", "1")
    assert not (tmp_path / "e").exists()


def test_scenario_scores_by_hand(spark):
    kind = "event_type string, role string, direction string, magnitude double, exposure double, hedging double, pricing_power double, substitution double, horizon_days int"
    rows = [("input_price_change", "consumer", "increase", 20.0, 20.0, 0.5, 0.0, 0.0, 0), ("demand_change", "neutral", "increase", 20.0, 0.0, 0.0, 0.0, 0.0, 7), ("interest_rate_change", "bank", "hike", 80.0, 50.0, 0.0, 0.0, 0.0, 0)]
    got = scenarios.scored(spark.createDataFrame(rows, kind), F.lit("oil")).collect()
    assert [round(r.score, 9) for r in got] == [-0.175, 0.0, 0.8] and [r.case_type for r in got] == ["company", "company", "bank"]
    assert got[0].context_text == "role=consumer; oil_exposure=20%; hedging_ratio=50%; pricing_power=0%; substitution_ability=0%"
    assert got[1].context_text == "role=neutral; oil_exposure=0%; the company has no significant oil exposure"
    assert scenarios.grids(spark.createDataFrame(rows, kind)).count() == 28
