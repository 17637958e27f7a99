"""Strict reading, publishing and tampering of frozen datasets."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rippleframe.operators.records import base_records, shaped
from rippleframe.sources import frozen


@pytest.fixture(scope="module")
def records(spark, sf_dir):
    rows = shaped(base_records(spark, sf_dir).limit(40))
    event = F.struct("event.*", F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("unit"))
    return rows.withColumn("event", event).withColumn("split", F.lit("train"))


def test_round_trip_and_tampering(spark, records, tmp_path):
    path = f"file://{tmp_path}/frozen"
    manifest = frozen.freeze(spark, records, path, "v1")
    assert manifest["total_examples"] == 40
    got, again = frozen.load(spark, path)
    assert again == manifest and got.count() == 40
    with pytest.raises(frozen.FrozenDatasetError, match="exists"):
        frozen.freeze(spark, records, path, "v1")
    file = next(Path(f"{tmp_path}/frozen/split=train").glob("part-*"))
    file.write_text(file.read_text().replace("increase", "decrease"))
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(frozen.FrozenDatasetError, match="differ"):
        frozen.load(spark, path)


def test_strictness(spark, records):
    good = json.loads(records.select(F.to_json(F.struct(*[f.name for f in frozen.RECORD]))).first()[0])
    bad = [dict(good, extra=1), {k: v for k, v in good.items() if k != "id"}, dict(good, confidence="high"), dict(good, target={"entity_id": "e", "x": 1})]
    text = json.dumps(good)
    lines = [text, *map(json.dumps, bad), "", text + " x", text.replace('"confidence": 0.9', '"confidence": NaN'), text[:-1] + ', "id": "twice"}']
    found = [len(r.problems) > 0 for r in frozen.strict(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert found == [False] + [True] * (len(lines) - 1)


def test_lines_are_parsed_once(spark, records):
    """A filter on the problems stays above what finds them, and lines that are not written as they would be again are sound, too."""
    text = records.select(F.to_json(F.struct(*[f.name for f in frozen.RECORD])).alias("value"))
    spaced = text.select(F.regexp_replace("value", '"event":', ' "event" : ').alias("value"))
    assert frozen.strict(text.unionByName(spaced)).where(F.size("problems") > 0).isEmpty()
    plan = frozen.strict(text).where(F.size("problems") > 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_parse_json") <= 1 and plan.count("Generate explode") >= 2, plan
