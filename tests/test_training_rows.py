"""Semantic keys in tables and streams, the early-stopping fold, padding and masking."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rippleframe.operators import bundles, early_stopping, masking, semantic_key


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    """Events, a third of them again an hour later with other white space and case."""
    rows = bundles.of_events(spark.read.parquet(f"{sf_dir}/events.parquet")).select("event")
    e = F.col("event")
    again = e.withField("summary", F.concat(F.upper(e["summary"]), F.lit(" \t"))).withField("event_id", F.concat(e["event_id"], F.lit("/b"))).withField("observed_at", e["observed_at"] + F.expr("INTERVAL 1 HOUR"))
    return rows.unionByName(rows.where("substring(event.event_id, 7, 9) % 3 = 0").select(again.alias("event")))


def test_each_part_of_the_key_counts(spark, sf_dir):
    rows = bundles.of_events(spark.read.parquet(f"{sf_dir}/events.parquet")).select("event").limit(1)
    e = F.col("event")
    changes = {
        "event_type": F.lit("other"), "summary": F.lit("other"), "direction": F.lit(""), "magnitude": e["magnitude"] + 1e-12, "unit": F.lit(None).cast("string"), "occurred_at": e["occurred_at"] + F.expr("INTERVAL 1 MICROSECOND"),
        "subject_ids": F.array(F.lit("a"), F.lit("b")), "object_ids": F.array(F.lit("ab")),
    }
    keys = [semantic_key.semantic_key(e), *[semantic_key.semantic_key(e.withField(k, v)) for k, v in changes.items()]]
    found = rows.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).first()
    assert len(set(found)) == len(keys) and None not in found
    same = e.withField("summary", F.concat(F.lit(" "), F.upper(e["summary"]))).withField("confidence", F.lit(0.1)).withField("subject_ids", F.concat(e["subject_ids"], e["subject_ids"]))
    assert rows.select(semantic_key.semantic_key(same)).first()[0] == found[0]


def test_stream_and_table_agree(spark, events, tmp_path):
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = semantic_key.distinct_stream(stream, delay="1000 days").select("key").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    run.awaitTermination(300)
    got = [r["key"] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    table = semantic_key.distinct_events(events).collect()
    assert sorted(got) == sorted(r["key"] for r in table) and sum(r["n"] for r in table) == events.count() > len(got)
    assert not any(r["event"]["event_id"].endswith("/b") for r in table)  # the one observed first stays


def fold(errors, min_delta, patience):
    best, at, waited, n = math.inf, None, 0, 0
    for x in errors:
        n += 1
        if x < best - min_delta:
            best, at, waited = x, n, 0
        else:
            waited += 1
            if patience and waited >= patience:
                return n, best if at else None, at, waited, True
    return n, best if at else None, at, waited, False


@pytest.mark.parametrize("patience", [0, 1, 3])
def test_early_stopping(spark, patience):
    rng = random.Random(patience)
    series = {k: [rng.choice([0.1, 0.2, 0.3, 0.3001, 0.35, 0.4, math.nan, None]) for _ in range(rng.randrange(1, 40))] for k in range(60)}
    series[99] = [math.nan, math.nan]
    series[100] = [0.4, 0.3, 0.31, 0.32]
    series[101] = [1 / (k + 1) for k in range(5000)]
    rows = [(k, i, x) for k, own in series.items() for i, x in enumerate(own)]
    rng.shuffle(rows)
    got = {r["k"]: tuple(r)[1:] for r in early_stopping.stopped(spark.createDataFrame(rows, "k long, i int, x double"), "k", ["i"], "x", 1e-4, patience).collect()}
    assert got == {k: fold([x for x in own if x is not None], 1e-4, patience) for k, own in series.items() if any(x is not None for x in own)}


def test_padding(spark):
    rows = [(k, [1, *range(20, 20 + k % 7), 2]) for k in range(50)]
    got = masking.batched(spark, spark.createDataFrame(rows, "k long, ids array<int>").repartition(5), ["k"], "ids", 8).collect()
    for r in got:
        own = rows[r["k"]][1]
        width = max(len(x) for k, x in rows if k // 8 == r["k"] // 8)
        assert r["batch"] == r["k"] // 8 and r["ids"] == own + [0] * (width - len(own)) and r["attention"] == [1] * len(own) + [0] * (width - len(own))


def test_masking(spark):
    rng = random.Random(5)
    rows = [(k, [1, 5, *[rng.randrange(12, 900) for _ in range(60)], 2]) for k in range(256)] + [(256, [1, 2])]
    batches = masking.batched(spark, spark.createDataFrame(rows, "k long, ids array<int>"), ["k"], "ids", 32)
    name = F.col("k").cast("string")
    got = masking.masked(batches, "ids", name, share=0.5).collect()
    kinds = {"mask": 0, "same": 0, "other": 0}
    for r in got:
        for x, label, m, a in zip(r["ids"], r["labels"], r["masked"], r["attention"], strict=True):
            assert label in (x, -100) and (label == -100 or (a and x not in masking.STRUCTURAL)) and (label != -100 or m == x)
            if label != -100:
                kinds["mask" if m == 4 else "same" if m == x else "other"] += 1
                assert 0 <= m <= r["top"]
    n = sum(kinds.values())
    assert abs(n / (256 * 60) - 0.5) < 0.02 and abs(kinds["mask"] / n - 0.8) < 0.02 and abs(kinds["same"] / n - 0.1) < 0.02 and abs(kinds["other"] / n - 0.1) < 0.02
    again = masking.masked(masking.batched(spark, spark.createDataFrame(rows[::-1], "k long, ids array<int>").repartition(9), ["k"], "ids", 32), "ids", name, share=0.5).collect()
    assert sorted((r["k"], r["masked"]) for r in again) == sorted((r["k"], r["masked"]) for r in got)
    few = masking.masked(batches, "ids", name, share=1e-9).collect()
    assert all(sum(x != -100 for x in r["labels"]) == (r["k"] < 256) for r in few)  # the fallback: one in each row that has any
    with pytest.raises(ValueError, match="shares"):
        masking.masked(batches, "ids", name, share=0)
