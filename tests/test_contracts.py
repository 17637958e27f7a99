"""Exact sums, ordered digests, bundles, canonical files, manifests and line numbers."""

import hashlib
import json
import math
import random
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rippleframe.functions import exprs
from rippleframe.operators import bundles, exact_sums, ordered_digest
from rippleframe.operators.records import base_records, shaped
from rippleframe.sources import canonical, frozen, lines


def doubles(n, seed):
    rng = random.Random(seed)
    found = [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(n)]
    found = [x for x in found if math.isfinite(x) and abs(x) < 1e300]
    return found + [rng.uniform(-1, 1) * 10 ** rng.randrange(-20, 20) for _ in range(n)] + [5e-324, -5e-324, 2.0**-1022, 1e300, -1e300, 0.0, -0.0, 1.0, 2.0**53, -(2.0**53) + 1]


@pytest.mark.parametrize("partitions", [1, 64])
def test_exact_sums_equal_fsum_to_the_bit(spark, partitions):
    rows = [("wild", x) for x in doubles(1500, 1)] + [("even", k / 10) for k in range(2000)] + [("gone", 1e16), ("gone", 1.0), ("gone", -1e16), ("none", None), ("up", math.inf), ("up", 1.0), ("both", math.inf), ("both", -math.inf), ("nan", math.nan)]
    random.Random(partitions).shuffle(rows)
    table = spark.createDataFrame(rows, "k string, x double").repartition(partitions)
    got = {r["k"]: r for r in exact_sums.exact_sums(table, ["k"], x=F.col("x"), twice=F.col("x") * 2).collect()}
    for k in ("wild", "even", "gone"):
        own = [x for key, x in rows if key == k]
        assert got[k]["x"] == math.fsum(own) and got[k]["n_x"] == len(own)
        assert got[k]["twice"] == math.fsum(2 * x for x in own)
    assert got["none"]["x"] is None and got["none"]["n_x"] == 0
    assert got["up"]["x"] == math.inf and math.isnan(got["both"]["x"]) and math.isnan(got["nan"]["x"])


def tree(items, fanout):
    level = [hashlib.sha256(len(p.encode()).to_bytes(8, "big") + p.encode() + struct.pack("!f", s)).hexdigest() for p, s in items]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[k : k + fanout]).encode()).hexdigest() for k in range(0, len(level), fanout)]
    return level[0] if level else hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 300])
def test_ordered_digest(spark, n):
    items = [(f"té {k % 5}", (k % 11) / 11) for k in range(n)]
    table = spark.createDataFrame([(k, p, s) for k, (p, s) in enumerate(items)], "k long, p string, s double")
    for rows in (table.repartition(1), table.repartition(17).orderBy(F.rand(3))):
        found = ordered_digest.ordered_digest(spark, rows, ["k"], F.col("p"), F.col("s"), fanout=8).first()
        assert (found["n"], found["root"]) == (n, tree(items, 8))
    if n == 300:
        moved = table.withColumn("k", F.when(F.col("k") == 3, 4).when(F.col("k") == 4, 3).otherwise(F.col("k")))
        assert ordered_digest.ordered_digest(spark, moved, ["k"], F.col("p"), F.col("s"), fanout=8).first()["root"] != tree(items, 8)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8, 9, 27, 28, 100])
def test_ordered_digest_of_three_levels(spark, n):
    """The last level takes all nodes below it, however many; the SQL of documents_stream_digest with a fanout of 3."""
    table = spark.createDataFrame([(k, f"té {k % 5}", (k % 11) / 11) for k in range(n)], "k long, p string, s double").repartition(5)
    level = [hashlib.sha256(len(p.encode()).to_bytes(8, "big") + p.encode() + struct.pack("!f", s)).hexdigest() for p, s in ((f"té {k % 5}", (k % 11) / 11) for k in range(n))]
    for fanout in (3, 3, max(n, 1)):
        level = [hashlib.sha256("".join(level[k : k + fanout]).encode()).hexdigest() for k in range(0, len(level), fanout)]
        if len(level) == 1:
            break
    found = ordered_digest.ordered_digest(spark, table, ["k"], F.col("p"), F.col("s"), fanout=3, levels=3).first()
    assert (found["n"], found["root"]) == (n, level[0] if level else None)


def test_number_formats(spark):
    rng = random.Random(2)
    xs = [0.0, -0.0, 1e16, 1e15, 123456789.0, 1e22, 1e-4, 1e-5, 0.00012345678, 999999.5, 1e6, 1234567.0, 2e23, 1.7976931348623157e308, 1 / 3]
    xs += [rng.uniform(-1, 1) * 10 ** rng.randrange(-8, 16) for _ in range(800)] + [round(rng.random(), 4) for _ in range(300)]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", exprs.general(F.col("x")).alias("g"), exprs.python_float(F.col("x")).alias("s")).collect():
        assert (r.g, r.s) == (f"{r.x:g}", str(r.x))


def some_bundles(spark, sf_dir):
    return bundles.of_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def test_bundles_as_of_their_cutoffs(spark, sf_dir):
    raw = {r["bundle_id"]: r for r in some_bundles(spark, sf_dir).collect()}
    got = {r["bundle_id"]: r for r in bundles.as_of(some_bundles(spark, sf_dir)).collect()}
    for key, b in raw.items():
        assert (key in got) == (b["event"]["observed_at"] <= b["cutoff"])
        if key not in got:
            continue
        at = min(b["event"]["occurred_at"], b["cutoff"])
        seen = lambda x, b=b: [p["source_id"] for p in sorted(x["provenance"], key=lambda p: (p["observed_at"], p["source_id"])) if p["observed_at"] <= b["cutoff"]]
        facts = {f["fact_id"]: seen(f) for f in b["facts"] if f["observed_at"] <= b["cutoff"] and f["valid_from"] <= at and (f["valid_to"] is None or at <= f["valid_to"])}
        events = {e["event_id"]: seen(e) for e in b["historical_events"] if e["observed_at"] <= b["cutoff"] and e["occurred_at"] < b["event"]["occurred_at"]}
        assert {f["fact_id"]: [p["source_id"] for p in f["provenance"]] for f in got[key]["facts"]} == facts
        assert {e["event_id"]: [p["source_id"] for p in e["provenance"]] for e in got[key]["historical_events"]} == events
        assert [p["source_id"] for p in got[key]["event"]["provenance"]] == seen(b["event"])
    assert bundles.violations(bundles.as_of(some_bundles(spark, sf_dir))).count() == 0


def test_text_of_bundles_depends_on_no_order(spark, sf_dir):
    rows = bundles.as_of(some_bundles(spark, sf_dir)).where("size(facts) > 1 and size(historical_events) > 1")
    turned = rows.withColumns({"facts": F.reverse("facts"), "historical_events": F.reverse("historical_events"), "event": F.col("event").withField("object_ids", F.reverse("event.object_ids"))})
    assert sorted(map(tuple, bundles.serialized(rows).collect())) == sorted(map(tuple, bundles.serialized(turned).collect())) and rows.count() > 100
    none = bundles.serialized(rows, "none").first()["text"]
    assert "summary=[NO_SUMMARY]" in none and "[HISTORICAL_EVENT]" in none
    with pytest.raises(Exception, match="horizon does not match"):
        bundles.serialized(rows, horizon=F.lit("999d")).collect()


def test_bundles_of_records_have_the_records_text(spark, sf_dir):
    from rippleframe.operators import serialize

    rows = base_records(spark, sf_dir).limit(50).withColumns({"hedging": F.round("hedging", 2)})
    assert sorted(map(tuple, bundles.serialized(bundles.of_records(rows)).collect())) == sorted(map(tuple, serialize.serialized(rows).collect()))
    assert bundles.violations(bundles.of_records(rows)).count() == 0


def test_rules_of_bundles_that_no_query_plants(spark, sf_dir):
    rows = bundles.as_of(some_bundles(spark, sf_dir)).where("size(facts) > 0").limit(3)
    broken = rows.withColumn("facts", F.transform("facts", lambda f: f.withField("valid_to", f["valid_from"] - F.expr("INTERVAL 1 DAY"))))
    assert {"validity_reversed", "fact_not_valid"} == {r["code"] for r in bundles.violations(broken).collect()}
    nothing = spark.createDataFrame([], bundles.SCHEMA)
    assert bundles.violations(nothing).count() == 0 and bundles.as_of(nothing).count() == 0
    blank = rows.withColumns({"facts": F.lit(None).cast(f"array<{bundles.FACT}>"), "historical_events": F.lit(None).cast(f"array<{bundles.EVENT}>")})
    assert bundles.as_of(blank).select(F.size("facts")).first()[0] == 0


def test_canonical_json_equals_the_standard_writer(spark):
    odd = "".join(map(chr, range(0x20))) + '"\\/\x7fé漢🙂 \\u000B'
    rows = spark.createDataFrame([("b", odd, 0.1 + 0.2, 3, True, [1.5, 1e-7], ("y", None)), ("a", "plain", None, None, False, [], ("z", -0.0)), ("c", "say \"x\"", 1e22, 1 << 40, None, None, None)], "id string, t string, x double, n long, f boolean, v array<double>, s struct<b: string, a: double>")
    for r in rows.select("*", canonical.canonical_lines(rows).alias("line")).collect():
        own = {k: v for k, v in r.asDict(recursive=True).items() if k != "line" and v is not None}
        if "s" in own:
            own["s"] = {k: v for k, v in own["s"].items() if v is not None}
        assert r["line"] == json.dumps(own, ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":"))
    with pytest.raises(Exception, match="not finite"):
        rows.withColumn("x", F.lit(math.nan)).select(canonical.canonical_lines(rows, ["x"])).collect()


@pytest.fixture(scope="module")
def records(spark, sf_dir):
    return shaped(base_records(spark, sf_dir)).limit(300).cache()


def test_published_files_and_their_faults(spark, records, tmp_path):
    path = f"file://{tmp_path}/set"
    split = F.element_at(F.array(*map(F.lit, ["train", "validation", "test_iid", "test_hard_ood"])), (F.pmod(F.substring("id", 6, 9).cast("int"), F.lit(4)) + 1).cast("int"))
    rows = records.select("id", split.alias("split"), canonical.canonical_lines(records).alias("line"))
    header = canonical.publish(spark, rows, path, per_file=20, seed=42)
    got, again = canonical.load(spark, path, records.schema)
    assert again == header and header["total_examples"] == 300 and header["files"] > 12
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in rows.select("id").collect())
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r["id"]):
        want[r["split"]] = want.get(r["split"], "") + r["line"] + "\n"
    files = {s: sorted(Path(f"{tmp_path}/set/data/split={s}").glob("part-*")) for s in want}
    assert {s: "".join(f.read_text() for f in own) for s, own in files.items()} == want  # by name, a split's files are its bytes
    listed = {(r["split"], r["file"]): (r["sha256"], r["examples"]) for r in canonical.listed(spark, path).collect()}
    assert listed == {(s, f.name): (hashlib.sha256(f.read_bytes()).hexdigest(), f.read_text().count("\n")) for s, own in files.items() for f in own}
    with pytest.raises(canonical.ManifestError, match="exists"):
        canonical.publish(spark, rows, path)

    def changed(file, text):
        for crc in file.parent.glob(f".{file.name}.crc"):
            crc.unlink()
        if text is None:
            file.unlink()
        else:
            file.write_text(text)

    text = files["validation"][0].read_text()
    changed(files["train"][0], None)
    changed(files["validation"][0], "".join(text.splitlines(True)[:-3]))
    changed(files["test_iid"][0], files["test_iid"][0].read_text().replace("increase", "decrease").replace("synthetic", "Synthetic"))
    changed(files["test_iid"][1], files["test_iid"][1].read_text() + "{}\n")
    changed(files["test_hard_ood"][0].with_name("part-99999-x.txt"), "{}\n{}\n")
    found = {(r["split"], r["file"]): (r["problem"], r["present"] - r["expected"]) for r in canonical.reconcile(spark, path).collect()}
    assert found == {
        ("train", files["train"][0].name): ("missing", -20), ("validation", files["validation"][0].name): ("short", -3), ("test_iid", files["test_iid"][0].name): ("altered", 0),
        ("test_iid", files["test_iid"][1].name): ("long", 1), ("test_hard_ood", "part-99999-x.txt"): ("extra", 2),
    }
    with pytest.raises(canonical.ManifestError, match="of"):
        canonical.load(spark, path, records.schema)


def test_lines_keep_their_numbers_over_blocks(spark, records, tmp_path):
    text = [r[0] for r in records.select(F.to_json(F.struct(*records.columns))).collect()]
    bad = {("a.jsonl", 1): "", ("a.jsonl", 170): text[0][:-1], ("b.jsonl", 300): text[5].replace('"horizon_days"', '"horizon"'), ("c.jsonl", 2): text[1].replace('"confidence":0.9', '"confidence":1.5')}
    for name in ("a.jsonl", "b.jsonl", "c.jsonl"):
        own = [bad.get((name, k + 1), line) for k, line in enumerate(text)]
        Path(tmp_path / name).write_text("\n".join(own) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        numbered = lines.numbered(spark, str(tmp_path))
        assert numbered.rdd.getNumPartitions() > 10
        for r in numbered.collect():
            name = r["file"].rsplit("/", 1)[1]
            assert r["value"] == bad.get((name, r["line"]), text[r["line"] - 1])
        found = {(r["file"].rsplit("/", 1)[1], r["line"]): r["problems"] for r in lines.bad_lines(spark, str(tmp_path)).collect()}
        assert set(found) == set(bad) and found["c.jsonl", 2] == ["number_out_of_bounds"]
        with pytest.raises(frozen.FrozenDatasetError, match=r"a\.jsonl:1: blank line"):
            lines.require_lines(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
