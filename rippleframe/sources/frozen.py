"""Frozen datasets: strict JSON lines with checksums, written to a staging folder and published by one rename."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from rippleframe.functions.exprs import let
from rippleframe.operators import splits, verify
from rippleframe.operators.catalog import FACTORS, SPLITS, STATES
from rippleframe.operators.records import shaped
from rippleframe.sources import companies as company_rules

#: Fixed value of the data contract.
SCHEMA_VERSION = "1.0"


def _struct(kind, names) -> StructType:
    return StructType([StructField(n, kind) for n in names])


RECORD = StructType(
    [
        StructField("id", StringType()),
        StructField("event", StructType([*_struct(StringType(), ["mechanism", "subject_class", "subject", "direction"]), StructField("magnitude", DoubleType()), *_struct(StringType(), ["summary", "unit"])])),
        StructField("target", _struct(StringType(), ["entity_id"])),
        StructField("context", _struct(DoubleType(), FACTORS)),
        StructField("horizon_days", IntegerType()),
        StructField("state_delta", _struct(DoubleType(), STATES)),
        StructField("economic_impact", DoubleType()),
        StructField("confidence", DoubleType()),
        StructField("metadata", StructType([*_struct(StringType(), ["source", "generator_version"]), StructField("seed", LongType())])),
    ]
)
OPTIONAL = {"event.summary", "event.unit", *[f"context.{f}" for f in FACTORS]}


class FrozenDatasetError(ValueError):
    pass


def _objects(schema: StructType, source: Column, prefix: str = "") -> list[tuple[StructType, str, Column]]:
    """(schema, prefix, keys) of a JSON object in text and of all objects in it."""
    out = [(schema, prefix, F.json_object_keys(source))]
    for f in schema:
        if isinstance(f.dataType, StructType):
            out += _objects(f.dataType, F.get_json_object(source, f"$.{f.name}"), f"{prefix}{f.name}.")
    return out


def _problems(schema: StructType, prefix: str, keys: Column) -> list[Column]:
    """Unknown and missing keys of one object."""
    names = [f.name for f in schema]
    needed = [n for n in names if prefix + n not in OPTIONAL]
    return [
        F.when(keys.isNull(), F.lit(f"{prefix or 'record'}: not an object")),
        F.when(F.size(F.array_except(keys, F.array(*map(F.lit, names)))) > 0, F.lit(f"{prefix or 'record'}: unknown keys")),
        F.when(F.size(F.array_except(F.array(*map(F.lit, needed)), keys)) > 0, F.lit(f"{prefix or 'record'}: missing keys")) if needed else F.lit(None).cast("string"),
    ]


def _complete(schema: StructType, record: Column, prefix: str = "") -> Column:
    """Whether a record has a value for every key that it needs."""
    out = F.lit(True)
    for f in schema:
        if prefix + f.name not in OPTIONAL:
            out = out & record[f.name].isNotNull()
        if isinstance(f.dataType, StructType):
            out = out & _complete(f.dataType, record[f.name], f"{prefix}{f.name}.")
    return out


def strict(lines: DataFrame, schema: StructType = RECORD) -> DataFrame:
    """lines (value, others) to those, record and problems. Rejects blank lines, what is no JSON (duplicate keys, NaN, text after the
    object), unknown and missing keys, and values of another type. Row by row.

    A line that is the record written again, with all keys that are needed, breaks none of these and is parsed once; any other
    is held against each. Both come out of a generator, so that a filter on them stays above and parses nothing again."""
    text = F.col("value")
    parsed = F.try_parse_json(text)
    record = F.col("_read.record")
    kept = F.col("_read.kept")
    same_type = F.size(F.array_except(F.json_object_keys(text), F.json_object_keys(kept))) == 0
    objects = _objects(schema, text)

    def found(keys: Column) -> Column:
        out = [
            F.when(F.trim(text) == "", F.lit("blank line")),
            F.when(parsed.isNull() | ~text.rlike(r"(?s)^\s*\{.*\}\s*$"), F.lit("not a JSON object")),
            *[x for k, (own, prefix, _) in enumerate(objects) for x in _problems(own, prefix, keys[k])],
            F.when(~F.coalesce(same_type, F.lit(False)), F.lit("wrong type")),
        ]
        return F.filter(F.array(*out), lambda x: x.isNotNull())

    once = let(F.from_json(text, schema), lambda r: F.struct(r.alias("record"), F.to_json(r).alias("kept")))
    rows = lines.withColumn("_read", F.explode_outer(F.array(once)))
    whole = (text == kept) & _complete(schema, record)
    problems = F.when(whole, F.array().cast("array<string>")).otherwise(let(F.array(*[k for _, _, k in objects]), found))
    rows = rows.withColumn("problems", F.explode_outer(F.array(problems)))
    return rows.select(*lines.columns, record.alias("record"), "problems")


def read_jsonl(spark: SparkSession, path: str, schema: StructType = RECORD) -> DataFrame:
    """The records of a file or folder; a line with a problem fails the job with that problem and its text."""
    rows = strict(spark.read.text(path), schema)
    text = F.concat_ws("; ", "problems")
    good = F.when(F.size("problems") == 0, True).otherwise(F.raise_error(F.concat(text, F.lit(" in "), F.substring("value", 1, 200))).cast("boolean"))
    return rows.where(good).select("record.*")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target, jvm.org.apache.hadoop.fs.Path


def require_sound(records: DataFrame) -> None:
    """An error unless flat records with a split break no rule of records and none of splits."""
    broken = verify.verified(records).where("not valid").select("id", "issues").first()
    if broken:
        raise FrozenDatasetError(f"record {broken['id']}: {broken['issues']}")
    leak = splits.violations(records).first()
    if leak:
        raise FrozenDatasetError(f"{leak['kind']}: {leak['key']}")


def publish(spark: SparkSession, records: DataFrame, path: str, version: str, seed: int = 42, companies: DataFrame | None = None) -> dict:
    """freeze() of flat records (as labelled, with a split and base_record_id) after require_sound()."""
    require_sound(records)
    return freeze(spark, shaped(records).join(records.select("id", "split"), "id"), path, version, seed, companies)


def freeze(spark: SparkSession, records: DataFrame, path: str, version: str, seed: int = 42, companies: DataFrame | None = None) -> dict:
    """Publishes records (with their split) as one folder of sorted JSON lines per split, and a manifest.

    Refuses a target that exists. Everything is written beside it and renamed at the end; a failure leaves nothing. The
    manifest has for each split the examples and a digest over the sorted digests of its lines, computed by Spark.
    """
    fs, target, hadoop_path = _fs(spark, path)
    if fs.exists(target):
        raise FrozenDatasetError(f"{path} exists")
    staging = f"{path}.staging"
    stage = hadoop_path(staging)
    fs.delete(stage, True)
    try:
        lines = records.select("split", F.to_json(F.struct(*[F.col(f.name) for f in RECORD])).alias("value"), "id")
        lines.repartitionByRange("split", "id").sortWithinPartitions("split", "id").select("split", "value").write.partitionBy("split").text(staging)
        manifest = {"dataset_version": version, "schema_version": SCHEMA_VERSION, "seed": seed, "splits": _summary(spark, staging)}
        counts = {name: found["examples"] for name, found in manifest["splits"].items()}
        manifest["totals"] = {"train": counts["train"], "validation": counts["validation"], "test": sum(n for k, n in counts.items() if k.startswith("test_"))}
        manifest["total_examples"] = sum(counts.values())
        if companies is not None:
            lines = companies.select("company_id", F.to_json(F.struct(*companies.columns)).alias("value"))
            lines.repartitionByRange("company_id").sortWithinPartitions("company_id").select("value").write.text(f"{staging}/companies")
            manifest["companies"] = _digest(spark.read.text(f"{staging}/companies"))
        out = fs.create(hadoop_path(f"{staging}/manifest.json"))
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if not fs.rename(stage, target):
            raise FrozenDatasetError(f"{path} can't be published")
    except Exception:
        fs.delete(stage, True)
        raise
    return manifest


def _words() -> list[Column]:
    """A digest of many lines: how many there are, and sums of the four 64-bit words of their SHA-256. It needs no order."""
    part = [F.sum(F.conv(F.substring(F.sha2("value", 256), 16 * k + 1, 16), 16, 10).cast("decimal(38,0)")).alias(f"w{k}") for k in range(4)]
    return [F.count(F.lit(1)).alias("n"), *part]


def _told(row) -> dict:
    words = [] if row is None else [str(row[f"w{k}"]) for k in range(4)]
    return {"examples": 0 if row is None else row["n"], "sha256": hashlib.sha256(":".join(words).encode()).hexdigest()}


def _digest(lines: DataFrame) -> dict:
    return _told(lines.agg(*_words()).first())


def _summary(spark: SparkSession, path: str) -> dict:
    """Examples and digest by split."""
    rows = spark.read.schema("value string, split string").option("basePath", path).text(path + "/split=*")
    found = {r["split"]: r for r in rows.groupBy("split").agg(*_words()).collect()}
    return {s: _told(found.get(s)) for s in SPLITS}


def load_companies(spark: SparkSession, path: str) -> DataFrame:
    """The companies of a frozen dataset; the first one that breaks a rule is an error."""
    schema = StructType([StructField(c, StringType() if c == "company_id" else DoubleType()) for c in company_rules.COLUMNS])
    rows = strict(spark.read.text(f"{path}/companies"), schema)
    bad = rows.where(F.size("problems") > 0).first()
    if bad:
        raise FrozenDatasetError(f"companies: {bad['problems']}")
    rows = rows.select("record.*")
    bad = rows.withColumn("p", company_rules.problems()).where(F.size("p") > 0).first()
    if bad:
        raise FrozenDatasetError(f"company {bad['company_id']}: {bad['p']}")
    return rows


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The records with their split, and the manifest. Counts and digests must agree with it."""
    text = "".join(r["value"] for r in spark.read.text(f"{path}/manifest.json").collect())
    manifest = json.loads(text)
    if manifest.get("schema_version") != SCHEMA_VERSION or set(manifest.get("splits", {})) != set(SPLITS):
        raise FrozenDatasetError("the manifest is of another schema")
    if _summary(spark, path) != manifest["splits"]:
        raise FrozenDatasetError("files differ from the manifest")
    if "companies" in manifest and _digest(spark.read.text(f"{path}/companies")) != manifest["companies"]:
        raise FrozenDatasetError("companies differ from the manifest")
    rows = spark.read.schema("value string, split string").option("basePath", path).text(path + "/split=*")
    bad = strict(rows.select("value")).where(F.size("problems") > 0).first()
    if bad:
        raise FrozenDatasetError(f"{bad['problems']}")
    return rows.select(F.from_json("value", RECORD).alias("r"), "split").select("r.*", "split"), manifest
