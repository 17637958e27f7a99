"""Canonical JSON lines, files with their SHA-256, and a manifest that is reconciled with what is there.

A record's line has its keys in order at every level, no blanks, no escapes but those JSON needs, the shortest digits of its
numbers, and no key for what is null. Files hold ranges of the order, so a split's files one after the other, by name, are
the split's canonical bytes, however many files there are. Each file is hashed by the task that reads it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, StringType, StructType

from rippleframe.functions.exprs import let, python_float

#: Records of a file; bounds what a task hashes at a time.
PER_FILE = 100_000
_NAMED = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


class ManifestError(ValueError):
    pass


def json_string(x: Column) -> Column:
    """A text in quotes; escapes only quotes, backslashes and control characters."""
    out = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    # Control characters are rare: only texts with one, character by character.
    named = F.create_map(*[F.lit(t) for i in range(32) for t in (chr(i), _NAMED.get(chr(i), f"\\u{i:04x}"))])
    slow = F.array_join(F.transform(F.split(out, ""), lambda c: F.coalesce(F.try_element_at(named, c), c)), "")
    return F.concat(F.lit('"'), F.when(x.rlike(r"[\x00-\x1f]"), slow).when(x.rlike(r'["\\]'), out).otherwise(x), F.lit('"'))


def _number(x: Column) -> Column:
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(x.isNotNull(), F.when(bad, F.raise_error(F.lit("a number is not finite")).cast("string")).otherwise(python_float(x)))


def canonical_json(x: Column, kind: DataType, number: Callable[[Column], Column] = _number) -> Column:
    """Canonical JSON of a value; null where it is. A number that isn't finite is an error."""
    if isinstance(kind, StructType):
        parts = []
        for f in sorted(kind, key=lambda f: f.name):
            made = canonical_json(x[f.name], f.dataType, number)
            parts.append(F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), made))
        return F.when(x.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    if isinstance(kind, ArrayType):
        inner = F.transform(x, lambda v: F.coalesce(canonical_json(v, kind.elementType), F.lit("null")))
        return F.when(x.isNotNull(), F.concat(F.lit("["), F.array_join(inner, ","), F.lit("]")))
    if isinstance(kind, StringType):
        return json_string(x)
    if isinstance(kind, DoubleType | FloatType):
        return number(x.cast("double"))
    return F.lower(x.cast("string")) if isinstance(kind, BooleanType) else x.cast("string")


def canonical_lines(records: DataFrame, columns: list[str] | None = None) -> Column:
    """Canonical JSON of rows of a frame, of some or all of its columns. Numbers outside of arrays are written by one
    expression over an array of them, so that plans stay small."""
    names = columns or records.columns
    whole, kind = F.struct(*names), StructType([records.schema[n] for n in names])
    numbers: list[Column] = []

    def gathered(x: Column) -> Column:
        numbers.append(x)
        return F.lit("")

    canonical_json(whole, kind, gathered)
    if not numbers:
        return canonical_json(whole, kind)

    def line(texts: Column) -> Column:
        place = iter(range(len(numbers)))
        return canonical_json(whole, kind, lambda _: texts[next(place)])

    return let(F.transform(F.array(*numbers), _number), line)


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def found(spark: SparkSession, path: str) -> DataFrame:
    """split, file, bytes, examples, sha256: the data files that are there."""
    content = F.col("content")
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(f"{path}/data")
    return rows.select(
        F.regexp_extract("path", r"/split=([^/]+)/[^/]+$", 1).alias("split"), F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"),
        F.regexp_count(content.cast("string"), F.lit("\n")).cast("long").alias("examples"), F.sha2(content, 256).alias("sha256"),
    )


LISTED = "split string, file string, bytes long, examples long, sha256 string"


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The files that the manifest lists."""
    return spark.read.schema(LISTED).json(f"{path}/files")


def publish(spark: SparkSession, lines: DataFrame, path: str, order: str = "id", per_file: int = PER_FILE, **about: str | int) -> dict:
    """Writes split, <order> and line as one folder of sorted files for each split, lists the files, and writes the header.

    Refuses a path that exists. Everything is staged beside it and renamed at the end. The header has examples by split,
    train, validation, test (all test_ splits) and all of them, the number of files and the digest of their list.
    """
    fs, target = _path(spark, path)
    if fs.exists(target):
        raise ManifestError(f"{path} exists")
    staging = f"{path}.staging"
    stage = _path(spark, staging)[1]
    fs.delete(stage, True)
    try:
        dealt = lines.repartitionByRange("split", order).sortWithinPartitions("split", order).select("split", "line")
        dealt.write.option("maxRecordsPerFile", per_file).partitionBy("split").text(f"{staging}/data")
        found(spark, staging).write.json(f"{staging}/files")
        told = listed(spark, staging).groupBy("split").agg(F.sum("examples").alias("n"), F.count(F.lit(1)).alias("files")).collect()
        splits = {r["split"]: r["n"] for r in told}
        header = about | {
            "splits": dict(sorted(splits.items())), "train_examples": splits.get("train", 0), "validation_examples": splits.get("validation", 0),
            "test_examples": sum(n for s, n in splits.items() if s.startswith("test_")), "total_examples": sum(splits.values()), "files": sum(r["files"] for r in told),
        }
        out = fs.create(_path(spark, f"{staging}/manifest.json")[1])
        out.write(bytearray((json.dumps(header, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n").encode()))
        out.close()
        if not fs.rename(stage, target):
            raise ManifestError(f"{path} can't be published")
    except Exception:
        fs.delete(stage, True)
        raise
    return header


def reconcile(spark: SparkSession, path: str) -> DataFrame:
    """The disagreements of a published manifest with the files that are there."""
    return disagreements(listed(spark, path), found(spark, path))


def disagreements(told: DataFrame, there: DataFrame) -> DataFrame:
    """split, file, problem, expected, present: a row for each file that is missing or extra, that has other examples than
    listed (short, long), or as many, but altered."""
    a, b = told.alias("a"), there.alias("b")
    both = a.join(b, (F.col("a.split") == F.col("b.split")) & (F.col("a.file") == F.col("b.file")), "full")
    problem = (
        F.when(F.col("b.file").isNull(), "missing").when(F.col("a.file").isNull(), "extra").when(F.col("b.examples") < F.col("a.examples"), "short")
        .when(F.col("b.examples") > F.col("a.examples"), "long").when(F.col("a.sha256") != F.col("b.sha256"), "altered")
    )
    rows = both.select(
        F.coalesce("a.split", "b.split").alias("split"), F.coalesce("a.file", "b.file").alias("file"), problem.alias("problem"),
        F.coalesce("a.examples", F.lit(0)).alias("expected"), F.coalesce("b.examples", F.lit(0)).alias("present"),
    )
    return rows.where("problem is not null")


def load(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, dict]:
    """The records, with their split, and the header. Files must be as listed, and lists add up to the header."""
    header = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/manifest.json").collect()))
    wrong = reconcile(spark, path).first()
    if wrong:
        raise ManifestError(f"{wrong['split']}/{wrong['file']}: {wrong['problem']}, {wrong['present']} of {wrong['expected']} examples")
    told = {r["split"]: r["n"] for r in listed(spark, path).groupBy("split").agg(F.sum("examples").alias("n")).collect()}
    if told != header["splits"] or sum(told.values()) != header["total_examples"]:
        raise ManifestError("the header differs from the list of files")
    rows = spark.read.schema("value string, split string").option("basePath", f"{path}/data").text(f"{path}/data/split=*")
    return rows.select(F.from_json("value", schema).alias("r"), "split").select("r.*", "split"), header
