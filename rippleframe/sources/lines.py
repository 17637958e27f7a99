"""Line numbers of text files that many tasks read, and bad lines of record files by file and number.

Tasks read blocks of files. Lines are counted by block; a running sum over a file's blocks gives the lines before each; a
line's number is that plus its place in its block. The blocks' table has a row a block, not a line, and only lines that are
reported are joined to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rippleframe.operators import verify
from rippleframe.sources import frozen


def _read(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def _numbered(rows: DataFrame, all_rows: DataFrame) -> DataFrame:
    """Some of the rows of _read() with their line numbers. Both come from one listing of files, so blocks are the same."""
    blocks = all_rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(blocks, ["file", "block"]).withColumn("line", F.col("before") + F.col("at") - F.col("first") + 1).drop("block", "at", "first", "before")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """value, file, line (from 1) of a file, folder or pattern."""
    rows = _read(spark, path)
    return _numbered(rows, rows)


def _flat(schema: StructType) -> list[Column]:
    out = []
    for f in schema:
        out += [F.col(f"record.{f.name}.{g.name}").alias(g.name) for g in f.dataType] if isinstance(f.dataType, StructType) else [F.col(f"record.{f.name}").alias(f.name)]
    return out


def bad_lines(spark: SparkSession, path: str, schema: StructType = frozen.RECORD) -> DataFrame:
    """file, line, problems of every line of record files that is no sound record: how it breaks the format or, if it
    doesn't, the codes of the rules that the record breaks."""
    rows = _read(spark, path)
    read = frozen.strict(rows, schema)
    # One reading: a broken line has a record of nulls, which is not held against the rules.
    flat = read.select("file", "block", "at", "problems", *_flat(schema))
    codes = F.array_sort(F.array_distinct(F.transform("issues", lambda i: i["code"])))
    checked = verify.verified(flat, F.size("problems") == 0).where("size(problems) > 0 OR size(issues) > 0")
    found = checked.select("file", "block", "at", F.when(F.size("problems") > 0, F.col("problems")).otherwise(codes).alias("problems"))
    return _numbered(found, rows).select("file", "line", "problems")


def require_lines(spark: SparkSession, path: str, schema: StructType = frozen.RECORD) -> None:
    """An error that names the first bad line by file and number, if there is one."""
    bad = bad_lines(spark, path, schema).orderBy("file", "line").first()
    if bad:
        raise frozen.FrozenDatasetError(f"{bad['file']}:{bad['line']}: {'; '.join(bad['problems'])}")
