"""What the corpus operators share: the shared scratch folder, tables written there, and Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.sources.scratch import shared_dir as shared_dir

#: Rows that a Python worker turns into objects at a time; bounds its memory whatever the batch size is.
SLICE_ROWS = 256


def written(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """The frame as a table in the shared folder: cuts lineage and outlives lost executors."""
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder that no returned frame reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


_held: dict = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps between batches and tasks, one thing at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, keeps: tuple | None = None) -> Iterator[pa.RecordBatch]:
    """Small batches. Workers outlive stages, so whatever they hold but `keeps` goes first."""
    if keeps not in _held:
        _held.clear()
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def by_slice(work: Callable[[pa.RecordBatch], pa.RecordBatch], keeps: tuple | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one that maps a small batch; keeps: the key of what work() has from held()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, keeps=keeps):
            yield work(part)

    return run


#: Rows of one key from which its partner is broadcast, and how many such keys there are at most.
HOT_ROWS, HOT_KEYS = 20_000, 50_000


def split_join(spark: SparkSession, many: DataFrame, one: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Inner or left join of a frame that is cheap to read again with one that has a row per key, where some keys may have a
    large part of the rows.

    Keys of over max(HOT_ROWS, rows / HOT_KEYS) rows, less than HOT_KEYS by that, have their partners broadcast; all others
    meet in a shuffle, where no key has more rows than that."""
    counts = many.groupBy(*on).agg(F.count(F.lit(1)).alias("rows_of_key"))
    most = max(HOT_ROWS, (many.count() // HOT_KEYS) + 1)
    hot = counts.where(F.col("rows_of_key") > most).select(*on)
    if hot.isEmpty():
        return many.join(one, on, how)
    hot = F.broadcast(hot)
    found = many.join(hot, on, "left_semi").join(F.broadcast(one.join(hot, on, "left_semi")), on, how)
    return found.unionByName(many.join(hot, on, "left_anti").join(one, on, how))
