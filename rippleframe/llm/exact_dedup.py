"""Exact deduplication as a stateful stream: RocksDB keyed state, without expiry, holds digest, stable id and locator.

A digest log (id, SHA-256, locator: file and row) is written in one pass over the texts. A Structured Streaming aggregation
reads it in micro-batches and keeps, for each digest, the row that stays, where its content lies, and how many rows
have it; contents() fetches texts by locator from the files named alone. The state lives in RocksDB and in the query's checkpoint, so a later run over new files goes on from there.
Then every hit is checked on its full bytes; rows whose digests meet but whose bytes differ are grouped by their bytes.

All work on executors is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.llm.common import shared_dir, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Beyond the broadcast, the content of one digest is compared in so many tasks, for a text that very many rows have.
SALTS = 16
#: Digests of repeated texts that are broadcast at most (about 40 MB); more are joined by a shuffle.
BROADCAST_ROWS = 250_000
#: Digests for each state store, and stores at least. A store costs some 4 MB of disk, however little it holds.
STORE_ROWS, LEAST_STORES = 250_000, 12
#: Input of one micro-batch of digests.
BYTES_PER_TRIGGER = str(4 << 30)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def locator_of(docs: DataFrame) -> Column:
    """file and row of each row of a frame read from Parquet files; null for what other frames don't have."""
    for file, row in (("_metadata.file_path", "_metadata.row_index"), ("_metadata.file_path", None)):
        found = F.struct(F.col(file).alias("file"), (F.col(row) if row else F.lit(None).cast("long")).alias("row"))
        try:
            docs.select(found.alias("locator")).schema  # noqa: B018
            return found
        except AnalysisException:
            continue
    return F.struct(F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("row"))


def contents(spark: SparkSession, located: DataFrame, text: str = "text") -> DataFrame:
    """located (locator, ...) with `content`, the text that lies there. Only the files that locators name are read.

    The list of files comes to the driver. A null locator, as of a frame that isn't read from Parquet files, has no content.
    """
    files = [r[0] for r in located.where("locator.file is not null and locator.row is not null").select("locator.file").distinct().collect()]
    if not files:
        return located.withColumn("content", F.lit(None).cast("string"))
    rows = spark.read.parquet(*files).select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("_at"), F.coalesce(text, F.lit("")).alias("content"))
    return located.join(rows, located["locator"] == rows["_at"], "left").drop("_at")


def digest_state(digests: DataFrame) -> DataFrame:
    """Streaming (or batch) aggregation from (id, digest, seq, locator) to the keeper of each digest.

    Without a watermark, so no state ever expires. The largest id stays; of repeated rows with one id, the largest seq.
    Partial aggregation before the shuffle leaves a hot digest one row for each task.
    """
    return digests.groupBy("digest").agg(
        F.max(F.struct("id", "seq", "locator")).alias("keeper"), F.count(F.lit(1)).alias("group_size")
    )


def run_stream(spark: SparkSession, log: str, schema, checkpoint: str, stores: int = LEAST_STORES) -> DataFrame:
    """Feeds what is new in the log folder to the state, and returns the whole state as a table.

    Called again with the same checkpoint it reads only files that have come since. stores: of a new checkpoint.
    """
    conf = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
        "spark.sql.streaming.internal.stateStore.partitions": str(stores),
    }
    with _settings(spark, conf):
        source = spark.readStream.schema(schema).option("maxBytesPerTrigger", BYTES_PER_TRIGGER).parquet(log)
        query = (
            digest_state(source)
            .writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    state = spark.read.format("statestore").option("path", checkpoint).load()
    # The state's value has the buffers of the two aggregates, in the order of digest_state().
    return state.select("key.digest", F.col("value.max").alias("keeper"), F.col("value.count").alias("group_size"))


def decisions(
    spark: SparkSession,
    docs: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest, keep_locator (of the row that stays; null for a text
    that no other row has).

    A null text counts as empty; so all null and empty texts are one group. A null id is smaller than any other.
    Rows that repeat both id and text count each, and one of them is kept. Other columns, whatever their names, are
    neither read nor returned. An empty table gives an empty result.
    """
    scratch = shared_dir(spark)
    body = F.coalesce(docs[text], F.lit(""))
    log = docs.select(
        docs[id_column].alias("id"),
        digest(body).alias("digest"),
        F.monotonically_increasing_id().alias("seq"),
        locator_of(docs).alias("locator"),
    )
    log = written(spark, log, f"{scratch}/log")
    n_rows = log.count()
    if not n_rows:
        return log.select(
            "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", F.col("locator").alias("keep_locator")
        )
    state = run_stream(spark, f"{scratch}/log", log.schema, f"{scratch}/state", max(LEAST_STORES, -(-n_rows // STORE_ROWS)))
    groups = written(
        spark,
        state.where("group_size > 1").select(
            "digest", F.col("keeper.id").alias("keep_id"), F.col("keeper.seq").alias("keep_seq"), "group_size", F.col("keeper.locator").alias("keep_locator")
        ),
        f"{scratch}/groups",
    )

    def outcome(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
        alone = F.col("group_size").isNull()
        return rows.join(found, on, "left").select(
            "id",
            F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (alone | (F.col("seq") == F.col("keep_seq"))).alias("kept"),
            "digest",
            "keep_locator",
        )

    differ = written(spark, _differing(docs, body, digest, groups), f"{scratch}/differ")
    if differ.isEmpty():
        return outcome(log.select("id", "digest", "seq"), groups, ["digest"])
    # Digests that meet although the bytes differ: their rows are grouped by the bytes themselves.
    same = log.join(differ, "digest", "left_anti").select("id", "digest", "seq")
    rows = docs.select(docs[id_column].alias("id"), digest(body).alias("digest"), body.alias("bytes"), locator_of(docs).alias("locator")).join(differ, "digest", "left_semi")
    rows = written(spark, rows.select("*", F.monotonically_increasing_id().alias("seq")), f"{scratch}/met")
    by_bytes = (
        rows.groupBy("digest", "bytes")
        .agg(F.max(F.struct("id", "seq", "locator")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", "bytes", F.col("keeper.id").alias("keep_id"), F.col("keeper.seq").alias("keep_seq"), "group_size", F.col("keeper.locator").alias("keep_locator"))
    )
    return outcome(same, groups, ["digest"]).unionByName(outcome(rows, by_bytes, ["digest", "bytes"]))


def _differing(docs: DataFrame, body: Column, digest: Callable[[Column], Column], groups: DataFrame) -> DataFrame:
    """Digests with more than one text. Compares the full bytes of every row in a group of two or more."""
    hits = docs.select(digest(body).alias("digest"), body.alias("bytes"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    if groups.count() <= BROADCAST_ROWS:
        hits = hits.join(F.broadcast(groups.select("digest")), "digest", "left_semi")
    else:
        salted = groups.select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        hits = hits.join(salted, ["digest", "salt"], "left_semi")
    part = hits.groupBy("digest", "salt").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"))
    return part.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("digest")


def keep_one(spark: SparkSession, docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows that stay, with the columns of docs. Nulls, ties and repeated rows as in decisions()."""
    found = decisions(spark, docs, text, id_column)
    dropped = found.where(~F.col("kept")).groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n_dropped"))
    left = found.where("kept").groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n_left"))
    verdict = dropped.join(left, ["id", "digest"], "left").select(F.struct(F.col("id").alias("i"), F.col("digest").alias("d")).alias("_k"), F.col("n_left").isNotNull().alias("_some"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    rows = rows.withColumn("_k", F.struct(F.col("_row")[id_column].alias("i"), sha256(F.coalesce(F.col("_row")[text], F.lit(""))).alias("d")))
    rows = rows.join(verdict, rows["_k"].eqNullSafe(verdict["_k"]), "left").select("_row", rows["_k"], "_some")
    single = rows.where(F.col("_some").isNull()).select("_row.*")
    repeated = rows.where(F.col("_some")).dropDuplicates(["_k"]).select("_row.*")
    return single.unionByName(repeated)
