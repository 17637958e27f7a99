"""Batches for masked-language training: right-padded rows, and positions chosen by hashes.

The hash of seed, row and position gives four numbers in [0, 1): whether a position is chosen, what becomes of it (80 % the
mask, 10 % another id, 10 % itself), which other id, and its rank in the fallback. So a choice depends on neither order nor
partitions, and a lost task makes the same again. The fallback is a batch's: if none of its positions is chosen, each of its
rows gets the one that ranks highest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.operators.ordered_digest import ranked

# Ids of the special tokens.
PAD, CLS, SEP, MASK = 0, 1, 2, 4
#: Structural ids: never chosen.
STRUCTURAL = (CLS, SEP, 5, 6, 7, 8, 9, 10, 11)
#: The label of a position that isn't chosen.
IGNORED = -100


def batched(spark: SparkSession, rows: DataFrame, order: list[str], ids: str, batch_size: int = 32) -> DataFrame:
    """Adds batch (rows in order, `batch_size` at a time), width (the longest of the batch), top (its largest id), the ids
    padded to that width, and their attention mask."""
    own = ranked(spark, rows, order).withColumn("batch", F.expr(f"rank div {batch_size}"))
    size = F.size(ids)
    shape = own.groupBy("batch").agg(F.max(size).alias("width"), F.max(F.array_max(ids)).alias("top"))
    own = own.join(shape, "batch")
    padding = F.array_repeat(F.lit(PAD), F.col("width") - size)
    attention = F.concat(F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), F.col("width") - size))
    return own.withColumns({"attention": attention, ids: F.concat(F.col(ids).cast("array<int>"), padding)})


def _draw(digest: Column, k: int) -> Column:
    """The k-th of the digest's four numbers, of 32 bits each."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("double") / 4294967296.0


def masked(rows: DataFrame, ids: str, name: Column, seed: int = 42, share: float = 0.15, random_share: float = 0.1, kept_share: float = 0.1) -> DataFrame:
    """Adds labels (the id where a position is chosen, else -100) and masked to rows of batched(). name: a text that tells
    rows apart. A row of structural ids alone gets no position."""
    if not 0 < share <= 1 or random_share < 0 or kept_share < 0 or random_share + kept_share > 1:
        raise ValueError("shares must be in [0, 1], and some position chosen")
    place = F.concat(F.lit(f"{seed}:"), name, F.lit(":"))
    length = F.aggregate("attention", F.lit(0), lambda a, x: a + x)
    made = F.transform(F.slice(ids, F.lit(1), length), lambda x, i: F.struct(x.alias("id"), F.when(~x.isin(*STRUCTURAL), F.sha2(F.concat(place, i.cast("string")), 256)).alias("d")))
    drawn = F.transform(made, lambda p: F.struct(p["id"].alias("id"), *[F.when(p["d"].isNotNull(), _draw(p["d"], k)).alias(f"u{k}") for k in range(4)]))
    own = rows.withColumn("_p", drawn)
    chosen = F.exists("_p", lambda p: p["u0"] < share)
    any_chosen = own.groupBy(F.col("batch").alias("_b")).agg(F.bool_or(F.coalesce(chosen, F.lit(False))).alias("_some"))
    own = own.join(any_chosen, F.col("batch") == F.col("_b")).withColumn("_best", F.array_max(F.transform("_p", lambda p: p["u3"])))
    pick = lambda p: F.coalesce(F.when(F.col("_some"), p["u0"] < share).otherwise(p["u3"] == F.col("_best")), F.lit(False))
    other = lambda p: F.floor(p["u2"] * (F.col("top") + 1)).cast("int")
    changed = lambda p: F.when(p["u1"] < 1 - random_share - kept_share, F.lit(MASK)).when(p["u1"] < 1 - kept_share, other(p)).otherwise(p["id"])
    rest = F.col("width") - length
    labels = F.concat(F.transform("_p", lambda p: F.when(pick(p), p["id"]).otherwise(F.lit(IGNORED))), F.array_repeat(F.lit(IGNORED), rest))
    out = F.concat(F.transform("_p", lambda p: F.when(pick(p), changed(p)).otherwise(p["id"])), F.array_repeat(F.lit(PAD), rest))
    return own.withColumns({"labels": labels, "masked": out}).drop("_p", "_b", "_some", "_best")
