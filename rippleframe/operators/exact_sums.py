"""Exact sums of doubles: the nearest double to the true sum, whatever the order and the partitions.

A finite double is m * 2^u with a whole m of 53 bits. Exponents are dealt to limbs of 32: u = 32 * limb + shift, and
m * 2^shift is a whole number below 2^84. Its sums by limb are exact in decimal(38), for some 5 * 10^12 rows a group, and
can be merged in any order; a group has at most 66 limbs. They are put together and rounded once, at the end.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LIMB = 32
#: Exponent of the least double above 0.
_LEAST = -1074


def _parts(x: Column) -> Column:
    """limb and part of a finite number other than 0. Every step is exact: powers of two, and quotients below 2^53."""
    a = F.abs(x)
    guess = F.floor(F.log2(a)).cast("int")
    power = lambda e: F.pow(F.lit(2.0), e)
    e = F.when(a < power(guess), guess - 1).when(a >= power(guess + 1), guess + 1).otherwise(guess)
    u = F.greatest(e - 52, F.lit(_LEAST))
    limb = F.floor(u / F.lit(float(LIMB))).cast("int")
    m = (a / power(u)).cast("long").cast("decimal(17,0)")
    part = m * power(u - limb * LIMB).cast("long").cast("decimal(10,0)")
    return F.struct(limb.alias("limb"), F.when(x < 0, -part).otherwise(part).cast("decimal(28,0)").alias("part"))


def rounded_sum(limbs: list[tuple[int, int]], nans: int, ups: int, downs: int) -> float:
    """The nearest double to a sum of part * 2^(32 limb); infinities and NaN as addition has them."""
    if nans or (ups and downs):
        return math.nan
    if ups or downs:
        return math.inf if ups else -math.inf
    if not limbs:
        return 0.0
    low = min(limb for limb, _ in limbs)
    total = sum(int(part) << LIMB * (limb - low) for limb, part in limbs)
    try:
        return total / (1 << -LIMB * low) if low < 0 else float(total << LIMB * low)
    except OverflowError:
        return math.copysign(math.inf, total)


@F.arrow_udf(DoubleType())
def _rounded(limbs: pa.Array, nans: pa.Array, ups: pa.Array, downs: pa.Array) -> pa.Array:
    rows = zip(*(c.to_pylist() for c in (limbs, nans, ups, downs)), strict=True)
    return pa.array([rounded_sum([(x["limb"], x["part"]) for x in own], *rest) for own, *rest in rows], pa.float64())


def exact_sums(rows: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    """keys, and per column its exact sum and n_<column>, how many are not null. A null sum where there are none.

    One shuffle of at most 66 partial sums for each group, column and task; no row holds more than a group's limbs.
    """
    names = list(columns)
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("c"), columns[n].cast("double").alias("x")) for k, n in enumerate(names)])).alias("v")).select(*keys, "v.*")
    x = F.col("x")
    special = x.isNull() | F.isnan(x) | (F.abs(x) == math.inf) | (x == 0)
    long = long.withColumn("p", F.when(~special, _parts(x)))
    count: Callable[[Column], Column] = F.count_if
    limbs = long.groupBy(*keys, "c", "p.limb").agg(
        F.sum("p.part").alias("part"), F.count("x").alias("n"), count(F.isnan(x)).alias("nans"), count(x == math.inf).alias("ups"), count(x == -math.inf).alias("downs")
    )
    own = F.collect_list(F.when(F.col("limb").isNotNull(), F.struct("limb", "part")))
    wide = limbs.groupBy(*keys, "c").agg(own.alias("limbs"), *[F.sum(c).alias(c) for c in ("n", "nans", "ups", "downs")])
    wide = wide.withColumn("total", F.when(F.col("n") > 0, _rounded("limbs", "nans", "ups", "downs")))
    found = [F.max(F.when(F.col("c") == k, F.col(v))).alias(a) for k, n in enumerate(names) for v, a in (("total", n), ("n", f"n_{n}"))]
    return wide.groupBy(*keys).agg(*found)
