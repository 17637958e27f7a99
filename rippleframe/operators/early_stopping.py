"""The early-stopping fold over series of errors: the best so far, and how long there has been no better one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stopped(rows: DataFrame, key: str, order: list[str], error: str, min_delta: float = 1e-4, patience: int = 3) -> DataFrame:
    """key, n (errors read), best, best_at (from 1; null if none), waited, stopped: one row for each series.

    An error is better if it is less than the best by more than min_delta. After `patience` errors in a row that aren't, the
    series stops, and the rest of it isn't read; a patience of 0 never stops. Null errors are not in the series, and NaN is
    never better. A fold depends on what came before, so a series is one task's; it streams through with a few numbers of
    state, whatever its length. Key and order may be of any type that sorts.
    """
    ddl = f"{key} {rows.schema[key].dataType.simpleString()}, n long, best double, best_at long, waited long, stopped boolean"
    dealt = rows.where(F.col(error).isNotNull()).select(key, *order, F.col(error).cast("double").alias("_error"))
    dealt = dealt.repartition(key).sortWithinPartitions(key, *order).select(F.col(key), "_error")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        at, n, best, best_at, waited, done, kind = none, 0, np.inf, 0, 0, False, None
        out: list[tuple] = []

        def told() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = [kind, pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[key, "n", "best", "best_at", "waited", "stopped"])
            out.clear()
            return batch

        def closed() -> tuple:
            return at, n, best if best_at else None, best_at or None, waited, done

        for batch in batches:
            kind = batch.schema.field(key).type
            for k, x in zip(batch.column(key).to_pylist(), batch.column("_error").to_pylist(), strict=True):
                if at is none or k != at:
                    if at is not none:
                        out.append(closed())
                    at, n, best, best_at, waited, done = k, 0, np.inf, 0, 0, False
                if done:
                    continue
                n += 1
                if x < best - min_delta:
                    best, best_at, waited = x, n, 0
                else:
                    waited += 1
                    done = patience > 0 and waited >= patience
            if len(out) >= 1000:
                yield told()
        if at is not none:
            out.append(closed())
        if out:
            yield told()

    return dealt.mapInArrow(fold, ddl)
