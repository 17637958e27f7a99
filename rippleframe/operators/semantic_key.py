"""The strict semantic key of an event, and events without repeats, in tables and in streams.

Two events are the same if their types, subjects, objects, directions, magnitudes to the bit, units, times to the
microsecond and summaries are; case and runs of white space don't count in texts. Near matches are not merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.functions.exprs import normalised_text, python_float
from rippleframe.operators.bundles import ids_in_order


def semantic_key(e: Column) -> Column:
    """SHA-256 over the eight parts, each behind its length; a missing part differs from an empty one."""
    ids = lambda values: F.array_join(F.transform(F.transform(ids_in_order(values), F.lower), lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)), "")
    parts = [
        normalised_text(e["event_type"]), ids(e["subject_ids"]), ids(e["object_ids"]), normalised_text(e["direction"]), python_float(e["magnitude"]), normalised_text(e["unit"]),
        F.unix_micros(e["occurred_at"]).cast("string"), normalised_text(e["summary"]),
    ]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256)


def distinct_events(rows: DataFrame, event: str = "event") -> DataFrame:
    """Of the events of each key, the one observed first, of ties that with the least id: key, n, and the event. The shuffle
    carries one candidate per key and task."""
    e = F.col(event)
    keyed = rows.select(semantic_key(e).alias("key"), e.alias("event"))
    first = F.min_by("event", F.struct("event.observed_at", "event.event_id"))
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), first.alias("event"))


def distinct_stream(rows: DataFrame, event: str = "event", delay: str = "2 days") -> DataFrame:
    """A stream's events without repeats that are observed within the delay of each other: the one that comes first stays.
    Its state holds a digest a key, for as long as the watermark of observed_at allows a repeat."""
    e = F.col(event)
    keyed = rows.select(semantic_key(e).alias("key"), e["observed_at"].alias("observed_at"), e.alias("event"))
    return keyed.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["key"])
