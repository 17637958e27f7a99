"""Canonical text of records: masked, ordered, with the event's summary or without."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.functions.exprs import clean, general, mask
from rippleframe.operators.catalog import FACTORS

MARKER, NO_SUMMARY = "[CASE_ENTITY]", "[NO_SUMMARY]"
#: Fixed value of the serializer's contract.
VERSION = "context-serializer-v3"
# How reports name the mechanisms.
PHRASES = {
    "input_cost_change": "input costs",
    "output_price_change": "selling prices",
    "demand_change": "market demand",
    "supply_change": "available supply",
    "capacity_change": "production capacity",
    "supplier_disruption": "supplier availability",
    "customer_dependency_change": "customer dependency",
    "financing_cost_change": "financing costs",
    "currency_change": "currency exposure",
    "regulatory_cost_change": "regulatory costs",
    "tax_change": "the tax burden",
    "subsidy_change": "subsidy support",
    "competitive_pressure_change": "competitive pressure",
    "contract_change": "the contract position",
    "labor_cost_change": "labor costs",
}
RUNTIME_VERSION = "runtime-view-v1"


def summary_mode(mode: str) -> str:
    found = mode.strip().casefold()
    if found not in ("full", "none"):
        raise ValueError(f"summary mode must be full or none, not {mode!r}")
    return found


def default_summary() -> Column:
    return F.concat_ws(" ", "subject", "mechanism", "direction", general(F.col("magnitude")))


def event_text(mode: str, summary: Column) -> Column:
    subject = F.concat(F.col("subject_class"), F.lit(":"), F.col("subject"))
    said = F.lit(NO_SUMMARY) if mode == "none" else F.when(F.trim(summary) == NO_SUMMARY, NO_SUMMARY).otherwise(mask(clean(summary), clean(F.col("entity_id"))))
    return F.concat_ws(
        "; ", F.concat(F.lit("type="), clean(F.col("mechanism"))), F.concat(F.lit("summary="), said),
        F.concat(F.lit("subjects="), F.when(subject == F.col("entity_id"), MARKER).otherwise(clean(subject))),
        F.concat(F.lit("direction="), clean(F.col("direction"))), F.concat(F.lit("magnitude="), general(F.col("magnitude"))),
        F.lit("unit=fraction"), F.concat(F.lit("confidence="), general(F.col("confidence"))),
    )


def facts() -> Column:
    """(predicate, value) of the known factors, in the order of the predicates."""
    made = [F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("predicate"), F.col(f).alias("value"))) for f in sorted(FACTORS)]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def serialized(records: DataFrame, mode: str = "full", summary: Column | None = None) -> DataFrame:
    """id, text. A missing summary is made from the event. Row by row: streams are served as tables are."""
    mode = summary_mode(mode)
    summary = default_summary() if summary is None else F.coalesce(summary, default_summary())
    lines = F.transform(
        facts(),
        lambda f: F.concat(
            F.lit(f"[CONTEXT] subject={MARKER}; predicate="), f["predicate"], F.lit("; value="), f["value"].cast("string"),
            F.lit("; unit=ratio; confidence="), general(F.col("confidence")),
        ),
    )
    head = F.array(
        F.lit("[CLS]"), F.concat(F.lit("[EVENT] "), event_text(mode, summary)), F.lit(f"[CASE] type=company name={MARKER}"),
        F.concat(F.lit("[HORIZON] "), F.col("horizon_days").cast("string"), F.lit("d")),
    )
    return records.select("id", F.array_join(F.concat(head, lines, F.array(F.lit("[SEP]"))), "\n").alias("text"))


def unpivoted(records: DataFrame) -> DataFrame:
    """record_id, fact_id, predicate, value: one row for each known factor; the fact's number is the factor's place."""
    made = F.array(*[F.struct(F.lit(f"fact:{k}").alias("fact_id"), F.lit(f).alias("predicate"), F.col(f).alias("value")) for k, f in enumerate(FACTORS)])
    return records.select(F.col("id").alias("record_id"), F.explode(made).alias("f")).where("f.value is not null").select("record_id", "f.*")


def runtime_views(records: DataFrame, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Noisy report summaries for a hash sample of records: id, summary."""
    from rippleframe.functions.exprs import unit_hash_of

    key = F.concat(F.lit(f"{RUNTIME_VERSION}\0{seed}\0"), F.col("id"))
    phrase = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])[F.col("mechanism")]
    text = F.concat(
        F.lit("According to the latest report, "), phrase, F.lit(" linked to "), F.col("subject"), F.lit(" "),
        F.when(F.col("direction") == "increase", "increased").otherwise("decreased"), F.lit("; normalized shock magnitude "), general(F.col("magnitude")),
        F.lit(". The article also contained unrelated market commentary and quarterly background."),
    )
    return records.where(unit_hash_of(key) < ratio).select(F.concat("id", F.lit(f"::{RUNTIME_VERSION}")).alias("id"), text.alias("summary"))
