"""Context bundles: one event, the case it is assessed for, and what was known of the case at a cutoff.

Columns of a bundle: bundle_id, event, case_id, entity_id, name, case_type, cutoff, retrieved_at, horizon, facts and
historical_events. Events and facts have their evidence as an array of provenance; times are of two kinds, when something
held or happened and when it was observed. Everything is done on a bundle's own row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.functions.exprs import clean, general, mask, python_float
from rippleframe.operators.serialize import MARKER, NO_SUMMARY, summary_mode

PROVENANCE = "struct<source_id: string, source_type: string, observed_at: timestamp, published_at: timestamp, uri: string, external_id: string, content_hash: string>"
EVENT = (
    "struct<event_id: string, event_type: string, summary: string, occurred_at: timestamp, observed_at: timestamp, subject_ids: array<string>, object_ids: array<string>, "
    f"direction: string, magnitude: double, unit: string, confidence: double, provenance: array<{PROVENANCE}>>"
)
FACT = (
    "struct<fact_id: string, subject_id: string, predicate: string, observed_at: timestamp, object_id: string, value: double, text: string, unit: string, "
    f"valid_from: timestamp, valid_to: timestamp, confidence: double, provenance: array<{PROVENANCE}>>"
)
SCHEMA = (
    f"bundle_id string, event {EVENT}, case_id string, entity_id string, name string, case_type string, cutoff timestamp, retrieved_at timestamp, horizon string, "
    f"facts array<{FACT}>, historical_events array<{EVENT}>"
)


def evidence_id(p: Column) -> Column:
    """What names a piece of evidence: its external id, else its content hash, its address or the time it was observed."""
    at = F.date_format(p["observed_at"], "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(p["observed_at"]), F.lit(1_000_000))
    iso = F.concat(at, F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))), F.lit("+00:00"))
    said = F.coalesce(p["external_id"], F.concat(F.lit("content-hash:"), F.lower(p["content_hash"])), p["uri"], iso)
    return F.concat(p["source_id"], F.lit(":"), said)


def provenance_in_order(values: Column) -> Column:
    """Distinct evidence by time, source and name, their case folded."""
    keyed = F.transform(F.array_distinct(values), lambda p: F.struct(p["observed_at"].alias("a"), F.lower(p["source_id"]).alias("b"), F.lower(evidence_id(p)).alias("c"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda k: k["p"])


def ids_in_order(ids: Column) -> Column:
    """Distinct ids by their folded form, then by themselves."""
    return F.transform(F.array_sort(F.transform(F.array_distinct(ids), lambda x: F.struct(F.lower(x).alias("a"), x.alias("b")))), lambda k: k["b"])


def valid_at(fact: Column, at: Column) -> Column:
    """A fact holds from valid_from to valid_to, both included; an open end has no bound."""
    return F.coalesce(fact["valid_from"] <= at, F.lit(True)) & F.coalesce(at <= fact["valid_to"], F.lit(True))


def _as_observed(x: Column, cutoff: Column) -> Column:
    """An event or fact with the evidence that was there at the cutoff."""
    return x.withField("provenance", F.filter(x["provenance"], lambda p: p["observed_at"] <= cutoff))


def as_of(bundles: DataFrame) -> DataFrame:
    """Bundles as they could be known at their cutoffs, in canonical order.

    A bundle whose event came later goes. Of facts, those stay that were observed by then and valid at the event's time or
    the cutoff, whichever is first; of historical events, those observed by then that happened before the event. Later
    evidence goes from all of them. Null arrays count as empty.
    """
    cutoff, at = F.col("cutoff"), F.least(F.col("event.occurred_at"), F.col("cutoff"))

    def array(name: str, kind: str) -> Column:
        return F.coalesce(F.col(name), F.array().cast(f"array<{kind}>"))

    facts = F.filter(array("facts", FACT), lambda f: (f["observed_at"] <= cutoff) & valid_at(f, at))
    events = F.filter(array("historical_events", EVENT), lambda e: (e["observed_at"] <= cutoff) & (e["occurred_at"] < F.col("event.occurred_at")) & (e["event_id"] != F.col("event.event_id")))
    rows = bundles.where(F.col("event.observed_at") <= cutoff)
    rows = rows.withColumns({"facts": F.transform(facts, lambda f: _as_observed(f, cutoff)), "historical_events": F.transform(events, lambda e: _as_observed(e, cutoff)), "event": _as_observed(F.col("event"), cutoff)})
    return in_order(rows)


def _fact_key(f: Column) -> Column:
    value = F.coalesce(f["text"], python_float(f["value"]), F.lit(""))
    return F.struct(*[F.lower(x).alias(n) for n, x in zip("abcde", (f["predicate"], f["subject_id"], F.coalesce(f["object_id"], F.lit("")), value, f["fact_id"]), strict=True)], f.alias("row"))


def in_order(bundles: DataFrame) -> DataFrame:
    """Facts, events and evidence in canonical order, so that equal bundles have equal text however they were retrieved."""

    def settled(x: Column) -> Column:
        return x.withField("provenance", provenance_in_order(x["provenance"]))

    def event(x: Column) -> Column:
        return settled(x).withField("subject_ids", ids_in_order(x["subject_ids"])).withField("object_ids", ids_in_order(x["object_ids"]))

    facts = F.transform(F.array_sort(F.transform("facts", _fact_key)), lambda k: settled(k["row"]))
    history = F.transform("historical_events", lambda e: F.struct(e["occurred_at"].alias("a"), F.lower(e["event_id"]).alias("b"), e.alias("row")))
    return bundles.withColumns({"facts": facts, "historical_events": F.transform(F.array_sort(history), lambda k: event(k["row"])), "event": event(F.col("event"))})


def evidence_ids() -> Column:
    """All that a bundle rests on, each once, in order: facts, events, evidence of events, evidence of facts."""
    events = F.concat(F.array("event"), F.col("historical_events"))
    named = lambda values: F.flatten(F.transform(values, lambda x: F.transform(x["provenance"], evidence_id)))
    return F.array_distinct(F.concat(F.transform("facts", lambda f: f["fact_id"]), F.transform("historical_events", lambda e: e["event_id"]), named(events), named(F.col("facts"))))


def _any(values: Column | str, broken: Callable[[Column], Column]) -> Column:
    return F.exists(values, lambda x: F.coalesce(broken(x), F.lit(False)))


def _blank(x: Column) -> Column:
    return x.isNull() | (F.trim(x) == "")


def _unsure(x: Column) -> Column:
    return x["confidence"].isNull() | F.isnan(x["confidence"]) | (x["confidence"] < 0) | (x["confidence"] > 1)


def _before_its_evidence(x: Column) -> Column:
    return (F.size(x["provenance"]) > 0) & (x["observed_at"] < F.array_min(F.transform(x["provenance"], lambda p: p["observed_at"])))


def rules() -> dict[str, Column]:
    """Code and condition of every rule of a bundle: the ten on what a cutoff allows, and those on its parts."""
    cutoff, events = F.col("cutoff"), F.concat(F.array("event"), F.col("historical_events"))
    at = F.least(F.col("event.occurred_at"), cutoff)
    fact_ids, event_ids = F.transform("facts", lambda f: f["fact_id"]), F.transform("historical_events", lambda e: e["event_id"])
    late = lambda x: _any(x["provenance"], lambda p: p["observed_at"] > cutoff)
    folded = lambda ids: F.array_distinct(F.transform(ids, F.lower))
    evidence = F.concat(F.flatten(F.transform(events, lambda e: e["provenance"])), F.flatten(F.transform("facts", lambda f: f["provenance"])))
    return {
        "retrieved_before_cutoff": F.col("retrieved_at") < cutoff,
        "repeated_fact_id": F.size(F.array_distinct(fact_ids)) < F.size(fact_ids),
        "repeated_event_id": F.size(F.array_distinct(event_ids)) < F.size(event_ids),
        "primary_event_in_history": F.array_contains(event_ids, F.col("event.event_id")),
        "history_not_before_event": _any("historical_events", lambda e: e["occurred_at"] >= F.col("event.occurred_at")),
        "event_after_cutoff": _any(events, lambda e: e["observed_at"] > cutoff),
        "fact_after_cutoff": _any("facts", lambda f: f["observed_at"] > cutoff),
        "fact_not_valid": _any("facts", lambda f: ~valid_at(f, at)),
        "event_evidence_after_cutoff": _any(events, late),
        "fact_evidence_after_cutoff": _any("facts", late),
        "blank_text": _blank(F.col("bundle_id")) | _blank(F.col("case_id")) | _blank(F.col("entity_id")) | _blank(F.col("case_type")) | _blank(F.col("horizon"))
        | _any(events, lambda e: _blank(e["event_id"]) | _blank(e["event_type"]) | _blank(e["summary"])) | _any("facts", lambda f: _blank(f["fact_id"]) | _blank(f["subject_id"]) | _blank(f["predicate"])),
        "no_subject": _any(events, lambda e: F.coalesce(F.size(e["subject_ids"]), F.lit(0)) <= 0),
        "ids_differ_by_case": _any(events, lambda e: (F.size(folded(e["subject_ids"])) < F.size(F.array_distinct(e["subject_ids"]))) | (F.size(folded(e["object_ids"])) < F.size(F.array_distinct(e["object_ids"])))),
        "confidence_out_of_range": _any(events, _unsure) | _any("facts", _unsure),
        "value_not_finite": _any("facts", lambda f: F.isnan(f["value"]) | (F.abs(f["value"]) == float("inf"))) | _any(events, lambda e: F.isnan(e["magnitude"]) | (F.abs(e["magnitude"]) == float("inf"))),
        "fact_without_value": _any("facts", lambda f: f["value"].isNull() & f["text"].isNull() & f["object_id"].isNull()),
        "validity_reversed": _any("facts", lambda f: f["valid_from"] > f["valid_to"]),
        "observed_before_evidence": _any(events, _before_its_evidence) | _any("facts", _before_its_evidence),
        "evidence_before_publication": _any(evidence, lambda p: p["observed_at"] < p["published_at"]),
    }


def violations(bundles: DataFrame) -> DataFrame:
    """bundle_id, code: a row for each rule that a bundle breaks."""
    found = F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in rules().items()])
    return bundles.select("bundle_id", F.explode_outer(F.array_compact(found)).alias("code")).where("code is not null")


def _masked(x: Column) -> Column:
    """Text without the case's identity: its id, then its name."""
    return mask(mask(clean(x), clean(F.col("entity_id"))), clean(F.col("name")))


def _entity(x: Column) -> Column:
    return F.when(x == F.col("entity_id"), F.lit(MARKER)).otherwise(clean(x))


def _part(label: str, x: Column) -> Column:
    """A part of a line; null, so left out, where x is."""
    return F.concat(F.lit(f"{label}="), x)


def _event_line(e: Column, mode: str) -> Column:
    entities = lambda ids: F.array_join(F.transform(ids, _entity), ",")
    said = F.lit(NO_SUMMARY) if mode == "none" else F.when(F.trim(e["summary"]) == NO_SUMMARY, NO_SUMMARY).otherwise(_masked(e["summary"]))
    return F.concat_ws(
        "; ", _part("type", clean(e["event_type"])), _part("summary", said), _part("subjects", entities(e["subject_ids"])),
        F.when(F.size(e["object_ids"]) > 0, _part("objects", entities(e["object_ids"]))), _part("direction", clean(e["direction"])),
        _part("magnitude", general(e["magnitude"])), _part("unit", clean(e["unit"])), _part("confidence", general(e["confidence"])),
    )


def _fact_line(f: Column) -> Column:
    value = F.coalesce(_masked(f["text"]), python_float(f["value"]))
    return F.concat_ws(
        "; ", _part("subject", _entity(f["subject_id"])), _part("predicate", clean(f["predicate"])), _part("object", _entity(f["object_id"])),
        _part("value", value), _part("unit", clean(f["unit"])), _part("confidence", general(f["confidence"])),
    )


def serialized(bundles: DataFrame, mode: str = "full", horizon: Column | None = None, settled: bool = False) -> DataFrame:
    """bundle_id, text: the canonical text of bundles in order (settled: they are, as as_of() gives them). Another horizon than the bundle's is an error."""
    mode = summary_mode(mode)
    own = F.col("horizon")
    if horizon is not None:
        own = F.when(F.trim(horizon) == own, own).otherwise(F.raise_error(F.concat(F.lit("horizon does not match bundle "), "bundle_id")))
    lines = F.concat(
        F.array(F.lit("[CLS]"), F.concat(F.lit("[EVENT] "), _event_line(F.col("event"), mode)), F.concat(F.lit("[CASE] type="), clean(F.col("case_type")), F.lit(f" name={MARKER}")), F.concat(F.lit("[HORIZON] "), clean(own))),
        F.transform("facts", lambda f: F.concat(F.lit("[CONTEXT] "), _fact_line(f))),
        F.transform("historical_events", lambda e: F.concat(F.lit("[HISTORICAL_EVENT] "), _event_line(e, mode))),
        F.array(F.lit("[SEP]")),
    )
    return (bundles if settled else in_order(bundles)).select("bundle_id", F.array_join(lines, "\n").alias("text"))


def of_records(records: DataFrame, base_time: str = "2026-01-01 12:00:00") -> DataFrame:
    """Bundles of flat labelled records: the event, the known factors as facts, no history; all at one time."""
    from rippleframe.operators.catalog import FACTORS
    from rippleframe.operators.serialize import default_summary

    at, null = F.lit(base_time).cast("timestamp"), lambda kind: F.lit(None).cast(kind)
    evidence = F.array(F.struct(F.col("source").alias("source_id"), F.lit("dataset").alias("source_type"), at.alias("observed_at"), null("timestamp").alias("published_at"), *[null("string").alias(n) for n in ("uri", "external_id", "content_hash")]))
    event = F.struct(
        F.concat(F.lit("event:"), "id").alias("event_id"), F.col("mechanism").alias("event_type"), default_summary().alias("summary"), at.alias("occurred_at"), at.alias("observed_at"),
        F.array(F.concat("subject_class", F.lit(":"), "subject")).alias("subject_ids"), F.array().cast("array<string>").alias("object_ids"), "direction", "magnitude", F.lit("fraction").alias("unit"), "confidence", evidence.alias("provenance"),
    )
    made = [F.when(F.col(f).isNotNull(), F.struct(
        F.lit(f"fact:{k}").alias("fact_id"), F.col("entity_id").alias("subject_id"), F.lit(f).alias("predicate"), at.alias("observed_at"), null("string").alias("object_id"), F.col(f).alias("value"), null("string").alias("text"),
        F.lit("ratio").alias("unit"), null("timestamp").alias("valid_from"), null("timestamp").alias("valid_to"), F.col("confidence"), F.array().cast(f"array<{PROVENANCE}>").alias("provenance"),
    )) for k, f in enumerate(FACTORS)]
    return records.select(
        F.col("id").alias("bundle_id"), event.alias("event"), F.concat(F.lit("case:"), "entity_id").alias("case_id"), "entity_id", F.col("entity_id").alias("name"), F.lit("company").alias("case_type"),
        at.alias("cutoff"), at.alias("retrieved_at"), F.concat(F.col("horizon_days").cast("string"), F.lit("d")).alias("horizon"), F.array_compact(F.array(*made)).alias("facts"), F.array().cast(f"array<{EVENT}>").alias("historical_events"),
    )


def of_events(events: DataFrame, last: int = 8) -> DataFrame:
    """Candidate bundles, a row per event of a user: the user's `last` events before it as facts and as history, whenever
    they were observed (see as_of()). A fact holds until the next event of its kind. One window by user and time, whose
    frame has `last` rows, so a user of many events costs a sort."""
    from pyspark.sql import Window

    from rippleframe.functions.exprs import ordinal_id
    from rippleframe.operators.catalog import HORIZONS

    at, i = F.col("ts").cast("timestamp"), F.col("event_id")
    hours = lambda k: F.make_dt_interval(hours=F.pmod(i, F.lit(k)).cast("int"))
    entity, name = ordinal_id("synthetic_", 5, F.col("user_id")), F.concat(F.lit("User "), F.col("user_id").cast("string"))
    null = lambda kind: F.lit(None).cast(kind)
    observed = at + hours(48)

    def evidence(source: str, kind: str, seen: Column, external: Column, content: Column) -> Column:
        return F.struct(F.lit(source).alias("source_id"), F.lit(kind).alias("source_type"), seen.alias("observed_at"), null("timestamp").alias("published_at"), null("string").alias("uri"), external.alias("external_id"), content.alias("content_hash"))

    both = F.array(
        evidence("feed", "stream", observed, i.cast("string"), null("string")),
        evidence("archive", "batch", observed + F.make_dt_interval(days=F.pmod(i, F.lit(5)).cast("int")), null("string"), F.upper(F.sha2(i.cast("string"), 256))),
    )
    kind = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    fact = F.struct(
        F.concat(F.lit("fact:"), i.cast("string")).alias("fact_id"), entity.alias("subject_id"), F.col("event_type").alias("predicate"), observed.alias("observed_at"), null("string").alias("object_id"), F.col("value"),
        null("string").alias("text"), F.lit("points").alias("unit"), at.alias("valid_from"), F.col("until").alias("valid_to"), F.lit(0.9).alias("confidence"), both.alias("provenance"),
    )
    summary = F.concat(F.initcap("event_type"), F.lit(" by "), name, F.lit(" ["), entity, F.lit("]"))
    event = F.struct(
        F.concat(F.lit("event:"), i.cast("string")).alias("event_id"), F.col("event_type"), summary.alias("summary"), at.alias("occurred_at"), observed.alias("observed_at"), F.array(entity).alias("subject_ids"),
        F.when(i % 3 == 0, F.array(F.lit("shop:B"), F.lit("shop:a"))).otherwise(F.array().cast("array<string>")).alias("object_ids"), null("string").alias("direction"), F.col("value").alias("magnitude"), F.lit("points").alias("unit"),
        F.lit(0.9).alias("confidence"), both.alias("provenance"),
    )
    rows = events.select("event_id", "user_id", "event_type", "value", "ts", F.lead(at).over(kind).alias("until")).withColumns({"fact": fact, "event": event})
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-last, -1)
    rows = rows.withColumns({"facts": F.collect_list("fact").over(before), "historical_events": F.collect_list("event").over(before)})
    horizon = F.element_at(F.array(*[F.lit(f"{h}d") for h in HORIZONS]), (F.pmod(i, F.lit(len(HORIZONS))) + 1).cast("int"))
    cutoff = at + hours(72)
    return rows.select(
        i.cast("string").alias("bundle_id"), "event", F.concat(F.lit("case:"), entity).alias("case_id"), entity.alias("entity_id"), name.alias("name"), F.lit("company").alias("case_type"), cutoff.alias("cutoff"),
        (cutoff + F.expr("INTERVAL 1 HOUR")).alias("retrieved_at"), horizon.alias("horizon"), "facts", "historical_events",
    )
