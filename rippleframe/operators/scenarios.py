"""Scenarios of the older contract: score, context text and event text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Roles of each event type, and the number of days after which an effect has faded to 1/e.
ROLES = {
    "input_price_change": ["consumer", "producer", "neutral"],
    "demand_change": ["producer", "neutral"],
    "interest_rate_change": ["bank", "real_estate"],
    "customer_loss": ["supplier_high", "supplier_low"],
    "export_restriction": ["consumer", "competitor", "neutral"],
}
CASE_TYPES = {"bank": "bank", "real_estate": "real_estate"}
#: Names of the last three variables in the text, by event type and role; the second part is what they are made of.
CONTEXT = {
    ("input_price_change", "consumer"): [("hedging_ratio", "hedging"), ("pricing_power", "pricing_power"), ("substitution_ability", "substitution")],
    ("input_price_change", "producer"): [("hedging_ratio", "hedging")],
    ("demand_change", "producer"): [("pricing_power", "pricing_power")],
    ("interest_rate_change", "bank"): [("rate_sensitivity", "pricing_power")],
    ("interest_rate_change", "real_estate"): [("debt_ratio", None), ("rate_sensitivity", "pricing_power")],
    ("customer_loss", "supplier_high"): [("replacement_difficulty", "substitution")],
    ("customer_loss", "supplier_low"): [("replacement_difficulty", "substitution")],
    ("export_restriction", "consumer"): [("substitution_ability", "substitution")],
    ("export_restriction", "competitor"): [("market_share_gain_potential", "pricing_power"), ("substitution_barrier", "substitution")],
}
GRIDS = {"exposure": [10, 30, 50, 70], "hedging": [0.0, 0.3, 0.6], "pricing_power": [0.1, 0.5, 0.9], "horizon_days": [7, 30, 90, 365]}


def score() -> Column:
    """The score in [-1, 1] of rows with event_type, role, direction, magnitude, exposure, hedging, pricing_power,
    substitution and horizon_days. A role that an event type does not concern, and an unknown type, score 0."""
    c = F.col
    size, stake = F.least(F.lit(1.0), c("magnitude") / 40.0), F.least(F.lit(1.0), c("exposure") / 40.0)
    unhedged, unpassed, unreplaced = 1.0 - c("hedging") * 0.6, 1.0 - c("pricing_power") * 0.3, 1.0 - c("substitution") * 0.3
    up = F.when(c("direction").isin("increase", "hike"), 1.0).otherwise(-1.0)
    effects = {
        ("input_price_change", "consumer"): -up * size * stake * unhedged * unpassed * unreplaced,
        ("input_price_change", "producer"): up * size * stake * unhedged,
        ("demand_change", "producer"): up * size * stake * unpassed,
        ("interest_rate_change", "bank"): up * size * 0.8,
        ("interest_rate_change", "real_estate"): -up * size * stake * 0.9,
        ("customer_loss", "supplier_high"): -stake * 1.2 * unreplaced,
        ("customer_loss", "supplier_low"): -stake * 0.4 * unreplaced,
        ("export_restriction", "consumer"): -size * stake * unreplaced,
        ("export_restriction", "competitor"): size * 0.7,
    }
    raw = F.lit(0.0)
    for (kind, role), effect in effects.items():
        raw = F.when((c("event_type") == kind) & (c("role") == role), effect).otherwise(raw)
    fading = 0.4 + 0.6 * F.exp(-c("horizon_days") / 365.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw * fading)) + F.lit(0.0)


def context_text(subject: Column) -> Column:
    """The sentence of variables: only those that the type and role name, and for a neutral role none."""
    c = F.col
    percent = lambda x: F.concat(F.format_string("%.0f", F.bround(x * 100)), F.lit("%"))
    out = F.concat(F.lit("role="), c("role"), F.lit("; "), subject, F.lit("_exposure="), F.format_string("%.0f", c("exposure")), F.lit("%"))
    more = F.lit("")
    for (kind, role), named in CONTEXT.items():
        parts = [F.concat(F.lit(f"; {name}="), percent(c(x)) if x else F.format_string("%.2f", c("exposure") / 100)) for name, x in named]
        more = F.when((c("event_type") == kind) & (c("role") == role), F.concat(*parts)).otherwise(more)
    neutral = F.concat(F.lit("role=neutral; "), subject, F.lit("_exposure=0%; the company has no significant "), subject, F.lit(" exposure"))
    return F.when(c("role") == "neutral", neutral).otherwise(F.concat(out, more))


def case_type() -> Column:
    return F.when(F.col("role").isin(list(CASE_TYPES)), F.col("role")).otherwise("company")


def scored(rows: DataFrame, subject: Column) -> DataFrame:
    return rows.withColumn("score", score()).withColumn("context_text", context_text(subject)).withColumn("case_type", case_type())


def grids(rows: DataFrame) -> DataFrame:
    """For each row whose role is not neutral, one row for each value of each grid, with `varied` and `variant`; all else equal."""
    made = [F.struct(F.lit(f).alias("f"), F.lit(k).alias("k"), F.lit(float(v)).alias("v")) for f, values in GRIDS.items() for k, v in enumerate(values)]
    rows = rows.where("role <> 'neutral'").withColumn("_g", F.explode(F.array(*made)))
    changed = {f: F.when(F.col("_g.f") == f, F.col("_g.v")).otherwise(F.col(f)) for f in GRIDS}
    changed["horizon_days"] = changed["horizon_days"].cast("int")
    return rows.withColumns(changed).withColumn("varied", F.col("_g.f")).withColumn("variant", F.col("_g.k")).drop("_g")
