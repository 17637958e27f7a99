"""DuckDB SQL that the oracles share: the base records, the variants and the splits, over the same tables."""

from __future__ import annotations

import re

from rippleframe.operators.catalog import CONCEPT_SUBJECTS, FACTORS, HORIZON_GRID, HORIZONS, MAGNITUDE_GRID, MECHANISMS, OOD_PAIRS, POOLS, RATIO_GRID, SPLITS, STATES

# The effects, written out for the oracles alone: dm is direction times magnitude, inv, liq and res the exposures.
EFFECTS = {
    "revenue_expectation": {
        "output_price_change": "dm * output_dependency * (0.55 + 0.45 * d * pricing_power)",
        "demand_change": "dm * demand_exposure * CASE WHEN d > 0 THEN (0.55 + 0.45 * pricing_power) * (1 - 0.6 * capacity_utilization) ELSE 1 - 0.5 * pricing_power END",
        "supply_change": "0.35 * dm * input_dependency * res",
        "capacity_change": "0.8 * dm * demand_exposure * (0.25 + 0.75 * capacity_utilization)",
        "supplier_disruption": "-0.55 * dm * input_dependency * res",
        "customer_dependency_change": "dm * customer_concentration",
        "financing_cost_change": "-0.25 * fixed_cost_share * dm * debt_ratio * (1 - hedging) * up_liq",
        "currency_change": "dm * (1 - hedging) * currency_revenue_exposure",
        "subsidy_change": "0.35 * dm * subsidy_exposure * down_liq",
        "competitive_pressure_change": "-dm * competitive_pressure * demand_exposure * (1 - 0.65 * pricing_power) * (0.6 + 0.4 * customer_concentration)",
        "contract_change": "dm * contract_revenue_share",
    },
    "demand": {
        "output_price_change": "-0.35 * dm * demand_exposure * output_dependency * (1 - pricing_power)",
        "demand_change": "dm * demand_exposure",
        "customer_dependency_change": "dm * demand_exposure",
        "competitive_pressure_change": "-dm * competitive_pressure * demand_exposure * (0.7 + 0.3 * customer_concentration)",
        "contract_change": "dm * contract_revenue_share * (0.5 + 0.5 * customer_concentration)",
    },
    "operating_costs": {
        "input_cost_change": "dm * input_dependency * (1 - hedging) * (1 - substitutability) * inv",
        "supply_change": "-0.55 * dm * input_dependency * res",
        "capacity_change": "0.25 * dm * fixed_cost_share",
        "supplier_disruption": "0.5 * dm * input_dependency * res",
        "currency_change": "dm * (1 - hedging) * currency_cost_exposure",
        "regulatory_cost_change": "dm * regulatory_exposure * up_liq",
        "subsidy_change": "-0.65 * dm * subsidy_exposure * down_liq",
        "labor_cost_change": "dm * labor_intensity * (0.7 + 0.3 * fixed_cost_share)",
    },
    "margin_expectation": {
        "input_cost_change": "-dm * input_dependency * (1 - hedging) * (1 - substitutability) * inv * (1 - pricing_power)",
        "output_price_change": "dm * output_dependency * (0.55 + 0.45 * d * pricing_power) - 0.07 * dm * demand_exposure * output_dependency * (1 - pricing_power)",
        "demand_change": "dm * demand_exposure * (0.55 + 0.45 * pricing_power) * CASE WHEN d > 0 THEN (0.55 + 0.45 * pricing_power) * (1 - 0.6 * capacity_utilization) ELSE 1 - 0.5 * pricing_power END",
        "supply_change": "0.65 * dm * input_dependency * res",
        "capacity_change": "0.65 * dm * demand_exposure * (0.25 + 0.75 * capacity_utilization) - 0.125 * dm * fixed_cost_share",
        "supplier_disruption": "-0.7 * dm * input_dependency * res",
        "customer_dependency_change": "dm * customer_concentration * (0.55 + 0.45 * d * pricing_power)",
        "financing_cost_change": "-dm * debt_ratio * (1 - hedging) * up_liq",
        "currency_change": "dm * (1 - hedging) * (currency_revenue_exposure - currency_cost_exposure * (1 - 0.65 * d * pricing_power))",
        "regulatory_cost_change": "-dm * regulatory_exposure * up_liq * (1 - pricing_power)",
        "tax_change": "-dm * tax_exposure * up_liq * (1 - 0.35 * pricing_power)",
        "subsidy_change": "dm * subsidy_exposure * down_liq",
        "competitive_pressure_change": "-dm * competitive_pressure * demand_exposure * (1 - 0.65 * pricing_power) * (0.6 + 0.4 * customer_concentration) * (0.7 + 0.3 * (1 - pricing_power))",
        "contract_change": "dm * contract_revenue_share * (0.5 + 0.5 * d * pricing_power)",
        "labor_cost_change": "-dm * labor_intensity * (1 - 0.75 * pricing_power)",
    },
    "supply_risk": {
        "input_cost_change": "0.1 * dm * input_dependency * (1 - hedging) * (1 - substitutability) * inv",
        "supply_change": "-dm * input_dependency * res",
        "capacity_change": "-0.5 * dm * demand_exposure * (0.25 + 0.75 * capacity_utilization)",
        "supplier_disruption": "dm * input_dependency * res",
        "labor_cost_change": "0.2 * dm * labor_intensity * fixed_cost_share",
    },
    "competitive_position": {
        "input_cost_change": "-0.25 * dm * input_dependency * (1 - hedging) * (1 - substitutability) * inv * (1 - pricing_power)",
        "output_price_change": "0.2 * dm * output_dependency * (0.55 + 0.45 * d * pricing_power) - 0.07 * dm * demand_exposure * output_dependency * (1 - pricing_power)",
        "customer_dependency_change": "-0.25 * dm * customer_concentration * (1 - pricing_power)",
        "financing_cost_change": "-dm * debt_ratio * (1 - hedging) * up_liq * (0.25 + 0.35 * fixed_cost_share)",
        "currency_change": "0.25 * dm * (1 - hedging) * (currency_revenue_exposure - currency_cost_exposure * (1 - 0.65 * d * pricing_power))",
        "regulatory_cost_change": "-0.3 * dm * regulatory_exposure * up_liq * (1 - pricing_power)",
        "tax_change": "-0.25 * dm * tax_exposure * up_liq * (1 - pricing_power)",
        "subsidy_change": "0.3 * dm * subsidy_exposure * down_liq * (1 - 0.5 * pricing_power)",
        "competitive_pressure_change": "-dm * competitive_pressure * (1 - 0.4 * pricing_power)",
        "contract_change": "0.25 * dm * contract_revenue_share * (0.5 + 0.5 * d * pricing_power)",
        "labor_cost_change": "-0.25 * dm * labor_intensity * (1 - pricing_power)",
    },
}
#: What each mechanism needs, written out for the oracles alone.
NEEDS = {
    "input_cost_change": "input_dependency hedging pricing_power substitutability inventory_buffer",
    "output_price_change": "output_dependency demand_exposure pricing_power",
    "demand_change": "demand_exposure pricing_power capacity_utilization",
    "supply_change": "input_dependency inventory_buffer supplier_diversification substitutability",
    "capacity_change": "capacity_utilization demand_exposure fixed_cost_share",
    "supplier_disruption": "input_dependency inventory_buffer supplier_diversification substitutability",
    "customer_dependency_change": "customer_concentration demand_exposure pricing_power",
    "financing_cost_change": "debt_ratio cash_buffer hedging fixed_cost_share",
    "currency_change": "currency_revenue_exposure currency_cost_exposure hedging pricing_power",
    "regulatory_cost_change": "regulatory_exposure pricing_power cash_buffer",
    "tax_change": "tax_exposure pricing_power cash_buffer",
    "subsidy_change": "subsidy_exposure cash_buffer pricing_power",
    "competitive_pressure_change": "competitive_pressure demand_exposure pricing_power customer_concentration",
    "contract_change": "contract_revenue_share customer_concentration pricing_power",
    "labor_cost_change": "labor_intensity pricing_power fixed_cost_share",
}
#: Signs of effects relative to the direction, by state: those that rise with it, and those that fall.
RISE = {
    "revenue_expectation": "output_price_change demand_change supply_change capacity_change customer_dependency_change subsidy_change contract_change",
    "demand": "demand_change customer_dependency_change contract_change",
    "operating_costs": "input_cost_change capacity_change supplier_disruption regulatory_cost_change labor_cost_change",
    "margin_expectation": "demand_change supply_change customer_dependency_change subsidy_change contract_change",
    "supply_risk": "input_cost_change supplier_disruption labor_cost_change",
    "competitive_position": "subsidy_change contract_change",
}
FALL = {
    "revenue_expectation": "supplier_disruption financing_cost_change competitive_pressure_change",
    "demand": "output_price_change competitive_pressure_change",
    "operating_costs": "supply_change subsidy_change",
    "margin_expectation": "input_cost_change supplier_disruption financing_cost_change regulatory_cost_change tax_change competitive_pressure_change labor_cost_change",
    "supply_risk": "supply_change capacity_change",
    "competitive_position": "input_cost_change customer_dependency_change financing_cost_change regulatory_cost_change tax_change competitive_pressure_change labor_cost_change",
}
IMPACT = "(0.75 * revenue_expectation + 0.5 * demand - 0.75 * operating_costs + margin_expectation - 0.5 * supply_risk + 0.25 * competitive_position)"


def doubled(text: str) -> str:
    """Decimal numbers as doubles."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", text)


def names(text: str) -> str:
    return ", ".join(f"'{x}'" for x in text.split())


def bound(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 1 THEN 1.0e0 WHEN {x} < -1 THEN -1.0e0 ELSE {x} + 0.0e0 END"


def expected(source: str, prefix: str) -> str:
    """Adds the effects, named with the prefix, to a source of records; null where a needed factor is."""
    complete = "CASE mechanism " + " ".join(f"WHEN '{m}' THEN {' AND '.join(f'{f} IS NOT NULL' for f in need.split())}" for m, need in NEEDS.items()) + " ELSE FALSE END"
    made = ", ".join(doubled(f"CASE WHEN {complete} THEN CASE mechanism " + " ".join(f"WHEN '{m}' THEN {x}" for m, x in own.items()) + f" ELSE 0.0 END END AS raw_{s}") for s, own in EFFECTS.items())
    exposed = doubled(
        """CASE direction WHEN 'increase' THEN 1.0 WHEN 'decrease' THEN -1.0 END AS d, d * magnitude AS dm, 1.0 - inventory_buffer * exp(-horizon_days / 90.0) AS inv,
1.0 - 0.65 * cash_buffer * exp(-horizon_days / 180.0) AS liq, inv * (1 - supplier_diversification) * (1 - substitutability) AS res, CASE WHEN dm > 0 THEN liq ELSE 1.0 END AS up_liq,
CASE WHEN dm < 0 THEN liq ELSE 1.0 END AS down_liq"""
    )
    scratch = "d, dm, inv, liq, res, up_liq, down_liq, " + ", ".join(f"raw_{s}" for s in STATES)
    return f"SELECT * EXCLUDE ({scratch}), {', '.join(f'{bound(f"raw_{s}")} AS {prefix}{s}' for s in STATES)} FROM (SELECT *, {made} FROM (SELECT *, {exposed} FROM {source}))"


def unit_hash(payload: str) -> str:
    return f"(CAST(CAST(concat('0x', substr(sha256({payload}), 1, 16)) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0)"


def texts(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def general(x: str) -> str:
    return f"regexp_replace(CAST({x} + 0.0 AS VARCHAR), '\\.0$', '')"


def catalogue() -> str:
    concept = {c: s for s, c in CONCEPT_SUBJECTS.items()}
    rows = []
    for k, m in enumerate(MECHANISMS):
        for j, c in enumerate(m.classes):
            own = f"'{concept[c]}'" if c in concept else "NULL"
            rows.append(f"({k}, '{m.name}', {j}, {len(m.classes)}, '{c}', {texts(POOLS[c])}, {own})")
    return "cat(ordinal, mechanism, j, n_classes, subject_class, pool, concept) AS (VALUES " + ", ".join(rows) + ")"


def base() -> str:
    """CTEs up to rec: one labelled base record per event."""
    factors = ", ".join(
        f"CASE WHEN mechanism IN ({', '.join(repr(m.name) for m in MECHANISMS if f in m.factors)}) THEN {unit_hash(f"'42:ctx:' || CAST(user_id AS VARCHAR) || ':{f}'")} END AS {f}" for f in FACTORS
    )
    return f"""
{catalogue()},
drawn AS (
  SELECT 'case_' || CASE WHEN event_id + 1 < 1000000 THEN lpad(CAST(event_id + 1 AS VARCHAR), 6, '0') ELSE CAST(event_id + 1 AS VARCHAR) END AS id,
    mechanism, subject_class, CASE WHEN concept IS NOT NULL AND event_id % 10 = 0 THEN concept ELSE pool[CAST(event_id % len(pool) AS INT) + 1] END AS subject,
    CASE WHEN (event_id // 15) % 2 = 0 THEN 'increase' ELSE 'decrease' END AS direction, least(1.0e0, floor(value + 0.5) / 100.0e0) AS magnitude,
    'synthetic_' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS entity_id, {HORIZONS}[CAST(event_id % 7 AS INT) + 1] AS horizon_days,
    CAST(0.9 AS DOUBLE) AS confidence, 'synthetic' AS source, {factors}
  FROM events JOIN cat ON ordinal = event_id % 15 AND j = (event_id // 30) % n_classes
),
rec AS ({labelled("drawn")})"""


def labelled(source: str) -> str:
    return f"SELECT *, {bound(doubled(IMPACT))} AS economic_impact FROM ({expected(source, '')})"


def variants() -> str:
    """CTE var: the counterfactual variants."""
    needs = [(m.name, f) for m in MECHANISMS for f in FACTORS if f in m.factors]
    rows = [f"('{m}', '{f}', {k}, {v}e0, NULL)" for m, f in needs for k, v in enumerate(RATIO_GRID)]
    for m in MECHANISMS:
        rows += [f"('{m.name}', 'magnitude', {k}, {v}e0, NULL)" for k, v in enumerate(MAGNITUDE_GRID)]
        rows += [f"('{m.name}', 'direction', {k}, NULL, '{v}')" for k, v in enumerate(["increase", "decrease"])]
        rows += [f"('{m.name}', 'horizon_days', {k}, {v}e0, NULL)" for k, v in enumerate(HORIZON_GRID)]
    changed = ", ".join(f"CASE WHEN field = '{f}' THEN number ELSE {f} END AS {f}" for f in [*FACTORS, "magnitude"])
    return f"""
grid(mech, field, k, number, word) AS (VALUES {", ".join(rows)}),
changed AS (
  SELECT id || '__cf_' || field || '_' || lpad(CAST(k AS VARCHAR), 2, '0') AS id, mechanism, subject_class, subject, entity_id, confidence, source, {changed},
    CASE WHEN field = 'direction' THEN word ELSE direction END AS direction, CASE WHEN field = 'horizon_days' THEN CAST(number AS INT) ELSE horizon_days END AS horizon_days,
    id AS base_record_id, 'cf:' || id || ':' || field AS group_id, field AS varied_field, k AS variant_index
  FROM drawn JOIN grid ON mech = mechanism
),
var AS ({labelled("changed")})"""


COLUMNS = ", ".join(["id", "mechanism", "subject_class", "subject", "direction", "magnitude", "entity_id", "horizon_days", "confidence", "source", *FACTORS, *STATES, "economic_impact"])


def combination() -> str:
    return "(" + " OR ".join(f"coalesce({a} >= 0.75 AND {b} >= 0.75, FALSE)" for a, b in OOD_PAIRS) + ")"


CONCEPT = "(regexp_replace(trim(replace(lower(subject), '-', ' ')), '\\s+', '_', 'g') IN ({}))".format(", ".join(f"'{s}'" for s in CONCEPT_SUBJECTS))


def families() -> str:
    """CTEs all_rec, fam: all records, and one row per family with its split, under the default policy."""
    return f"""
all_rec AS (SELECT {COLUMNS}, NULL AS base_record_id FROM rec UNION ALL SELECT {COLUMNS}, base_record_id FROM var),
ent AS (
  SELECT entity_id, row_number() OVER (ORDER BY {unit_hash("'42:entity:' || entity_id")}, entity_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT entity_id FROM all_rec)
),
fam AS (
  SELECT family_key, f.entity_id, n_records, CASE
      WHEN r <= CASE WHEN n = 1 THEN CAST(floor(n * 0.1e0) AS BIGINT) ELSE greatest(1, least(CAST(floor(n * 0.1e0) AS BIGINT), n - 1)) END THEN 'test_entity_ood'
      WHEN concept THEN 'test_concept_ood' WHEN par AND comb THEN 'test_hard_ood' WHEN par THEN 'test_parameter_ood' WHEN comb THEN 'test_combination_ood'
      WHEN u < 0.1e0 THEN 'validation' WHEN u < 0.2e0 THEN 'test_iid' ELSE 'train' END AS split
  FROM (
    SELECT coalesce(base_record_id, id) AS family_key, min(entity_id) AS entity_id, count(*) AS n_records, bool_or({CONCEPT}) AS concept,
      bool_or(base_record_id IS NULL AND magnitude >= 0.98) AS par, bool_or({combination()}) AS comb, {unit_hash("'42:family:' || coalesce(base_record_id, id)")} AS u
    FROM all_rec GROUP BY coalesce(base_record_id, id)
  ) f JOIN ent ON ent.entity_id = f.entity_id
)"""


def issues() -> str:
    """All (id, code, path) of the records in CTE tam, which has effects by formula as x_<state>."""
    needs = {m: need.split() for m, need in NEEDS.items()}
    fits = "coalesce(direction IN ('increase', 'decrease') AND CASE mechanism " + " ".join(
        f"WHEN '{m.name}' THEN subject_class IN ({names(' '.join(m.classes))}) AND {' AND '.join(f'{f} IS NOT NULL AND {f} BETWEEN 0 AND 1' for f in needs[m.name])}" for m in MECHANISMS
    ) + " ELSE FALSE END, FALSE)"
    known = f"mechanism IN ({names(' '.join(needs))})"
    recomputed = f"{known} AND horizon_days >= 1 AND lower(source) NOT IN ('teacher', 'curated', 'real')"
    paths = {"magnitude": "event.magnitude", "economic_impact": "economic_impact", "confidence": "confidence"} | {f: f"context.{f}" for f in FACTORS} | {s: f"state_delta.{s}" for s in STATES}
    found = [("invalid_horizon", "horizon_days", "horizon_days < 1"), ("mechanism_contract", "event.mechanism", f"NOT {fits}"), ("state_labeling_failure", "state_delta", f"{recomputed} AND NOT {fits}")]
    for x, path in paths.items():
        low = -1 if x in STATES or x == "economic_impact" else 0
        found.append(("number_out_of_bounds", path, f"{x} IS NOT NULL AND NOT isnan({x}) AND ({x} < {low} OR {x} > 1)"))
        found.append(("non_finite_number", path, f"isnan({x})" if x in FACTORS else f"({x} IS NULL OR isnan({x}))"))
    for x in STATES:
        affects = f"mechanism IN ({names(' '.join(EFFECTS[x]))})"
        found.append(("undeclared_state_effect", f"state_delta.{x}", f"{known} AND NOT {affects} AND NOT isnan({x}) AND abs({x}) > 1e-12"))
        found.append(("state_delta_mismatch", f"state_delta.{x}", f"{recomputed} AND {fits} AND ({x} IS NULL OR isnan({x}) OR abs({x} - x_{x}) > 1e-12)"))
        for sign, rule in (("", RISE), ("-", FALL)):
            way = f"{sign}{x} * CASE direction WHEN 'increase' THEN 1 ELSE -1 END"
            found.append(("state_sign_invariant", f"state_delta.{x}", f"mechanism IN ({names(rule[x])}) AND NOT isnan({x}) AND {way} < -1e-12"))
    unsound = " OR ".join(f"{x} IS NULL OR isnan({x})" for x in STATES)
    found.append(("impact_failure", "economic_impact", f"({unsound})"))
    found.append(("economic_impact_mismatch", "economic_impact", f"NOT ({unsound}) AND (economic_impact IS NULL OR isnan(economic_impact) OR abs(economic_impact - ({bound(doubled(IMPACT))})) > 1e-12)"))
    for code, x, than in (("margin", "margin_expectation", "operating_costs"), ("supply", "supply_risk", "operating_costs"), ("competition", "competitive_position", "margin_expectation")):
        found.append((f"input_cost_{code}_invariant", f"state_delta.{x}", f"mechanism = 'input_cost_change' AND NOT isnan({x}) AND abs({x}) > abs({than}) + 1e-12"))
    # NaN is the largest number in both engines, so a NaN state that is compared with is no smaller than any other.
    rows = ", ".join(f"CASE WHEN {broken} THEN {{'code': '{code}', 'path': '{path}'}} END" for code, path, broken in found)
    return f"SELECT id, i.code AS code, i.path AS path FROM (SELECT id, unnest([{rows}]) AS i FROM ({expected('tam', 'x_')})) WHERE i IS NOT NULL"


def violations() -> str:
    """All (kind, key, n_splits) of the records in CTE t, which have a split and the family's key k."""
    early = "'test_entity_ood', 'test_concept_ood'"
    leak = "SELECT '{}', k, count(DISTINCT split) FROM t WHERE {} AND split NOT IN ({}) GROUP BY k"
    return f"""SELECT kind, key, n_splits FROM (
SELECT 'unknown_split' AS kind, split AS key, count(DISTINCT split) AS n_splits FROM t WHERE split NOT IN ({names(' '.join(SPLITS))}) GROUP BY split
UNION ALL SELECT 'duplicate_id', id, count(DISTINCT split) FROM t GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'family_leak', k, count(DISTINCT split) FROM t GROUP BY k HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'entity_leak', entity_id, count(DISTINCT split) FROM t GROUP BY entity_id HAVING count(DISTINCT split) > 1 AND bool_or(split = 'test_entity_ood')
UNION ALL {leak.format('concept_leak', CONCEPT, early)}
UNION ALL {leak.format('combination_leak', combination(), early + ", 'test_combination_ood', 'test_hard_ood'")}
UNION ALL {leak.format('parameter_leak', 'magnitude >= 0.98', early + ", 'test_parameter_ood', 'test_hard_ood'")})"""


def scored() -> str:
    """CTE sco: base records with target, prediction and split (of families with all variants)."""
    noise = f"({unit_hash("'42:pred:' || id")} - 0.5e0) * 0.4e0"
    return f"sco AS (SELECT rec.*, split, economic_impact AS target, greatest(-1.0e0, least(1.0e0, economic_impact + {noise})) AS prediction FROM rec JOIN fam ON family_key = id)"


def direction(x: str) -> str:
    return f"(CASE WHEN {x} < -0.05 THEN -1 WHEN {x} > 0.05 THEN 1 ELSE 0 END)"


METRICS = f"""count(*) AS n, round(avg(abs(target - prediction)), 9) AS mae, round(avg(CASE WHEN {direction("target")} = {direction("prediction")} THEN 1.0 ELSE 0.0 END), 9) AS sign_accuracy,
count(*) FILTER (abs(target) >= 0.5) AS strong_n, round(avg(abs(target - prediction)) FILTER (abs(target) >= 0.5), 9) AS strong_mae"""


def with_parts(select: str, *parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select
