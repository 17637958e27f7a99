"""Record verification: every rule as a condition with a code; a record's issues are an array, without a user function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.operators.catalog import BY_NAME, DIRECTIONS, FACTORS, INDEPENDENT_SOURCES, MECHANISMS, STATES, WEIGHTS
from rippleframe.operators.labels import impact, with_effects

TOLERANCE = 1e-12
#: Columns of the effects by formula.
EXPECTED = {s: f"_expected_{s}" for s in STATES}


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _differ(x: Column, y: Column) -> Column:
    return ~_true(_finite(x) & _finite(y) & (F.abs(x - y) <= TOLERANCE))


def registry_issues(mechanisms: list = MECHANISMS) -> list[tuple[str, str]]:
    """(code, path) of contradictions in the catalogue itself; they hold for every record."""
    names = [m.name for m in mechanisms]
    out = []
    if names != list(BY_NAME):
        out.append(("registry_schema_mismatch", "event.mechanism"))
    if len(set(names)) != len(names) or any(not set(m.factors) <= set(FACTORS) for m in mechanisms):
        out.append(("registry_definition_mismatch", "event.mechanism"))
    if any(not m.effects or not set(m.effects) <= set(STATES) for m in mechanisms) or set(WEIGHTS) != set(STATES):
        out.append(("registry_labeler_mismatch", "event.mechanism"))
    if any(not set(m.signs) <= set(m.effects) for m in mechanisms):
        out.append(("registry_sign_rule_mismatch", "state_delta"))
    return out


def rules() -> list[tuple[str, str, Column]]:
    """(code, path, condition that breaks the rule); the effects by formula are in the columns EXPECTED."""
    mechanism = F.col("mechanism")
    d = F.when(F.col("direction") == "increase", 1.0).otherwise(-1.0)
    out = [(code, path, F.lit(True)) for code, path in registry_issues()]
    out.append(("invalid_horizon", "horizon_days", ~_true(F.col("horizon_days") >= 1)))
    paths = {"magnitude": "event.magnitude", "economic_impact": "economic_impact", "confidence": "confidence"}
    paths |= {f: f"context.{f}" for f in FACTORS} | {s: f"state_delta.{s}" for s in STATES}
    for name, path in paths.items():
        x, low = F.col(name), -1.0 if name in STATES or name == "economic_impact" else 0.0
        needed = x.isNotNull() if name in FACTORS else F.lit(True)
        out.append(("non_finite_number", path, needed & ~_true(_finite(x))))
        out.append(("number_out_of_bounds", path, _true(_finite(x) & ((x < low) | (x > 1.0)))))
    fits = F.lit(False)
    for m in MECHANISMS:
        complete = F.col("subject_class").isin(m.classes) & F.expr(" AND ".join(f"coalesce({f} BETWEEN 0 AND 1, FALSE)" for f in m.factors))
        fits = F.when(mechanism == m.name, complete).otherwise(fits)
    fits = _true(fits & F.col("direction").isin(DIRECTIONS))
    known = _true(mechanism.isin(list(BY_NAME)))
    out.append(("mechanism_contract", "event.mechanism", ~fits))
    recomputed = known & _true(F.col("horizon_days") >= 1) & ~_true(F.lower("source").isin(INDEPENDENT_SOURCES))
    out.append(("state_labeling_failure", "state_delta", recomputed & ~fits))
    for s in STATES:
        affected = mechanism.isin([m.name for m in MECHANISMS if s in m.effects])
        out.append(("undeclared_state_effect", f"state_delta.{s}", _true(known & ~affected & _finite(F.col(s)) & (F.abs(F.col(s)) > TOLERANCE))))
        out.append(("state_delta_mismatch", f"state_delta.{s}", recomputed & fits & _differ(F.col(s), F.col(EXPECTED[s]))))
        for sign in (1, -1):
            bound = mechanism.isin([m.name for m in MECHANISMS if m.signs.get(s) == sign])
            out.append(("state_sign_invariant", f"state_delta.{s}", _true(bound & _finite(F.col(s)) & (F.col(s) * d * sign < -TOLERANCE))))
    summed = F.lit(True)
    for s in STATES:
        summed = summed & _finite(F.col(s))
    out.append(("impact_failure", "economic_impact", ~_true(summed)))
    out.append(("economic_impact_mismatch", "economic_impact", _true(summed) & _differ(F.col("economic_impact"), impact())))
    cost = mechanism == "input_cost_change"
    for code, small, large in (
        ("input_cost_margin_invariant", "margin_expectation", "operating_costs"),
        ("input_cost_supply_invariant", "supply_risk", "operating_costs"),
        ("input_cost_competition_invariant", "competitive_position", "margin_expectation"),
    ):
        out.append((code, f"state_delta.{small}", _true(cost & _finite(F.col(small)) & (F.abs(F.col(small)) > F.abs(F.col(large)) + TOLERANCE))))
    return out


def sound() -> Column:
    """True only where no rule is broken; false or null where one may be. A few comparisons for a whole record: extremes
    stand for all numbers (a null drops out of them, and NaN is the largest of numbers), sums for all that must be known."""
    ratios, outcomes = ["magnitude", "confidence", *FACTORS], [*STATES, "economic_impact"]

    def all_known(names: list[str]) -> Column:
        total = F.col(names[0])
        for name in names[1:]:
            total = total + F.col(name)
        return total.isNotNull()

    out = F.lit(not registry_issues()) & (F.col("horizon_days") >= 1) & F.col("direction").isin(DIRECTIONS)
    out = out & all_known(["magnitude", "confidence", *outcomes, *EXPECTED.values()])
    out = out & (F.greatest(*ratios) <= 1.0) & (F.least(*ratios) >= 0.0) & (F.greatest(*outcomes) <= 1.0) & (F.least(*outcomes) >= -1.0)
    # A state that the mechanism doesn't affect is expected to be 0.
    out = out & (F.greatest(*[F.abs(F.col(s) - F.col(EXPECTED[s])) for s in STATES]) <= TOLERANCE) & (F.abs(F.col("economic_impact") - impact()) <= TOLERANCE)
    own = "CASE mechanism"
    for m in MECHANISMS:
        classes = ", ".join(f"'{c}'" for c in m.classes)
        own += f" WHEN '{m.name}' THEN subject_class IN ({classes}) AND {' + '.join(m.factors)} IS NOT NULL"
        for s, sign in m.signs.items():
            own += f" AND {s} * (CASE WHEN direction = 'increase' THEN 1.0e0 ELSE -1.0e0 END) * {sign}.0e0 >= -{TOLERANCE}D"
    bounded_by = F.abs(F.col("operating_costs")) + TOLERANCE
    costs = (F.greatest(F.abs(F.col("margin_expectation")), F.abs(F.col("supply_risk"))) <= bounded_by) & (F.abs(F.col("competitive_position")) <= F.abs(F.col("margin_expectation")) + TOLERANCE)
    return out & F.expr(own + " END") & ((F.col("mechanism") != "input_cost_change") | costs)


def verified(records: DataFrame, where: Column | None = None) -> DataFrame:
    """Records with `issues`, an array of (code, path), and `valid`. where: records to verify; others have no issues.

    The issues come out of a generator, so that a filter on them stays above and does not copy the rules. Only records
    that may break a rule are held against each of them.
    """
    found = F.array(*[F.when(broken, F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"))) for code, path, broken in rules()])
    none = F.lit(None).cast("struct<code:string,path:string>")
    rows = with_effects(records, EXPECTED, barrier=True).withColumn("issues", F.explode_outer(F.array(F.when(sound() if where is None else ~where | sound(), F.filter(F.array(none), lambda x: F.lit(False))).otherwise(F.filter(found, lambda x: x.isNotNull())))))
    return rows.drop(*EXPECTED.values()).withColumn("valid", F.size("issues") == 0)


def require_valid(records: DataFrame) -> DataFrame:
    """The records, unchanged; the first record that breaks a rule fails the job with what it breaks."""
    checked = verified(records)
    text = F.array_join(F.transform("issues", lambda x: F.concat(x["path"], F.lit(": "), x["code"])), "; ")
    return checked.where(F.when(F.col("valid"), True).otherwise(F.raise_error(F.concat(F.col("id"), F.lit(" "), text)).cast("boolean"))).drop("issues", "valid")
