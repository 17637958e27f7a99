"""State labels and economic impact as Column expressions in layers: exposures, effects, bounds; no user functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.functions.exprs import let
from rippleframe.operators.catalog import MECHANISMS, STATES, WEIGHTS, Mechanism

EXPOSURES = {
    "_sign": "CASE direction WHEN 'increase' THEN 1.0e0 WHEN 'decrease' THEN -1.0e0 END",
    "_inventory": "1 - inventory_buffer * exp(-horizon_days / 90.0e0)",
    "_liquidity": "1 - 0.65e0 * cash_buffer * exp(-horizon_days / 180.0e0)",
    "_residual": "(1 - inventory_buffer * exp(-horizon_days / 90.0e0)) * (1 - supplier_diversification) * (1 - substitutability)",
}
_NAMES = {"sign": "_sign", "inventory_exposure": "_inventory", "liquidity_exposure": "_liquidity", "residual_exposure": "_residual"}


def _filled(text: str, names: dict[str, str]) -> str:
    text = re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", text)  # doubles, not decimals
    return re.sub(r"\b[a-z_]+\b", lambda x: names.get(x[0], x[0]), text)


def effects_sql(m: Mechanism) -> str:
    """A struct of the effects of one mechanism on all states, before they are bounded; null if a needed factor is."""
    names = dict(_NAMES)
    for term, text in m.terms.items():
        names[term] = f"({_filled(text, names)})"
    made = ", ".join(f"'{s}', CAST({_filled(m.effects[s], names) if s in m.effects else '0.0e0'} AS DOUBLE)" for s in STATES)
    return f"CASE WHEN {' AND '.join(f'{f} IS NOT NULL' for f in m.factors)} THEN named_struct({made}) END"


def bounded(x: Column) -> Column:
    """In [-1, 1]. Unknown and non-finite values are null, not a bound."""
    # x - x is 0, null for an unknown x, and NaN for one without end.
    return F.nanvl(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) + (x - x), F.lit(None).cast("double"))


def impact(states: dict[str, Column] | None = None) -> Column:
    """The weighted sum of six states, bounded; null if one is unknown."""
    total = F.lit(0.0)
    for s, w in WEIGHTS.items():
        total = total + F.lit(w) * (F.col(s) if states is None else states[s])
    return bounded(total)


def with_effects(rows: DataFrame, names: dict[str, str], barrier: bool = False) -> DataFrame:
    """Adds the bounded effect on each state, named by `names`, to rows with mechanism, direction, magnitude, horizon_days
    and the factors. It is 0 for a state that the mechanism does not affect. All are null if the mechanism or direction is
    unknown, or a factor that the mechanism needs.

    barrier: the effects come out of a generator, so that a filter on them stays above and does not copy all formulas. A
    generator can't be pruned, though; without one, a reader of other columns evaluates no formula."""
    rows = rows.withColumns({k: F.expr(v) for k, v in EXPOSURES.items()})
    raw = F.expr("CASE mechanism " + " ".join(f"WHEN '{m.name}' THEN {effects_sql(m)}" for m in MECHANISMS) + " END")
    raw = F.when(F.col("_sign").isNotNull(), raw)  # a row evaluates the formulas of its own mechanism only
    # The formulas of all mechanisms in one generated method would be too long to be compiled. Inside of let() they are
    # evaluated as a tree, a branch of it for each row, and the stage's method stays short.
    rows = rows.withColumn("_raw", F.explode_outer(F.array(raw)) if barrier else let(F.lit(0), lambda _: raw)).withColumns({names[s]: bounded(F.col("_raw")[s]) for s in STATES})
    return rows.drop(*EXPOSURES, "_raw")


def labelled(rows: DataFrame, barrier: bool = False) -> DataFrame:
    """Adds the six state fields and economic_impact. They are null where with_effects() says so."""
    return with_effects(rows, {s: s for s in STATES}, barrier).withColumn("economic_impact", impact())


def require_labels(rows: DataFrame) -> DataFrame:
    """labelled(), but a record whose labels cannot be computed fails the job."""
    out = labelled(rows, barrier=True)
    known = F.when(F.col("economic_impact").isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit("no finite label: "), F.col("id"))).cast("boolean"))
    return out.where(known)
