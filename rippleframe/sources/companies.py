"""Synthetic companies: each is drawn by a generator of its own, seeded by its index, so tasks draw them independently."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.operators.catalog import FACTORS, MECHANISMS

#: Fixed value of the data contract: part of every seed.
VERSION = "companies-v1"
SHARES = ["energy", "materials", "labor", "financing"]
COLUMNS = ["company_id", *[f"{s}_share" for s in SHARES], *FACTORS]


@dataclass(frozen=True)
class Beta:
    """A beta-distributed ratio, scaled to [low, high]."""

    alpha: float
    beta: float
    low: float = 0.0
    high: float = 1.0

    def draw(self, rng: random.Random, known: dict[str, float]) -> float:
        if not 0.0 <= self.low <= self.high <= 1.0 or not (self.alpha > 0 and self.beta > 0):
            raise ValueError(f"no ratio distribution: {self}")
        if self.low == self.high:
            return self.low
        return min(self.high, max(self.low, self.low + (self.high - self.low) * rng.betavariate(self.alpha, self.beta)))


@dataclass(frozen=True)
class Normal:
    """A normal ratio in [low, high]: draws outside are drawn again, the last of `attempts` is clamped."""

    mean: float
    deviation: float
    low: float = 0.0
    high: float = 1.0
    attempts: int = 128

    def draw(self, rng: random.Random, known: dict[str, float]) -> float:
        if not 0.0 <= self.low <= self.mean <= self.high <= 1.0 or self.deviation < 0 or self.attempts < 1:
            raise ValueError(f"no ratio distribution: {self}")
        x = self.mean
        if self.low == self.high or self.deviation == 0:
            return x
        for _ in range(self.attempts):
            x = rng.normalvariate(self.mean, self.deviation)
            if self.low <= x <= self.high:
                break
        return min(self.high, max(self.low, x))


@dataclass(frozen=True)
class Near:
    """A ratio that a normal draw and an anchor share: the anchor's part is |pull|, mirrored in [0, 1] for a negative one."""

    anchor: str | Callable[[dict[str, float]], float]
    pull: float
    mean: float | str
    deviation: float

    def draw(self, rng: random.Random, known: dict[str, float]) -> float:
        at = known[self.anchor] if isinstance(self.anchor, str) else self.anchor(known)
        mean = known[self.mean] if isinstance(self.mean, str) else self.mean
        if not 0.0 <= at <= 1.0 or not -1.0 <= self.pull <= 1.0:
            raise ValueError(f"no correlated ratio: {self} at {at}")
        own = Normal(mean, self.deviation).draw(rng, known)
        goal, part = at if self.pull >= 0 else 1.0 - at, abs(self.pull)
        return min(1.0, max(0.0, part * goal + (1.0 - part) * own))


class Shares:
    """Cost shares: gamma weights, scaled to a beta-distributed total."""

    total = Beta(4.5, 2.2, 0.45, 0.93)
    #: Shape of each weight: a constant, and a multiple of an anchor.
    shapes = [(0.8, 2.2, "capital_intensity"), (1.2, 2.6, "capital_intensity"), (1.0, 3.2, "labor_orientation"), (0.6, 1.6, "capital_intensity")]

    def draw(self, rng: random.Random, known: dict[str, float]) -> list[float]:
        total = self.total.draw(rng, known)
        weights = [rng.gammavariate(a + b * known[c], 1.0) for a, b, c in self.shapes]
        whole = math.fsum(weights)
        return [total * w / whole for w in weights]


def _modelled(k: dict[str, float]) -> float:
    return math.fsum(k[s] for s in SHARES)


# Fixed values of the data contract: what is drawn, in this order, with these parameters.
DRAWS: list[tuple[str, Beta | Near | Shares]] = [
    ("capital_intensity", Beta(2.2, 2.8, 0.04, 0.94)),
    ("labor_orientation", Beta(2.0, 2.4, 0.08, 0.92)),
    ("resilience", Beta(2.8, 2.3, 0.06, 0.94)),
    ("global_exposure", Beta(1.7, 3.1, 0.01, 0.92)),
    ("competition", Beta(2.7, 2.0, 0.06, 0.96)),
    ("shares", Shares()),
    ("pricing_power", Near("competition", -0.68, 0.36, 0.17)),
    ("debt_ratio", Near("capital_intensity", 0.64, 0.42, 0.18)),
    ("cash_buffer", Near("debt_ratio", -0.58, 0.24, 0.13)),
    ("inventory_buffer", Near("resilience", 0.68, 0.27, 0.15)),
    ("supplier_diversification", Near("resilience", 0.73, 0.42, 0.18)),
    ("substitutability", Near("resilience", 0.61, 0.39, 0.19)),
    ("input_dependency", Near(lambda k: min(1.0, (k["energy"] + k["materials"]) / _modelled(k)), 0.76, 0.38, 0.17)),
    ("output_dependency", Beta(2.6, 1.8, 0.10, 0.98)),
    ("demand_exposure", Near("output_dependency", 0.79, 0.54, 0.17)),
    ("hedging", Near(lambda k: math.fsum((k["capital_intensity"], k["cash_buffer"], k["global_exposure"])) / 3.0, 0.54, 0.25, 0.16)),
    ("customer_concentration", Beta(1.45, 4.0, 0.01, 0.94)),
    ("currency_revenue_exposure", Near("global_exposure", 0.76, 0.20, 0.15)),
    ("currency_cost_exposure", Near(lambda k: math.fsum((k["global_exposure"], k["input_dependency"])) / 2.0, 0.69, 0.22, 0.15)),
    ("regulatory_exposure", Near(lambda k: math.fsum((k["capital_intensity"], _modelled(k))) / 2.0, 0.46, 0.38, 0.18)),
    ("tax_exposure", Beta(3.0, 1.8, 0.12, 0.98)),
    ("subsidy_exposure", Beta(1.05, 6.0, 0.0, 0.72)),
    ("competitive_pressure", Near("pricing_power", -0.77, "competition", 0.16)),
    ("contract_revenue_share", Near("customer_concentration", 0.72, 0.27, 0.16)),
    ("capacity_utilization", Near("demand_exposure", 0.34, 0.72, 0.12)),
    ("fixed_cost_share", Near(lambda k: min(1.0, 0.68 * k["capital_intensity"] + 0.22 * k["financing"] + 0.10 * k["energy"]), 0.72, 0.43, 0.16)),
]


def derived_seed(seed: int, index: int) -> int:
    """128 bits of a hash of version, seed and index."""
    return int.from_bytes(hashlib.sha256(f"{VERSION}:{seed}:{index}".encode("ascii")).digest()[:16], "big")


def company(seed: int = 42, index: int = 1) -> dict[str, float | str]:
    """One company, the same wherever and in whatever order it is drawn. index counts from 1."""
    if isinstance(seed, bool) or not isinstance(seed, int) or isinstance(index, bool) or not isinstance(index, int) or index < 1:
        raise ValueError("seed and index are integers, the index at least 1")
    rng, known = random.Random(derived_seed(seed, index)), {}
    for name, rule in DRAWS:
        found = rule.draw(rng, known)
        known |= dict(zip(SHARES, found, strict=True)) if isinstance(rule, Shares) else {name: found}
    known["labor_intensity"] = known["labor"]
    return {"company_id": f"synthetic_{index:05d}"} | {f"{s}_share": known[s] for s in SHARES} | {f: known[f] for f in FACTORS}


def companies(spark: SparkSession, count: int, seed: int = 42) -> DataFrame:
    """Companies 1 to count, one row each, drawn by tasks. None for a count of 0."""
    if count < 0:
        raise ValueError("count is at least 0")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [company(seed, i + 1) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string() if c == "company_id" else pa.float64()) for c in COLUMNS], names=COLUMNS)

    return spark.range(count).mapInArrow(work, ", ".join(f"{c} {'string' if c == 'company_id' else 'double'}" for c in COLUMNS))


def problems() -> Column:
    """What breaks the rules of a company: unknown or unbounded factors, shares beyond 1, a labour share that differs."""
    found = [F.when(~F.coalesce(F.col(f).between(0, 1), F.lit(False)), F.lit(f)) for f in [*FACTORS, *[f"{s}_share" for s in SHARES]]]
    total = F.col("energy_share") + F.col("materials_share") + F.col("labor_share") + F.col("financing_share")
    found.append(F.when(total > 1 + 1e-12, F.lit("shares")))
    found.append(F.when(F.abs(F.col("labor_intensity") - F.col("labor_share")) > 1e-12, F.lit("labor")))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def context_for(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """rows (mechanism, company_id, ...) with the factors of their company that the mechanism needs; others are null.

    A company or a mechanism that is not known leaves all factors null.
    """
    chosen = owners.select("company_id", *FACTORS)
    out = rows.join(chosen, "company_id", "left")
    for f in FACTORS:
        needs = [m.name for m in MECHANISMS if f in m.factors]
        out = out.withColumn(f, F.when(F.col("mechanism").isin(needs), F.col(f)))
    return out
