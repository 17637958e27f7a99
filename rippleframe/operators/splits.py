"""Leakage-free splits: whole families and entities go to one split; integrity checks as violation queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.functions.exprs import subject_token, unit_hash
from rippleframe.operators.catalog import CONCEPT_SUBJECTS, DIRECTIONS, HORIZON_GRID, MAGNITUDE_GRID, MECHANISMS, OOD_PAIRS, RATIO_GRID, SPLITS
from rippleframe.operators.expand import inputs_of_families, with_families


@dataclass(frozen=True)
class Policy:
    seed: int = 42
    validation: float = 0.1
    iid_test: float = 0.1
    entity_ood: float = 0.1
    concept_subjects: tuple[str, ...] = tuple(CONCEPT_SUBJECTS)

    def __post_init__(self):
        for x in (self.validation, self.iid_test, self.entity_ood):
            if not 0 <= x < 1:
                raise ValueError("fractions lie in [0, 1)")
        if self.validation + self.iid_test >= 1:
            raise ValueError("validation and iid test leave nothing to train on")


def is_parameter_ood() -> Column:
    return F.col("magnitude") >= 0.98


def is_combination_ood() -> Column:
    out = F.lit(False)
    for a, b in OOD_PAIRS:
        out = out | F.coalesce((F.col(a) >= 0.75) & (F.col(b) >= 0.75), F.lit(False))
    return out


def is_hard_ood() -> Column:
    return is_parameter_ood() & is_combination_ood()


def is_concept_ood(subjects: tuple[str, ...] = tuple(CONCEPT_SUBJECTS)) -> Column:
    return subject_token(F.col("subject")).isin(list(subjects))


def family_key() -> Column:
    return F.coalesce(F.col("base_record_id"), F.col("id"))


def held_out_entities(records: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """entity_id: the first of all entities by hash; a distributed top-k, not a window over all entities.

    Every family has a base record with the family's entity, so variants need not be made for it.
    """
    rows = records.where("base_record_id is null") if "base_record_id" in records.columns else records
    entities = rows.select("entity_id").distinct()
    n = entities.count()
    if policy.entity_ood == 0 or n == 0:
        return entities.limit(0)
    k = int(n * policy.entity_ood)
    k = k if n == 1 else max(1, min(k, n - 1))
    return entities.orderBy(unit_hash(policy.seed, F.concat(F.lit("entity:"), F.col("entity_id"))), "entity_id").limit(k)


def families(records: DataFrame, policy: Policy = Policy(), *sums: Column) -> DataFrame:
    """One row per family. Partial aggregation leaves one row a family before the only large shuffle. sums: more aggregates."""
    base = F.col("base_record_id").isNull()
    return records.groupBy(family_key().alias("family_key")).agg(
        F.min("entity_id").alias("entity_id"),
        F.max("entity_id").alias("other_entity_id"),
        F.count_if(base).alias("n_base"),
        F.bool_or(is_concept_ood(policy.concept_subjects)).alias("concept"),
        F.coalesce(F.bool_or(base & is_parameter_ood()), F.lit(False)).alias("parameter"),
        F.bool_or(is_combination_ood()).alias("combination"),
        F.count(F.lit(1)).alias("n_records"),
        *sums,
    )


def families_of_bases(base: DataFrame, policy: Policy = Policy(), more: list[str] | None = None) -> DataFrame:
    """families(with_families(base)) without making the variants. more: other columns of the base record.

    A grid has 1, so a factor that the mechanism needs reaches the bound in one of its variants; the other factor of a pair
    must have it in the base record. No grid of magnitudes reaches that bound. Subjects and entities do not vary.
    """
    mechanism, both, n = F.col("mechanism"), is_combination_ood(), F.lit(0)
    for x, y in OOD_PAIRS:  # one term for all mechanisms: a method with one for each would be too long to be compiled
        for varied, fixed in ((x, y), (y, x)):
            both = both | F.coalesce(mechanism.isin([m.name for m in MECHANISMS if varied in m.factors]) & (F.col(fixed) >= 0.75), F.lit(False))
    for k in sorted({len(m.factors) for m in MECHANISMS}):
        size = 1 + k * len(RATIO_GRID) + len(MAGNITUDE_GRID) + len(DIRECTIONS) + len(HORIZON_GRID)
        n = F.when(mechanism.isin([m.name for m in MECHANISMS if len(m.factors) == k]), size).otherwise(n)
    more = [] if more is None else more
    return base.select(
        F.col("id").alias("family_key"), "entity_id", F.col("entity_id").alias("other_entity_id"), F.lit(1).alias("n_base"), is_concept_ood(policy.concept_subjects).alias("concept"),
        F.coalesce(is_parameter_ood(), F.lit(False)).alias("parameter"), both.alias("combination"), n.cast("long").alias("n_records"), *more,
    )


def assigned(records: DataFrame, policy: Policy = Policy(), rows: DataFrame | None = None) -> DataFrame:
    """families() with its split, and what else `rows`, the families, has. A family of two entities, or without one base
    record, is an error."""
    held = held_out_entities(records, policy).select(F.col("entity_id").alias("held_entity"))
    rows = families(records, policy) if rows is None else rows
    more = [c for c in rows.columns if c not in ("family_key", "entity_id", "other_entity_id", "n_base", "concept", "parameter", "combination", "n_records")]
    rows = rows.join(held, F.col("entity_id") == F.col("held_entity"), "left")
    draw = unit_hash(policy.seed, F.concat(F.lit("family:"), F.col("family_key")))
    entity, concept = F.col("held_entity").isNotNull(), F.col("concept")
    split = (
        F.when(F.col("entity_id") != F.col("other_entity_id"), F.raise_error(F.concat(F.lit("family of more than one entity: "), F.col("family_key"))))
        .when(entity, "test_entity_ood")
        .when(concept, "test_concept_ood")
        .when(F.col("n_base") != 1, F.raise_error(F.concat(F.lit("family without one base record: "), F.col("family_key"))))
        .when(F.col("parameter") & F.col("combination"), "test_hard_ood")
        .when(F.col("parameter"), "test_parameter_ood")
        .when(F.col("combination"), "test_combination_ood")
        .when(draw < policy.validation, "validation")
        .when(draw < policy.validation + policy.iid_test, "test_iid")
        .otherwise("train")
    )
    return rows.select("family_key", "entity_id", "n_records", split.alias("split"), *more)


def split_records(records: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Records with their split."""
    return records.withColumn("family_key", family_key()).join(assigned(records, policy).select("family_key", "split"), "family_key")


def split_bases(base: DataFrame, policy: Policy = Policy(), flags: bool = False) -> DataFrame:
    """Base records with the family_key and split of their family. With_families() of them equals split_records() of all
    records, but only base records, and no variant, are joined to a split. flags: also n_records of the family, and whether
    one of them is out of distribution, as family_concept, family_parameter and family_combination."""
    rows = families_of_bases(base, policy, [c for c in base.columns if c != "entity_id"])
    if flags:
        rows = rows.withColumns({f"family_{c}": F.col(c) for c in ("concept", "parameter", "combination")})
        return assigned(base, policy, rows)
    return assigned(base, policy, rows).drop("n_records")


_EARLY = ["test_entity_ood", "test_concept_ood"]
_ALLOWED = {
    "concept_leak": _EARLY,
    "combination_leak": [*_EARLY, "test_combination_ood", "test_hard_ood"],
    "parameter_leak": [*_EARLY, "test_parameter_ood", "test_hard_ood"],
}


def violations(records: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """kind, key, n_splits: what breaks the rules of splits; records have a split. A sound dataset gives no row."""
    split = F.col("split")

    def leak(kind: str, where: Column) -> Column:
        return F.coalesce(F.bool_or(where & ~split.isin(_ALLOWED[kind])), F.lit(False)).alias(kind)

    # A row for each family, entity and split, which holds all that the rules ask for but repeated ids.
    groups = records.groupBy(family_key().alias("family"), "entity_id", "split").agg(
        leak("concept_leak", is_concept_ood(policy.concept_subjects)),
        leak("combination_leak", is_combination_ood()),
        leak("parameter_leak", is_parameter_ood()),
    )

    def asked(kind: str, what: str, where: Column | None = None) -> Column:
        found = F.struct(F.lit(kind).alias("kind"), F.col(what).alias("key"))
        return found if where is None else F.when(where, found)

    kinds = [asked("family_leak", "family"), asked("entity_leak", "entity_id"), asked("unknown_split", "split", ~split.isin(SPLITS))]
    kinds += [asked(k, "family", F.col(k)) for k in ("concept_leak", "combination_leak", "parameter_leak")]
    rows = groups.select("split", F.explode(F.filter(F.array(*kinds), lambda x: x.isNotNull())).alias("a")).select("a.*", "split")
    rows = rows.groupBy("kind", "key").agg(F.count_distinct("split").alias("n_splits"), F.bool_or(split == "test_entity_ood").alias("held"))
    several = F.when(F.col("kind") == "family_leak", F.col("n_splits") > 1).when(F.col("kind") == "entity_leak", F.col("held") & (F.col("n_splits") > 1)).otherwise(True)
    return rows.where(several).select("kind", "key", "n_splits").unionByName(_duplicates(records))


def _duplicates(records: DataFrame) -> DataFrame:
    """kind, key, n_splits of ids that are there more than once. Ids are shuffled as 64 bits; only those whose bits are
    there again are compared as they are."""
    ids = records.select("id", "split", F.xxhash64("id").alias("h"))
    again = ids.select("h").repartition("h").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    found = ids.join(again, "h", "left_semi").groupBy(F.col("id").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("n_splits"))
    return found.where("n > 1").select(F.lit("duplicate_id").alias("kind"), "key", "n_splits")


def violations_after(base: DataFrame, touched: Column, after: Column, policy: Policy = Policy(), bases: DataFrame | None = None) -> DataFrame:
    """violations() of the split records with_families(split_bases(base)), of which those that `touched` (a condition on id)
    holds for are in the splits of the array `after` (of id and split) instead of their own: one, several or none.
    bases: base as it is split otherwise, with the columns that split_bases() has with flags.

    Every record's id is made and asked, but no other column of those that nothing happens to. They count by their family: its
    base record has their number and, in closed form, whether one of them may break a rule. A family with such a one is looked
    at record by record. Records are added to and taken from the (entity, split) and (family, split) they are in; those that
    still have one exist. An id that is there again in base, or looks like a variant's, needs violations() itself.
    """
    ids = base.select(F.xxhash64("id").alias("h"), F.contains("id", F.lit("__cf_")).alias("odd"))
    ids = ids.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.bool_or("odd").alias("odd"))
    split, touched = F.col("split"), F.coalesce(touched, F.lit(False))
    now = F.when(touched, after).otherwise(F.array("split"))
    bases = split_bases(base, policy, flags=True) if bases is None else bases
    if not ids.where("n > 1 or odd or odd is null").isEmpty():
        return violations(with_families(bases).withColumn("split", F.explode(now)), policy)

    plain = F.coalesce(split.isin(SPLITS), F.lit(True))
    for kind, allowed in _ALLOWED.items():
        plain = plain & ~F.coalesce(F.col(f"family_{kind.removesuffix('_leak')}") & ~split.isin(allowed), F.lit(False))
    bases = bases.withColumns({"plain": plain, "n_records": F.greatest("n_records", F.lit(1).cast("long"))})
    is_base = F.col("base_record_id").isNull()
    rows = inputs_of_families(bases).where(is_base | touched | ~F.col("plain"))

    def asked(kind: str, what: str | Column, split: Column, n: int | str, size: Column | None = None, where: Column | None = None) -> Column:
        key, n = F.col(what) if isinstance(what, str) else what, F.lit(n) if isinstance(n, int) else F.col(n)
        size = F.lit(0) if size is None else size
        found = F.struct(F.lit(kind).alias("kind"), key.alias("key"), split.alias("split"), n.cast("long").alias("n"), size.cast("long").alias("size"))
        return found if where is None else F.when(where, found)

    def placed(x: Column) -> Column:
        out = [asked("family_leak", "family_key", x, 1), asked("entity_leak", "entity_id", x, 1), asked("duplicate_id", "id", x, 1), asked("unknown_split", x, x, 1, where=~x.isin(SPLITS))]
        for kind, flag in (("concept_leak", is_concept_ood(policy.concept_subjects)), ("combination_leak", is_combination_ood()), ("parameter_leak", is_parameter_ood())):
            out.append(asked(kind, "family_key", x, 1, where=flag & ~x.isin(_ALLOWED[kind])))
        return F.array(*out)

    whole = asked("entity_leak", "entity_id", split, "n_records", where=is_base & F.col("plain"))
    taken = [asked("entity_leak", "entity_id", split, -1, where=F.col("plain")), asked("family_leak", "family_key", split, -1, F.col("n_records"), F.col("plain"))]
    each = F.concat(F.array(whole, *taken), F.flatten(F.transform(now, placed)))
    rows = rows.select(F.explode(F.when(touched | ~F.col("plain"), F.filter(each, lambda x: x.isNotNull())).otherwise(F.array(whole))).alias("a")).select("a.*")
    # A row for each split that still has a record, or a leak, of the key.
    rows = rows.groupBy("kind", "key", "split").agg(F.sum("n").alias("n"), F.max("size").alias("size")).where("n + size > 0")
    rows = rows.groupBy("kind", "key").agg(F.count("split").alias("n_splits"), F.bool_or(split == "test_entity_ood").alias("held"), F.sum("n").alias("n"))
    several = F.when(F.col("kind") == "family_leak", F.col("n_splits") > 1).when(F.col("kind") == "entity_leak", F.col("held") & (F.col("n_splits") > 1))
    return rows.where(several.when(F.col("kind") == "duplicate_id", F.col("n") > 1).otherwise(True)).select("kind", "key", "n_splits")
