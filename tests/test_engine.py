"""Contract tests of the engine's own operators, and its queries against DuckDB."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from rippleframe.functions import exprs
from rippleframe.operators import metrics, serialize, splits, tokens, verify, vocabulary
from rippleframe.operators.catalog import BY_NAME, FACTORS, MECHANISMS, STATES
from rippleframe.operators.expand import counterfactuals, with_families
from rippleframe.operators.labels import labelled, require_labels, with_effects
from rippleframe.operators.records import base_records
from rippleframe.plans import contract_queries  # noqa: F401  adds its queries to the registry
from rippleframe.plans.catalog_of_queries import ORACLES, QUERIES

TABLES = "events documents conversations customer supplier nation orders lineitem".split()
CHEAP = ["unit_hash_sample", "event_records", "state_delta_tax_change", "state_delta_demand_change", "economic_impact", "counterfactual_group_counts",
         "split_assignment", "context_facts_unpivot", "serialize_records_none", "runtime_views", "asof_latest_fact", "valid_at_event", "historical_events",
         "pair_counts", "conversation_digest", "lr_schedule", "checkpoint_retention", "run_contract_diff", "registry_equality", "key_set_difference",
         "exact_price_sums", "documents_stream_digest", "context_bundles", "bundle_texts", "bundle_violations", "canonical_records", "canonical_files",
         "manifest_disagreements", "jsonl_bad_lines", "semantic_duplicates", "early_stopping", "masked_batches"]


def record(spark, mechanism, **values):
    row = {"id": "case_000001", "mechanism": mechanism, "direction": "increase", "magnitude": 0.4, "horizon_days": 30, "confidence": 0.9, "source": "synthetic", "entity_id": "e", "subject": "steel", "subject_class": BY_NAME[mechanism].classes[0]}
    row |= dict.fromkeys(FACTORS) | {f: 0.5 for f in BY_NAME[mechanism].factors} | values
    kind = lambda k: "int" if k == "horizon_days" else "double" if k in FACTORS or k in ("magnitude", "confidence") else "string"
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kind(k)}" for k in row))


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir).toArrow()
    want = con.execute(ORACLES[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = lambda t: sorted(tuple(repr(r[c] + 0.0 if isinstance(r[c], float) else r[c]) for c in columns) for r in t.to_pylist())
    assert rows(got) == rows(want)


def test_labels_by_hand(spark):
    row = labelled(record(spark, "input_cost_change", input_dependency=0.25, hedging=0.0, substitutability=0.0, inventory_buffer=0.0, pricing_power=0.0)).first()
    assert math.isclose(row.operating_costs, 0.1) and math.isclose(row.margin_expectation, -0.1)
    assert math.isclose(row.supply_risk, 0.01) and math.isclose(row.competitive_position, -0.025)
    assert math.isclose(row.economic_impact, -0.75 * 0.1 - 0.1 - 0.5 * 0.01 - 0.25 * 0.025)


def test_every_mechanism_keeps_its_signs_and_mirrors(spark, sf_dir):
    rows = with_families(base_records(spark, sf_dir).limit(60))
    assert verify.verified(rows).where("not valid").count() == 0


def test_tampering_is_found(spark):
    row = labelled(record(spark, "tax_change")).withColumn("economic_impact", F.lit(0.5))
    assert [i.code for i in verify.verified(row).first().issues] == ["economic_impact_mismatch"]
    teacher = labelled(record(spark, "tax_change", source="teacher")).withColumn("margin_expectation", F.col("margin_expectation") * 0.9)
    teacher = teacher.withColumn("economic_impact", F.col("margin_expectation") + 0.25 * F.col("competitive_position"))
    assert verify.verified(teacher).first().valid
    with pytest.raises(Exception, match="economic_impact_mismatch"):
        verify.require_valid(row).collect()


def test_sound_records_are_those_that_break_no_rule(spark, sf_dir):
    """The short test of whole records against each rule, on records with one field changed; and as many tasks as cores."""
    base = base_records(spark, sf_dir)
    assert base.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    rows = with_families(base.limit(15)).localCheckpoint()
    fields = ["magnitude", "confidence", *FACTORS, *STATES, "economic_impact"]
    values = F.array(*map(F.lit, [float("nan"), 1.5, -0.5, None, 0.0, float("inf"), -1.0, 1.0]))
    drawn = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(len(fields) + 8))
    value = F.element_at(values, (F.pmod(F.xxhash64("id"), F.lit(8)) + 1).cast("int"))
    changes = {f: F.when(drawn == k, value).otherwise(F.col(f)) for k, f in enumerate(fields)}
    for k, (f, v) in enumerate([("horizon_days", 0), ("direction", "up"), ("mechanism", "unheard"), ("mechanism", "input_cost_change"), ("subject_class", "nothing")]):
        changes[f] = F.when(drawn == len(fields) + k, v).otherwise(changes.get(f, F.col(f)))
    rows = with_effects(rows.withColumns(changes).localCheckpoint(), verify.EXPECTED, barrier=True).localCheckpoint()
    codes = F.filter(F.array(*[F.when(rule, code) for code, _, rule in verify.rules()]), lambda x: x.isNotNull())
    pairs = rows.select(F.coalesce(verify.sound(), F.lit(False)).alias("s"), (F.size(codes) > 0).alias("b")).collect()
    assert {tuple(r) for r in pairs} == {(True, False), (False, True)}


def test_family_sizes(spark):
    for m in MECHANISMS:
        assert counterfactuals(record(spark, m.name)).count() == 5 * len(m.factors) + 12


def test_unknown_factor_is_not_zero(spark):
    row = labelled(record(spark, "tax_change", tax_exposure=None)).first()
    assert row.margin_expectation is None and row.economic_impact is None
    assert labelled(record(spark, "tax_change", tax_exposure=0.0)).first().economic_impact == 0.0
    assert labelled(record(spark, "tax_change", tax_exposure=float("nan"))).first().margin_expectation is None
    assert labelled(record(spark, "tax_change", direction="sideways")).first().economic_impact is None
    with pytest.raises(Exception, match="no finite label"):
        require_labels(record(spark, "tax_change", tax_exposure=None)).collect()
    assert require_labels(record(spark, "tax_change")).where("economic_impact < 0").count() == 1


def test_codes_of_what_cannot_be_labelled(spark):
    def codes(rows):
        return {i.code for i in verify.verified(rows).first().issues}

    assert codes(labelled(record(spark, "tax_change", tax_exposure=None))) == {"mechanism_contract", "state_labeling_failure", "impact_failure", "non_finite_number"}
    unheard = record(spark, "tax_change").withColumn("mechanism", F.lit("unheard")).withColumns({s: F.lit(0.0) for s in [*STATES, "economic_impact"]})
    assert codes(unheard) == {"mechanism_contract"}
    assert verify.registry_issues() == []
    assert {c for c, _ in verify.registry_issues(MECHANISMS[1:])} == {"registry_schema_mismatch"}


def test_flags_of_families_in_closed_form(spark, sf_dir):
    base = base_records(spark, sf_dir).limit(300)
    columns = ["family_key", "entity_id", "concept", "parameter", "combination", "n_records"]
    whole = splits.families(with_families(base)).select(columns).collect()
    assert sorted(whole) == sorted(splits.families_of_bases(base).select(columns).collect()) and any(r.combination for r in whole)


def test_policy_and_sound_splits(spark, sf_dir):
    with pytest.raises(ValueError):
        splits.Policy(validation=0.6, iid_test=0.4)
    rows = splits.split_records(with_families(base_records(spark, sf_dir).limit(80))).cache()
    assert splits.violations(rows).count() == 0
    moved = rows.withColumn("split", F.when(F.col("id") == rows.first().family_key, "nowhere").otherwise(F.col("split")))
    assert "unknown_split" in {r.kind for r in splits.violations(moved).collect()}


def test_split_bases_and_one_pass_of_violations(spark, sf_dir):
    """Families of split bases have the splits of split_records(); every kind of violation is found; the records are shuffled for two passes."""
    base = base_records(spark, sf_dir).limit(40).localCheckpoint()
    rows = with_families(splits.split_bases(base))
    want = {(r["id"], r["split"]) for r in splits.split_records(with_families(base)).select("id", "split").collect()}
    assert {(r["id"], r["split"]) for r in rows.select("id", "split").collect()} == want
    plan = splits.violations(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union false") < 7, plan.count("Union false")  # the records are made for families, hashes of ids and ids, not for each kind
    a = spark.createDataFrame([("a", None, "e", "train"), ("a__1", "a", "e", "test_iid"), ("b", None, "e", "test_entity_ood"), ("b", None, "e", "test_entity_ood"), ("c", None, "f", "nowhere"), ("c", None, "f", None)], "id string, base_record_id string, entity_id string, split string")
    factors = {f: F.when(F.col("id") == "a", 1.0) for f in FACTORS} | {"magnitude": F.when(F.col("id") == "a", 0.99), "subject": F.lit("steel")}
    found = {tuple(r) for r in splits.violations(a.withColumns(factors)).collect()}
    assert found == {("family_leak", "a", 2), ("entity_leak", "e", 3), ("duplicate_id", "b", 1), ("duplicate_id", "c", 1), ("unknown_split", "nowhere", 1), ("combination_leak", "a", 1), ("parameter_leak", "a", 1)}


def test_metric_vector(spark):
    rows = spark.createDataFrame([(-0.8, -0.5), (-0.02, 0.01), (0.6, -0.1), (0.2, 0.1)], "target double, prediction double")
    m = rows.agg(*metrics.metrics()).first()
    assert (m.n, round(m.mae, 9), m.sign_accuracy, m.strong_n, round(m.strong_mae, 9)) == (4, 0.2825, 0.75, 2, 0.5)
    band = spark.createDataFrame([(-0.06,), (0.04,), (0.06,)], "x double").select(exprs.score_direction(F.col("x")).alias("d")).collect()
    assert [r.d for r in band] == [-1, 0, 1]


def test_masking_and_modes(spark):
    row = record(spark, "tax_change", entity_id="ACME.1")
    text = serialize.serialized(row, "full", F.lit("acme.1 [raises];  xacme.1")).first().text
    assert "summary=[CASE_ENTITY] (raises), xacme.1" in text
    assert "[NO_SUMMARY]" in serialize.serialized(row, " None ").first().text
    with pytest.raises(ValueError):
        serialize.summary_mode("half")


def test_special_tokens_have_their_ids():
    bpe = tokens.Bpe.train([("oil", 3), ("prices", 2), ("oily", 1), ("aaa", 2)], 200)
    contract = "[pad]=0 [cls]=1 [sep]=2 [unk]=3 [mask]=4 [event]=5 [case]=6 [context]=7 [horizon]=8 [historical_event]=9 [case_entity]=10 [no_summary]=11"
    assert {t: bpe.vocab[t] for t in tokens.SPECIALS} == {x.split("=")[0]: int(x.split("=")[1]) for x in contract.split()}
    for w in ("oil", "prices", "aaa"):
        assert bpe.decode(bpe.word(w)) == w
    assert bpe.word("z") == [3, bpe.vocab["</w>"]]
    bpe.check_specials()
    with pytest.raises(ValueError, match="special"):
        tokens.Bpe(bpe.vocab | {"[cls]": 99}, bpe.merges).check_specials()


def test_pre_tokens(spark):
    cases = {
        "[CLS]\n[EVENT] Oil +3.5% or -2,75; x_y": ["[cls]", "[event]", "oil", "+3.5", "%", "or", "-2,75", ";", "x", "y"],
        "[cls] [No]": ["[", "cls", "]", "[", "no", "]"],
        "Straße ΣΊΣΥΦΟΣ Émile 東京 1.2.3": ["strasse", "σίσυφοσ", "émile", "東京", "1.2", ".", "3"],
        "": [],
    }
    rows = spark.createDataFrame([(x,) for x in cases], "text string")
    assert {r.text: r.w for r in rows.select("text", tokens.words(F.col("text")).alias("w")).collect()} == cases
    counts = {r.word: r.n for r in tokens.word_counts(rows).collect()}
    assert "[cls]" not in counts and counts["cls"] == 1


def test_tokenizer_files_and_encoding(spark, tmp_path):
    docs = spark.createDataFrame([(1, "[CLS] oil prices, oil price [NO_SUMMARY]"), (2, "oily"), (3, None)], "doc_id long, text string")
    bpe = vocabulary.train(docs, 60)
    bpe.save(str(tmp_path / "t" / "bpe.json"))
    again = tokens.Bpe.load(str(tmp_path / "t" / "bpe.json"))
    assert again.vocab == bpe.vocab and again.merges == bpe.merges and again.fingerprint == bpe.fingerprint and len(bpe.fingerprint) == 64
    ids = {r.id: list(r.ids) for r in tokens.encoded(docs, again).collect()}
    assert ids[1][0] == 1 and ids[1][-1] == 11 and ids[3] == []
    assert again.decode(ids[1]).replace(" ", "") == "[cls]oilprices,oilprice[no_summary]"


def test_states_are_complete():
    assert len(STATES) == 6 and len(FACTORS) == 21 and sum(len(m.factors) for m in MECHANISMS) == 52


def test_bpe_covers_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [(r["word"], r["n"]) for r in tokens.word_counts(docs).orderBy("word").collect()]
    bpe = tokens.Bpe.train(counts, 600)
    assert {r.token: r.token_id for r in QUERIES["bpe_vocab"](spark, sf_dir).collect()} == bpe.vocab
    lengths = {w: len(bpe.word(w)) for w, _ in counts}
    want = docs.select("doc_id", F.explode_outer(tokens.words(F.col("text"))).alias("w")).collect()
    total = {}
    for r in want:
        total[r.doc_id] = total.get(r.doc_id, 0) + lengths.get(r.w, 0)
    got = QUERIES["bpe_encode_lengths"](spark, sf_dir).collect()
    assert {r.id: r.n_tokens for r in got} == total and len(got) == docs.count() and not any(r.n_unknown for r in got)
