"""Queries on the contracts of the data: exact sums, digests, bundles, canonical files and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.operators import bundles, exact_sums, masking, ordered_digest, semantic_key
from rippleframe.operators import early_stopping as stopping
from rippleframe.operators.catalog import FACTORS
from rippleframe.operators.records import base_records, shaped
from rippleframe.plans import oracle_parts as O
from rippleframe.plans.catalog_of_queries import query, table
from rippleframe.sources import canonical, lines
from rippleframe.sources.scratch import shared_dir

_PRICE = "CASE WHEN l_linenumber % 2 = 0 THEN -1.0e0 ELSE 1.0e0 END * (l_extendedprice * (1.0e0 - l_discount))"


def _nearest(total: str, bits: int) -> str:
    """SQL for the nearest double to a whole HUGEINT by 2^bits: both halves are doubles, and one addition rounds."""
    half = 1 << 40
    return f"(CAST({total} // {half} AS DOUBLE) * {half}.0e0 + CAST({total} % {half} AS DOUBLE)) / {1 << bits}.0e0"


@query(f"""WITH s AS (SELECT l_returnflag, l_linestatus, count(*) AS n_net, sum(CAST({_PRICE} * {1 << 48}.0e0 AS HUGEINT)) AS net, sum(CAST(l_tax * {1 << 60}.0e0 AS HUGEINT)) AS tax FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, n_net, {_nearest('net', 48)} AS net, {_nearest('tax', 60)} AS tax FROM s""")
def exact_price_sums(spark, sf_dir):
    """Exact sums of prices of changing signs, and of taxes: equal to the last bit."""
    net = F.when(F.col("l_linenumber") % 2 == 0, -1.0).otherwise(1.0) * (F.col("l_extendedprice") * (1.0 - F.col("l_discount")))
    found = exact_sums.exact_sums(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], net=net, tax=F.col("l_tax"))
    return found.select("l_returnflag", "l_linestatus", "n_net", "net", "tax")


_SCORE = "((n_chars % 1000) / 1000.0e0)"
#: The bits of a number in [0, 1) as an IEEE single.
_SINGLE = f"""(CASE WHEN {_SCORE} = 0 THEN 0 ELSE CAST(floor(log2(CAST(CAST({_SCORE} AS FLOAT) AS DOUBLE))) AS BIGINT) + 127 END) * 8388608
  + CASE WHEN {_SCORE} = 0 THEN 0 ELSE CAST(round((CAST(CAST({_SCORE} AS FLOAT) AS DOUBLE) / pow(2.0e0, floor(log2(CAST(CAST({_SCORE} AS FLOAT) AS DOUBLE)))) - 1) * 8388608) AS BIGINT) END"""


@query(f"""WITH l AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS rank, sha256(unhex(lpad(to_hex(octet_length(encode(text))), 16, '0')) || encode(text) || unhex(lpad(to_hex({_SINGLE}), 8, '0'))) AS d FROM documents),
a AS (SELECT rank // 64 AS rank, sha256(string_agg(d, '' ORDER BY rank)) AS d FROM l GROUP BY rank // 64), b AS (SELECT rank // 64 AS rank, sha256(string_agg(d, '' ORDER BY rank)) AS d FROM a GROUP BY rank // 64),
c AS (SELECT CAST(0 AS BIGINT) AS rank, sha256(string_agg(d, '' ORDER BY rank)) AS d FROM b)
SELECT (SELECT count(*) FROM l) AS n, coalesce((SELECT max(d) FROM a HAVING count(*) = 1), (SELECT max(d) FROM b HAVING count(*) = 1), (SELECT d FROM c)) AS root""")
def documents_stream_digest(spark, sf_dir):
    """One digest of all documents in order, with a score for each: a resumed run must read the same stream."""
    rows = table(spark, sf_dir, "documents")
    return ordered_digest.ordered_digest(spark, rows.withColumn("s", F.pmod("n_chars", F.lit(1000)) / 1000.0), ["doc_id"], F.col("text"), F.col("s"), fanout=64, levels=3)


#: Events, the eight before each as its facts and history, and what the cutoff leaves of them.
_BUNDLES = """e AS (SELECT *, 'synthetic_' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS entity, ts + to_hours(CAST(event_id % 48 AS INT)) AS obs, ts + to_hours(CAST(event_id % 72 AS INT)) AS cutoff,
  lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS until, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
c AS (SELECT b.event_id AS bid, b.ts AS bts, b.cutoff AS upto, x.* FROM e b JOIN e x ON x.user_id = b.user_id AND x.r BETWEEN b.r - 8 AND b.r - 1),
f AS (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY event_type, CAST(value AS VARCHAR), 'fact:' || event_id) AS k FROM c WHERE obs <= upto AND ts <= least(bts, upto) AND (until IS NULL OR least(bts, upto) <= until)),
h AS (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY ts, 'event:' || event_id) AS k FROM c WHERE obs <= upto AND ts < bts),
b AS (SELECT * FROM e WHERE obs <= cutoff)"""
_EVIDENCE = """p AS (SELECT bid, 3 AS part, k, event_id, obs, upto FROM (SELECT event_id AS bid, 0 AS k, event_id, obs, cutoff AS upto FROM b UNION ALL SELECT bid, k, event_id, obs, upto FROM h)
  UNION ALL SELECT bid, 4, k, event_id, obs, upto FROM f),
q AS (SELECT bid, part, k, obs AS seen, 'feed' AS source, 'feed:' || event_id AS id, upto FROM p UNION ALL SELECT bid, part, k, obs + to_days(CAST(event_id % 5 AS INT)), 'archive', 'archive:content-hash:' || sha256(CAST(event_id AS VARCHAR)), upto FROM p),
i AS (SELECT bid, 1 AS part, k, ts AS seen, '' AS source, 'fact:' || event_id AS id FROM f UNION ALL SELECT bid, 2, k, ts, '', 'event:' || event_id FROM h UNION ALL SELECT bid, part, k, seen, source, id FROM q WHERE seen <= upto),
u AS (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY part, k, seen, source, id) AS place FROM i),
d AS (SELECT bid, id, min(place) AS place FROM u GROUP BY ALL),
v AS (SELECT bid, count(*) AS n, string_agg(id, '|' ORDER BY place) AS ids FROM d GROUP BY bid)"""


def _bundles(spark, sf_dir) -> DataFrame:
    return bundles.of_events(table(spark, sf_dir, "events"))


@query(f"""WITH {_BUNDLES}, {_EVIDENCE} SELECT CAST(event_id AS VARCHAR) AS bundle_id, (SELECT count(*) FROM f WHERE f.bid = b.event_id) AS n_facts, (SELECT count(*) FROM h WHERE h.bid = b.event_id) AS n_events,
coalesce(n, 0) AS n_evidence, sha256(coalesce(ids, '')) AS evidence FROM b LEFT JOIN v ON v.bid = b.event_id""")
def context_bundles(spark, sf_dir):
    """What was known of each event's user at its cutoff, and all evidence for it in order, as a digest."""
    ids = bundles.evidence_ids()
    rows = bundles.as_of(_bundles(spark, sf_dir))
    return rows.select("bundle_id", F.size("facts").cast("long").alias("n_facts"), F.size("historical_events").cast("long").alias("n_events"), F.size(ids).cast("long").alias("n_evidence"), F.sha2(F.array_join(ids, "|"), 256).alias("evidence"))


_LINE = "'type=' || event_type || '; summary=' || upper(event_type[1]) || event_type[2:] || ' by [CASE_ENTITY] ([CASE_ENTITY]); subjects=[CASE_ENTITY]' || CASE WHEN event_id % 3 = 0 THEN '; objects=shop:a,shop:B' ELSE '' END || '; magnitude=' || {} || '; unit=points; confidence=0.9'".format(O.general("value"))


@query(f"""WITH {_BUNDLES}, ft AS (SELECT bid, string_agg('[CONTEXT] subject=[CASE_ENTITY]; predicate=' || event_type || '; value=' || CAST(value AS VARCHAR) || '; unit=points; confidence=0.9' || chr(10), '' ORDER BY k) AS t FROM f GROUP BY bid),
ht AS (SELECT bid, string_agg('[HISTORICAL_EVENT] ' || {_LINE} || chr(10), '' ORDER BY k) AS t FROM h GROUP BY bid)
SELECT CAST(event_id AS VARCHAR) AS bundle_id, '[CLS]' || chr(10) || '[EVENT] ' || {_LINE} || chr(10) || '[CASE] type=company name=[CASE_ENTITY]' || chr(10) || '[HORIZON] ' || [7, 14, 30, 60, 90, 180, 365][event_id % 7 + 1] || 'd' || chr(10)
  || coalesce(ft.t, '') || coalesce(ht.t, '') || '[SEP]' AS text FROM b LEFT JOIN ft ON ft.bid = event_id LEFT JOIN ht ON ht.bid = event_id""")
def bundle_texts(spark, sf_dir):
    """Canonical text of those bundles, with their history."""
    return bundles.serialized(bundles.as_of(_bundles(spark, sf_dir)), "full", F.col("horizon"), settled=True)


@query(f"""WITH {_BUNDLES}, n AS (SELECT b.event_id, b.event_id % 29 AS kind, b.ts, b.cutoff, b.obs, (SELECT count(*) FROM f WHERE f.bid = b.event_id) AS nf, (SELECT count(*) FROM h WHERE h.bid = b.event_id) AS nh,
  b.ts = b.cutoff AS same FROM b)
SELECT CAST(event_id AS VARCHAR) AS bundle_id, unnest(list_filter([CASE WHEN kind = 0 THEN 'retrieved_before_cutoff' END, CASE WHEN kind = 1 AND nf > 0 THEN 'repeated_fact_id' END, CASE WHEN kind = 2 AND nh > 0 THEN 'repeated_event_id' END,
  CASE WHEN kind = 3 THEN 'primary_event_in_history' END, CASE WHEN kind IN (3, 4) THEN 'history_not_before_event' END, CASE WHEN kind = 5 THEN 'event_after_cutoff' END, CASE WHEN kind = 6 AND nf > 0 THEN 'fact_after_cutoff' END,
  CASE WHEN kind = 7 AND nf > 0 THEN 'fact_not_valid' END, CASE WHEN kind = 8 THEN 'event_evidence_after_cutoff' END, CASE WHEN kind = 9 AND nf > 0 THEN 'fact_evidence_after_cutoff' END, CASE WHEN kind = 10 THEN 'blank_text' END,
  CASE WHEN kind = 11 THEN 'no_subject' END, CASE WHEN kind = 12 THEN 'ids_differ_by_case' END, CASE WHEN kind = 13 AND nf > 0 THEN 'confidence_out_of_range' END, CASE WHEN kind = 14 AND nf > 0 THEN 'value_not_finite' END,
  CASE WHEN kind = 15 AND nf > 0 THEN 'fact_without_value' END, CASE WHEN kind = 16 THEN 'observed_before_evidence' END, CASE WHEN kind = 17 THEN 'evidence_before_publication' END], lambda x: x IS NOT NULL)) AS code FROM n""")
def bundle_violations(spark, sf_dir):
    """Every rule that bundles break, of which most are tampered with in one of 18 ways; the others, as of their cutoffs, break none."""
    rows = bundles.as_of(_bundles(spark, sf_dir))
    kind, cutoff = F.pmod(F.col("bundle_id").cast("long"), F.lit(29)), F.col("cutoff")
    later = cutoff + F.expr("INTERVAL 1 DAY")

    def facts(change) -> object:
        return F.transform("facts", change)

    def evidence(x, **fields):
        def changed(p):
            for name, value in fields.items():
                p = p.withField(name, value)
            return p

        return x.withField("provenance", F.transform(x["provenance"], changed))

    e, history = F.col("event"), F.col("historical_events")
    return bundles.violations(rows.withColumns({
        "retrieved_at": F.when(kind == 0, cutoff - F.expr("INTERVAL 1 SECOND")).otherwise(F.col("retrieved_at")),
        "entity_id": F.when(kind == 10, " ").otherwise(F.col("entity_id")),
        "facts": F.when(kind == 1, F.concat("facts", "facts")).when(kind == 6, facts(lambda f: f.withField("observed_at", later)))
        .when(kind == 7, facts(lambda f: f.withField("valid_from", F.col("event.occurred_at") + F.expr("INTERVAL 1 SECOND")).withField("valid_to", F.lit(None).cast("timestamp"))))
        .when(kind == 9, facts(lambda f: evidence(f, observed_at=later).withField("observed_at", cutoff).withField("provenance", F.concat(f["provenance"], F.slice(evidence(f, observed_at=later)["provenance"], 1, 1)))))
        .when(kind == 13, facts(lambda f: f.withField("confidence", F.lit(1.5)))).when(kind == 14, facts(lambda f: f.withField("value", F.lit(float("nan")))))
        .when(kind == 15, facts(lambda f: f.withField("value", F.lit(None).cast("double")))).otherwise(F.col("facts")),
        "historical_events": F.when(kind == 2, F.concat(history, history)).when(kind == 3, F.concat(history, F.array(e)))
        .when(kind == 4, F.concat(history, F.array(e.withField("event_id", F.lit("event:other"))))).otherwise(history),
        "event": F.when(kind == 5, e.withField("observed_at", later))
        .when(kind == 8, e.withField("provenance", F.concat(e["provenance"], F.slice(evidence(e, observed_at=later)["provenance"], 1, 1))))
        .when(kind == 11, e.withField("subject_ids", F.array().cast("array<string>"))).when(kind == 12, e.withField("subject_ids", F.array(F.lit("shop:a"), F.lit("Shop:A"))))
        .when(kind == 16, e.withField("observed_at", e["observed_at"] - F.expr("INTERVAL 1 SECOND"))).when(kind == 17, evidence(e, published_at=e["observed_at"] + F.expr("INTERVAL 90 DAYS"))).otherwise(e),
    }))


_SPLIT = ["train", "train", "validation", "test_iid", "test_hard_ood"]
_CONTEXT = " || ".join(f"CASE WHEN {f} IS NULL THEN '' ELSE ',\"{f}\":' || CAST(round({f}, 6) AS VARCHAR) END" for f in sorted(FACTORS))
_CANONICAL = f"""l AS (SELECT id, {_SPLIT}[(CAST(substr(id, 6) AS BIGINT) - 1) % 5 + 1] AS split, '{{"confidence":0.9,"context":{{' || substr({_CONTEXT}, 2) || '}},"event":{{"direction":"' || direction || '","magnitude":' || CAST(magnitude AS VARCHAR)
  || ',"mechanism":"' || mechanism || '","subject":"' || subject || '","subject_class":"' || subject_class || '"}},"horizon_days":' || horizon_days || ',"id":"' || id
  || '","metadata":{{"generator_version":"events-adapter-v1","seed":42,"source":"synthetic"}},"target":{{"entity_id":"' || entity_id || '"}}}}' AS line FROM rec)"""


def _canonical(spark, sf_dir) -> DataFrame:
    """id, split and canonical line of base records without labels; the factors have six decimals, which both engines have."""
    rows = base_records(spark, sf_dir).withColumns({f: F.round(f, 6) for f in FACTORS})
    rows = shaped(rows).select("id", "event", "target", "context", "horizon_days", "confidence", "metadata")
    turn = (F.pmod(F.substring("id", 6, 20).cast("long") - 1, F.lit(5)) + 1).cast("int")
    return rows.select("id", F.element_at(F.array(*map(F.lit, _SPLIT)), turn).alias("split"), canonical.canonical_lines(rows).alias("line"))


@query(O.with_parts("SELECT id, split, line FROM l", O.base(), _CANONICAL))
def canonical_records(spark, sf_dir):
    """Canonical JSON of every base record."""
    return _canonical(spark, sf_dir)


@query(O.with_parts("SELECT split, count(*) AS examples, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS bytes, min(id) AS first_id, max(id) AS last_id FROM l GROUP BY split", O.base(), _CANONICAL))
def canonical_files(spark, sf_dir):
    """Published canonical files, read again: examples, bytes on disk and ids by split."""
    rows, path = _canonical(spark, sf_dir), f"{shared_dir(spark)}/canonical"
    canonical.publish(spark, rows, path, seed=42)
    kept, _ = canonical.load(spark, path, shaped(base_records(spark, sf_dir)).select("id").schema)
    ids = kept.groupBy("split").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return canonical.listed(spark, path).groupBy("split").agg(F.sum("examples").alias("examples"), F.sum("bytes").alias("bytes")).join(ids, "split")


@query(O.with_parts(
    """SELECT split, CASE split WHEN 'train' THEN 'short' WHEN 'validation' THEN 'extra' WHEN 'test_iid' THEN 'altered' ELSE 'long' END AS problem,
CAST(sum(CASE split WHEN 'train' THEN 2 WHEN 'test_iid' THEN 1 ELSE 0 END) AS BIGINT) AS expected, count(*) AS present FROM l GROUP BY split
UNION ALL SELECT 'test_concept_ood', 'missing', count(*), 0 FROM l WHERE split = 'train'""",
    O.base(), _CANONICAL,
))
def manifest_disagreements(spark, sf_dir):
    """Published files against a list that tells every file otherwise: examples by split and kind of disagreement."""
    path = f"{shared_dir(spark)}/canonical"
    canonical.publish(spark, _canonical(spark, sf_dir), path, seed=42)
    told, split = canonical.listed(spark, path), F.col("split")
    changed = told.where(split != "validation").withColumn("examples", F.when(split == "train", F.col("examples") * 2).when(split == "test_hard_ood", 0).otherwise(F.col("examples")))
    changed = changed.withColumn("sha256", F.when(split == "test_iid", F.reverse("sha256")).otherwise(F.col("sha256")))
    gone = told.where(split == "train").withColumns({"split": F.lit("test_concept_ood")})
    rows = canonical.disagreements(changed.unionByName(gone), canonical.found(spark, path))
    return rows.groupBy("split", "problem").agg(F.sum("expected").alias("expected"), F.sum("present").alias("present"))


#: What a line of each kind is found to be; kinds go by the record's number modulo 40.
_FAULTS = {1: "not a JSON object", 2: "record: unknown keys; record: missing keys; wrong type", 3: "wrong type", 4: "blank line; not a JSON object; record: not an object; event.: not an object; target.: not an object; context.: not an object; state_delta.: not an object; metadata.: not an object; wrong type", 5: "not a JSON object"}


@query(f"""SELECT event_id // 5000 AS part, event_id % 5000 + 1 AS line, CASE event_id % 40 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in _FAULTS.items())} ELSE 'economic_impact_mismatch' END AS problems
FROM events WHERE event_id % 40 BETWEEN 1 AND 6""")
def jsonl_bad_lines(spark, sf_dir):
    """Files of 5,000 records in order, some of which are broken in one of six ways: the bad lines by file and number."""
    number = F.substring("id", 6, 20).cast("long") - 1
    rows = base_records(spark, sf_dir)
    impact = F.col("economic_impact")
    rows = rows.withColumn("economic_impact", F.when(F.pmod(number, F.lit(40)) == 6, F.when(impact > 0, impact - 0.5).otherwise(impact + 0.5)).otherwise(impact))
    rows = shaped(rows).select("id", F.to_json(F.struct(*shaped(rows).columns)).alias("line"))
    turn, line = F.pmod(number, F.lit(40)), F.col("line")
    line = F.when(turn == 1, F.concat(F.lit('{"id":"again",'), F.substring("line", 2, 1 << 30))).when(turn == 2, F.regexp_replace("line", '"horizon_days":', '"horizon":'))
    line = line.when(turn == 3, F.regexp_replace("line", '"horizon_days":(\\d+)', '"horizon_days":"$1"')).when(turn == 4, F.lit("  ")).when(turn == 5, F.concat("line", F.lit(" trailing"))).otherwise(F.col("line"))
    path = f"{shared_dir(spark)}/lines"
    files = rows.select(number.alias("k"), F.expr("(CAST(substring(id, 6, 20) AS BIGINT) - 1) div 5000").alias("part"), line.alias("value")).repartition("part").sortWithinPartitions("part", "k")
    files.select("value", "part").write.partitionBy("part").text(path)
    bad = lines.bad_lines(spark, f"{path}/part=*")
    return bad.select(F.regexp_extract("file", "/part=(\\d+)/", 1).cast("long").alias("part"), "line", F.array_join("problems", "; ").alias("problems"))


@query("""SELECT min(event_id) AS event_id, CAST(sum(CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM events GROUP BY event_type, user_id, value, ts, event_id % 3 = 0""")
def semantic_duplicates(spark, sf_dir):
    """Events of which every seventh is there again, written otherwise and observed later: distinct events by their keys."""
    rows = _bundles(spark, sf_dir).select("event")
    e = F.col("event")
    again = e.withField("summary", F.concat(F.lit("  "), F.upper(e["summary"]))).withField("event_type", F.initcap(e["event_type"])).withField("subject_ids", F.transform(e["subject_ids"], F.upper))
    again = again.withField("observed_at", e["observed_at"] + F.expr("INTERVAL 1 HOUR")).withField("event_id", F.concat(e["event_id"], F.lit("/again")))
    number = F.substring("event.event_id", 7, 20).cast("long")
    rows = rows.unionByName(rows.where(F.pmod(number, F.lit(7)) == 0).select(again.alias("event")))
    found = semantic_key.distinct_events(rows)
    return found.select(F.substring_index(F.substring_index("event.event_id", "/", 1), ":", -1).cast("long").alias("event_id"), "n")


@query("""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST('Infinity' AS DOUBLE) AS best, CAST(0 AS BIGINT) AS best_at, CAST(0 AS BIGINT) AS waited FROM events
  UNION ALL SELECT f.user_id, r, CASE WHEN value < best - 0.5e0 THEN value ELSE best END, CASE WHEN value < best - 0.5e0 THEN r ELSE best_at END, CASE WHEN value < best - 0.5e0 THEN 0 ELSE waited + 1 END
  FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.n + 1 WHERE waited < 3)
SELECT user_id, max(n) AS n, arg_max(best, n) AS best, arg_max(best_at, n) AS best_at, arg_max(waited, n) AS waited, arg_max(waited, n) >= 3 AS stopped FROM f GROUP BY user_id""")
def early_stopping(spark, sf_dir):
    """Each user's values as a series of errors: where it would have been stopped, and its best."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return stopping.stopped(rows, "user_id", ["ts", "event_id"], "value", min_delta=0.5, patience=3)


_IDS = "list_transform(list_filter(string_split(lower(text), ' '), lambda x: x <> ''), lambda x: CAST('0x' || sha256(x)[1:4] AS BIGINT) % 4000 + 12)"


def _drawn(k: int) -> str:
    return f"CAST('0x' || d[{8 * k + 1}:{8 * k + 8}] AS BIGINT) / 4294967296.0e0"


@query(f"""WITH r AS (SELECT conv_id, turn, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 16 AS batch, [1] || {_IDS} || [2] AS ids FROM conversations),
s AS (SELECT batch, max(len(ids)) AS width, max(list_max(ids)) AS top FROM r GROUP BY batch),
p AS (SELECT conv_id, turn, batch, unnest(ids) AS id, unnest(range(len(ids))) AS i FROM r),
u AS (SELECT *, CASE WHEN id > 11 THEN sha256('42:' || conv_id || ':' || turn || ':' || i) END AS d FROM p),
w AS (SELECT conv_id, turn, batch, id, i, {_drawn(0)} AS u0, {_drawn(1)} AS u1, {_drawn(2)} AS u2, {_drawn(3)} AS u3 FROM u),
b AS (SELECT batch, coalesce(bool_or(u0 < 0.02e0), false) AS found FROM w GROUP BY batch),
x AS (SELECT w.*, found, width, top, coalesce(CASE WHEN found THEN u0 < 0.02e0 ELSE u3 = max(u3) OVER (PARTITION BY conv_id, turn) END, false) AS pick FROM w JOIN b USING (batch) JOIN s USING (batch)),
y AS (SELECT *, CASE WHEN NOT pick THEN id WHEN u1 < 1 - 0.1e0 - 0.1e0 THEN 4 WHEN u1 < 1 - 0.1e0 THEN CAST(floor(u2 * (top + 1)) AS BIGINT) ELSE id END AS made FROM x)
SELECT conv_id, turn, batch, CAST(max(width) AS BIGINT) AS width, count(*) FILTER (pick) AS n_chosen, count(*) FILTER (pick AND made = 4) AS n_masked,
  sha256(string_agg(CAST(made AS VARCHAR), ',' ORDER BY i) || repeat(',0', CAST(max(width) - count(*) AS INT))) AS masked FROM y GROUP BY conv_id, turn, batch""")
def masked_batches(spark, sf_dir):
    """Messages as ids in padded batches of 16, with 2 % of their positions masked: what is chosen, and the rows' digests."""
    words = F.filter(F.split(F.lower("text"), " "), lambda x: x != "")
    ids = F.transform(words, lambda x: (F.conv(F.substring(F.sha2(x, 256), 1, 4), 16, 10).cast("int") % 4000 + 12).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.array(F.lit(masking.CLS)), ids, F.array(F.lit(masking.SEP))).alias("ids"))
    rows = masking.batched(spark, rows, ["conv_id", "turn"], "ids", 16)
    rows = masking.masked(rows, "ids", F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")), share=0.02)
    chosen = F.filter(F.arrays_zip("labels", "masked"), lambda p: p["labels"] != masking.IGNORED)
    n = F.size(chosen).cast("long")
    texts = F.array_join(F.transform("masked", lambda x: x.cast("string")), ",")
    n_masked = F.size(F.filter(chosen, lambda p: p["masked"] == masking.MASK)).cast("long")
    return rows.select("conv_id", "turn", F.col("batch").cast("long").alias("batch"), F.col("width").cast("long").alias("width"), n.alias("n_chosen"), n_masked.alias("n_masked"), F.sha2(texts, 256).alias("masked"))
