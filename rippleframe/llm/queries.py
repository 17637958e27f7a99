"""The corpus queries and their oracles."""

from __future__ import annotations

import importlib.util

from pyspark.sql import functions as F

from rippleframe.llm import bpe, collocations, exact_dedup, language_id, license_scan, near_dedup, ordinal_quality, packing, quality_rules, quote_links, repair, token_counts, url_filter
from rippleframe.llm.common import table

#: Folder of public tokenizer files; the package public_tokenizers names it where it is installed.
TOKENIZERS = "/opt/tokenizers"


def tokenizer_path(name: str) -> str:
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


def op1_minhash_dedup(spark, sf_dir):
    """Near-duplicate components of all documents, on shingles of four words and a similarity of 0.8."""
    found = near_dedup.find(spark, table(spark, sf_dir, "documents"), size=4)
    return found.withColumnRenamed("id", "doc_id")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh
  FROM w
), e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b
  WHERE 100 * n_both >= 80 * (len(x.sh) + len(y.sh) - n_both)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN c ON c.a = s.doc_id
"""


def op2_language_id(spark, sf_dir):
    """Language of every document, learned from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(language_id.learned_rows(docs)))
    found = language_id.identify(spark, docs, model)
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False))
    return found.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")


def op3_bpe_round_trip(spark, sf_dir):
    """Byte-level BPE encoding and decoding of all documents, as digests."""
    found = bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return found.withColumnRenamed("id", "doc_id")


def op4_quote_links(spark, sf_dir):
    """All messages without quotes, linked to what they quote, with their place in reply order."""
    return quote_links.link(table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


OP4_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS body FROM conversations),
q AS (SELECT DISTINCT conv_id, turn, body FROM m WHERE regexp_matches(body, '(?m)^[ \t]*>') AND conv_id IS NOT NULL AND turn IS NOT NULL),
s AS (SELECT conv_id, turn, body, string_split(body, chr(10)) AS ls FROM q),
l AS (SELECT conv_id, turn, body, unnest(range(1, len(ls) + 1)) AS ln, unnest(ls) AS line FROM s),
v AS (SELECT *, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+[ \t]?'), '[^>]', '', 'g')) AS level FROM l),
n AS (SELECT *, coalesce(CAST(lag(level) OVER w <> level AS INT), 1) AS new FROM v WINDOW w AS (PARTITION BY conv_id, turn, body ORDER BY ln)),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn, body ORDER BY ln) AS run FROM n),
b AS (SELECT *, trim(regexp_replace(lower(regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '')), '[ \t-\r]+', ' ', 'g')) AS bare FROM r WHERE level > 0),
p AS (SELECT conv_id, turn, level, count(*) AS many, string_agg(bare, ' ' ORDER BY ln) AS body FROM b WHERE bare <> '' GROUP BY conv_id, turn, b.body, run, level),
c AS (SELECT *, CASE WHEN regexp_matches(body, '(?m)^[ \t]*>') THEN trim(array_to_string(list_filter(string_split(body, chr(10)),
        lambda x: NOT regexp_matches(x, '^(?:[ \t]*>)+[ \t]?') AND NOT regexp_matches(x, '(?i)^[ \t]*on [^\n]{1,200} wrote:[ \t\r]*$')), chr(10))) ELSE body END AS content FROM m),
w AS (SELECT conv_id, turn, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(regexp_replace(lower(x), '[ \t-\r]+', ' ', 'g'))), lambda x: x <> '') AS own FROM c WHERE conv_id IN (SELECT conv_id FROM q)),
o AS (SELECT DISTINCT conv_id, turn, array_to_string(own[a:z], ' ') AS body, z - a + 1 AS many, len(own) AS n FROM (SELECT *, unnest(range(a, len(own) + 1)) AS z FROM (SELECT *, unnest(range(1, len(own) + 1)) AS a FROM w))),
k AS (SELECT p.conv_id, p.turn, p.level, (SELECT max(o.turn) FROM o WHERE o.conv_id = p.conv_id AND o.body = p.body AND (o.many = p.many OR o.many = o.n) AND o.turn < p.turn) AS origin FROM p),
f AS (SELECT conv_id, turn, max(level) AS depth, count(*) AS n, count(origin) AS linked, arg_min(origin, (level, -origin)) FILTER (origin IS NOT NULL) AS reply_to FROM k GROUP BY 1, 2),
h AS (SELECT conv_id, turn, reply_to AS root FROM f WHERE reply_to IS NOT NULL UNION ALL SELECT h.conv_id, h.turn, f.reply_to FROM h JOIN f ON f.conv_id = h.conv_id AND f.turn = h.root WHERE f.reply_to IS NOT NULL),
t AS (SELECT conv_id, turn, min(root) AS root FROM h GROUP BY 1, 2)
SELECT c.conv_id, c.turn, role, content, CAST(coalesce(depth, 0) AS BIGINT) AS quote_depth, CAST(coalesce(n, 0) AS BIGINT) AS n_passages,
       CAST(coalesce(linked, 0) AS BIGINT) AS n_linked, reply_to, coalesce(root, c.turn) AS order_thread
FROM c LEFT JOIN f ON f.conv_id = c.conv_id AND f.turn = c.turn LEFT JOIN t ON t.conv_id = c.conv_id AND t.turn = c.turn
"""


def op5_license_scan(spark, sf_dir):
    """Licence notices in all documents."""
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.array_join("licenses", ",").alias("licenses"), "n_passages", "best_license", F.round("best_dice", 9).alias("best_dice"))


def _op5_sql() -> str:
    """The same by brute force: every run of lines against every template."""
    rows = ", ".join("('{}', [{}])".format(k, ", ".join(f"'{b}'" for b in sorted(own))) for k, own in license_scan.texts_of(license_scan.TEMPLATES))
    longest = license_scan.most_words(license_scan.TEMPLATES, license_scan.AT)
    return f"""
WITH t(name, own) AS (VALUES {rows}),
x AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
y AS (SELECT r, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS k FROM x),
w AS (SELECT r, k, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+(?:\\.[0-9]+)*') AS ws FROM y),
l AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY k) AS i, ws FROM w WHERE len(ws) > 0),
n AS (SELECT r, i, ws, sum(len(ws)) OVER (PARTITION BY r ORDER BY i) AS upto FROM l),
u AS (SELECT a.r, a.i, b.i AS j, (SELECT flatten(list(c.ws ORDER BY c.i)) FROM n c WHERE c.r = a.r AND c.i BETWEEN a.i AND b.i) AS ws
      FROM n a JOIN n b ON b.r = a.r AND b.i >= a.i AND b.i < a.i + {longest} AND b.upto - a.upto + len(a.ws) <= {longest}),
b AS (SELECT r, i, j, list_distinct(list_transform(range(1, len(ws)), lambda q: ws[q] || ' ' || ws[q + 1])) AS bs FROM u WHERE len(ws) > 1),
d AS (SELECT r, i, j, name, 2.0 * len(list_intersect(bs, own)) / (len(bs) + len(own)) AS dice FROM b, t),
m AS (SELECT *, row_number() OVER (PARTITION BY r, i, j ORDER BY dice DESC, name) AS place FROM d WHERE dice >= {license_scan.AT}),
h AS (SELECT * FROM m WHERE place = 1),
v AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.r = h.r AND g.i <= h.j AND h.i <= g.j AND (-g.dice, g.j - g.i, g.i) < (-h.dice, h.j - h.i, h.i))),
s AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(*) AS n, arg_min(name, (-dice, name)) AS best, max(dice) AS top FROM v GROUP BY r)
SELECT doc_id, coalesce(licenses, '') AS licenses, CAST(coalesce(n, 0) AS BIGINT) AS n_passages, best AS best_license, CAST(round(top, 9) AS DOUBLE) AS best_dice FROM x LEFT JOIN s USING (r)
"""


def op7_url_filter(spark, sf_dir):
    """Rules and the language-model ratio over all page URLs."""
    found = url_filter.judge(spark, table(spark, sf_dir, "pages"))
    return found.withColumnRenamed("id", "page_id")


def op6_quality_rules(spark, sf_dir):
    """Base counts and perplexity bands of all documents."""
    return quality_rules.score(spark, table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_quality_classifier(spark, sf_dir):
    """Expected grade and tail probability of all documents, from the ratings in labels."""
    ratings = ordinal_quality.grades_of(table(spark, sf_dir, "labels"))
    found = ordinal_quality.classify(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), ratings, ordinal_quality.N_GRADES)
    return found.select("doc.doc_id", "expected_grade", "tail_probability", "kept")


def op9_packing(spark, sf_dir):
    """All documents packed into sequences of 2048 ids: one row per piece."""
    found = packing.pack(spark, table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return found.withColumnRenamed("id", "doc_id")



def op10_exact_dedup(spark, sf_dir):
    """Exact deduplication of all documents: one row per document with the row that stays."""
    found = exact_dedup.decisions(spark, table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


OP10_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


def op11_token_counts(spark, sf_dir):
    """Tokens of all documents, from the pieces of their distinct pre-tokens."""
    found = token_counts.count(spark, table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return found.withColumnRenamed("id", "doc_id")


def op12_collocations(spark, sf_dir):
    """The first 2000 phrases of two or three words of each language, over all documents."""
    return collocations.mine(spark, table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 4) r(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, a, cut, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
      FROM u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(ws[1:cut], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')),
b AS (SELECT lang, phrase, a, arg_min(l, (score, cut)) AS l, arg_min(r, (score, cut)) AS r, min(score) AS score FROM s GROUP BY ALL),
i AS (SELECT lang, array_to_string(ws[j:j + 1], ' ') AS phrase, max(a) AS longer FROM c, range(1, 3) r(j) WHERE k = 3 GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE 100 * coalesce(longer, 0) < 50 * a)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""


def _op13(spark, conversations):
    found = repair.repair(spark, repair.damage(conversations))
    told = found.conversations.join(repair.digests(found.messages), "key")
    ids = conversations.select("conv_id").distinct().withColumn("key", repair.key_of(F.col("conv_id"))).join(told, "key", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_structure_repair(spark, sf_dir):
    """Damaged copies of all conversations, repaired by their cheapest edits."""
    return _op13(spark, table(spark, sf_dir, "conversations"))


#: A dynamic program over rows and states; the crc is taken bit by bit.
OP13_SQL = r"""
WITH RECURSIVE k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(CAST(4294967295 AS BIGINT), list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(id) + 1), lambda i: CAST(ascii(substr(id, i, 1)) AS BIGINT))),
        lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, j: xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END)))) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(CAST(octet_length(encode(role)) AS VARCHAR) || ':' || role || text)) AS i FROM d),
q AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
        NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM o),
r AS (SELECT *, blank OR again AS must, CASE WHEN open THEN 5 ELSE 0 END AS extra FROM q),
e(s, t, ins, added) AS (VALUES (0, 0, '', CAST([] AS VARCHAR[])), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']), (3, 2, 'I', ['user:']),
        (2, 3, 'I', ['assistant:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:'])),
x(t, letter, initial, z, cost, role) AS (VALUES (0, 'D', '', 0, 2, ''), (1, 'D', '', 1, 2, ''), (2, 'D', '', 2, 2, ''), (3, 'D', '', 3, 2, ''),
        (0, 'K', 's', 1, 0, ''), (0, 'K', 'u', 2, 0, ''), (1, 'K', 'u', 2, 0, ''), (2, 'K', 'a', 3, 0, ''), (3, 'K', 'u', 2, 0, ''),
        (0, 'R', 'u', 2, 1, 'user'), (1, 'R', 'u', 2, 1, 'user'), (2, 'R', 'a', 3, 1, 'assistant'), (3, 'R', 'u', 2, 1, 'user')),
v AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, CAST(0 AS BIGINT) AS c, '' AS a, CAST([] AS VARCHAR[]) AS lines FROM conversations
  UNION ALL
  SELECT conv_id, i, s, min(c), arg_min(a, (c, a)), arg_min(lines, (c, a)) FROM (
    SELECT v.conv_id, r.i, x.z AS s, v.c + 5 * length(ins) + x.cost + CASE WHEN letter = 'D' THEN 0 ELSE extra END AS c, a || ins || letter AS a,
      list_concat(list_concat(lines, added), CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || text] ELSE [x.role || ':' || text] END) AS lines
    FROM v JOIN e ON e.s = v.s JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i + 1
    JOIN x ON x.t = e.t AND (letter = 'D' OR NOT must AND (letter = 'R' OR initial = substr(r.role, 1, 1)))) GROUP BY conv_id, i, s),
z AS (SELECT v.conv_id, v.i, v.c + 5 * length(ins) AS c, a || ins AS a, list_concat(lines, added) AS lines FROM v JOIN e ON e.s = v.s AND e.t IN (0, 3)),
f AS (SELECT conv_id, max(i) AS i FROM v GROUP BY conv_id),
b AS (SELECT z.conv_id, min(c) AS cost, arg_min(a, (c, a)) AS audit, arg_min(lines, (c, a)) AS lines FROM z JOIN f ON f.conv_id IS NOT DISTINCT FROM z.conv_id AND f.i = z.i GROUP BY z.conv_id),
n AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
        count(*) FILTER (open AND NOT must) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM b LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id
"""


def pipeline(spark, sf_dir):
    """The whole corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op2_language_id": op2_language_id,
    "op4_quote_links": op4_quote_links,
    "op5_license_scan": op5_license_scan,
    "op7_url_filter": op7_url_filter,
    "op6_quality_rules": op6_quality_rules,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_packing": op9_packing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_collocations": op12_collocations,
    "op13_structure_repair": op13_structure_repair,
}
if importlib.util.find_spec("corpus_pipeline"):
    QUERIES["pipeline"] = pipeline
ORACLES = {"op1_minhash_dedup": OP1_SQL, "op4_quote_links": OP4_SQL, "op5_license_scan": _op5_sql(), "op10_exact_dedup": OP10_SQL, "op12_collocations": OP12_SQL, "op13_structure_repair": OP13_SQL}
