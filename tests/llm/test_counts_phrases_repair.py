"""Token counts, collocations and structure repair against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rippleframe.llm import collocations, queries, repair, token_counts
from rippleframe.llm.common import split_join

WORD_BPE = queries.tokenizer_path("word_bpe_49k.json")


def random_texts(n, seed):
    rng = random.Random(seed)
    signs = [*"abcABC'sStTdDreRvVmMlL019.,!?;:\"()#<|>-_ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0éÉßİıſΣςσ漢字̸́‍🙂½²ⅷ≠«»…", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'re", "'LL"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("known", [1 << 18, 40])
def test_token_counts_equal_the_library(spark, monkeypatch, known):
    """With all pre-tokens broadcast, and with most of them joined by a shuffle."""
    monkeypatch.setattr(token_counts, "HELD", known)
    library = token_counts._encoder(WORD_BPE)
    rows = [(k, x, "q") for k, x in enumerate([*random_texts(3000, 3), "", None, "   ", "a" * 100_000, "word " * 30_000, "same", "same"])]
    rows += [(None, "no id", "q"), (5, "again", "q")]
    got = token_counts.count(spark, spark.createDataFrame(rows, "doc_id long, text string, token string"), WORD_BPE, limit=3000).collect()
    want = [(i, len((x or "").encode()), len(library.encode(x or "", add_special_tokens=False).ids)) for i, x, _ in rows]
    assert sorted(((r.id, r.n_bytes, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 3000) for r in got) and any(r.over_limit for r in got)
    assert token_counts.count(spark, spark.createDataFrame([], "doc_id long, text string"), WORD_BPE).count() == 0


def brute_phrases(rows, longest=3, least=10, keep=2000, share=50):
    counts, total, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            counts[lang].update(tuple(ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + q] for p, a in found.items() for q in range(2, len(p)) for i in range(len(p) - q + 1) if 100 * a >= share * f[p[i : i + q]]}
        scored = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0]) for i, x in enumerate(sorted(scored)[:keep])]
    return sorted(out)


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(1)
    some = ["the", "of", "Élan", "été", "a\x00b", "\x01", "\x01\x02", "ab", "ab\x08", "new", "york", "City", "漢字", "🙂", "x" * 40, "zz"]
    rows = []
    for k in range(300):
        own = [rng.choice(some[: int(2 + 14 * rng.random())]) for _ in range(rng.randrange(0, 60))]
        rows.append((k, "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "!?", " \x0b"]) for w in own), rng.choice(["en", "en", "de", None, "", "fr\x00"])))
    return [*rows, (None, None, "en"), (1, "", "en"), (2, "   ", "xx"), (3, "one two three", "solo"), rows[0], rows[0]]


@pytest.mark.parametrize("options", [{}, {"longest": 4, "least": 3, "keep": 50}, {"least": 2, "share": 80}])
@pytest.mark.parametrize("sizes", [None, (60, 5000, 3)])
def test_collocations(spark, phrases, monkeypatch, options, sizes):
    """Also with many small ranges, few rows merged at a time, and hot links apart."""
    if sizes:
        monkeypatch.setattr(collocations, "MERGED", sizes[0])
        monkeypatch.setattr(collocations, "SAMPLE_BYTES", sizes[1])
        monkeypatch.setattr("rippleframe.llm.common.HOT_ROWS", sizes[2])
        monkeypatch.setattr("rippleframe.llm.common.HOT_KEYS", 10**9)
    docs = spark.createDataFrame(phrases, "doc_id long, text string, lang string").withColumn("phrase", F.lit("x")).withColumn("n", F.lit(1))
    assert sorted(tuple(r) for r in collocations.mine(spark, docs, **options).collect()) == brute_phrases([(t, g) for _, t, g in phrases], **options)


def test_collocations_over_many_blocks_and_cuts(spark, phrases):
    """Ranges that start inside a word's and a pair's subtree, and blocks of a few words."""
    docs = spark.createDataFrame([(t or "", "en") for _, t, _ in phrases], "body string, lang string")
    bounds = [("en", "ab", "the"), ("en", "ab", "the", "of"), ("en", "new"), ("en", "of", "of", "the"), ("en", "the", "of"), ("en", "the", "the", "the"), ("zz",)]
    rows = collocations.shards(docs, bounds, 3, block=50)
    got = collocations.merged(rows, len(bounds) + 1, 3, 10).collect()
    want = Counter()
    for text, _ in docs.collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            want.update(" ".join(ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    assert {r.phrase: r.f for r in got} == {p: n for p, n in want.items() if n >= 10 or " " not in p} and len(got) == len({r.phrase for r in got})
    for r in got:
        ws = r.phrase.split(" ")
        assert r.lefts == [want[" ".join(ws[:k])] for k in range(1, len(ws))]


def test_collocations_of_an_empty_table(spark):
    assert collocations.mine(spark, spark.createDataFrame([], "text string, lang string")).count() == 0


def test_split_join(spark):
    many = spark.createDataFrame([(k % 3 if k < 90 else k, k) for k in range(100)], "key long, v long")
    one = spark.createDataFrame([(0, "a"), (1, "b"), (95, "c")], "key long, w string")
    for hot in (3, 20_000):
        from rippleframe.llm import common

        before, common.HOT_ROWS = common.HOT_ROWS, hot
        for how in ("inner", "left"):
            got = split_join(spark, many, one, ["key"], how).select("key", "v", "w").collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, many.join(one, "key", how).select("key", "v", "w").collect()))
        common.HOT_ROWS = before


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repaired(rows):
    """A dynamic program over whole rows that tries every insertion before each of them."""
    seen, faults = set(), []
    for _, _, r, x in rows:
        bare = x.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((r, x))
    best = {0: (0, "", ())}

    def put(into, state, way):
        if state is not None and (state not in into or way[:2] < into[state][:2]):
            into[state] = way

    def inserted(best):
        for _ in range(3):
            for s, (c, a, o) in list(best.items()):
                for role in ("user", "assistant"):
                    put(best, repair.STEP.get((s, role[0])), (c + 5, a + "I", (*o, role + ":")))
        return best

    inserted(best)
    for (_, _, r, x), fault in zip(rows, faults, strict=True):
        after = {}
        for s, (c, a, o) in best.items():
            put(after, s, (c + 2, a + "D", o))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                put(after, repair.STEP.get((s, r[:1])), (c + extra, a + "K", (*o, f"{r}:{x}")))
                for role in ("user", "assistant"):
                    put(after, repair.STEP.get((s, role[0])), (c + extra + 1, a + "R", (*o, f"{role}:{x}")))
        best = inserted(after)
    cost, audit, lines = min((best[s] for s in (0, 3) if s in best), key=lambda v: v[:2])
    turns = [t for _, t, _, _ in rows if t is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    digest = lambda r, x: hashlib.sha256((str(len(r.encode())) + ":" + r + x).encode()).digest()[:16]
    return {c: repaired(sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), digest(r[2], r[3])))) for c, own in by.items()}


@pytest.fixture(scope="module")
def conversations():
    rng, rows = random.Random(4), []
    for c in [None, *range(120)]:
        n = rng.choice([1, 1, 2, 3, 5, 8, 13, 40]) if c is not None else 30
        turns = rng.sample(range(-3, 60), n) if rng.random() < 0.7 else [rng.randrange(0, 8) for _ in range(n)]
        for t in turns:
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", "", "umpire"])
            rows.append((c, None if rng.random() < 0.05 else t, role, rng.choice(["Hi.", "Hi.", "ok", "Yes!\n", "What? ", "", "  ", None, "a.b", "…", "x" * 50 + "."])))
    return rows + [(777, k, "user" if k % 2 == 0 else "assistant", f"word {rng.randrange(900)}{rng.choice(['.', '.', '', ''])}") for k in range(3000)]


def test_structure_repair_of_damaged_rows(spark, conversations):
    """A conversation of 3,000 rows spans ranges and segments; one is null; some lose all rows."""
    table = spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("k")).withColumn("pos", F.lit(1))
    got = {r.conv_id: tuple(r)[1:] for r in queries._op13(spark, table).collect()}
    want = expected(damaged(conversations))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: want.get(c, empty) for c in {r[0] for r in conversations}} and empty in got.values()


@pytest.mark.parametrize("most", [1, 2, 7])
def test_structure_repair_in_small_segments(spark, conversations, most):
    rows = [r for r in conversations if r[0] is not None and r[0] < 60]
    found = repair.repair(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), most=most)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest"]
    got = {int(r["key"][1:]): tuple(r[n] for n in names) for r in found.conversations.join(repair.digests(found.messages), "key").collect()}
    assert got == expected([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])


def test_structure_repair_of_an_empty_table(spark):
    assert queries._op13(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
