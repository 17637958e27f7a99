"""Language identification of mixed-language text: script ranges, per-word scores, and a Viterbi path over words.

The languages and their models are learned from labelled rows: how often each byte 4-gram (hashed to 2^16 buckets) and
each script occurs in a language. The letters' scripts narrow a word's candidates to languages that use its script. A
word's score under a language is the log likelihood of its 4-grams. The Viterbi path maximises the sum of scores less a
penalty for each switch of language between words; its runs are the spans. The document's language is the one with the
most letters, and the score is its share of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from rippleframe.llm.common import by_slice, sliced
from rippleframe.llm.quality_rules import _FOLD, folded, grams, hashed

BUCKET_BITS, ORDER = 16, 4
#: Cost of a switch of language between two words, in nats.
PENALTY = 12.0
#: Scores of bytes by language that are held at a time; a long text is scored in parts of whole words.
HELD_SCORES = 1 << 22
#: A language uses a script that has at least this share of its letters.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: First code points of Unicode blocks, and the script from there on (0: no script).
SCRIPTS = ["none", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "georgian", "hangul", "kana", "han"]
RANGES = [
    (0x00, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xC0, 1), (0xD7, 0), (0xD8, 1), (0xF7, 0), (0xF8, 1), (0x2B0, 0),
    (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 0), (0x750, 6), (0x780, 0), (0x900, 7), (0xE00, 8),
    (0xE80, 0), (0x10A0, 9), (0x1100, 10), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 11), (0x3100, 0),
    (0x3400, 12), (0xA000, 0), (0xAC00, 10), (0xD7B0, 0), (0xF900, 12), (0xFB00, 0), (0xFB50, 6), (0xFE00, 0), (0x20000, 12), (0x30000, 0),
]
_STARTS, _SCRIPT = (np.array(x) for x in zip(*RANGES, strict=True))


def scripts_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return _SCRIPT[np.searchsorted(_STARTS, points, side="right") - 1]


def buckets(data: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (hashed(grams(data, ORDER), 0) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def learned_rows(docs: DataFrame, id_column: str = "doc_id") -> Column:
    """Whether a row may be learned from: crc32 of its id as text is not 1 modulo 3."""
    return F.coalesce(F.crc32(docs[id_column].cast("string")) % 3 != 1, F.lit(True))


class Languages:
    """Log likelihoods by language and bucket, and the scripts each language uses."""

    def __init__(self, names: list[str], counts: np.ndarray):
        """counts: for each language the buckets, then the scripts."""
        self.names = names
        own = counts[:, : 1 << BUCKET_BITS].astype(np.float64) + 0.05
        self.logs = np.log(own / own.sum(axis=1, keepdims=True)).T.astype(np.float32).copy() if names else np.zeros((0, 0), np.float32)
        letters = counts[:, (1 << BUCKET_BITS) + 1 :].astype(np.float64)
        share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
        self.uses = np.hstack([np.ones((len(names), 1), bool), share >= SCRIPT_SHARE])

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Scores (word by language) and letters of each word."""
        data = np.append(folded(text), np.uint8(32))
        if data[-2] == 32:
            data = data[:-1]
        if len(data) < 3:
            return np.zeros((0, len(self.names))), np.zeros(0)
        padded = np.concatenate([data, np.full(ORDER - 1, 32, np.uint8)])
        found = buckets(padded)[: len(data) - 1]  # one for each byte
        starts = np.flatnonzero(data == 32)[:-1]
        scores = np.empty((len(starts), len(self.names)))
        most = max(1, HELD_SCORES // len(self.names))
        first = 0
        while first < len(starts):
            past = max(first + 1, int(np.searchsorted(starts, starts[first] + most)))
            stop = starts[past] if past < len(starts) else len(found)
            scores[first:past] = np.add.reduceat(self.logs[found[starts[first] : stop]], starts[first:past] - starts[first], axis=0)
            first = past
        if text.isascii():
            script = np.where(_FOLD[data[:-1]] >= ord("a"), 1, 0)
            letters = np.add.reduceat(script, starts)
            script = np.maximum.reduceat(script, starts)
        else:
            own = scripts_of(text)
            blank = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            blank = (blank == 32) | ((blank >= 9) & (blank <= 13))
            first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
            own = np.where(blank, 0, own)
            letters = np.add.reduceat((own > 0).astype(np.int64), first)
            script = np.maximum.reduceat(own, first)
        allowed = self.uses[:, script].T
        allowed[~allowed.any(axis=1)] = True  # a script of no language rules none out
        return np.where(allowed, scores, scores - 1e4), letters

    def path(self, scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
        """The best language of each word."""
        n, m = scores.shape
        total = scores.sum(axis=0)
        best = int(total.argmax())
        if m == 1:
            return np.zeros(n, dtype=np.int64)
        # Leaving the best language over any run of words gains at most the run's sum of the largest advantages. Where no
        # run's sum reaches one penalty, the path that stays is the best of all.
        gain = np.cumsum(np.delete(scores, best, axis=1).max(axis=1) - scores[:, best])
        low = np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]]))
        if (gain - low).max() <= penalty:
            return np.full(n, best)
        came = np.empty((n, m), dtype=np.int64)
        now, stay = scores[0].copy(), np.arange(m)
        for t in range(1, n):
            top = int(now.argmax())
            leave = now < now[top] - penalty
            came[t] = np.where(leave, top, stay)
            now = np.where(leave, now[top] - penalty, now) + scores[t]
        out = np.empty(n, dtype=np.int64)
        out[-1] = now.argmax()
        for t in range(n - 1, 0, -1):
            out[t - 1] = came[t, out[t]]
        return out

    def label(self, text: str | None) -> tuple[str, float, list[tuple[int, int, str]]]:
        """Language, score, and spans (first word, past the last word, language)."""
        if not self.names or not text or _LETTER.search(text) is None:
            return UNKNOWN, 0.0, []
        scores, letters = self.words(text)
        way = self.path(scores)
        weight = np.bincount(way, weights=np.maximum(letters, 1e-3), minlength=len(self.names))
        best = int(weight.argmax())
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(way)) + 1, [len(way)]])
        spans = [(int(a), int(b), self.names[way[a]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return self.names[best], float(weight[best] / weight.sum()), spans


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Languages:
    """Counts all rows with a text and a lang. Every lang is learned; at most 2^16 sums of each come to the driver, and the
    model has 256 KB for each."""
    rows = docs.select(docs[text].alias("body"), docs[lang].cast("string").alias("lang")).where("body is not null and lang is not null")
    names = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not names:
        return Languages([], np.zeros((0, (1 << BUCKET_BITS) + len(SCRIPTS)), np.int64))
    number = {k: i for i, k in enumerate(names)}
    width = (1 << BUCKET_BITS) + len(SCRIPTS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part in sliced(batches):
            for x, k in zip(part.column("body").to_pylist(), part.column("lang").to_pylist(), strict=True):
                own = sums.setdefault(number[k], np.zeros(width, np.int64))
                found = buckets(folded(x))
                if len(found) > 4096:
                    own[: 1 << BUCKET_BITS] += np.bincount(found, minlength=1 << BUCKET_BITS)
                else:
                    np.add.at(own, found, 1)
                own[1 << BUCKET_BITS :] += np.bincount(scripts_of(x), minlength=len(SCRIPTS))
        for k, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["k", "at", "n"])

    got = rows.mapInArrow(work, "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(names), width), np.int64)
    counts[got.column("k").to_numpy(), got.column("at").to_numpy()] = got.column("n").to_numpy()
    return Languages(names, counts)


SPANS = ArrayType(StructType([StructField("first", LongType()), StructField("past", LongType()), StructField("lang", StringType())]))


def identify(spark: SparkSession, docs: DataFrame, model: Languages, text: str = "text", id_column: str = "doc_id", with_spans: bool = False) -> DataFrame:
    """One row per document: id, lang_pred, score and, if asked for, spans.

    A null or empty text, or one without a letter, is `und` with the score 0 and no spans; so is every text if no row is
    labelled. Ties go to the first language in order of name. Nulls in other columns, repeated rows and extra columns do
    not matter: only id and text are read. An empty table gives an empty result.
    """
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_column].dataType

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.label(x) for x in batch.column("body").to_pylist()]
        columns = [batch.column("id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
        names = ["id", "lang_pred", "score"]
        if with_spans:
            spans = [[{"first": a, "past": b, "lang": c} for a, b, c in f[2]] for f in found]
            columns.append(pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64()), ("lang", pa.string())]))))
            names.append("spans")
        return pa.RecordBatch.from_arrays(columns, names=names)

    fields = [StructField("id", kind), StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    rows = docs.select(docs[id_column].alias("id"), docs[text].alias("body"))
    return rows.mapInArrow(by_slice(work), StructType(fields + [StructField("spans", SPANS)] * with_spans))
