"""Quality rules with n-gram perplexity: a modified Kneser-Ney model for each language, counted by Spark.

The n-grams are of bytes of lower-cased text, whose white space is one blank and whose digits are 0: such a model has
scripts of every kind, and its types saturate where those of words grow with the corpus. Tasks count n-grams of the highest order in a
slice with vector operations, and Spark adds the counts over all documents. Lower orders count distinct left
extensions, as Kneser-Ney asks. Discounts come from counts of counts, for each language and order. The model is
stored as sorted arrays of hashes with logarithms of probabilities. It holds every n-gram with its whole count, so what is
broadcast grows with the number of distinct n-grams.

Two measures of a document are held against bands of its language. Its perplexity must not lie above the upper one. Its
perplexity by types, where each distinct n-gram of the highest order counts once as in Kneser-Ney's lower orders, must not
lie below the lower one: contexts that little but the document itself has are nearly certain there, while a text that is
copied often gains nothing. Medians and spreads have one vote for each distinct text that passes the base rules. Means over
n bytes stray with 1 / sqrt(n), so spreads are of deviations times sqrt(n), and at least that of the longest tenth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rippleframe.llm.common import by_slice, shared_dir, sliced, written

#: Highest order of the byte n-grams, at most 7 to fit 8 bytes with the language.
ORDER = 5
#: A worker spreads the highest order over so many places for each n-gram at least, 14 bytes each; a place is checked by 32 further bits.
PLACES = 4
#: Bands: middle - LOW x spread of log perplexity by types, middle + HIGH x spread of log perplexity.
LOW, HIGH = 18.0, 14.0
#: A language with fewer distinct texts that pass the base rules has no bands.
LEAST_VOTES = 30
#: The spread counts as this at least, in nats.
LEAST_SPREAD = 0.002
#: Discount of a type.
TYPE_DISCOUNT = 0.5
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\v\f\r"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[ord("0") : ord("9") + 1] = ord("0")
_FOLD[list(WHITE.encode())] = 32


def folded(text: str) -> np.ndarray:
    """Bytes of the text with ASCII letters lower-cased, digits as 0 and runs of white space as one blank, after a blank."""
    raw = _FOLD[np.frombuffer((" " + text).encode(), dtype=np.uint8)]
    blank = raw == 32
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return raw[keep]


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """Packed n-grams, one for each byte after the first order - 1."""
    if len(data) < order:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(data) - order + 1, dtype=np.uint64)
    for k in range(order):
        out = (out << np.uint64(8)) | data[k : len(data) - order + 1 + k].astype(np.uint64)
    return out


def hashed(codes: np.ndarray, lang: int) -> np.ndarray:
    """Hash of n-gram and language: 64 bits, a bijection of the n-grams of a language."""
    x = codes ^ np.uint64((lang + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def place(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> np.uint64(64 - bits)


def check(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(32 - min(bits, 32))).astype(np.uint32)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode().split()
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in WHITE)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    n_dup = 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            n_dup += line in seen
            seen.add(line)
    n_repeat = 0
    if n >= 3:
        own = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.fromiter(map(own.__getitem__, words), dtype=np.int64, count=n)
        m = len(own)
        pair = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)[1]
        _, place, count = np.unique(pair[:-1] * m + ids[2:], return_inverse=True, return_counts=True)
        twice = count[place] > 1
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        n_repeat = int(covered.sum())
    return n, word_chars, n_symbols, n_dup, n_repeat


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Counts (lang, code, n) of the highest order over all documents; docs has body and lang."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def fold() -> None:
            for lang, parts in held.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                if lang in sums:
                    codes = np.concatenate([sums[lang][0], codes])
                    n = np.concatenate([sums[lang][1], n])
                    codes, place = np.unique(codes, return_inverse=True)
                    n = np.bincount(place, weights=n).astype(np.int64)
                sums[lang] = (codes, n)
            held.clear()

        for part in sliced(batches):
            for text, lang in zip(part.column("body").to_pylist(), part.column("lang").to_pylist(), strict=True):
                codes = grams(folded(text), order)
                held.setdefault(lang, []).append(codes)
                size += len(codes)
            if size > 2_000_000:
                fold()
                size = 0
            if sum(len(c) for c, _ in sums.values()) > 1_500_000:  # bounds the task's memory; Spark adds the rest
                yield from rows(sums)
                sums.clear()
        fold()
        yield from rows(sums)

    def rows(sums: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, (codes, n) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(codes), lang, np.int32)), pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"]
            )

    found = docs.select("body", "lang").mapInArrow(work, "lang int, code long, n long")
    return found.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def discounts(histogram: dict[int, int]) -> tuple[float, float, float]:
    """Chen and Goodman's discounts for counts 1, 2 and 3 or more, from how many types have each count."""
    n1, n2, n3, n4 = (float(histogram.get(k, 0)) for k in (1, 2, 3, 4))
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(float(min(max(x, 0.01), k + 0.99)) for k, x in enumerate(d))


class KneserNey:
    """Interpolated modified Kneser-Ney over sorted arrays of hashes, for one language or more.

    found: for each order, the sorted hashes of its n-grams and their log probabilities. weight: for each length of a
    context, the sorted hashes of contexts and the logarithm of the weight that unseen continuations get. types: log
    probabilities of the highest order's n-grams where each counts once, in the order of found.
    """

    def __init__(self, order: int):
        self.order = order
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.weight: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.types = np.zeros(0, dtype=np.float32)

    @classmethod
    def fit(cls, top: dict[int, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> "KneserNey":
        """top: for each language the packed n-grams of the highest order, and their counts."""
        self = cls(order)
        found: dict[int, list] = {k: [] for k in range(1, order + 1)}
        weight: dict[int, list] = {k: [] for k in range(order)}
        types: list[tuple[np.ndarray, np.ndarray]] = []
        for lang, (codes, counts) in top.items():
            ascending = np.argsort(codes)
            level = {order: (codes[ascending].astype(np.uint64), counts[ascending].astype(np.float64))}
            for k in range(order - 1, 0, -1):  # distinct left extensions
                own, n = np.unique(level[k + 1][0] & np.uint64((1 << 8 * k) - 1), return_counts=True)
                level[k] = (own, n.astype(np.float64))
            lower = None
            for k in range(1, order + 1):
                own, n = level[k]
                base, at = np.unique(own >> np.uint64(8), return_inverse=True)
                total = np.bincount(at, weights=n)
                d = np.array([0.0, *discounts({c: int((n == c).sum()) for c in (1, 2, 3, 4)})])
                cut = np.minimum(d[np.minimum(n, 3).astype(int)], n)
                gamma = np.bincount(at, weights=cut) / total
                if lower is None:
                    below = np.full(len(own), 1 / 256)
                else:
                    below = lower[1][np.searchsorted(lower[0], own & np.uint64((1 << 8 * (k - 1)) - 1))]
                p = (n - cut) / total[at] + gamma[at] * below
                lower = (own, p)
                found[k].append((hashed(own, lang), np.log(p)))
                weight[k - 1].append((hashed(base, lang), np.log(np.maximum(gamma, 1e-9))))
            types.append((found[order][-1][0], np.log((1 - TYPE_DISCOUNT) / np.bincount(at)[at] + TYPE_DISCOUNT * below)))
        if types:
            self.types = np.concatenate([b for _, b in types])[np.argsort(np.concatenate([a for a, _ in types]))].astype(np.float32)
        for parts, out in ((found, self.found), (weight, self.weight)):
            for k, x in parts.items():
                if x:
                    keys = np.concatenate([a for a, _ in x])
                    ascending = np.argsort(keys)
                    out[k] = (keys[ascending], np.concatenate([b for _, b in x])[ascending].astype(np.float32))
        return self

    def spread(self) -> tuple[int, np.ndarray, np.ndarray]:
        """The highest order by place: bits of a place, check bits, and log probabilities by counts and by types, NaN where there is none."""
        if not hasattr(self, "_spread"):
            keys, logs = self.found.get(self.order, (np.zeros(0, np.uint64), np.zeros(0, np.float32)))
            bits = max(16, (PLACES * len(keys)).bit_length())
            checks, values = np.zeros(1 << bits, dtype=np.uint32), np.full((1 << bits, 2), np.nan, dtype=np.float32)
            at = place(keys, bits)
            checks[at], values[at, 0], values[at, 1] = check(keys, bits), logs, self.types
            self._spread = bits, checks, values
        return self._spread

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_spread"}

    @staticmethod
    def _look(arrays: dict, k: int, keys: np.ndarray, none: float) -> np.ndarray:
        if k not in arrays:
            return np.full(len(keys), none, dtype=np.float32)
        own, values = arrays[k]
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        return np.where(own[at] == keys, values[at], np.float32(none))

    def log_probabilities(self, data: np.ndarray, lang: int) -> np.ndarray:
        """Of each byte after the first order - 1, given those before it."""
        return self.both(data, lang)[:, 0]

    def both(self, data: np.ndarray, lang: int) -> np.ndarray:
        """The same by counts and by types, in two columns. They differ for n-grams of the highest order only."""
        codes = grams(data, self.order)
        keys, (bits, checks, values) = hashed(codes, lang), self.spread()
        at = place(keys, bits)
        out = values[at]
        open_ = np.flatnonzero((checks[at] != check(keys, bits)) | np.isnan(out[:, 0]))
        carried = np.zeros((len(open_), 2), dtype=np.float32)
        for k in range(self.order, -1, -1):  # backs off; the weight of an unknown context is 1
            if not len(open_):
                break
            if not k:
                out[open_] = carried - np.float32(np.log(256))
                break
            own = codes[open_] & np.uint64((1 << 8 * k) - 1)
            where = hashed(own, lang)
            p = self._look(self.found, k, where, np.nan)
            known = ~np.isnan(p)
            out[open_[known]] = p[known, None] + carried[known]
            if k == self.order and known.any():
                out[open_[known], 1] = self.types[np.searchsorted(self.found[k][0], where[known])]
            open_, own = open_[~known], own[~known]
            w = self._look(self.weight, k - 1, hashed(own >> np.uint64(8), lang), 0.0)
            by_type = np.where(w == 0, w, np.float32(np.log(TYPE_DISCOUNT))) if k == self.order else w
            carried = carried[~known] + np.stack([w, by_type], axis=1)
        return out

    def log_perplexities(self, text: str, lang: int) -> tuple[float | None, float | None]:
        """Log perplexity by counts and by types; none of a text shorter than the order."""
        data = folded(text)
        if len(data) < self.order:
            return None, None
        by_count, by_type = (-self.both(data, lang).mean(axis=0, dtype=np.float64)).tolist()
        return by_count, by_type

    def log_perplexity(self, text: str, lang: int) -> float | None:
        return self.log_perplexities(text, lang)[0]


def fit_model(spark: SparkSession, docs: DataFrame, scratch: str, order: int = ORDER) -> KneserNey:
    """Counts all documents. All distinct n-grams come to the driver, language by language, 16 bytes each."""
    counted = written(spark, count_grams(docs, order), f"{scratch}/grams")
    top = {}
    for k in [r["lang"] for r in counted.select("lang").distinct().collect()]:
        got = counted.where(F.col("lang") == k).select("code", "n").toArrow()
        top[k] = (got.column("code").to_numpy().view(np.uint64), got.column("n").to_numpy())
    return KneserNey.fit(top, order)


_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double, type_log_perplexity double"


def _prepared(docs: DataFrame, text: str, lang: str) -> tuple[DataFrame, list[str]]:
    """The documents with body, the number of the language, and all columns in the struct `doc`; the languages' names."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.coalesce(docs[text], F.lit("")).alias("body"), docs[lang].cast("string").alias("name"))
    names = sorted(r["name"] for r in rows.where("name is not null").select("name").distinct().collect())
    numbered = F.create_map(*[x for k, v in enumerate(names) for x in (F.lit(v), F.lit(k))])[F.col("name")] if names else F.lit(None)
    return rows.select("doc", "body", F.coalesce(numbered, F.lit(len(names))).cast("int").alias("lang")), names


def _measured(rows: DataFrame, shared, carried: list[str]) -> DataFrame:
    """Base counts and log perplexity of each row, beside the columns carried; row by row, without a shuffle."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, logs = [], []
        for x, k in zip(batch.column("body").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            counts.append(base_counts(x))
            logs.append(shared.value.log_perplexities(x, k))
        columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(5)]
        kept = [batch.column(c) for c in carried]
        return pa.RecordBatch.from_arrays([*kept, *columns, *(pa.array([x[k] for x in logs], pa.float64()) for k in range(2))], names=names)

    extra = StructType.fromDDL(_DDL)
    names = [*carried, *extra.names]
    schema = StructType([rows.schema[c] for c in carried] + extra.fields)
    return rows.mapInArrow(by_slice(work), schema)


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _size() -> Column:
    return F.greatest(F.col("word_chars") + F.col("n_words"), F.lit(1))


def _bands(measured: DataFrame) -> DataFrame:
    """For each lang and measure the middle, the spread (times sqrt(size)) and the least spread. measured has digest, a hash of the text."""
    votes = measured.where(~_base_failed() & F.col("log_perplexity").isNotNull()).withColumn("size", _size())
    votes = votes.select("lang", "digest", "size", "log_perplexity", "type_log_perplexity").dropDuplicates(["lang", "digest"])
    half = lambda x: F.percentile_approx(x, 0.5, 10_000)
    middle = votes.groupBy("lang").agg(
        F.count(F.lit(1)).alias("votes"), half("log_perplexity").alias("middle"), half("type_log_perplexity").alias("type_middle"), F.percentile_approx("size", 0.9, 10_000).alias("long")
    )
    off, type_off = F.abs(F.col("log_perplexity") - F.col("middle")), F.abs(F.col("type_log_perplexity") - F.col("type_middle"))
    is_long = F.col("size") >= F.col("long")
    least = lambda x: F.greatest(half(F.when(is_long, x)), F.lit(LEAST_SPREAD))
    return (
        votes.join(F.broadcast(middle.where(F.col("votes") >= LEAST_VOTES)), "lang")
        .groupBy("lang", "middle", "type_middle")
        .agg(half(off * F.sqrt("size")).alias("spread"), least(off).alias("least"), half(type_off * F.sqrt("size")).alias("type_spread"), least(type_off).alias("type_least"))
    )


def _judged(measured: DataFrame, bands: DataFrame) -> DataFrame:
    width = lambda spread, least: F.greatest(F.col(spread) / F.sqrt(_size()), F.col(least))
    rows = measured.join(F.broadcast(bands), "lang", "left")
    rows = rows.withColumn("low", F.col("type_middle") - LOW * width("type_spread", "type_least")).withColumn("high", F.col("middle") + HIGH * width("spread", "least"))
    fits = F.coalesce((F.col("type_log_perplexity") >= F.col("low")) & (F.col("log_perplexity") <= F.col("high")), F.lit(True))
    return rows.withColumn("base_failed", _base_failed()).withColumn("kept", ~F.col("base_failed") & fits)


def score(spark: SparkSession, docs: DataFrame, text: str = "text", id_column: str = "doc_id", lang: str = "lang") -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang,
    log_perplexity, type_log_perplexity, low (of the latter), high (of the former).

    A null or empty text has no words, and fails the base rules. A null lang is a language of its own. A text shorter
    than the model's order has no perplexity; a language of few texts has no bands. Null ids and repeated rows are judged row by row. Extra columns are not read. An empty table gives an empty result.
    """
    scratch = shared_dir(spark)
    rows, _ = _prepared(docs.select(*dict.fromkeys([id_column, text, lang])), text, lang)
    shared = spark.sparkContext.broadcast(fit_model(spark, rows, scratch))
    rows = rows.select(F.col("doc")[id_column].alias("id"), "body", "lang", F.xxhash64("body").alias("digest"))
    measured = written(spark, _measured(rows, shared, ["id", "lang", "digest"]), f"{scratch}/measured")
    return _judged(measured, _bands(measured)).select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "log_perplexity", "type_log_perplexity", "low", "high"
    )


def keep(spark: SparkSession, docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that the rules keep, with all their columns. Cases as in score().

    The measures are made twice, once for the bands and once for the verdict, so no text is shuffled or written.
    """
    scratch = shared_dir(spark)
    rows, _ = _prepared(docs, text, lang)
    shared = spark.sparkContext.broadcast(fit_model(spark, rows, scratch))
    measured = _measured(rows.withColumn("digest", F.xxhash64("body")), shared, ["lang", "digest"])
    bands = written(spark, _bands(written(spark, measured, f"{scratch}/measured")), f"{scratch}/bands")
    return _judged(_measured(rows, shared, ["doc", "lang"]), bands).where("kept").select("doc.*")
