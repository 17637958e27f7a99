"""Packing token sequences as a cutting-stock problem, solved by column generation.

Every document's ids are cut into full pieces of `capacity` ids and a remainder. Full pieces are sequences of their own.
The remainders' lengths, rounded up to a grain, form a histogram of at most capacity / grain classes, whatever the
input's size; only that histogram comes to the driver. A linear program over patterns (how many pieces of each class go
into one sequence) is solved by column generation: its duals price pieces, and a knapsack dynamic program finds the
pattern that is worth most. Whole multiples of the patterns are taken, what is left is packed best-fit, and patterns are
given to the ranked documents of each class by rank intervals, in a distributed join.
"""

from __future__ import annotations

import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rippleframe.llm.common import by_slice, held, shared_dir, written

CAPACITY, GRAIN = 2048, 8
#: Id that ends each document.
END_ID = 1
#: Chunks that a worker remembers; it starts anew beyond that.
REMEMBERED = 900_000
#: A full stop or comma between an ASCII letter and white space: a pre-token of its own, so it can stand alone.
_STOP = re.compile(rb"(?<=[a-z])([.,])(?=[ \t-\r]|\Z)")
_MARK = regex.compile(r"\p{M}")
#: By the format, the tokens that end a word end so.
WORD_END = "</w>"
#: Chunks of more bytes are not remembered.
LONGEST_REMEMBERED = 64
#: Pieces in one task when they are ranked.
RANKED_ROWS = 200_000


class WordIds:
    """Packed ids of white-space-free chunks. The tokenizer drops white space, so a text's ids are its chunks' ids.

    It also lower-cases, after composing characters; so ASCII letters can be lower-cased before unless a combining mark
    follows somewhere, or a special token's string may be there.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.seen: dict[bytes, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True

    @staticmethod
    def chunks(text: str) -> list[bytes]:
        data = text.encode()
        if "<|" in text or not (text.isascii() or _MARK.search(text) is None):
            return data.split()
        return _STOP.sub(rb" \1", data.lower()).split()

    def _learn(self, new: list[bytes]) -> None:
        """Encodes chunks. A chunk of letters is one word, whose last id alone ends one; so many are encoded as one text."""
        single, groups, letters = [], [], []
        for c in new:
            x = c.decode()
            (letters if x.isalpha() else single).append((c, x))
        for start in range(0, len(letters), 256):
            groups.append(letters[start : start + 256])
        found = self.tokenizer.encode_batch_fast([" ".join(x for _, x in g) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, found, strict=True):
            ids = np.array(e.ids, "<u4")
            edges = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(edges) != len(group):  # some letter falls apart when it is lower-cased
                single += group
                continue
            raw = ids.tobytes()
            self.seen.update((c, raw[a:b]) for (c, _), a, b in zip(group, [0, *edges], edges, strict=False))
        for start in range(0, len(single), 4096):
            part = single[start : start + 4096]
            found = self.tokenizer.encode_batch_fast([x for _, x in part], add_special_tokens=False)
            self.seen.update((c, np.array(e.ids, "<u4").tobytes()) for (c, _), e in zip(part, found, strict=True))

    def packed(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        chunks = [self.chunks(x) for x in texts]
        new = set().union(*chunks)
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        new = list(new.difference(self.seen))
        self._learn(new)
        get = self.seen.__getitem__
        out = [b"".join(map(get, c)) for c in chunks]
        for c in new:
            if len(c) > LONGEST_REMEMBERED:
                del self.seen[c]
        return out


def word_ids(path: str) -> WordIds:
    return held(("word_ids", path), lambda: WordIds(path))


def cut(docs: DataFrame, path: str, text: str = "text", id_column: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every whole document: id, start, length, ids_crc32, doc_tokens. A null text is empty: just the end id."""
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
    end = END_ID.to_bytes(4, "little")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: tuple[list, ...] = ([], [], [], [], [])
        for i, packed in zip(batch.column("id").to_pylist(), word_ids(path).packed(batch.column("body").to_pylist()), strict=True):
            packed += end
            n = len(packed) // 4
            for start in range(0, n, capacity):
                part = packed[4 * start : 4 * (start + capacity)]
                for column, value in zip(rows, (i, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], schema=schema)

    rows = docs.select(docs[id_column].cast("long").alias("id"), F.coalesce(docs[text], F.lit("")).alias("body"))
    return rows.mapInArrow(by_slice(work, ("word_ids", path)), "id long, start long, length long, ids_crc32 long, doc_tokens long")


@dataclass
class Pattern:
    """How many sequences, and pieces of each class in one of them."""

    times: int
    pieces: dict[int, int]


def best_pattern(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: the multiset of sizes within room that is worth most, and its worth."""
    worth, last = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), side="right")  # sizes ascend
    for c in range(int(sizes[0]), room + 1):
        n = fits[c]
        tried = worth[c - sizes[:n]] + values[:n]
        k = tried.argmax()
        worth[c] = worth[c - 1]
        if tried[k] > worth[c] + 1e-12:
            worth[c], last[c] = tried[k], k
    counts, c = np.zeros(len(sizes)), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(worth[room]), counts


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots. Small matrices only; it needs no threads of a linear algebra library."""
    m = len(matrix)
    both = np.hstack([matrix.astype(float), np.eye(m)])
    for k in range(m):
        r = k + int(np.abs(both[k:, k]).argmax())
        both[[k, r]] = both[[r, k]]
        both[k] /= both[k, k]
        rest = both[:, k].copy()
        rest[k] = 0
        both -= np.outer(rest, both[k])
    return both[:, m:]


def solve(demand: dict[int, int], room: int, most: int = 4_000, gap: float = 0.002) -> list[Pattern]:
    """Patterns that cover the demand: the linear program by column generation, rounded down, then best fit.

    A revised simplex keeps the inverse of the basis. A pattern worth w more than the sequence it fills bounds what can
    still be gained: it stops within a share `gap` of the optimum, or with the feasible basis it has after `most` columns.
    A small uneven addition to the demand keeps the simplex from cycling.
    """
    sizes = np.array(sorted(k for k, n in demand.items() if n > 0), dtype=np.int64)
    m = len(sizes)
    if not m:
        return []
    wanted = np.array([demand[int(s)] for s in sizes], dtype=float)
    basis = np.diag((room // sizes).astype(float))
    cost = np.ones(m)
    inverse = np.diag(1 / np.diag(basis))
    eased = wanted + 1e-3 * (1 + np.arange(m) * 0.618 % 1)
    amount = inverse @ eased
    for step in range(most):
        price = cost @ inverse
        if (k := int(price.argmin())) < -1e-9:  # more than the demand of this class may be made
            column, own = np.zeros(m), 0.0
            column[k] = -1
        else:
            worth, column = best_pattern(sizes, price, room)
            own = 1.0
            if worth <= 1 + gap:
                break
        way = inverse @ column
        rises = way > 1e-9
        if not rises.any():
            break
        ratio = np.where(rises, amount / np.where(rises, way, 1), np.inf)
        r = int(ratio.argmin())
        amount -= ratio[r] * way
        amount[r] = ratio[r]
        np.maximum(amount, 0, out=amount)
        row = inverse[r] / way[r]
        inverse -= np.outer(way, row)
        inverse[r] = row
        basis[:, r], cost[r] = column, own
        if step % 500 == 499:
            inverse = inverted(basis)
            amount = np.maximum(inverse @ eased, 0)
    left, out = wanted.astype(np.int64), []
    for r in range(m):
        counts = basis[:, r].astype(np.int64)
        if cost[r] and (times := int(amount[r] + 1e-6)) > 0:
            times = min(times, int((left[counts > 0] // counts[counts > 0]).min()))
            if times:
                left -= times * counts
                out.append(Pattern(times, {int(s): int(n) for s, n in zip(sizes, counts, strict=True) if n}))
    return out + best_fit({int(s): int(n) for s, n in zip(sizes, left, strict=True) if n}, room)


def best_fit(demand: dict[int, int], room: int) -> list[Pattern]:
    """Packs few pieces: the largest that still fits goes next. Like sequences are made at once."""
    left, out = dict(demand), []
    while left:
        pieces, free = {}, room
        for s in sorted(left, reverse=True):
            if n := min(left[s], free // s):
                pieces[s] = n
                free -= n * s
        times = min(left[s] // n for s, n in pieces.items())
        for s, n in pieces.items():
            left[s] -= times * n
            if not left[s]:
                del left[s]
        out.append(Pattern(times, pieces))
    return out


def pack(spark: SparkSession, docs: DataFrame, path: str, text: str = "text", id_column: str = "doc_id", capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Packs all documents: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. A null id is packed as any other. Rows that repeat an id are documents of
    their own. Ties of length are ranked by id, then by place in the input. Other columns, whatever their names, are not
    read. An empty table gives an empty result.
    """
    scratch = shared_dir(spark)
    pieces = written(spark, cut(docs, path, text, id_column, capacity).withColumn("uid", F.monotonically_increasing_id()), f"{scratch}/pieces")
    room = capacity // grain
    # Class 0 has the full pieces.
    pieces = pieces.withColumn("class", F.when(F.col("length") == capacity, 0).otherwise(F.ceil(F.col("length") / grain)).cast("int"))
    histogram = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = max(1, -(-sum(histogram.values()) // RANKED_ROWS))
    patterns = solve({k: n for k, n in histogram.items() if k}, room)
    intervals, used, sequences = [], dict.fromkeys(histogram, 0), 0
    for p in patterns:
        for k, n in p.pieces.items():
            first = used[k]
            used[k] += n * p.times
            intervals.append((k, first, used[k], n, sequences))
        sequences += p.times
    intervals.append((0, 0, histogram.get(0, 0), 1, sequences))
    slots = spark.createDataFrame(intervals, "class int, first long, past long, each long, base long")

    ranked = pieces.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int"))
    before = ranked.groupBy("class", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("class", "salt", (F.sum("n").over(Window.partitionBy("class").orderBy("salt")) - F.col("n")).alias("ahead"))
    ranked = ranked.withColumn("own", F.row_number().over(Window.partitionBy("class", "salt").orderBy("id", "uid")))
    ranked = ranked.join(F.broadcast(before), ["class", "salt"]).withColumn("rank", F.col("ahead") + F.col("own") - 1)
    placed = ranked.join(F.broadcast(slots), "class").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))
    step = F.col("rank") - F.col("first")
    placed = placed.select(
        "id", "start", "length", "ids_crc32", "doc_tokens", "class",
        (F.col("base") + F.expr("(rank - first) div each")).alias("sequence_id"), (step % F.col("each")).alias("turn"),
    )
    order = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "turn")
    shared = placed.where("class > 0").withColumn("offset", F.sum("length").over(order) - F.col("length"))
    full = placed.where("class = 0").withColumn("offset", F.lit(0).cast("long"))
    return shared.unionByName(full).drop("class", "turn")
