"""Byte-pair vocabularies learned from a table of words that stays distributed.

A round takes one pass over the words: the driver drafts the next merges from frequent words and a spread of the others, tasks apply the
draft and tell by how much each merge changes the counts of pairs, and the driver takes as many merges of the draft as the
exact counts confirm, at least the first. So the result is that of one merge at a time over all words, whatever the draft.

The driver knows the counts of the `tracked` largest pairs of an epoch. Every other pair is below the least of them, and
stays there: a merge only adds to pairs with the symbol it makes, and those come with the round. A symbol is made by one
merge only, as no merge crosses its borders and so its letters are joined as if they stood alone. An epoch ends when no
tracked pair is above that mark, or after `pending` merges; then the words are written with all merges applied and pairs
are counted again.

The words' table grows with distinct words and is never collected. The driver holds `head` words, `tracked` pairs and those
made above their mark, and the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.operators import tokens
from rippleframe.sources.scratch import drop, shared_dir

#: Symbols are code points; a line feed, which no word holds, is the end of a word; made symbols count from MADE.
STOP, MADE = 10, 0x110000
_FORMS = "form array<int>, n long"
#: Words that a task turns into one array at a time.
CHUNK = 100_000


class Forms:
    """Words as one array of symbols, with a weight each."""

    def __init__(self, form: np.ndarray, sizes: np.ndarray, weight: np.ndarray):
        self.form, self.weight = form, weight
        self.word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    @classmethod
    def spelled(cls, words: list[str], weight: np.ndarray) -> Forms:
        points = np.frombuffer("".join(f"{w}\n" for w in words).encode("utf-32-le"), dtype=np.int32)
        return cls(points, np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=len(words)), weight)

    def copy(self) -> Forms:
        other = object.__new__(Forms)
        other.form, other.word, other.weight = self.form, self.word, self.weight  # merges make new arrays
        return other

    def touched(self, merges: list[tuple[int, int, int]]) -> Forms:
        """The words that these merges change: each has a pair of symbols that none of the merges makes."""
        old = np.array([m for m in merges if max(m[:2]) < merges[0][2]], dtype=np.int64)
        sides = np.zeros((2, max(int(self.form.max(initial=0)), int(old.max())) + 1), dtype=bool)
        sides[0, old[:, 0]] = sides[1, old[:, 1]] = True
        at = np.flatnonzero(sides[0][self.form[:-1]] & sides[1][self.form[1:]])
        at = at[self.word[at] == self.word[at + 1]]
        at = at[np.isin(_key(self.form[at], self.form[at + 1]), _key(old[:, 0], old[:, 1]))]
        kept = np.zeros(len(self.weight), dtype=bool)
        kept[self.word[at]] = True
        symbols = kept[self.word]
        return Forms(self.form[symbols], np.bincount(self.word, minlength=len(kept))[kept], self.weight[kept])

    def pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs at these places within words, and their weights."""
        at = at[(at >= 0) & (at < len(self.form) - 1)]
        at = at[self.word[at] == self.word[at + 1]]
        return _added(_key(self.form[at], self.form[at + 1]), self.weight[self.word[at]])

    def merge(self, left: int, right: int, joined: int) -> tuple[np.ndarray, np.ndarray]:
        """Joins the pair everywhere, from the left; pairs whose counts change, and by how much."""
        at = np.flatnonzero(self.form[:-1] == left)
        at = at[(self.form[at + 1] == right) & (self.word[at] == self.word[at + 1])]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left == right:  # in a run every second place
            first = np.concatenate([[True], np.diff(at) != 1])
            at = at[(at - at[first][np.cumsum(first) - 1]) % 2 == 0]
        lost, less = self.pairs(np.unique(np.concatenate([at - 1, at, at + 1])))
        form = self.form.copy()
        form[at] = joined
        stay = np.ones(len(form), dtype=bool)
        stay[at + 1] = False
        self.form, self.word = form[stay], self.word[stay]
        at = at - np.arange(len(at))
        made, more = self.pairs(np.unique(np.concatenate([at - 1, at])))
        return _added(np.concatenate([lost, made]), np.concatenate([-less, more]))


def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.astype(np.int64) << 32 | right.astype(np.int64)


def _added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(keys), dtype=np.int64)
    np.add.at(sums, place, values)
    return keys[sums != 0], sums[sums != 0]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Forms]:
    """Rows of the words' table, some CHUNK at a time."""
    held: list[tuple] = []
    for batch in batches:
        forms = batch.column("form")
        held.append((forms.flatten().to_numpy(zero_copy_only=False), np.diff(forms.offsets.to_numpy()), batch.column("n").to_numpy(zero_copy_only=False)))
        if sum(len(sizes) for _, sizes, _ in held) >= CHUNK:
            yield Forms(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
    if held:
        yield Forms(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = Forms.spelled(batch.column("word").to_pylist(), np.zeros(batch.num_rows, np.int64))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(own.word, minlength=batch.num_rows))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, own.form), batch.column("n")], ["form", "n"])


def _applied(merges: list[tuple[int, int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _chunks(batches):
            for m in merges:
                own.merge(*m)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(own.word, minlength=len(own.weight)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, own.form), pa.array(own.weight)], ["form", "n"])

    return run


def _counted(made: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _chunks(batches):
            keys, sums = own.pairs(np.arange(len(own.form)))
            sides = [[_name(int(i), made) for i in side] for side in (keys >> 32, keys & 0xFFFFFFFF)]
            yield pa.RecordBatch.from_arrays([pa.array(sides[0], pa.string()), pa.array(sides[1], pa.string()), pa.array(sums)], ["left", "right", "n"])

    return run


def _changes(merges: list[tuple[int, int, int]], draft: list[tuple[int, int, int]], known: np.ndarray):
    """step, pair, d of each merge of the draft, for known pairs and those with a symbol of the draft."""
    fresh = draft[0][2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _chunks(batches):
            own = own.touched([*merges, *draft])
            for m in merges:
                own.merge(*m)
            for step, m in enumerate(draft):
                keys, sums = own.merge(*m)
                new = ((keys >> 32) >= fresh) | ((keys & 0xFFFFFFFF) >= fresh)
                kept = new | np.isin(keys, known)
                steps = np.full(int(kept.sum()), step, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(steps), pa.array(keys[kept]), pa.array(new[kept]), pa.array(sums[kept])], ["step", "pair", "new", "d"])

    return run


def _name(symbol: int, made: list[str]) -> str:
    return tokens.END if symbol == STOP else chr(symbol) if symbol < MADE else made[symbol - MADE]


def _draft_words(counts: DataFrame, head: int) -> list:
    """word, n: the most frequent words, half of `head`, and about as many spread over all others, which stand for these
    with their weight. Exact counts decide on every merge that is drafted from them."""
    top = counts.orderBy(F.desc("n"), "word").limit(head // 2).collect()
    rest = counts.where((F.col("n") < top[-1].n) | ((F.col("n") == top[-1].n) & (F.col("word") > top[-1].word))) if top else counts
    every = max(1, rest.count() // max(1, head - len(top)))
    spread = rest.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).limit(head - len(top))
    return top + spread.select("word", (F.col("n") * every).alias("n")).collect()


def learn(counts: DataFrame, size: int, tracked: int = 4_096, ahead: int = 96, pending: int = 64, head: int = 120_000) -> tokens.Bpe:
    """Merges of the most frequent pair, of ties the largest, until the vocabulary has `size` tokens or no pair occurs twice.

    counts: word, n; words without white space, each once. Null and empty words are left out, other columns are not read.
    An empty table gives the special tokens and the end of a word. The other parameters change the time, not the result:
    merges drafted per round, merges until the words are written anew, words that drafts look at.
    """
    spark = counts.sparkSession
    folder = shared_dir(spark)
    counts.where("word <> ''").select("word", F.col("n").cast("long").alias("n")).write.parquet(f"{folder}/words")
    counts = spark.read.parquet(f"{folder}/words")
    made: list[str] = []
    ids = {r.ch: ord(r.ch) for r in tokens.characters(counts).collect()} | {tokens.END: STOP}  # at most Unicode's letters
    vocab = {t: i for i, t in enumerate([*tokens.SPECIALS, *sorted(ids)])}
    rows = _draft_words(counts, head)
    top = Forms.spelled([r.word for r in rows], np.fromiter((r.n for r in rows), dtype=np.int64, count=len(rows)))
    counts.mapInArrow(_spell, _FORMS).write.parquet(f"{folder}/forms-0")
    merges: list[tuple[str, str]] = []
    epoch, steps, waiting, done = 0, 8, [], False
    while not done:
        if waiting:
            spark.read.parquet(f"{folder}/forms-{epoch}").mapInArrow(_applied(waiting), _FORMS).write.parquet(f"{folder}/forms-{epoch + 1}")
            drop(spark, f"{folder}/forms-{epoch}")
            epoch, waiting = epoch + 1, []
        words = spark.read.parquet(f"{folder}/forms-{epoch}")
        pairs = words.mapInArrow(_counted(made), "left string, right string, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))
        found = pairs.orderBy(F.desc("n"), F.desc("left"), F.desc("right")).limit(tracked).collect()
        exact = {(r.left, r.right): r.n for r in found}
        last = found[-1] if len(found) == tracked else None
        mark = (last.n, (last.left, last.right)) if last else (1, ("", ""))

        def best(table: dict, mark: tuple = mark) -> tuple[str, str] | None:
            """The pair to merge next, none if it may not be among those that are tracked."""
            pair = max(table, key=lambda p: (table[p], p), default=None)
            return pair if pair and table[pair] >= 2 and (table[pair], pair) >= mark else None

        done = len(vocab) >= size or best(exact) is None  # of fresh counts the largest is tracked
        while not done and len(waiting) < pending and best(exact):
            draft, guess, own, names = [], dict(exact), top.copy(), dict(ids)
            while len(draft) < min(steps, ahead, size - len(vocab)) and (pair := best(guess)):
                joined = pair[0] + pair[1]
                names[joined] = MADE + len(made) + len(draft)
                draft.append((names[pair[0]], names[pair[1]], names[joined]))
                label = {i: t for t, i in names.items()}
                keys, sums = own.merge(*draft[-1])
                seen = {(label[k >> 32], label[k & 0xFFFFFFFF]): d for k, d in zip(keys.tolist(), sums.tolist(), strict=True)}
                scale = guess[pair] / max(1, -seen.get(pair, 0))
                for p, d in seen.items():
                    if p in guess or joined in p:
                        guess[p] = guess.get(p, 0) + d * scale
                guess.pop(pair, None)
            known = np.array([ids[a] << 32 | ids[b] for a, b in exact], dtype=np.int64)
            told = words.mapInArrow(_changes(waiting, draft, known), "step int, pair long, new boolean, d long").groupBy("step", "pair", "new").agg(F.sum("d").alias("d"))
            told = told.where(~F.col("new") | (F.col("d") >= mark[0]) | (F.col("d") < 0)).collect()
            label = {i: t for t, i in names.items()}
            by_step: dict[int, list] = {}
            for r in told:
                by_step.setdefault(r.step, []).append(((label[r.pair >> 32], label[r.pair & 0xFFFFFFFF]), r.d))
            taken = 0
            for step, m in enumerate(draft):
                pair = label[m[0]], label[m[1]]
                if best(exact) != pair:
                    break
                joined = pair[0] + pair[1]
                merges.append(pair)
                vocab.setdefault(joined, len(vocab))
                ids[joined] = m[2]
                made.append(joined)
                top.merge(*m)
                waiting.append(m)
                taken += 1
                for p, d in by_step.get(step, []):
                    if p in exact:
                        exact[p] += d
                        if not exact[p]:
                            del exact[p]
                    elif d >= mark[0] and joined in p:
                        exact[p] = d
            steps = min(ahead, 2 * taken) if taken == len(draft) else max(4, 2 * taken)
            done = len(vocab) >= size
    drop(spark, folder)
    return tokens.Bpe(vocab, merges)


def train(docs: DataFrame, size: int, text: str = "text") -> tokens.Bpe:
    """The vocabulary of all texts; null texts have no words."""
    return learn(tokens.word_counts(docs, text), size)
