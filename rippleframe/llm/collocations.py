"""Phrase collocations from count tries of limited depth.

Shards count their words' n-grams in tries (sorted arrays of nodes in preorder, each with its count) over blocks of
`BLOCK` words. A block's trie is serialised sorted, one row per first word, cut at the bounds of prefix ranges; bounds
come from evenly spaced nodes of a sample of blocks and only balance the work. Spark deals the rows out by range and
merges each range's rows in order; tasks walk the merged trie and add up equal nodes. On the walk every node meets its
ancestors, the left parts of its phrase. A node's suffix link leads to the node without its first word, which is one
level up, so the right parts of longer phrases follow from those of shorter ones, level by level.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rippleframe.llm.common import shared_dir, sliced, split_join, written

LONGEST, LEAST, KEEP, SHARE = 3, 10, 2000, 50
#: Words of a block; bounds a task's memory.
BLOCK = 1_500_000
#: Bytes of text for one prefix range, and for the sample that sets the ranges; nodes of the sample for each range.
RANGE_BYTES, SAMPLE_BYTES, SAMPLED = 64 << 20, 48 << 20, 16
#: Nodes that a task merges at a time.
MERGED = 1_000_000
#: Rows of an Arrow batch that a task returns.
BATCH_ROWS = 20_000
#: Groups of a language's phrases that are ranked apart before its first ones are.
RANK_SALTS = 64
_CUTS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
#: The word that ends a piece; no word holds a line feed.
_END = b"\n"


class _Ids(dict):
    """Numbers words in the order in which they come; 0 ends a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _in_order(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts rows of small non-negative numbers, column by column, and where in it new rows start."""
    widths = [int(c.max()).bit_length() if len(c) else 0 for c in columns]
    if sum(widths) < 63:
        key = np.zeros(len(columns[0]), np.int64)
        for c, w in zip(columns, widths, strict=True):
            key = key << w | c
        order = np.argsort(key, kind="stable")  # merges sorted runs
        key = key[order]
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort(columns[::-1])
        new = np.zeros(max(len(order) - 1, 0), bool)
        for c in columns:
            c = c[order]
            new |= c[1:] != c[:-1]
    return order, np.flatnonzero(np.concatenate([[len(order) > 0], new]))


class Trie:
    """A count trie as nodes in preorder: the ranks of their words, one column per level (0: no word), and counts."""

    def __init__(self, words: list[bytes], ids: np.ndarray, longest: int):
        """words[0] ends a piece; ids: the words in order, with ends."""
        rank = np.zeros(len(words), np.int64)
        by_word = sorted(range(1, len(words)), key=words.__getitem__)
        rank[by_word] = np.arange(1, len(words))
        self.words = [words[i].decode() for i in by_word]
        at, columns = rank.astype(np.int32)[ids], [[] for _ in range(longest)]
        for n in range(1, longest + 1):
            inside = np.ones(max(len(at) - n + 1, 0), bool)
            for k in range(n):
                inside &= at[k : len(at) - n + 1 + k] > 0
            start = np.flatnonzero(inside)
            for k in range(longest):
                columns[k].append(at[start + k] if k < n else np.zeros(len(start), np.int32))
        whole = [np.concatenate(c) for c in columns]
        order, starts = _in_order(whole)
        self.n = np.diff(np.append(starts, len(order)))
        self.levels = [c[order[starts]] for c in whole]

    def __len__(self) -> int:
        return len(self.n)

    def above(self, path: tuple[str, ...]) -> list[int]:
        """Counts of the nodes that lead to a path, as far as they are there."""
        out = []
        for d in range(1, len(path)):
            node = self.place(path[:d])
            if node == len(self) or self.path(node) != path[:d]:
                break
            out.append(int(self.n[node]))
        return out

    def path(self, node: int) -> tuple[str, ...]:
        return tuple(self.words[c[node] - 1] for c in self.levels if c[node])

    def place(self, path: tuple[str, ...]) -> int:
        """The first node that doesn't come before a path."""
        low, high = 0, len(self)
        for level, word in zip(self.levels, path, strict=False):
            k = bisect_left(self.words, word) + 1
            within = level[low:high]
            low, high = low + int(np.searchsorted(within, k)), low + int(np.searchsorted(within, k, side="right"))
            if k > len(self.words) or self.words[k - 1] != word or low == high:
                return low
        return low

    def rows(self, cuts: list[int]) -> tuple:
        """A row per first word and cut: first words, bodies, counts, how many leading nodes are there as ancestors only (with
        a count of 0), and the first node of its own. A body has a node a line: its last word after a blank for each level
        over two."""
        depth = sum((c > 0).astype(np.int64) for c in self.levels)
        nodes, context = np.arange(len(self)), np.zeros(len(self), bool)
        extra_at, extra = [], []
        for cut in cuts:
            if 0 < cut < len(self) and depth[cut] > 1:
                above, node = [], cut
                for d in range(int(depth[cut]) - 1, 0, -1):
                    node = self.place(self.path(cut)[:d])
                    above.append(node)
                extra += above[::-1]
                extra_at += [cut] * len(above)
        if extra:
            nodes, context = np.insert(nodes, extra_at, extra), np.insert(context, extra_at, True)
        first = self.levels[0][nodes]
        starts = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (context[1:] & ~context[:-1])]))
        above = np.add.reduceat(context.astype(np.int64), starts)
        own = nodes[starts + above]
        size = len(self.words)
        names = [""] + [" " * d + w for d in range(len(self.levels) - 1) for w in self.words]
        last = np.zeros(len(self), np.int64)
        for d, c in enumerate(self.levels[1:]):
            last = np.where(c > 0, d * size + c, last)
        tokens = pa.array(names, pa.string()).take(pa.array(last[nodes]))
        offsets = np.append(starts, len(nodes))
        bodies = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens), "\n")
        counts = np.where(context, 0, self.n[nodes]).astype("<i4")
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((offsets * 4).astype(np.int32).tobytes()), pa.py_buffer(counts.tobytes())])
        heads = pa.array(self.words, pa.string()).take(pa.array(first[starts] - 1))
        return heads, bodies, packed, above, own


def _blocks(batches: Iterator[pa.RecordBatch], longest: int, size: int = BLOCK) -> Iterator[tuple[str, Trie]]:
    """Tries by language of blocks of whole texts with so many words."""
    words: dict[str, _Ids] = {}
    parts: dict[str, list[np.ndarray]] = {}
    n = 0

    def built() -> Iterator[tuple[str, Trie]]:
        for lang in sorted(words):
            trie = Trie(list(words[lang]), np.concatenate(parts[lang]), longest)
            if len(trie):
                yield lang, trie
        words.clear()
        parts.clear()

    for batch in sliced(batches):
        for lang, body in zip(batch.column("lang").to_pylist(), batch.column("body").to_pylist(), strict=True):
            found = [w for w in body.encode().lower().translate(_CUTS).replace(_END, b" \n ").split(b" ") if w]
            number = words.setdefault(lang, _Ids({_END: 0}))
            ids = np.fromiter(map(number.__getitem__, found), np.int32, len(found))
            parts.setdefault(lang, []).append(np.append(ids, np.int32(0)))
            n += len(found)
            if n >= size:
                yield from built()
                n = 0
    yield from built()


def _bounds(docs: DataFrame, longest: int, ranges: int, size: int) -> list[tuple[str, ...]]:
    """Where prefix ranges start: language and path. Nodes of a sample of texts, evenly spaced in each block's trie."""
    per_block = ranges * SAMPLED // 4
    schema = pa.schema([("lang", pa.string()), ("path", pa.list_(pa.string())), ("weight", pa.int64())])

    def spaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, trie in _blocks(batches, longest):
            step = max(1, len(trie) // per_block)
            paths = [trie.path(k) for k in range(0, len(trie), step)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(paths)), pa.array(paths, schema.field("path").type), pa.array([step] * len(paths))], schema=schema)

    if size > SAMPLE_BYTES:
        docs = docs.where(F.rand(7) < SAMPLE_BYTES / size)
    rows = docs.mapInArrow(spaced, "lang string, path array<string>, weight long").collect()
    found = sorted(((r["lang"], *r["path"]), r["weight"]) for r in rows)
    total, upto, out = sum(n for _, n in found), 0, []
    for path, n in found:
        if upto * ranges >= total * (len(out) + 1) and path not in out[-1:]:
            out.append(path)
        upto += n
    return out


def shards(docs: DataFrame, bounds: list[tuple[str, ...]], longest: int, block: int = BLOCK) -> DataFrame:
    """range, lang, head, body, counts, above: the tries of all blocks, a row per first word and range."""
    schema = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("head", pa.string()), ("body", pa.string()), ("counts", pa.binary()), ("above", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    def serialised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for lang, trie in _blocks(batches, longest, block):
            before, own = bisect_left(bounds, (lang,)), []
            for b in bounds[before:]:
                if b[0] != lang:
                    break
                own.append(trie.place(b[1:]))
            # What a range's nodes have above them lies in earlier ranges; every block tells its counts.
            known = [(before + j + 1, b[1:], n) for j, b in enumerate(bounds[before : before + len(own)]) if (n := trie.above(b[1:]))]
            if known:
                bodies = ["\n".join(["", *[" " * d + w for d, w in enumerate(path[1 : len(n)])]]) for _, path, n in known]
                columns = [[k for k, _, _ in known], [lang] * len(known), [path[0] for _, path, _ in known], bodies, [np.array(n, "<i4").tobytes() for _, _, n in known], [len(n) for _, _, n in known]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            heads, bodies, counts, above, nodes = trie.rows(sorted(set(own)))
            place = before + np.searchsorted(np.array(own, np.int64), nodes, side="right")
            for s in range(0, len(nodes), BATCH_ROWS):
                e = min(s + BATCH_ROWS, len(nodes))
                columns = [pa.array(place[s:e].astype(np.int32)), pa.array([lang] * (e - s)), heads[s:e], bodies[s:e], counts[s:e], pa.array(above[s:e].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(serialised, "range int, lang string, head string, body string, counts binary, above int")


def _walked(table: pa.Table, longest: int, least: int) -> pa.RecordBatch:
    """Nodes of the merged trie of some first words, their rows in order."""
    place, lang, head = table.column("range").to_numpy(), table.column("lang").combine_chunks(), table.column("head").combine_chunks()
    same = (place[1:] == place[:-1]) & pc.equal(lang[1:], lang[:-1]).to_numpy(False) & pc.equal(head[1:], head[:-1]).to_numpy(False)
    group = np.concatenate([[0], np.cumsum(~same)]).astype(np.int64)
    lines = pc.split_pattern(table.column("body").combine_chunks(), "\n")
    row = pc.list_parent_indices(lines).to_numpy()
    lines = pc.list_flatten(lines)
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<i4").astype(np.int64)
    start = np.searchsorted(row, np.arange(len(group)))
    place_in_row = np.arange(len(row)) - start[row]
    context = place_in_row < table.column("above").to_numpy()[row]
    words = pc.ascii_ltrim(lines, " ")
    depth = (pc.binary_length(lines).to_numpy() - pc.binary_length(words).to_numpy()).astype(np.int64) + 2
    depth[place_in_row == 0] = 1
    coded = words.dictionary_encode()
    names = coded.dictionary
    rank = np.empty(len(names), np.int64)
    in_order = pc.sort_indices(names).to_numpy()
    rank[in_order] = np.arange(1, len(names) + 1)
    code = rank[coded.indices.to_numpy()]
    nodes, columns, above = np.arange(len(row)), [group[row]], []
    for d in range(2, longest + 1):
        latest = np.maximum.accumulate(np.where(depth == d, nodes, 0))
        columns.append(np.where(depth >= d, code[latest], 0))
    order, starts = _in_order(columns)
    total = np.add.reduceat(counts[order], starts)
    one = order[starts]
    only_above = np.maximum.reduceat(context[order].astype(np.int8), starts) > 0
    depth, nodes = depth[one], np.arange(len(one))
    for d in range(1, longest):
        above.append(total[np.maximum.accumulate(np.where(depth == d, nodes, 0))])
    keep = np.flatnonzero(~only_above & ((depth == 1) | (total >= least)))
    one, depth, total = one[keep], depth[keep], total[keep]
    of_row = pa.array(row[one])
    parts = [head.take(of_row)]
    name = names.take(pa.array(in_order))
    for d in range(2, longest + 1):
        k = columns[d - 1][one]
        parts.append(pc.if_else(pa.array(k > 0), name.take(pa.array(np.maximum(k - 1, 0))), pa.scalar(None, pa.string())))
    phrase = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
    lengths = depth - 1
    inside = np.arange(longest - 1)[None, :] < lengths[:, None]
    lefts = np.stack([a[keep] for a in above], axis=1)[inside] if above else np.zeros(0, np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    return pa.RecordBatch.from_arrays([lang.take(of_row), phrase, pa.array(depth), pa.array(total), pa.ListArray.from_arrays(offsets, pa.array(lefts.astype(np.int64)))], names=["lang", "phrase", "depth", "f", "lefts"])


def merged(rows: DataFrame, ranges: int, longest: int, least: int) -> DataFrame:
    """lang, phrase, depth, f, lefts: all words, and all longer phrases of at least so many occurrences, with the counts of
    their left parts. A task holds the rows of a few first words of its range."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            out = _walked(table, longest, least)
            for s in range(0, out.num_rows, BATCH_ROWS):
                yield out.slice(s, BATCH_ROWS)

        for batch in batches:
            waiting.append(batch)
            size += pc.sum(pc.binary_length(batch.column("counts"))).as_py() // 4
            if size >= MERGED:
                table = pa.Table.from_batches(waiting).combine_chunks()
                last = tuple(table.column(c)[-1].as_py() for c in ("range", "lang", "head"))
                differs = np.flatnonzero(~(
                    (table.column("range").to_numpy() == last[0]) & pc.equal(table.column("lang"), last[1]).to_numpy() & pc.equal(table.column("head"), last[2]).to_numpy()
                ))
                if len(differs):
                    cut = int(differs[-1]) + 1
                    yield from done(table.slice(0, cut))
                    table = table.slice(cut)
                waiting = table.to_batches()
                size = 0  # the last word's rows wait for as many again
        if waiting:
            yield from done(pa.Table.from_batches(waiting).combine_chunks())

    dealt = rows.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "lang", "head")
    return dealt.mapInArrow(walk, "lang string, phrase string, depth long, f long, lefts array<long>")


def candidates(spark: SparkSession, docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, f, lefts, rights, longer: all phrases of 2 to `longest` words with at least `least` occurrences, the
    counts of their parts by the place of the cut, and the most occurrences of a candidate with one word more around it;
    and lang, n: the words of each language."""
    scratch = shared_dir(spark)
    rows = docs.select(F.coalesce(docs[lang], F.lit("und")).alias("lang"), F.coalesce(docs[text], F.lit("")).alias("body"))
    size = rows.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    bounds = _bounds(rows, longest, ranges, size)
    found = written(spark, merged(shards(rows, bounds, longest), len(bounds) + 1, longest, least), f"{scratch}/phrases")
    words = found.where("depth = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    known = found.where(F.col("f") >= least)
    linked = known.where("depth = 1").select("lang", "phrase", "f", "lefts", F.array().cast("array<long>").alias("rights"))
    levels = []
    for d in range(2, longest + 1):
        own = known.where(F.col("depth") == d).select("lang", "phrase", "f", "lefts", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("suffix"))
        link = linked.select("lang", F.col("phrase").alias("suffix"), F.array_insert("rights", 1, F.col("f")).alias("rights"))
        linked = written(spark, split_join(spark, own, link, ["lang", "suffix"]), f"{scratch}/linked-{d}").select("lang", "phrase", "f", "lefts", "rights", "suffix")
        levels.append(linked)
    out = []
    for level, above in zip(levels, [*levels[1:], None], strict=True):
        level = level.drop("suffix")
        if above is None:
            out.append(level.withColumn("longer", F.lit(0).cast("long")))
            continue
        prefix = F.substring_index("phrase", " ", len(out) + 2)
        around = above.select("lang", prefix.alias("phrase"), F.col("f").alias("longer")).unionAll(above.select("lang", "suffix", "f"))
        around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        out.append(level.join(around, ["lang", "phrase"], "left").withColumn("longer", F.coalesce("longer", F.lit(0).cast("long"))))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole, words


def mine(spark: SparkSession, docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, keep: int = KEEP, share: int = SHARE) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score (see candidates()).

    A cut after the first k words scores floor(10^6 a^2 / (l r)); the cut of the lowest score counts, of ties the first.
    Phrases inside a longer candidate with at least `share` percent of their occurrences go. Order: score and a descending,
    phrase ascending by bytes. Null text: no words; null lang: `und`. Texts without words, and empty tables, give no rows;
    repeated rows count again; other columns, whatever their names, are not read. Sums are exact: counts are 64-bit, and
    products decimals of 38 digits, enough for counts up to 10^15.
    """
    rows, words = candidates(spark, docs, text, lang, longest, least)
    big = lambda c: c.cast("decimal(18,0)")
    top = (F.lit(1_000_000).cast("decimal(7,0)") * (big(F.col("f")) * big(F.col("f"))).cast("decimal(31,0)")).alias("top")
    cuts = F.transform(F.sequence(F.lit(1), F.size("lefts")), lambda k: F.struct(
        F.expr("0L").alias("score"), k.alias("k"), F.element_at("lefts", k).alias("l"), F.element_at("rights", k).alias("r")))
    rows = rows.where(100 * F.col("longer") < share * F.col("f")).select("lang", "phrase", F.col("f").alias("a"), top, cuts.alias("cuts"))
    scored = F.expr("transform(cuts, x -> struct(top div cast(cast(x.l as decimal(18,0)) * cast(x.r as decimal(18,0)) as decimal(36,0)) as score, x.k as k, x.l as l, x.r as r))")
    rows = rows.withColumn("cut", F.array_min(scored)).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= keep)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= keep)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
