"""MinHash near-duplicate detection by a multi-index Hamming join.

A document's set is its distinct word shingles. Equal sets are one class, so exact copies cost one row from then on. A
class's signature has CHUNKS x WIDTH symbols of BITS bits, each the least of the set under one hash function; the
distance of two signatures is the number of symbols that differ. By the pigeonhole principle, signatures within RADIUS =
CHUNKS x (ERRORS + 1) - 1 of each other have a chunk with at most ERRORS differing symbols. So each chunk is indexed once
for every choice of ERRORS symbols that may differ: two classes meet in a bucket exactly if some chunk has at most ERRORS
errors. All pairs within RADIUS, which is the cut-off too, meet.

No bucket is joined with itself by Spark, and pairs inside a component are not expanded. Sorted buckets are streamed
through two passes. In the first, each member is paired with the nearest of a few leaders of its bucket; links that
hold on full sets join components. The second one takes the buckets that still hold several components and compares
their members across components, so no link is lost; it keeps a pair if the signature distance, the sizes and a sketch of BINS
bins allow the similarity. A pair is kept in the first of its common buckets only. Buckets of more than BLOCK members are split
into blocks whose pairs are compared in different tasks; those of very frequent keys, found on a sample of classes, are
dealt out by salt in the first pass. Links are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.llm.common import by_slice, shared_dir, sliced, written

CHUNKS, WIDTH, ERRORS, BITS = 7, 6, 2, 16
SYMBOLS = CHUNKS * WIDTH
#: All pairs of signatures with at most so many differing symbols meet, and others are no candidates. At a similarity of
#: 0.8 the mean is 8.4 and the deviation 2.6; more than 20 differ with a probability of 1.4e-5.
RADIUS = CHUNKS * (ERRORS + 1) - 1
#: Bins of the sketch, 4 bits each: the least hash of the set in each of BINS ranges; 0 for none.
BINS = 512
#: A candidate's similarity by the sketch may lie so many deviations below the threshold.
DEVIATIONS = 4.5
#: Leaders of a bucket in the first pass. A member that is nearer to a leader than NEAR symbols becomes no leader.
LEADERS, NEAR = 6, 8
#: Orders in which members of a bucket become leaders, so that the leaders' groups overlap.
ORDERS = 8
#: Members of a bucket that are compared in one go in the second pass.
BLOCK = 2048
#: A key is frequent if so many of a sample of 1 in SAMPLE classes have it; its rows are dealt out by SALTS.
SAMPLE, FREQUENT, SALTS = 64, 256, 32
#: Ids of at most so many classes are broadcast to pick texts (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 400_000

_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_random = np.random.default_rng(20_240_501)
_MULTIPLY = _random.integers(1, 2**63, size=(SYMBOLS, 2, 1), dtype=np.uint64) | np.uint64(1)
_LETTER = _random.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER[_SPACE] = 0
#: Masks of a chunk: the symbols that the key of the bucket is made of.
_KEPT = np.array([[k for k in range(WIDTH) if k not in gone] for gone in combinations(range(WIDTH), ERRORS)])
MASKS = len(_KEPT)
_PIECE = 1 << 18
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Powers of an odd number and of its inverse modulo 2^64, for hashes of words by prefix sums.
_BASE = 0xD1B54A32D192ED03


def _powers(base: int) -> np.ndarray:
    out = np.full(_PIECE + 1, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, in order; polynomials of random letters, by prefix sums."""
    out = []
    start = 0
    while start < len(raw):
        stop = len(raw)
        if stop - start >= _PIECE:  # a piece ends at white space; a longer word is hashed by itself
            cut = max(raw.rfind(c, start, start + _PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
            if cut < 0:
                ends = [x for x in (raw.find(c, start + _PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if x >= 0]
                stop = min(ends, default=len(raw))
                import xxhash

                for word in raw[start:stop].split():
                    out.append(np.array([xxhash.xxh64_intdigest(word)], dtype=np.uint64))
                start = stop
                continue
            stop = cut + 1
        data = np.frombuffer(raw, dtype=np.uint8, count=stop - start, offset=start)
        start = stop
        inside = np.concatenate([[False], ~_SPACE[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, after = edges[::2], edges[1::2]
        if not len(first):
            continue
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_LETTER[data] * _POWER[: len(data)], out=sums[1:])
        out.append(mixed((sums[after] - sums[first]) * _INVERSE[first] + (after - first).astype(np.uint64) * _GOLD))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles: lower-cased A-Z, words between ASCII white space."""
    with np.errstate(over="ignore"):
        w = word_hashes(text.encode().translate(_UPPER))
        n = len(w)
        if not n:
            return w
        span = min(n, size)
        out = np.full(n - span + 1, span, dtype=np.uint64)
        for k in range(span):
            out = mixed(out * _GOLD + w[k : n - span + 1 + k])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def signature(own: np.ndarray) -> np.ndarray:
    """The least of the set under each of the hash functions, folded to BITS bits."""
    out = np.full(SYMBOLS, 2**64 - 1, dtype=np.uint64)
    for start in range(0, len(own), 4096):
        out = np.minimum(out, ((own[start : start + 4096] ^ _MULTIPLY[:, 1]) * _MULTIPLY[:, 0]).min(axis=1))
    return (mixed(out) >> np.uint64(64 - BITS)).astype(np.uint16)


def sketch_of(own: np.ndarray) -> np.ndarray:
    """Four bits, 1 to 15, of the least hash in each of BINS ranges, 0 for an empty one; two bins a byte. own is sorted."""
    at = (own >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.concatenate([[True], at[1:] != at[:-1]])
    bins = np.zeros(BINS, dtype=np.uint8)
    bins[at[first]] = (mixed(own[first]) % np.uint64(15)).astype(np.uint8) + 1
    return bins[::2] << 4 | bins[1::2]


_ZERO_NIBBLES = np.array([(b & 15 == 0) + (b >> 4 == 0) for b in range(256)], dtype=np.uint8)


def allowed(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n, m with the sketches x, y (rows) may have the similarity.

    A bin that is not empty in both agrees with the probability of the similarity; those that differ agree by chance in
    1 of 15. The bins are drawn from a union that they may nearly exhaust, which lessens the deviation.
    """
    t = percent / 100
    empty = _ZERO_NIBBLES[x | y].sum(axis=1, dtype=np.int64)
    agree = _ZERO_NIBBLES[x ^ y].sum(axis=1, dtype=np.int64) - empty
    used = np.maximum(BINS - empty, 1)
    union = np.maximum((n + m) / (1 + t), used)
    variance = t * (1 - t) / used * (union - used) / np.maximum(union - 1, 1) + (1 - t) / 15 / used
    return agree / used >= t - DEVIATIONS * np.sqrt(variance) - 1 / used


def bucket_keys(signs: np.ndarray) -> np.ndarray:
    """For each signature (row), one key for each chunk and mask; key mod 128 is chunk x MASKS + mask."""
    out = np.empty((len(signs), CHUNKS * MASKS), dtype=np.uint64)
    for c in range(CHUNKS):
        chunk = signs[:, c * WIDTH : (c + 1) * WIDTH].astype(np.uint64)
        for m, kept in enumerate(_KEPT):
            key = np.full(len(signs), c * MASKS + m + 1, dtype=np.uint64)
            for k in kept:
                key = (key * _GOLD) ^ chunk[:, k]
                key ^= key >> np.uint64(29)
            out[:, c * MASKS + m] = (mixed(key) & np.uint64(2**64 - 128)) | np.uint64(c * MASKS + m)
    return out


def first_bucket(same: np.ndarray) -> np.ndarray:
    """chunk x MASKS + mask of the first bucket that each pair shares; same: which symbols agree (rows of SYMBOLS)."""
    whole = same.reshape(len(same), CHUNKS, WIDTH)
    agree = np.stack([whole[:, :, kept].all(axis=2) for kept in _KEPT], axis=2).reshape(len(same), CHUNKS * MASKS)
    return agree.argmax(axis=1)


def sketches(docs: DataFrame, text: str, id_column: str, size: int) -> DataFrame:
    """id, n, low and high (hash of the set), sign, bins: one row per document, row by row. Both are null for an empty set."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, low, high, signs, bins = [], [], [], [], []
        with np.errstate(over="ignore"):
            for x in batch.column("body"):
                own = shingles(x.as_py(), size)
                n.append(len(own))
                low.append(int(own.sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
                high.append(int(np.bitwise_xor.reduce(mixed(own + np.uint64(1))).view(np.int64)) if len(own) else 0)
                signs.append(signature(own).tobytes() if len(own) else None)
                bins.append(sketch_of(own).tobytes() if len(own) else None)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(signs, pa.binary()), pa.array(bins, pa.binary())],
            names=["id", "n", "low", "high", "sign", "bins"],
        )

    rows = docs.select(docs[id_column].cast("long").alias("id"), F.coalesce(docs[text], F.lit("")).alias("body"))
    return rows.mapInArrow(by_slice(work), "id long, n long, low long, high long, sign binary, bins binary")


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def _indexed(classes: DataFrame) -> DataFrame:
    """key, cid: every class under all its bucket keys."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            keys = bucket_keys(_matrix(batch.column("sign"), np.uint16, SYMBOLS)).reshape(-1).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column("cid").to_numpy(), CHUNKS * MASKS))], names=["key", "cid"])

    return classes.select("cid", "sign").mapInArrow(by_slice(work), "key long, cid long")


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key comes twice or more. Streamed, so no bucket is held in memory."""
    last: tuple[np.ndarray, np.ndarray] | None = None
    open_ = False  # whether the last row, which is held back, is known to share its bucket
    for batch in batches:
        keys, ids = batch.column("key").to_numpy(), batch.column("cid").to_numpy()
        if not len(keys):
            continue
        if last is not None:
            keys, ids = np.concatenate([last[0], keys]), np.concatenate([last[1], ids])
        same = keys[1:] == keys[:-1]
        give = np.zeros(len(keys), dtype=bool)
        give[1:] |= same
        give[:-1] |= same
        give[0] |= open_
        last, open_ = (keys[-1:], ids[-1:]), bool(give[-1])
        yield pa.RecordBatch.from_arrays([pa.array(keys[:-1][give[:-1]]), pa.array(ids[:-1][give[:-1]])], names=["key", "cid"])
    if last is not None and open_:
        yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array(last[1])], names=["key", "cid"])


class _Runs:
    """Cuts a stream of batches, sorted by the columns of `by`, into parts that end where a run of equal values ends.

    If `most` is given, a run of more rows is cut all the same.
    """

    def __init__(self, by: list[str], most: int = 0):
        self.by, self.most = by, most

    def parts(self, batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            change = np.zeros(table.num_rows - 1, dtype=bool)
            for c in self.by:
                x = table.column(c).to_numpy()
                change |= x[1:] != x[:-1]
            at = np.flatnonzero(change)
            cut = int(at[-1]) + 1 if len(at) else 0
            if not cut and self.most and count > self.most:
                cut = table.num_rows
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            count = table.num_rows - cut
        if count:
            yield pa.Table.from_batches(held).combine_chunks()


def _to_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass over rows (key, cid, sign) sorted by key and rank: each member with the nearest leader of its bucket.

    The first member of a bucket is a leader; so is the next one that lies NEAR symbols from all before it, and so on.
    A run that is cut (a bucket of very many members) has leaders in each part.
    """
    for table in _Runs(["key"], 65_536).parts(batches):
        keys, ids = table.column("key").to_numpy(), table.column("cid").to_numpy()
        signs = _matrix(table.column("sign"), np.uint16, SYMBOLS)
        n = len(keys)
        starts = np.concatenate([[True], keys[1:] != keys[:-1]])
        group = np.cumsum(starts) - 1
        best, to = np.full(n, SYMBOLS + 1), np.zeros(n, dtype=np.int64)
        leader = np.flatnonzero(starts)  # one for each group
        groups = np.arange(len(leader))
        is_leader = starts.copy()
        for _ in range(LEADERS):
            of = np.full(group[-1] + 1, -1, dtype=np.int64)
            of[groups] = leader
            rows = np.flatnonzero(of[group] >= 0)
            rows = rows[rows > of[group[rows]]]  # the earlier leaders have been compared with it already, as members
            for start in range(0, len(rows), 65_536):
                part = rows[start : start + 65_536]
                lead = of[group[part]]
                d = (signs[part] != signs[lead]).sum(axis=1)
                nearer = d < best[part]
                best[part[nearer]], to[part[nearer]] = d[nearer], lead[nearer]
            rest = np.flatnonzero((best > NEAR) & ~is_leader)
            if not len(rest):
                break
            groups, first = np.unique(group[rest], return_index=True)
            leader = rest[first]
            is_leader[leader] = True
        rows = np.flatnonzero((best <= RADIUS) & (ids != ids[to]))
        a, b = ids[rows], ids[to[rows]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _across(percent: int):
    """Second pass over rows (key, x, y, cid, owner, block, n, sign, bins) sorted by key, x, y: near pairs of different owners."""

    def pairs_of(ids, owner, block, n, signs, bins, place, one_block) -> tuple[np.ndarray, np.ndarray]:
        names, count = np.unique(owner, return_counts=True)
        most = names[count.argmax()]
        order = np.argsort(owner == most, kind="stable")  # the members of the largest component come last
        others = int((owner != most).sum())
        left, right = [], []
        for k in range(min(others, len(order) - 1)):
            i, js = order[k], order[k + 1 :]
            js = js[(owner[js] != owner[i]) & (100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i]))]
            if not one_block:
                js = js[block[js] != block[i]]
            if not len(js):
                continue
            js = js[(signs[js] != signs[i]).sum(axis=1) <= RADIUS]
            if not len(js):
                continue
            js = js[allowed(bins[js], bins[i], n[js], n[i], percent)]
            if len(js):
                left.append(np.full(len(js), i))
                right.append(js)
        if not left:
            none = np.zeros(0, dtype=np.int64)
            return none, none
        i, j = np.concatenate(left), np.concatenate(right)
        mine = first_bucket(signs[i] == signs[j]) == place
        return ids[i[mine]], ids[j[mine]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _Runs(["key", "x", "y"]).parts(batches):
            keys, x, y, ids, owner, block, n = (table.column(c).to_numpy() for c in ("key", "x", "y", "cid", "owner", "block", "n"))
            signs, bins = _matrix(table.column("sign"), np.uint16, SYMBOLS), _matrix(table.column("bins"), np.uint8, BINS // 2)
            place = (keys.view(np.uint64) & np.uint64(127)).astype(np.int64)
            change = np.concatenate([[True], (keys[1:] != keys[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]), [True]])
            edge = np.flatnonzero(change)
            size = np.diff(edge)
            two = edge[:-1][size == 2]  # most buckets: all at once
            i, j = two, two + 1
            fits = (owner[i] != owner[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((x[i] == y[i]) | (block[i] != block[j]))
            i, j = i[fits], j[fits]
            same = signs[i] == signs[j]
            fits = (same.sum(axis=1) >= SYMBOLS - RADIUS) & (first_bucket(same) == place[i])
            i, j = i[fits], j[fits]
            fits = allowed(bins[i], bins[j], n[i], n[j], percent)
            found = [(ids[i[fits]], ids[j[fits]])]
            for at, many in zip(edge[:-1][size > 2], size[size > 2], strict=True):
                s = slice(at, at + many)
                found.append(pairs_of(ids[s], owner[s], block[s], n[s], signs[s], bins[s], place[at], x[at] == y[at]))
            a, b = (np.concatenate([f[k] for f in found]) for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return work


def _full_sets(docs: DataFrame, needed: DataFrame, text: str, id_column: str, size: int) -> DataFrame:
    """cid, body: the sets of the needed classes (cid, id, n, low, high), 48 bits of each hash.

    An id may come with several texts; the set is that of the class only if its size and hash are.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            cids, bodies = [], []
            want = zip(*(part.column(c).to_pylist() for c in ("cid", "n", "low", "high")), strict=True)
            for x, (cid, n, low, high) in zip(part.column("body"), want, strict=True):
                own = shingles(x.as_py(), size)
                with np.errstate(over="ignore"):
                    is_it = len(own) == n and n and int(own.sum(dtype=np.uint64).view(np.int64)) == low and int(np.bitwise_xor.reduce(mixed(own + np.uint64(1))).view(np.int64)) == high
                if is_it:
                    cids.append(cid)
                    bodies.append((own >> np.uint64(32)).astype(np.uint32).tobytes() + (own >> np.uint64(16)).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(bodies, pa.binary())], names=["cid", "body"])

    rows = docs.select(docs[id_column].cast("long").alias("own_id"), F.coalesce(docs[text], F.lit("")).alias("body"))
    if needed.count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    rows = rows.join(needed, rows["own_id"] == needed["id"]).select("cid", "n", "low", "high", "body")
    return rows.mapInArrow(work, "cid long, body binary").groupBy("cid").agg(F.first("body").alias("body"))


def _unpacked(body: bytes) -> np.ndarray:
    n = len(body) // 6
    return np.frombuffer(body, dtype=np.uint32, count=n).astype(np.uint64) << np.uint64(16) | np.frombuffer(body, dtype=np.uint16, offset=4 * n)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for part in sliced(batches):
            b, keep = part.column("b").to_pylist(), []
            for k, (left, right) in enumerate(zip(part.column("left"), part.column("right"), strict=True)):
                if b[k] != last:
                    last, own = b[k], _unpacked(right.as_py())
                other = _unpacked(left.as_py())
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                both = int((own[at] == other).sum())
                keep.append(100 * both >= percent * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("cid").alias("a"), F.col("body").alias("left")), sets.select(F.col("cid").alias("b"), F.col("body").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(work, "a long, b long")


def components(spark: SparkSession, links: DataFrame, scratch: str, name: str, most: int = 200) -> DataFrame:
    """id, component: the least id reachable over links (a, b). Alternates large-star and small-star rounds until nothing changes."""
    edges = written(spark, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{scratch}/{name}-0")
    for step in range(1, most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = written(spark, small.where("u <> v").distinct(), f"{scratch}/{name}-{step}")
        sums = [x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first() for x in (edges, after)]
        edges = after
        if sums[0] == sums[1]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    raise RuntimeError(f"components did not settle within {most} rounds")


def _dealt(index: DataFrame, classes: DataFrame, frequent: DataFrame | None, partitions: int) -> DataFrame:
    """Rows (key, cid, sign) of shared buckets, each bucket sorted by a rank; frequent keys in SALTS parts that share a first member."""
    rows = index.withColumn("rank", F.xxhash64("cid", F.pmod("key", F.lit(ORDERS)))).withColumn("salt", F.lit(0))
    if frequent is not None:
        hot = rows.join(frequent, "key").withColumn("salt", F.pmod("rank", F.lit(SALTS)).cast("int"))
        seeds = hot.groupBy("key").agg(F.min(F.struct("rank", "cid")).alias("s")).select("key", F.col("s.cid").alias("cid"), F.col("s.rank").alias("rank"))
        seeds = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("key", "cid", "rank", "salt")
        rows = rows.join(frequent, "key", "left_anti").unionByName(hot).unionByName(seeds)
    rows = rows.join(classes.select("cid", "sign"), "cid")
    return rows.repartition(partitions, "key", "salt").sortWithinPartitions("key", "salt", "rank").select("key", "cid", "sign")


def find(
    spark: SparkSession, docs: DataFrame, text: str = "text", id_column: str = "doc_id", size: int = 5, percent: int = 80, sample: int = SAMPLE, frequent_at: int = FREQUENT, block: int = BLOCK
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Documents with a null or empty text, or without words, have the empty set and are linked with nothing. A text with
    fewer words than a shingle is one shingle. Rows that repeat an id are one document, linked with whatever any of their texts is
    linked with; each row is returned, and a null id forms a component of its own. Ties go to the least id. Other columns
    are not read. An empty table gives an empty result.

    sample, frequent_at: see SAMPLE and FREQUENT. block: see BLOCK. They decide what is split, not what is found.
    """
    scratch = shared_dir(spark)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    sketch = written(spark, sketches(docs, text, id_column, size), f"{scratch}/sketch")
    grouped = sketch.where("n > 0 and id is not null").groupBy("n", "low", "high").agg(F.min("id").alias("id"), F.min("sign").alias("sign"), F.min("bins").alias("bins"))
    classes = written(spark, grouped.withColumn("cid", F.monotonically_increasing_id()), f"{scratch}/classes")
    known = classes.select("n", "low", "high", "cid", F.col("id").alias("least_id"))
    members = written(spark, sketch.select("id", "n", "low", "high").join(known, ["n", "low", "high"], "left").select("id", "n", "cid", "least_id"), f"{scratch}/members")
    # An id that comes with several sets joins their classes.
    repeated = members.where("cid is not null and id is not null").groupBy("id").agg(F.min("cid").alias("b"), F.max("cid").alias("most")).where("b <> most").select("id", "b")
    repeated = members.where("cid is not null").join(repeated, "id").select(F.col("cid").alias("a"), "b").where("a <> b").distinct()

    few = _indexed(classes.where(F.pmod(F.xxhash64("cid", F.lit(7)), F.lit(sample)) == 0))
    frequent = written(spark, few.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= frequent_at).select("key"), f"{scratch}/frequent")
    some_frequent = not frequent.isEmpty()
    index = _indexed(classes)
    rare = index.join(frequent, "key", "left_anti") if some_frequent else index
    shared = rare.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(_shared_rows, "key long, cid long")
    if some_frequent:
        shared = shared.unionByName(index.join(frequent, "key", "left_semi"))
    buckets = written(spark, shared, f"{scratch}/buckets")

    def confirm(pairs: DataFrame, step: int) -> DataFrame:
        pairs = written(spark, pairs, f"{scratch}/pairs-{step}")
        needed = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
        needed = written(spark, classes.select("cid", "id", "n", "low", "high").join(needed, "cid", "left_semi"), f"{scratch}/needed-{step}")
        sets = written(spark, _full_sets(docs, needed, text, id_column, size), f"{scratch}/sets-{step}")
        return written(spark, _confirmed(pairs, sets, percent), f"{scratch}/links-{step}")

    nearest = _dealt(buckets, classes, frequent if some_frequent else None, partitions).mapInArrow(_to_leaders, "a long, b long").distinct()
    links = confirm(nearest, 0).unionByName(repeated)
    named = components(spark, links, scratch, "components-0")

    owned = buckets.join(named.select(F.col("id").alias("cid"), "component"), "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("owner"))
    owned = written(spark, owned, f"{scratch}/owned")
    several = owned.groupBy("key").agg(F.min("owner").alias("low"), F.max("owner").alias("high"), F.count(F.lit(1)).alias("m")).where("low <> high")
    rows = owned.join(several.select("key", F.ceil(F.col("m") / block).cast("int").alias("blocks")), "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("key", "cid", "owner", "block", F.explode(other).alias("other"))
    rows = rows.select("key", "cid", "owner", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    rows = rows.join(classes.select("cid", "n", "sign", "bins"), "cid").repartition(partitions, "key", "x", "y").sortWithinPartitions("key", "x", "y")
    across = rows.select("key", "x", "y", "cid", "owner", "block", "n", "sign", "bins").mapInArrow(_across(percent), "a long, b long")
    more = confirm(across, 1)
    if not more.isEmpty():
        named = components(spark, named.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), scratch, "components-1")

    linked = named.select(F.col("id").alias("cid"), "component").unionByName(named.select(F.col("component").alias("cid"), "component").distinct())
    linked = linked.join(classes.select("cid", "id"), "cid")
    least = linked.groupBy("component").agg(F.min("id").alias("component_id"))
    linked = linked.join(least, "component").select("cid", "component_id")
    out = members.join(linked, "cid", "left")
    component = F.coalesce("component_id", "least_id", "id")
    component = F.when(F.col("id").isNotNull(), component)
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, text: str = "text", id_column: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, with all their columns: one of each component, that with the least id.

    Rows that repeat an id count once. Documents without words, or with a null id, all stay.
    """
    gone = find(spark, docs, text, id_column, size, percent).where(~F.col("kept")).select(F.col("id").alias("_gone_id")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    rows = rows.join(gone, rows["_row"][id_column] == gone["_gone_id"], "left_anti")
    return rows.select("_row.*")
