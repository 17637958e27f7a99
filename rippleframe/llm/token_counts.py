"""Token counts of documents without their ids: each distinct pre-token is encoded once, its pieces are counted, and the
counts are joined to the pre-token frequencies of every document.

A tokenizer that drops white space encodes pre-tokens alone, so a text's count is the sum over its pre-tokens. The most
frequent of them, down to a power of two of document frequency and within `HELD` and `HELD_BYTES`, are broadcast with their
counts and joined where the text is read. While the first bound is what stops them, any other pre-token has less than
2 / HELD of the (document, pre-token) rows, so the shuffled join of the rest has no hot key.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.llm.common import by_slice, held, shared_dir, sliced, written

LIMIT = 2048
#: Bounds of what is broadcast.
HELD, HELD_BYTES = 1 << 18, 1 << 25
#: Distinct chunks that a task gathers before it passes their pre-tokens on.
GATHERED = 500_000
#: Chunks that a worker remembers, and the bytes of the longest; it starts anew beyond that.
REMEMBERED, LONGEST_REMEMBERED = 500_000, 64
#: Rows of an Arrow batch that a task returns.
BATCH_ROWS = 20_000
# Fixed value: the format's pre-token pattern over lower-case ASCII.
_ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: A full stop or comma at a chunk's end, after a letter of ASCII or Latin-1: always a pre-token of its own.
_STOP = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])[.,]\Z")


def chunks(text: str) -> list[bytes]:
    """Runs without ASCII white space; no pre-token goes across. ASCII letters of an ASCII text are lower-cased."""
    data = text.encode()
    return (data.lower() if data.isascii() and b"<|" not in data else data).split()


def pretokens(chunk: bytes) -> list[bytes]:
    """Parts of a chunk that are encoded alone: the pre-tokens of an ASCII chunk, in lower case. Any other chunk stays whole,
    as it may be composed anew, lower-cased by other rules, or hold a special token's string."""
    if b"<|" in chunk:
        return [chunk]
    if chunk.isascii():
        return _ASCII.findall(chunk.lower())
    return [chunk[:-1], chunk[-1:]] if _STOP.search(chunk) else [chunk]


class Chunks(dict):
    """What a worker remembers of the chunks that came lately: the sum of the known counts, and the unknown pre-tokens."""

    def __init__(self, known: dict[bytes, int]):
        super().__init__()
        self.known = known

    def __missing__(self, chunk: bytes) -> tuple[int, list[bytes]]:
        parts = pretokens(chunk)
        found = sum(self.known.get(t, 0) for t in parts), [t for t in parts if t not in self.known]
        if len(chunk) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = found
        return found


def _encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def pieces(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """token, often, pieces: every distinct pre-token of the texts, in how many distinct chunks of documents it is, and how
    many ids it gives."""
    gathered = pa.schema([("token", pa.binary()), ("often", pa.int64())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flushed() -> Iterator[pa.RecordBatch]:
            often: Counter = Counter()
            for chunk, n in found.items():
                for t in pretokens(chunk):
                    often[t] += n
            found.clear()
            tokens = list(often)
            for k in range(0, len(tokens), BATCH_ROWS):
                part = tokens[k : k + BATCH_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([often[t] for t in part], pa.int64())], schema=gathered)

        for batch in sliced(batches):
            for x in batch.column("body").to_pylist():
                found.update(set(chunks(x)))
                if len(found) > GATHERED:
                    yield from flushed()
        yield from flushed()

    counted = pa.schema([("token", pa.binary()), ("often", pa.int64()), ("pieces", pa.int64())])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = held(("pieces", path), lambda: _encoder(path))
        found = encoder.encode_batch_fast([t.decode() for t in batch.column("token").to_pylist()], add_special_tokens=False)
        return pa.RecordBatch.from_arrays([batch.column("token"), batch.column("often"), pa.array([len(e.ids) for e in found], pa.int64())], schema=counted)

    rows = docs.select(F.coalesce(docs[text], F.lit("")).alias("body")).mapInArrow(gather, "token binary, often long")
    distinct = rows.groupBy("token").agg(F.sum("often").alias("often"))
    return distinct.mapInArrow(by_slice(count, ("pieces", path)), "token binary, often long, pieces long")


def _frequent(counts: DataFrame) -> DataFrame:
    """The pre-tokens to broadcast: all from a power of two of documents on, as many as the bounds allow."""
    level = F.floor(F.log2("often")).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("token")).alias("size")).collect()
    least, n, size = 64, 0, 0
    for row in sorted(levels, reverse=True):
        n, size = n + row["n"], size + row["size"]
        if n > HELD or size > HELD_BYTES:
            break
        least = row["level"]
    return counts.where(level >= least)


def count(spark: SparkSession, docs: DataFrame, path: str, text: str = "text", id_column: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than the limit).

    path: a tokenizers file whose tokenizer drops white space, as word_bpe_49k.json. A null text is empty and has 0
    tokens; a null id stays null; repeated rows and ties give a row each; an empty table gives no row. Other columns,
    whatever their names, are not read. Texts are read twice; what is shuffled is each task's distinct pre-tokens, and
    the (row, pre-token, frequency) rows of those that are not broadcast.
    """
    scratch = shared_dir(spark)
    rows = docs.select(docs[id_column].cast("long").alias("id"), F.coalesce(docs[text], F.lit("")).alias("body"))
    counts = written(spark, pieces(rows, path, "body"), f"{scratch}/pieces")
    frequent = _frequent(counts)
    table = frequent.select("token", "pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True)))
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.binary())), ("times", pa.list_(pa.int64()))])

    def join(batch: pa.RecordBatch) -> pa.RecordBatch:
        look = held(("chunks", scratch), lambda: Chunks(known.value)).__getitem__
        sums, tokens, times = [], [], []
        for x in batch.column("body").to_pylist():
            n, rest = 0, Counter()
            for chunk, often in Counter(chunks(x)).items():
                k, unknown = look(chunk)
                n += k * often
                for t in unknown:
                    rest[t] += often
            sums.append(n)
            tokens.append(list(rest))
            times.append(list(rest.values()))
        columns = [batch.column("id"), batch.column("n_bytes"), pa.array(sums, pa.int64()), pa.array(tokens, schema.field("tokens").type), pa.array(times, schema.field("times").type)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    sums = rows.select("id", F.octet_length("body").cast("long").alias("n_bytes"), "body")
    sums = sums.mapInArrow(by_slice(join, ("chunks", scratch)), "id long, n_bytes long, n long, tokens array<binary>, times array<long>")
    sums = written(spark, sums.select(F.monotonically_increasing_id().alias("row"), "*"), f"{scratch}/sums")
    rest = sums.where(F.size("tokens") > 0).select("row", F.explode(F.arrays_zip("tokens", "times")).alias("t"))
    rest = rest.select("row", F.col("t.tokens").alias("token"), F.col("t.times").alias("times")).join(counts.select("token", "pieces"), "token")
    none = F.lit(None).cast("long")
    both = sums.select("row", "id", "n_bytes", "n").unionAll(rest.select("row", none, none, F.col("times") * F.col("pieces")))
    found = both.groupBy("row").agg(F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return found.select("id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
