"""Byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word starts as one symbol per byte. Leaf i of the tree holds the merge rank of symbol i and its right neighbour,
packed with i; an inner node holds the least of its children. The root is thus the leftmost pair of the lowest rank.
Merging it changes the pairs of at most three leaves, each a walk from leaf to root. It ends when the root is empty.
Symbols form a linked list, so no position ever moves.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.llm.common import by_slice, held

#: Splits a text where no token of the pattern below can go across: a run without white space with the one blank before it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The byte-level pre-tokenizer's pattern (fixed by the format).
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Chunks, and pre-tokens, that a worker remembers; it starts anew beyond that.
REMEMBERED = 600_000
#: Chunks longer than this are not remembered.
LONGEST_REMEMBERED = 64
_NONE = 1 << 62


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by the format's rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class SegmentTree:
    """Least of n values, with logarithmic point updates."""

    __slots__ = ("base", "node")

    def __init__(self, values: list[int]):
        base = 1
        while base < len(values):
            base *= 2
        node = [_NONE] * base + values + [_NONE] * (base - len(values))
        for i in range(base - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b
        self.base, self.node = base, node

    def least(self) -> int:
        return self.node[1]

    def put(self, place: int, value: int) -> None:
        node, i = self.node, place + self.base
        node[i] = value
        while i > 1:
            a, b = node[i], node[i ^ 1]
            low = a if a < b else b
            i >>= 1
            if node[i] == low:
                return
            node[i] = low


class Remembered(dict):
    """Packed ids of the strings that came lately."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        found = self.make(chunk)
        if len(chunk) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = found
        return found


class Bpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, stands = spec["model"], byte_symbols()
        vocab = model["vocab"]
        self.ids = {s: vocab[s] for s in vocab}
        self.first = [0] * 256
        for symbol, byte in stands.items():
            self.first[byte] = vocab[symbol]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges.setdefault(vocab[left] << 32 | vocab[right], (rank, vocab[left + right]))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(stands[c] for c in s) for s, i in vocab.items()}
        self.bytes_of.update({i: s.encode() for s, i in self.special.items()})
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = Remembered(lambda piece: b"".join(i.to_bytes(4, "little") for i in self.word(piece.encode())))
        self.seen = Remembered(self.chunk)

    def word(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.first[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        merges, width = self.merges, n.bit_length()
        get = merges.get

        def pair(i: int, j: int) -> int:
            found = get(ids[i] << 32 | ids[j])
            return _NONE if found is None else found[0] << width | i

        tree = SegmentTree([pair(i, i + 1) for i in range(n - 1)] + [_NONE])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        mask = (1 << width) - 1
        while (low := tree.least()) != _NONE:
            i = low & mask
            j = after[i]
            ids[i] = merges[ids[i] << 32 | ids[j]][1]
            alive[j] = False
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            tree.put(j, _NONE)
            tree.put(i, pair(i, k) if k < n else _NONE)
            if (h := before[i]) >= 0:
                tree.put(h, pair(h, i))
        return [x for x, a in zip(ids, alive, strict=True) if a]

    def chunk(self, chunk: str) -> bytes:
        """Ids of one chunk as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, PIECE.findall(chunk)))

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; a special token's string is that token."""
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(self.seen.__getitem__, CHUNK.findall(text)))
        out = []
        for k, part in enumerate(self.cut.split(text)):
            out.append(self.special[part].to_bytes(4, "little") if k % 2 else b"".join(map(self.seen.__getitem__, CHUNK.findall(part))))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return list(memoryview(self.packed(text)).cast("I"))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


def tokenizer(path: str) -> Bpe:
    """One encoder for each worker process and file."""
    return held(("bpe", path), lambda: Bpe(path))


def round_trip(docs: DataFrame, path: str, text: str = "text", id_column: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids and the text.

    A null or empty text has no tokens. Rows are independent, so ties and repeated rows give equal rows; a null id stays
    null. Other columns, whatever their names, are not read. One pass without a shuffle; a lost task runs again alone.
    """
    fields = [pa.field("id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    ddl = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields += [pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())]
        ddl += ", ids array<int>, decoded string"
    schema = pa.schema(fields)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tokenizer(path)
        counts, hashes, decoded, ids, texts = [], [], [], [], []
        for x in batch.column("body").to_pylist():
            packed = bpe.packed(x)
            own = memoryview(packed).cast("I")
            back = bpe.decode(own)
            counts.append(len(own))
            hashes.append(hashlib.sha256(packed).hexdigest())
            decoded.append(hashlib.sha256(back.encode()).hexdigest())
            if with_ids:
                ids.append(list(own))
                texts.append(back)
        columns = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
        if with_ids:
            columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(docs[id_column].cast("long").alias("id"), F.coalesce(docs[text], F.lit("")).alias("body"))
    return rows.mapInArrow(by_slice(work, ("bpe", path)), ddl)
