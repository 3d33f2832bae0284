"""BPE encoding and decoding.

A piece's symbols form a doubly linked list; a priority queue holds the merge rank and
place of each adjacent pair. The lowest rank merges first, leftmost on ties; queue
entries whose symbols have changed since are stale and are skipped. Decoding
concatenates the vocabulary strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, batch_of, kept

#: Fixed value: the published pattern of byte-level BPE that splits a text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most entries of each of a worker's two memos, some 40 MB each; a full one starts anew, which
#: costs time only.
MEMO_ENTRIES = 200_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else 256 upwards."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


def _pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Irregular(Exception):
    """A chunk whose tokens depend on the white space around it."""


class Codec:
    """Byte-level BPE read from the JSON of a tokenizer file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, symbols = spec["model"], byte_symbols()
        vocab = model["vocab"]
        of_symbol = {c: b for b, c in enumerate(symbols)}
        self.first = [vocab[c] for c in symbols]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.strings = [b""] * size
        for string, i in vocab.items():
            self.strings[i] = bytes(of_symbol[c] for c in string)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.strings[i] = content.encode()
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.pieces = regex.compile(PIECES)
        self.by_piece: dict[str, bytes] = {}
        self.by_chunk = _Chunks(self)

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one piece's bytes. A queue entry is rank * n + place in one integer."""
        first = self.first
        ids = [first[b] for b in data]
        n, find = len(ids), self.merges.get
        queue = [found[0] * n + i for i, pair in enumerate(zip(ids, ids[1:])) if (found := find(pair))]
        if not queue:
            return ids
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            rank, i = divmod(pop(queue), n)
            j = after[i]
            if j >= n or ids[i] < 0 or not (found := find((ids[i], ids[j]))) or found[0] != rank:
                continue  # stale: one of the two was merged meanwhile
            joined = ids[i] = found[1]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := find((joined, ids[k])):
                    push(queue, found[0] * n + i)
            h = before[i]
            if h >= 0 and (found := find((ids[h], joined))):
                push(queue, found[0] * n + h)
        return [i for i in ids if i >= 0]

    def piece(self, piece: str) -> bytes:
        memo = self.by_piece
        if (known := memo.get(piece)) is None:
            known = _pack(self.merge(piece.encode("utf-8", "surrogatepass")))
            if len(piece) <= 64:
                if len(memo) >= MEMO_ENTRIES:
                    memo.clear()
                memo[piece] = known
        return known

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens, as little-endian unsigned 32-bit integers.

        Where single spaces part the text, each chunk with its space encodes by itself.
        """
        if not text:
            return b""
        head, *rest = text.split(" ")
        try:
            if not head or head[-1].isspace():
                raise _Irregular
            return b"".join(map(self.piece, self.pieces.findall(head))) + b"".join(map(self.by_chunk.__getitem__, rest))
        except _Irregular:
            return b"".join(map(self.piece, self.pieces.findall(text)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.split_added is None or not any(a in text for a in self.added):
            return self.plain(text)
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += [self.plain(text[at : m.start()]), np.array([self.added[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        found = b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return found.decode("utf-8", "replace")


class _Chunks(dict):
    """Ids of a space and the chunk after it; a chunk that touches other white space raises."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Irregular
        codec = self.codec
        if chunk.isalpha():
            known = _pack(codec.merge(b" " + chunk.encode("utf-8", "surrogatepass")))
        elif chunk[-1] in ".,:;!?" and chunk[:-1].isalpha():
            return self[chunk[:-1]] + codec.piece(chunk[-1])
        else:
            known = b"".join(map(codec.piece, codec.pieces.findall(" " + chunk)))
        if len(chunk) <= 64:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[chunk] = known
        return known


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, texts: bool = False) -> DataFrame:
    """Encode whole texts and decode them again.

    docs: doc_id, text, any further columns (not read). tokenizer: path of a tokenizer
    JSON file at the driver; its content, bounded by the vocabulary, is broadcast.
    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``texts``, ids (binary)
    and decoded. A null or empty text has no tokens and decodes to the empty string;
    repeated rows give repeated rows; an empty table gives an empty table.
    """
    with open(tokenizer, encoding="utf-8") as f:
        content = f.read()
    # one codec a worker and vocabulary; a worker that runs many such tasks builds it once
    source, key = spark.sparkContext.broadcast(content), f"bpe {hashlib.sha256(content.encode()).hexdigest()}"
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * texts]

    def make():
        codec = kept(key, lambda: Codec(source.value))

        def each(batch: pa.RecordBatch):
            n, a, b, ids, decoded = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                packed = codec.encode(text)
                back = codec.decode(packed)
                n.append(len(packed) // 4)
                a.append(hashlib.sha256(packed).hexdigest())
                b.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                if texts:
                    ids.append(packed)
                    decoded.append(back)
            more = [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())] if texts else []
            yield batch_of(names, [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), *more])

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * texts
    return arrow_map(docs.select("doc_id", "text"), make, schema, keep=key)
