"""Token-id output as patched frame-of-reference blocks.

A segment holds whole documents. Its ids are cut into blocks of 128; each block stores
its minimum, and the differences packed at a width that a percentile of them fits. Wider
differences keep their low bits in the block and their high bits in an exception list.
The index gives the first word of each block and its first exception, so any range of
ids is read without unpacking what stands before it.

Segment layout, little-endian: magic ``GSP1``, u32 n_ids, u32 n_blocks, u32 n_words,
u32 n_exceptions; per block u32 minimum, u8 width, u32 first word, u32 first exception;
u64 words; per exception u8 place in its block and u32 high bits.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import arrow_map, batch_of, scratch_path

BLOCK = 128
HEAD = struct.Struct("<4s4I")
#: Share of a block's differences that its width must fit.
PERCENTILE = 0.9
#: Ids after which a segment is closed; a longer document makes a segment by itself.
SEGMENT_IDS = 1 << 18
#: Entries of a worker's memo of words, some 80 MB; a full one starts anew and soon has the
#: frequent words again.
MEMO_ENTRIES = 600_000


def _lanes(width: int):
    """Word and bit where each of 64 values of a width starts."""
    for j in range(64):
        yield j, *divmod(j * width, 64)


def encode_segment(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """Pack unsigned 32-bit ids. An empty array gives a segment without blocks."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return HEAD.pack(b"GSP1", 0, 0, 0, 0)
    padded = np.full(blocks * BLOCK, ids[-1], np.int64)
    padded[:n] = ids
    padded = padded.reshape(blocks, BLOCK)
    low = padded.min(axis=1)
    rest = (padded - low[:, None]).astype(np.uint64)
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    pivot = np.partition(rest, at, axis=1)[:, at]
    width = np.frexp(pivot.astype(np.float64))[1].astype(np.uint8)  # bits of the pivot; 0 for 0
    high = rest >> width.astype(np.uint64)[:, None]
    block_of, place = np.nonzero(high)
    first_exception = np.searchsorted(block_of, np.arange(blocks)).astype("<u4")
    size = width.astype(np.int64) * (BLOCK // 64)
    first_word = np.concatenate([[0], np.cumsum(size)])
    words = np.zeros(int(first_word[-1]), np.uint64)
    for w in np.unique(width):
        if w == 0:
            continue
        own = np.flatnonzero(width == w)
        values = (rest[own] & np.uint64((1 << int(w)) - 1)).reshape(-1, 64)
        packed = np.zeros((len(values), int(w)), np.uint64)
        for j, word, bit in _lanes(int(w)):
            packed[:, word] |= values[:, j] << np.uint64(bit)
            if bit + int(w) > 64:
                packed[:, word + 1] |= values[:, j] >> np.uint64(64 - bit)
        where = first_word[own][:, None] + np.arange(int(w) * (BLOCK // 64))
        words[where.reshape(-1)] = packed.reshape(-1)
    head = HEAD.pack(b"GSP1", n, blocks, len(words), len(place))
    parts = (low.astype("<u4"), width, first_word[:-1].astype("<u4"), first_exception, words.astype("<u8"), place.astype(np.uint8), high[block_of, place].astype("<u4"))
    return head + b"".join(x.tobytes() for x in parts)


def decode_segment(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids [start, stop) of a segment; only the blocks that hold them are unpacked."""
    magic, n, blocks, n_words, n_exceptions = HEAD.unpack_from(data)
    if magic != b"GSP1":
        raise ValueError("not a token segment")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    at, parts = HEAD.size, []
    for kind, k in (("<u4", blocks), ("u1", blocks), ("<u4", blocks), ("<u4", blocks), ("<u8", n_words), ("u1", n_exceptions), ("<u4", n_exceptions)):
        parts.append(np.frombuffer(data, kind, k, at))
        at += parts[-1].nbytes
    low, width, first_word, first_exception, words, place, high = parts
    b0, b1 = start // BLOCK, -(-stop // BLOCK)
    out = np.zeros((b1 - b0, BLOCK), np.uint64)
    for w in np.unique(width[b0:b1]):
        if w == 0:
            continue
        own = np.flatnonzero(width[b0:b1] == w)
        where = first_word[b0:b1][own].astype(np.int64)[:, None] + np.arange(int(w) * (BLOCK // 64))
        packed = words[where.reshape(-1)].reshape(-1, int(w))
        values = np.empty((len(packed), 64), np.uint64)
        mask = np.uint64((1 << int(w)) - 1)
        for j, word, bit in _lanes(int(w)):
            v = packed[:, word] >> np.uint64(bit)
            if bit + int(w) > 64:
                v = v | (packed[:, word + 1] << np.uint64(64 - bit))
            values[:, j] = v & mask
        out[own] = values.reshape(-1, BLOCK)
    e0 = int(first_exception[b0])
    e1 = int(first_exception[b1]) if b1 < blocks else n_exceptions
    if e1 > e0:
        block_of = np.searchsorted(first_exception, np.arange(e0, e1), side="right") - 1
        out[block_of - b0, place[e0:e1]] |= high[e0:e1].astype(np.uint64) << width[block_of].astype(np.uint64)
    out += low[b0:b1].astype(np.uint64)[:, None]
    return out.reshape(-1)[start - b0 * BLOCK : stop - b0 * BLOCK].astype(np.uint32)


#: A letter of one or two bytes, and the marks that end its word.
_MARKS = re.compile(rb"([a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])([!-/:-@\[-`{-~]+)(?=[ \t-\r]|\Z)")
#: The same where a text may hold an added token, whose own marks must stay.
_MARK = re.compile(rb"([a-z])([.,:;!?])(?=[ \t-\r]|\Z)")


class WordEncoder:
    """Ids of whole texts by the tokenizers library, which sees each new word once.

    For a tokenizer whose pieces never span white space and whose normalizer maps white
    space to white space, a text's ids are those of its words one after another. Case
    of ASCII letters doesn't matter to it, and the marks that end a word after a letter
    are a piece by themselves. A word of Latin letters is one piece: new ones go to the library
    many in a call, and the ends of their pieces part the ids.
    """

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        # a task has one core; threads of the library would hold heaps of their own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.ends = frozenset(i for t, i in self.library.get_vocab().items() if t.endswith("</w>"))
        self.memo: dict[bytes, bytes] = {}

    def ids(self, words: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def ids_of_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words that are one piece each, by one library call for many."""
        out, ends = [], self.ends
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            ids = self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids
            cuts = [i for i, x in enumerate(ids, 1) if x in ends]
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                packed = struct.pack(f"<{len(ids)}I", *ids)
                out += [packed[4 * i : 4 * j] for i, j in zip([0, *cuts], cuts)]
            else:
                out += self.ids(part)
        return out

    def learn(self, words: list[bytes]) -> None:
        letters, odd = [], []
        for w in words:
            text = w.decode()
            # beyond, case and composition may add marks
            (letters if text.isalpha() and max(text) < "\u0130" else odd).append(text)
        self.memo.update(zip(map(str.encode, letters), self.ids_of_letters(letters)))
        self.memo.update(zip(map(str.encode, odd), self.ids(odd)))

    def words(self, text: str | None) -> list[bytes]:
        if not text:
            return []
        data = text.encode()
        if b"<|" in data:
            return _MARK.sub(rb"\1 \2", data).split()
        return _MARKS.sub(rb"\1 \2", data.lower()).split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        memo, out = self.memo, []
        for k in range(0, len(texts), 256):  # so many texts share the library's calls
            some = [self.words(t) for t in texts[k : k + 256]]
            every = set().union(*some)
            new = every.difference(memo)
            if len(memo) + len(new) > MEMO_ENTRIES:
                memo.clear()
                new = every
            self.learn(list(new))
            out += [b"".join(map(memo.__getitem__, ws)) for ws in some]
        return out


_encoders: dict[str, WordEncoder] = {}


def _encoder(source: str) -> WordEncoder:
    if source not in _encoders:
        _encoders.clear()
        _encoders[source] = WordEncoder(source)
    return _encoders[source]


def write_token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 2) -> None:
    """Write the ids of all documents in ascending doc_id order below ``path``.

    docs: doc_id, text; other columns are not read. Ranges of doc_id go to files, each
    sorted; a file's rows are segments (shard, first, doc_ids, lengths, n_ids, payload),
    where first counts the ids of the shard before the segment. Spark's committer publishes
    whole files only, so a retried task leaves no half-written one. A null text counts as
    empty and has only the end id; null doc_ids come first; rows that repeat a doc_id stay
    rows of their own, next to each other. An empty table gives an empty folder of files.
    """
    with open(tokenizer, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType
    # hashing the text too orders rows that repeat a doc_id
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    ordered = ordered.select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    names = ["shard", "first", "doc_ids", "lengths", "n_ids", "payload"]
    arrow = pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string()

    def make():
        encoder, end = _encoder(source.value), b"" if end_id is None else struct.pack("<I", end_id)
        state = {"shard": 0, "first": 0, "ids": [], "docs": [], "n": 0}

        def close():
            data = np.frombuffer(b"".join(state["ids"]), "<u4")
            row = [[state["shard"]], [state["first"]], [state["docs"]], [[len(x) // 4 for x in state["ids"]]], [len(data)], [encode_segment(data)]]
            types = (pa.int32(), pa.int64(), pa.list_(arrow), pa.list_(pa.int64()), pa.int64(), pa.binary())
            state.update(first=state["first"] + len(data), ids=[], docs=[], n=0)
            return batch_of(names, [pa.array(x, t) for x, t in zip(row, types)])

        def each(batch):
            state["shard"] = batch.column(0)[0].as_py()
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                for doc, ids in zip(part.column(1).to_pylist(), encoder.encode(part.column(2).to_pylist())):
                    state["ids"].append(ids + end)
                    state["docs"].append(doc)
                    state["n"] += len(ids) // 4 + 1
                    if state["n"] >= SEGMENT_IDS:
                        yield close()

        def finish():
            if state["docs"]:
                yield close()

        each.finish = finish
        return each

    k = kind.simpleString()
    arrow_map(ordered, make, f"shard int, first long, doc_ids array<{k}>, lengths array<long>, n_ids long, payload binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 and, with ``ids``, the ids.

    start counts the ids of all documents before: those of the shards before, by a running
    sum over one row a shard (as many as the writer had partitions, so they are broadcast
    and no payload is shuffled), of the shard's segments before, and of the segment's
    documents before. An empty folder gives an empty table.
    """
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = files.join(F.broadcast(sizes.select("shard", before.alias("shard_start"))), "shard")
    rows = rows.select((F.col("shard_start") + F.col("first")).alias("start"), "doc_ids", "lengths", "payload")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids]

    def make():
        def each(batch):
            for k in range(batch.num_rows):  # one segment is held at a time
                start, docs, lengths, payload = (c[k].as_py() for c in batch.columns)
                data = decode_segment(payload).astype("<u4")
                ends = np.cumsum(np.array(lengths, np.int64))
                parts = [data[e - n : e].tobytes() for n, e in zip(lengths, ends.tolist())]
                out = [pa.array(docs, arrow), pa.array(start + ends - np.array(lengths, np.int64), pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield batch_of(names, out + ([pa.array(parts, pa.binary())] if ids else []))

        return each

    arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    return arrow_map(rows, make, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def token_file_digests(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back.

    One row a row of ``docs``, also for nulls, empty texts and repeats; none for an empty table.
    """
    path = scratch_path(spark, "token_files")
    write_token_files(spark, docs, tokenizer, path, end_id)
    return read_token_files(spark, path)
