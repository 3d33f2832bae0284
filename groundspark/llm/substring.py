"""Substring dedup: repeated word windows, found behind a count-min sketch.

First pass: each partition sketches its windows, each under its anchor gram (see
``anchors``), so a window's estimate is at least its count. The partition sketches are
merged cell by cell; only the bit "two or more" of each cell is kept. Second pass: windows
estimated repeated are grouped exactly; no other window can be repeated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .anchors import anchors, window_hash
from .common import arrow_map, batch_of, divided, scratch, words_of
from .minhash import _ODD, mix64

WINDOW, GRAM = 20, 6
#: Bytes of a word with the space behind it, about.
WORD_BYTES = 5.5
#: The sketch: DEPTH rows of cells, CELLS for each anchor by the size of the texts, between
#: 2 ** LEAST_BITS and 2 ** MOST_BITS of them, merged in 2 ** SEGMENT_BITS segments. What is
#: broadcast is a bit a cell: 64 MB at most. A fuller sketch only lets more contexts through.
DEPTH, CELLS, LEAST_BITS, MOST_BITS, SEGMENT_BITS = 2, 8, 20, 28, 8
#: Documents whose words are handled at once.
CHUNK = 2000
#: Ids from here on are doc_ids; below stand texts without one, by a hash.
LEAST_ID = -(1 << 62)


def _cells(hashes: np.ndarray, depth: int, cell_bits: int) -> np.ndarray:
    return (mix64(hashes + _ODD[3 + depth]) >> np.uint64(64 - cell_bits)).astype(np.int64)


def cell_bits(docs: DataFrame, symbol_bytes: float, window: int, gram: int) -> int:
    """Bits that number the cells of a row of the sketch: from the texts' bytes, their bytes a
    symbol and how densely anchors lie."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    anchors_about = size / symbol_bytes * 2 / (window - gram + 2)
    return min(MOST_BITS, max(LEAST_BITS, int(CELLS * anchors_about).bit_length()))


def _chunks(batch: pa.RecordBatch):
    """Ids, word lists, flat word hashes and lengths of some documents at a time."""
    for k in range(0, batch.num_rows, CHUNK):
        part = batch.slice(k, CHUNK)
        words = [words_of(t) for t in part.column(1).to_pylist()]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64, int(lengths.sum()))
        yield part.column(0).to_numpy(zero_copy_only=False), words, flat, lengths


def sketch(docs: DataFrame, hashes_of, bits: int) -> list[np.ndarray]:
    """Bitmaps of the merged sketch's cells that count two or more, one a row of the sketch.

    ``hashes_of(batch)`` yields arrays of what is to be counted; a row has 2 ** bits cells.
    """
    low = bits - SEGMENT_BITS
    flag = np.uint32(1 << 31)

    def make():
        held: list[np.ndarray] = []

        def flush():
            hashes = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            for d in range(DEPTH):
                cells, counts = np.unique(_cells(hashes, d, bits), return_counts=True)
                value = (cells & ((1 << low) - 1)).astype(np.uint32) | np.where(counts > 1, flag, np.uint32(0))
                edges = np.searchsorted(cells >> low, np.arange((1 << SEGMENT_BITS) + 1))
                full = np.flatnonzero(np.diff(edges))
                if len(full):
                    blobs = [value[edges[s] : edges[s + 1]].tobytes() for s in full.tolist()]
                    yield batch_of(["segment", "cells"], [pa.array((full + (d << SEGMENT_BITS)).astype(np.int32)), pa.array(blobs, pa.binary())])

        def each(batch):
            for hashes in hashes_of(batch):
                held.append(hashes)
                if sum(map(len, held)) > 1 << 19:
                    yield from flush()

        each.finish = flush
        return each

    partial = arrow_map(docs, make, "segment int, cells binary")

    def merge():
        counts: dict[int, np.ndarray] = {}

        def each(batch):
            for segment, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = np.frombuffer(blob, np.uint32)
                count = counts.setdefault(segment, np.zeros(1 << low, np.uint8))
                cells = data & (flag - np.uint32(1))
                count[cells] = np.minimum(2, count[cells] + np.where(data & flag, 2, 1).astype(np.uint8))
            return ()

        def finish():
            for segment, count in counts.items():
                yield batch_of(["segment", "bits"], [pa.array([segment], pa.int32()), pa.array([np.packbits(count >= 2).tobytes()], pa.binary())])

        each.finish = finish
        return each

    merged = arrow_map(partial.repartition("segment"), merge, "segment int, bits binary")
    bitmaps = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(DEPTH)]
    size = 1 << (low - 3)
    for row in merged.toLocalIterator():
        d, s = divmod(row["segment"], 1 << SEGMENT_BITS)
        bitmaps[d][s * size : (s + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return bitmaps


def anchor_hashes(window: int, gram: int):
    def of(batch: pa.RecordBatch):
        for _, _, flat, lengths in _chunks(batch):
            yield anchors(flat, lengths, window, gram)[3]

    return of


def estimated_repeated(bitmaps: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for d, bits in enumerate(bitmaps):
        cells = _cells(hashes, d, (len(bits) * 8).bit_length() - 1)
        out &= (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
    return out


def runs_of(sorted_places: np.ndarray) -> np.ndarray:
    """Sorted distinct places as (first, end) runs, flattened."""
    if not len(sorted_places):
        return np.zeros(0, np.int32)
    cut = np.flatnonzero(np.diff(sorted_places) > 1)
    first = sorted_places[np.concatenate([[0], cut + 1])]
    last = sorted_places[np.concatenate([cut, [len(sorted_places) - 1]])]
    return np.stack([first, last + 1], axis=1).reshape(-1).astype(np.int32)


def suspects(docs: DataFrame, bitmaps, window: int, gram: int) -> DataFrame:
    """Windows estimated repeated. Columns: id, hash, place, runs.

    Of equal windows in a chunk of documents only the first can be the first of all: that
    one is a row with its hash and place. The others are repeated beyond doubt: they
    leave, as runs of starts, one row a document, so a frequent window reaches the shuffle
    once a chunk.
    """
    names = ["id", "hash", "place", "runs"]

    def make():
        bits = bitmaps.value

        def each(batch):
            for ids, words, flat, lengths in _chunks(batch):
                at, index, _, hashes = anchors(flat, lengths, window, gram)
                at = at[estimated_repeated(bits, hashes)[index]] if len(at) else at
                if not len(at):
                    continue
                starts = np.cumsum(lengths) - lengths
                doc = np.searchsorted(starts, at, side="right") - 1
                place = at - starts[doc]
                key = window_hash(flat, at, window)
                by = np.lexsort((place, ids[doc], key))
                key, doc, place = key[by], doc[by], place[by]
                new = np.concatenate([[True], key[1:] != key[:-1]])
                head = np.flatnonzero(new)[np.cumsum(new) - 1]
                first = (ids[doc] == ids[doc[head]]) & (place == place[head])
                n = int(first.sum())
                yield batch_of(names, [pa.array(ids[doc[first]]), pa.array(key[first].view(np.int64)), pa.array(place[first].astype(np.int32)), pa.nulls(n, pa.list_(pa.int32()))])
                doc, place = doc[~first], place[~first]
                if len(doc):
                    by = np.lexsort((place, doc))
                    doc, place = doc[by], place[by]
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]])
                    runs = [runs_of(place[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                    m = len(runs)
                    yield batch_of(names, [pa.array(ids[doc[cut[:-1]]]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.array(runs, pa.list_(pa.int32()))])

        return each

    return arrow_map(docs, make, "id long, hash long, place int, runs array<int>")


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """Remove every word under a window whose words also start earlier.

    docs: doc_id (integer from LEAST_ID on), text; other columns are not read. Earlier means a
    smaller doc_id, or the same document and a smaller start; windows are judged on the
    input. Returns doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, the kept words
    joined by spaces. Null and empty texts have no words; texts with a null doc_id count as
    smaller than all others, in the order of a hash. doc_id is a key: rows that repeat it are
    one document given several times and none of them is earlier than another. Windows are
    grouped by a 64-bit hash. An empty table gives an empty table.
    """
    none = F.lit(-(1 << 63)) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("id"), "text")
    bitmaps = docs.sparkSession.sparkContext.broadcast(sketch(rows, anchor_hashes(window, gram), cell_bits(rows, WORD_BYTES, window, gram)))
    found = scratch(suspects(rows, bitmaps, window, gram), "suspects")
    rank = F.rank().over(W.partitionBy("hash").orderBy("id", "place"))
    later = found.where("hash is not null").select("id", "hash", "place").withColumn("r", rank).where("r > 1")
    later = later.groupBy("id").agg(F.collect_list("place").alias("places")).select("id", "places", F.lit(None).cast("array<int>").alias("runs"))
    local = found.where("hash is null").select("id", F.lit(None).cast("array<int>").alias("places"), "runs")
    cuts = later.unionByName(local).groupBy("id").agg(F.flatten(F.collect_list("places")).alias("places"), F.flatten(F.collect_list("runs")).alias("runs"))
    cuts = scratch(cuts, "cuts")
    names = ["id", "n_words", "n_removed", "kept_sha256", *["kept"] * texts]
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts

    def make():
        def each(batch):
            n, removed, kept = [], [], []
            blank = [None] * batch.num_rows
            lists = [batch.column(i).to_pylist() if batch.num_columns > i else blank for i in (2, 3)]
            for text, places, runs in zip(batch.column(1).to_pylist(), *lists):
                words = words_of(text)
                n.append(len(words))
                if not places and not runs:
                    removed.append(0)
                    kept.append(words)
                    continue
                delta = np.zeros(len(words) + window + 1, np.int32)
                p = np.array(places or [], np.int64)
                r = np.array(runs or [], np.int64)
                starts, ends = np.concatenate([p, r[0::2]]), np.concatenate([p + 1, r[1::2]])
                own = ends - 1 + window <= len(words)  # rows that repeat a doc_id may be shorter
                np.add.at(delta, starts[own], 1)
                np.add.at(delta, ends[own] - 1 + window, -1)
                gone = np.cumsum(delta)[: len(words)] > 0
                removed.append(int(gone.sum()))
                kept.append([w for w, g in zip(words, gone.tolist()) if not g])
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(map(_digest, kept), pa.string())]
            yield batch_of(names, arrays + ([pa.array([b" ".join(k).decode("utf-8", "surrogatepass") for k in kept], pa.string())] if texts else []))

        return each

    apart, maybe = divided(rows, cuts, "id")
    out = arrow_map(apart, make, schema).unionByName(arrow_map(maybe.select("id", "text", "places", "runs"), make, schema))
    return out.select(F.when(F.col("id") >= LEAST_ID, F.col("id")).alias("doc_id"), *names[1:])
