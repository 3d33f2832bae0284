"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a fixed number of cells. A virtual node owns the cells from the
one after its predecessor up to its own; a cell's rows belong to its owner's shard until
that is full, and the overflow continues clockwise to the next shard with room. Only one
count a cell reaches the driver, whose number is a parameter and not the data's.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: 2 ** CELL_BITS cells on the ring.
CELL_BITS = 14
VIRTUAL_NODES = 64


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, cell_bits: int = CELL_BITS, seed: int = 0) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, clockwise."""

    def place(shard: int, v: int) -> int:
        digest = hashlib.blake2b(f"{seed}/{shard}/{v}".encode(), digest_size=8).digest()
        return int.from_bytes(digest, "big") >> (64 - cell_bits)

    return sorted((place(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def allot(counts: dict[int, int], nodes: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Deal the rows of cells to shards: pieces (cell, first rank, end rank, shard, first slot).

    First every shard takes from its own cells, in ring order, up to its capacity; then
    what is left of each cell walks clockwise. The capacities together hold all rows.
    """
    cells, room = [c for c, _ in nodes], list(capacity)
    used, pieces, over = [0] * len(capacity), [], []

    def put(cell: int, at: int, n: int, shard: int) -> None:
        pieces.append((cell, at, at + n, shard, used[shard]))
        used[shard] += n
        room[shard] -= n

    for cell in sorted(counts):
        start = bisect_left(cells, cell) % len(nodes)
        shard = nodes[start][1]
        if n := min(counts[cell], room[shard]):
            put(cell, 0, n, shard)
        if n < counts[cell]:
            over.append((cell, n, start))
    for cell, at, node in over:
        while at < counts[cell]:
            node = (node + 1) % len(nodes)
            shard = nodes[node][1]
            if n := min(counts[cell] - at, room[shard]):
                put(cell, at, n, shard)
                at += n
    return pieces


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most rows of each shard. Without slack they sum to ``rows`` and differ by one at most."""
    if slack:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shard_documents(docs: DataFrame, shards: int = 24, slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES, cell_bits: int = CELL_BITS, seed: int = 0) -> DataFrame:
    """Put every row into a shard.

    docs: doc_id, text; other columns are not read. Returns doc_id, size (UTF-8 bytes plus
    8), text_crc32, law, shard, slot, grown_shard. With slack 0 the law is ``rows``: the
    shards' counts differ by one at most. A row's place on the ring is a hash of doc_id
    and the text's checksum; rows of a cell are ranked by that hash, then doc_id. A null
    text counts as empty; a null doc_id is a key like any other; repeated rows are rows of
    their own. An empty table gives an empty table. grown_shard is null: under this law a
    further shard also moves rows between the old ones where a bound is met.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    base = base.withColumn("place", F.xxhash64("doc_id", "text_crc32"))
    base = base.withColumn("cell", F.shiftrightunsigned("place", 64 - cell_bits).cast("int"))
    counts = {r["cell"]: r["n"] for r in base.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    pieces = allot(counts, ring(shards, virtual_nodes, cell_bits, seed), capacities(sum(counts.values()), shards, slack))
    frame = pd.DataFrame(pieces, columns=["cell", "first", "end", "shard", "slot0"])
    table = docs.sparkSession.createDataFrame(frame, "cell int, first long, end long, shard int, slot0 long")
    rank = F.row_number().over(W.partitionBy("cell").orderBy("place", "doc_id", "text_crc32", "size")) - 1
    # pieces: at most one a cell and one for each time a shard fills up
    rows = base.withColumn("rank", rank).join(F.broadcast(table), "cell").where("rank >= first and rank < end")
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bounded" if slack else "rows").alias("law"),
        "shard",
        (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
