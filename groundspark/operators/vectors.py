"""Cosine similarity of dense vectors as array expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


#: Queries and vectors of a block; a task holds one block of each.
QUERIES, VECTORS = 1024, 8192


def similar(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """query_id, vec_id, cosine, rank: the k nearest vectors of each stated query, not itself.

    Blocks of queries meet blocks of vectors, each pair of blocks in one task, which sends the
    best k of each query on (and those within rounding of the last), so no side is broadcast
    and what is ranked at the end is k rows a query and block. Vectors without length or of
    another number of dimensions than the query have cosine 0; null vectors are left out.
    """
    own = lambda rows: rows.where("embedding is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    q, v = own(queries), own(vectors)
    nq, nv = max(1, -(-q.count() // QUERIES)), max(1, -(-v.count() // VECTORS))
    block = lambda rows, n: rows.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    meet = lambda rows, n, names: rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(*[F.col(c).alias(a) for c, a in names], "vec_id", "v")
    left = meet(block(q, nq), nv, (("own", "qb"), ("other", "vb"))).withColumn("asks", F.lit(True))
    right = meet(block(v, nv), nq, (("other", "qb"), ("own", "vb"))).withColumn("asks", F.lit(False))
    kind = queries.schema["vec_id"].dataType.simpleString()

    def best(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids = table.column("vec_id").combine_chunks()
        lists = table.column("v").to_pylist()
        size = np.array([len(x) for x in lists])
        out = []
        for dim in np.unique(size[asks]):
            rows = np.flatnonzero(asks & (size == dim))
            cols = np.flatnonzero(~asks)
            same = cols[size[cols] == dim]
            unit = lambda at: _unit(np.array([lists[i] for i in at], np.float64).reshape(len(at), dim))  # noqa: B023, E731
            found = np.zeros((len(rows), len(cols)))
            found[:, size[cols] == dim] = unit(rows) @ unit(same).T
            itself = np.array(ids.take(pa.array(rows)).to_pylist(), object)[:, None] == np.array(ids.take(pa.array(cols)).to_pylist(), object)[None, :]
            found[itself] = -np.inf
            last = np.partition(found, -min(k, found.shape[1]), axis=1)[:, -min(k, found.shape[1])] if found.shape[1] else np.zeros(len(rows))
            x, y = np.nonzero((found >= last[:, None] - 2e-6) & np.isfinite(found))
            out.append((rows[x], cols[y], found[x, y]))
        x, y, c = (np.concatenate(p) for p in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"query_id": ids.take(pa.array(x)), "vec_id": ids.take(pa.array(y)), "cosine": pa.array(c, pa.float64())})

    pairs = left.unionByName(right).groupBy("qb", "vb").applyInArrow(best, f"query_id {kind}, vec_id {kind}, cosine double")
    order = W.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id")
    pairs = pairs.withColumn("cosine", F.round("cosine", 6))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; those without any stay as they are."""
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(size > 0, size, 1.0)
