"""Near-duplicates of embeddings by sorted projection passes.

Each pass orders the vectors of a label, less the label's mean, lexicographically by the
concatenated signs of random projections and compares those that lie near each other in
that order. A label of one block meets whole in one pass. For a larger one rounds of passes
follow until one joins no components any more, or until they have cost about what all pairs
would; an exact check of all pairs of different components then adds what passes have
missed. So labels of every size take one path, and none loses a link. Verified pairs are
united. Links are then counted inside the components found.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import arrow_map, batch_of, by_runs, components, scratch

#: Signs that one pass concatenates.
BITS = 48
#: Vectors of a block of the order, and of the next block that it also sees.
BLOCK, AHEAD = 1024, 256
#: Vectors of a component that are compared with each other in one step of counting.
TILE = 256
#: Share of linked pairs that may be missed at the threshold, by which first passes are planned.
MISS = 0.005
#: Vectors of a tile of the exact check.
SQUARE = 4096
#: No round follows in a label that has at most so many tiles for each of its passes.
WHOLE = 2.5
#: Least passes of a label, and of a round that follows the first.
PASSES, MORE = 12, 6


def planned_passes(vectors: int, cosine: float, least: int = PASSES) -> int:
    """Passes that meet MISS: in one, a pair meets if it shares log2(vectors / BLOCK) signs."""
    agree = 1 - math.acos(cosine) / math.pi
    meet = min(0.9, agree ** max(1.0, math.log2(max(2, vectors) / BLOCK)))
    return max(least, math.ceil(math.log(MISS) / math.log(1 - meet)))


def centred(cosine: float, shared: float) -> float:
    """Cosine of a pair at the threshold after the mean, of squared length ``shared``, is taken off."""
    return (cosine - shared) / (1 - shared) if shared < cosine else 0.0


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = _rows(column)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding, dim and a 128-bit hash, of vectors that can link.

    Embeddings of floats stay so, which halves what is moved; others become doubles.
    """
    names = ["vec_id", "label", "embedding", "dim", "hi", "lo"]
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    single = kinds["embedding"] == "array<float>"
    lists = pa.list_(pa.float32() if single else pa.float64())

    def make():
        def each(batch):
            keep, dims, hi, lo = [], [], [], []
            for v, label in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                ok = bool(v) and label is not None and None not in v and all(map(math.isfinite, v)) and any(v)
                keep.append(ok)
                if ok:
                    h = xxhash.xxh3_128_intdigest((np.array(v) + 0.0).tobytes())
                    dims.append(len(v))
                    hi.append((h >> 64) - (1 << 63))
                    lo.append((h & ((1 << 64) - 1)) - (1 << 63))
            mask = pa.array(keep, pa.bool_())
            cols = [c.filter(mask) for c in batch.columns]
            yield batch_of(names, [cols[0], cols[1], cols[2].cast(lists), pa.array(dims, pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())])

        return each

    return arrow_map(vectors.select("vec_id", "label", "embedding"), make, f"vec_id {kinds['vec_id']}, label {kinds['label']}, embedding array<{'float' if single else 'double'}>, dim int, hi long, lo long")


def _signs(rows: np.ndarray, dim: int, number: int, seed: int) -> np.ndarray:
    planes = np.random.default_rng([seed, dim, number]).standard_normal((dim, BITS))
    return (rows @ planes >= 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _star(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the least id of each component of the pairs (a, b) of places in ``ids``."""
    by = np.argsort(ids, kind="stable")
    ids, place = ids[by], np.argsort(by)
    a, b = place[a], place[b]
    least = np.arange(len(ids))
    while True:
        now = least.copy()
        np.minimum.at(now, a, least[b])
        np.minimum.at(now, b, least[a])
        now = now[now]
        if (now == least).all():
            break
        least = now
    far = np.flatnonzero(least != np.arange(len(ids)))
    return ids[far], ids[least[far]]


def _near(table: pa.Table, cosine: float, own: np.ndarray | None = None) -> pa.RecordBatch | None:
    """Edges a, b, label, dim that join what is linked among a group's rows; with ``own``, the
    rows' tiles, only pairs of different tiles are compared. If the rows have components, in
    a column c, only links between different ones count."""
    rows, ids = _matrix(table.column("v")), table.column("id").to_numpy()
    left = right = np.arange(len(ids))
    if own is not None:
        left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())
    # few rows at a time, and each step's links as a star, bound what is held
    other, a, b = rows[right], np.zeros(0, ids.dtype), np.zeros(0, ids.dtype)
    c = table.column("c").to_numpy() if "c" in table.column_names else None
    for k in range(0, len(left), 512):
        part = left[k : k + 512]
        start = 0 if own is not None else k
        near = rows[part] @ other[start:].T >= cosine
        if c is not None:
            near &= c[part][:, None] != c[right[start:]][None, :]
        x, y = np.nonzero(near)
        x, y = part[x], right[start + y]
        x, y = x[x != y], y[x != y]
        if len(x):
            more = _star(ids, x, y)
            a, b = np.concatenate([a, more[0]]), np.concatenate([b, more[1]])
    if not len(a):
        return None
    n = len(a)
    label = table.column("label").combine_chunks().take(pa.array(np.zeros(n, np.int64)))
    dim = table.column("dim").combine_chunks().take(pa.array(np.zeros(n, np.int64)))
    return batch_of(["a", "b", "label", "dim"], [pa.array(a), pa.array(b), label, dim])


def _edge_schema(classes: DataFrame) -> str:
    kind, label = (classes.schema[c].dataType.simpleString() for c in ("id", "label"))
    return f"a {kind}, b {kind}, label {label}, dim int"


def missed_edges(classes: DataFrame, labels: DataFrame, found: DataFrame, cosine: float) -> DataFrame:
    """Edges between components ``found (id, component_id)`` of ``labels (label, dim, tiles)``,
    by all pairs: each two tiles meet once."""
    tiled = classes.join(labels.select("label", "dim", "tiles"), ["label", "dim"]).join(found, "id", "left")
    tiled = tiled.withColumn("c", F.coalesce("component_id", "id")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select("label", "dim", F.least("own", "other").alias("t0"), F.greatest("own", "other").alias("t1"), "own", "id", "c", "v")

    def link(table: pa.Table):
        same = table.column("t0")[0].as_py() == table.column("t1")[0].as_py()
        own, c = table.column("own").to_numpy(), table.column("c").to_numpy()
        if (c == c[0]).all() or (not same and (own == own[0]).all()):
            return None
        return _near(table, cosine, None if same else own)

    return by_runs(tiled, ["label", "dim", "t0", "t1"], link, _edge_schema(classes))


def pass_edges(classes: DataFrame, labels: DataFrame, cosine: float, seed: int) -> DataFrame:
    """Edges that passes first to last - 1 of ``labels (label, dim, mean, first, last)`` meet.

    Blocks begin with the label; one without a mean is ordered by the vectors as they are.
    """
    kind, label = (classes.schema[c].dataType.simpleString() for c in ("id", "label"))
    own = classes.join(labels.select("label", "dim", "mean", "first", "last"), ["label", "dim"])
    own = own.withColumn("mean", F.coalesce("mean", F.array_repeat(F.lit(0.0), F.col("dim"))))

    def make():
        def each(batch):
            kinds = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 5, 6)], axis=1)
            for dim, first, last in np.unique(kinds, axis=0).tolist():
                part = batch.filter(pa.array((kinds == [dim, first, last]).all(axis=1)))
                rows = _matrix(part.column(3)) - _rows(part.column(4))
                for number in range(first, last):
                    keys = _signs(rows, dim, number, seed)
                    yield batch_of(["id", "label", "dim", "pass", "key"], [*part.columns[:3], pa.array(np.full(len(keys), number, np.int32)), pa.array(keys)])

        return each

    keyed = arrow_map(own.select("id", "label", "dim", "v", "mean", "first", "last"), make, f"id {kind}, label {label}, dim int, pass int, key long")
    order = ["pass", "label", "dim", "key", "id"]
    line = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    line = line.select("id", "label", "dim", "pass", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    line = scratch(line, "order")
    # one row a partition and label: where its rows stand in the label's order
    own = ["pass", "label", "dim"]
    parts = line.groupBy(*own, "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*own).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    line = line.join(parts.select(*own, "part", "first", before.alias("before")), [*own, "part"])
    rank = F.col("before") + F.col("at") - F.col("first")
    block = F.floor(rank / BLOCK).cast("long")
    seen = F.when((rank % BLOCK < AHEAD) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    line = line.select(F.explode(seen).alias("block"), "pass", "label", "dim", "id").join(classes.select("label", "dim", "id", "v"), ["label", "dim", "id"])
    return by_runs(line.select("block", "pass", "label", "dim", "id", "v"), ["block", "pass", "label", "dim"], lambda table: _near(table, cosine), _edge_schema(classes))


def plan(classes: DataFrame, sizes: DataFrame, cosine: float) -> DataFrame:
    """label, dim, tiles, mean of the unit vectors and passes of the labels ``sizes (label, dim, n, tiles)``."""
    label = classes.schema["label"].dataType.simpleString()
    names = ["label", "dim", "n", "tiles", "total"]
    own = classes.join(F.broadcast(sizes), ["label", "dim"]).select("label", "dim", "n", "tiles", "v")

    def make():
        totals: dict[tuple, np.ndarray] = {}
        kind = []

        def each(batch):
            kind[:] = [batch.schema.field(0).type]
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            for key in set(keys):
                rows = _matrix(batch.column(4).filter(pa.array([k == key for k in keys])))
                totals[key] = totals.get(key, 0.0) + rows.sum(axis=0)
            return iter(())

        def finish():
            if totals:
                cols = list(zip(*totals))
                yield batch_of(names, [pa.array(cols[0], kind[0]), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array([t.tolist() for t in totals.values()], pa.list_(pa.float64()))])

        each.finish = finish
        return each

    def planned(table: pa.Table):
        n = table.column("n")[0].as_py()
        mean = _rows(table.column("total")).sum(axis=0) / n
        passes = planned_passes(n, centred(cosine, float(mean @ mean)))
        head = [table.column(c).combine_chunks().slice(0, 1) for c in ("label", "dim", "tiles")]
        return batch_of(["label", "dim", "tiles", "mean", "passes"], [*head, pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([passes], pa.int32())])

    totals = arrow_map(own, make, f"label {label}, dim int, n long, tiles int, total array<double>")
    return by_runs(totals, ["label", "dim"], planned, f"label {label}, dim int, tiles int, mean array<double>, passes int")


def linked_components(classes: DataFrame, cosine: float, seed: int) -> DataFrame:
    """Components (id, component_id) of the classes' links."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where("n > 1")
    sizes = scratch(sizes.withColumn("tiles", F.ceil(F.col("n") / SQUARE).cast("int")), "sizes")
    large = sizes.where(F.col("n") > BLOCK)
    # one pass brings all pairs of a block together
    block = sizes.where(F.col("n") <= BLOCK).select("label", "dim", "tiles", F.lit(None).cast("array<double>").alias("mean"), F.lit(1).alias("passes"))
    todo = block.unionByName(plan(classes, large, cosine)).withColumn("first", F.lit(0)).withColumn("last", F.col("passes"))
    todo = scratch(todo, "plan")
    edges = found = None
    while True:
        new = scratch(pass_edges(classes, todo, cosine, seed).distinct(), "edges")
        if found is not None:
            to = found.withColumnRenamed("component_id", "c")
            new = new.join(to.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a", "left").join(to.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b", "left")
            new = scratch(new.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "label", "dim"), "joining")
            todo = todo.join(F.broadcast(new.select("label", "dim").distinct()), ["label", "dim"])
        edges = new if edges is None else edges.unionByName(new)
        found = components(edges.select("a", "b"))
        more = F.greatest(F.lit(MORE), F.ceil(F.col("passes") / 2)).cast("int")
        todo = todo.where(F.col("mean").isNotNull() & (F.col("tiles") > F.col("last") * WHOLE))
        todo = scratch(todo.select("label", "dim", "tiles", "mean", "passes", F.col("last").alias("first"), (F.col("last") + more).alias("last")), "plan")
        if todo.isEmpty():
            break
    if large.isEmpty():
        return found
    missed = scratch(missed_edges(classes, large, found, cosine).distinct(), "missed")
    return components(edges.unionByName(missed).select("a", "b"))


def vector_groups(vectors: DataFrame, cosine: float = 0.93, seed: int = 11) -> DataFrame:
    """Groups of near-duplicate vectors: vec_id, n_links, component_id, kept.

    vectors: vec_id, embedding, label; other columns are not read. Only vectors of one
    label and length are compared, in double precision. Null, empty and zero vectors and
    those with null or non-finite components, as well as null labels, link with nothing.
    Equal vectors form a class that takes part once, with its number of members. Links are
    exact and whole, whatever the size of a label; the check behind the passes takes time
    with the square of a label beyond one block. Repeated rows count as vectors of their own.
    An empty table gives an empty table.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    good = scratch(usable(vectors), "vectors")
    classes = good.groupBy("label", "dim", "hi", "lo").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.first("embedding").alias("v"))
    classes = scratch(classes, "classes")
    found = linked_components(classes, cosine, seed)
    linked = scratch(classes.select("id", "m", "v").join(found, "id"), "linked")
    sizes = linked.groupBy("component_id").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiled = linked.join(sizes, "component_id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select("component_id", F.least("own", "other").alias("t0"), F.greatest("own", "other").alias("t1"), "own", "id", "m", "v")

    def count(table: pa.Table):
        own = table.column("own").to_numpy()
        rows, m, ids = _matrix(table.column("v")), table.column("m").to_numpy(), table.column("id")
        near = (rows @ rows.T >= cosine) & ((own[:, None] != own[None, :]) | (table.column("t0")[0].as_py() == table.column("t1")[0].as_py()))
        np.fill_diagonal(near, False)
        return batch_of(["id", "links"], [ids.combine_chunks(), pa.array((near * m[None, :]).sum(axis=1).astype(np.int64))])

    links = by_runs(tiled, ["component_id", "t0", "t1"], count, f"id {kind}, links long").groupBy("id").agg(F.sum("links").alias("links"))
    done = classes.select("label", "dim", "hi", "lo", "id", "m").join(found, "id", "left").join(links, "id", "left")
    done = scratch(done.select("label", "dim", "hi", "lo", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")), "done")
    members = good.select("vec_id", "label", "dim", "hi", "lo").join(done, ["label", "dim", "hi", "lo"]).select("vec_id", "n_links", "component_id")
    bad = vectors.select("vec_id", "label", "embedding")
    fine = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    bad = bad.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = members.unionByName(bad)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
