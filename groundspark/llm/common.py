"""Shared pieces: scratch tables, Arrow mapping, word splitting, graph components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters that are not ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes; ``bytes.split`` splits on the same six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="groundspark-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def _remove(spark_ref: weakref.ref, path: str) -> None:
    spark = spark_ref()
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended: the folder's owner clears it
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when Python exits."""
    path = f"{scratch_root(spark).rstrip('/')}/groundspark-{uuid.uuid4().hex}/{name}"
    atexit.register(_remove, weakref.ref(spark), path)
    return path


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage.

    Lost executors cost nothing but a re-read.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """A name like ``name`` that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def every(columns: list[str]) -> list[Column]:
    """The columns themselves, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """The rows with a number of their own, in a column ``name`` that they don't have yet.

    Written so that the number stays the same; it tells rows of equal or null ids apart.
    """
    return scratch(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


#: Rows and bytes, by their mean, of what a mapping function sees at once.
PART_ROWS, PART_BYTES = 4096, 4 << 20


#: What was costly to build and stays in a worker from task to task. Only module functions may
#: touch it: a function that Spark pickles by value would get a copy.
_kept: dict[str, object] = {}


def kept(key: str, build):
    """What ``build()`` gave in this worker, until a task of ``arrow_map`` comes that keeps another key."""
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def keep_only(key: str | None) -> None:
    """Drop what is ``kept`` in this worker under other keys, and give its memory back."""
    other = [k for k in _kept if k != key]
    for k in other:
        del _kept[k]
    if other:
        gc.collect()  # it may hold itself
        free_memory()


def arrow_map(df: DataFrame, make, schema, keep: str | None = None) -> DataFrame:
    """``mapInArrow`` where ``make()`` builds, once per task, the function batch -> batches.

    A worker holds Python objects of one part of a batch at a time, by PART_ROWS and
    PART_BYTES. The built function may have an attribute ``finish`` giving last batches.
    Workers outlive their tasks, and those of other operators: what one has ``kept`` under
    another key than ``keep`` goes before ``make()`` is called.
    """

    names = df.columns

    def run(batches):
        keep_only(keep)
        each = make()
        for batch in batches:
            batch = batch_of(names, batch.columns)
            n = batch.num_rows
            step = max(1, min(PART_ROWS, n * PART_BYTES // max(1, batch.nbytes)))
            for k in range(0, n, step):
                yield from each(batch.slice(k, step))
            batch = None  # else it stays while the next one is read, and when memory is freed
        if hasattr(each, "finish"):
            yield from each.finish()
        del each
        free_memory()

    # mapInArrow looks columns up by name, which a dot in one would mislead
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, schema)


def free_memory() -> None:
    """Give what a task has freed back to the system; the worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it keeps the pages
        pass


def batch_of(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, names=names)


#: Edges up to which one task finds the components; more take the distributed rounds.
LOCAL_EDGES = 200_000


def _local_components(edges: DataFrame) -> DataFrame:
    """Components of a counted, small edge table by union-find in one task."""

    def run(batches):
        root: dict = {}

        def find(x):
            root.setdefault(x, x)
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for v, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(v), find(m)
                if a != b:
                    root[max(a, b)] = min(a, b)
        if root:
            ids = list(root)
            yield batch_of(["id", "component_id"], [pa.array(ids, kind), pa.array([find(x) for x in ids], kind)])

    kind = edges.schema["v"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(run, f"id {kind}, component_id {kind}")


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Connected components of ``edges (a, b)`` as rows ``(id, component_id)``.

    component_id is the smallest id reachable. Alternates the large-star and the
    small-star step, each a minimum per node (combined before the shuffle) and a join
    back, until the edges no longer change; once at most ``local_edges`` are left, counted,
    one task of that bounded size ends the work with the same result. Nodes without an
    edge are not returned. Self-loops and repeated edges are harmless; an empty table
    gives an empty one.
    """
    now = scratch(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m"))
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        if now.count() <= local_edges:
            return scratch(_local_components(now), "components")
        # large star: every larger neighbour of a node goes to the node's minimum
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(
            now.select(F.col("m").alias("u"), F.col("v").alias("w"))
        )
        least = both.groupBy("u").agg(F.least(F.min("w"), F.first("u")).alias("m"))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("v"), "m").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("v").agg(F.min("m").alias("r"))
        small = (
            large.join(low, "v")
            .where("m <> r")
            .select(F.col("m").alias("v"), F.col("r").alias("m"))
            .unionByName(low.select("v", F.col("r").alias("m")))
            .distinct()
        )
        now = scratch(small, "edges")
        after = now.agg(F.count("*"), F.sum(F.xxhash64("v", "m") % (1 << 31)), F.count_distinct("v")).first()
        if after[0] == after[2] and after == seen:
            break
        seen = after
    return now.select(F.col("v").alias("id"), F.col("m").alias("component_id")).unionByName(
        now.select(F.col("m").alias("id"), F.col("m").alias("component_id")).distinct()
    )


#: 64-bit words of the bitmap by which rows are passed over before a shuffle.
FILTER_WORDS = 1 << 17


def divided(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose key is surely not in ``ids``; and the others with the further
    columns of ``ids``, null where the key isn't there either. Keys are distinct in ``ids``.

    A bitmap of hashed keys, of FILTER_WORDS words however many keys there are, is
    broadcast, so most rows that are not asked for never enter the shuffle; the join of the
    others is exact. No column of ``docs`` but the key may be one of ``ids``.
    """
    bit = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(FILTER_WORDS * 64))
    word, mask = F.shiftright(bit, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    at, bits = unused(docs.columns, "word"), unused(docs.columns, "bits")
    bitmap = ids.select(word.alias(at), mask.alias(bits)).groupBy(at).agg(F.bit_or(bits).alias(bits))
    rows = docs.join(F.broadcast(bitmap), word == F.col(at), "left")
    found = F.coalesce(F.col(bits).bitwiseAND(mask) != 0, F.lit(False))
    return rows.where(~found).select(every(docs.columns)), rows.where(found).select(every(docs.columns)).join(ids, key, "left")


def rows_of(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is in ``ids``, with its further columns (see ``divided``)."""
    there = unused([*docs.columns, *ids.columns], "there")
    return divided(docs, ids.withColumn(there, F.lit(True)), key)[1].where(F.col(there)).drop(there)


def by_runs(df: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """Bring rows with equal keys together and call ``work(table)`` on each such group.

    Groups must be bounded by construction: each is held in memory, one at a time.
    ``work`` returns a record batch or None.
    """
    n = len(keys)

    def run(batches):
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            values = list(zip(*(table.column(i).to_pylist() for i in range(n))))
            start = 0
            for i, value in enumerate(values):
                if value != last:
                    if i > start:
                        held.append(table.slice(start, i - start))
                    if held and (out := work(pa.concat_tables(held))) is not None:
                        yield out
                    held, start, last = [], i, value
            held.append(table.slice(start))
        if held and (out := work(pa.concat_tables(held))) is not None:
            yield out

    ordered = df.select(*keys, *[c for c in df.columns if c not in keys])
    return ordered.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
