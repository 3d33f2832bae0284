"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source whose target exceeds its size first gives complete epochs of all its
documents; the fraction left is sampled without replacement: each document draws the
exponential key -ln(u) / weight, its source's documents are sorted by key, and the
prefix that comes nearest the budget of words is taken.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import arrow_map, batch_of, every, scratch, unused, words_of

#: Documents of a source that share a bucket of keys; one task sorts one bucket.
BUCKET_ROWS = 512


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and a quality weight from 0.05 upwards.

    The weight is the share of different words among a text's words, eased for length:
    distinct / n ** 0.75. It is 0.05 for a text without words.
    """

    def make():
        def each(batch: pa.RecordBatch):
            sizes, weights = [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                sizes.append(len(words))
                weights.append(max(0.05, len(set(words)) / math.pow(len(words), 0.75)) if words else 0.05)
            yield batch_of(["doc_id", "source", "size", "weight"], [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(weights, pa.float64())])

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text"), make, f"doc_id {kind}, source string, size long, weight double")


def source_targets(sized: DataFrame, max_epochs: int = 3, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """One row a source: number k, size, rows, mean weight and target.

    Sources by code point, null last, weigh ``weights`` over and over. Targets share the
    sum of all sizes by weight; none exceeds max_epochs times its source's size, and the
    excess goes to the others by weight until none is above. In order of the level at
    which a source reaches its limit, the level that fits is the highest of the running
    ones, so two running sums give what repeated sharing would. The windows here see one
    row a source, not the documents.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.avg("weight").alias("mean_weight"))
    k = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") - 1) % len(weights) + 1)
    out = total.withColumn("k", k).withColumn("share", cycle).withColumn("most", F.lit(float(max_epochs)) * F.col("source_size"))
    order = W.orderBy(F.col("most") / F.col("share"), "k")
    out = out.withColumn("spent", F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    out = out.withColumn("open", F.sum("share").over(order.rowsBetween(0, W.unboundedFollowing)))
    out = out.withColumn("level", (F.sum("source_size").over(W.partitionBy()) - F.col("spent")) / F.col("open"))
    out = out.withColumn("target", F.least("most", F.col("share") * F.max("level").over(W.partitionBy())))
    return out.select("k", "source", "source_size", "n", "mean_weight", "target")


def mix(docs: DataFrame, max_epochs: int = 3, weights: tuple[float, ...] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """How often the mix takes each document.

    docs: doc_id, text, source; other columns are not read. Returns doc_id, size,
    source_size, target, taken (words, repeats counted), copies. Keys come from a hash of
    doc_id and seed, so reruns agree; ties go by doc_id. A null text has size 0 and is
    never taken; null sources form one source. Repeated rows count as documents of their
    own that draw the same key. An empty table gives an empty table.

    A source's prefix sum runs over buckets of its keys: one row a bucket first, then
    within each bucket, so no task holds a whole source.
    """
    sized = scratch(measured(docs), "sized")
    sources = scratch(source_targets(sized, max_epochs, weights), "sources")
    # 52 bits of a hash that any engine has
    digest = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = sized.select("doc_id", F.col("source").alias("s"), "size", (-F.log(u) / F.col("weight")).alias("key"))
    rows = rows.join(sources, F.col("s").eqNullSafe(F.col("source")))
    buckets = F.ceil(F.col("n") / F.lit(BUCKET_ROWS))
    even = F.lit(1.0) - F.exp(-F.col("key") * F.col("mean_weight"))
    rows = rows.select("doc_id", "size", "key", "k", "source_size", "target", F.least(F.floor(even * buckets), buckets - 1).cast("long").alias("bucket"))
    sums = rows.groupBy("k", "bucket").agg(F.sum("size").alias("own"))
    before = F.coalesce(F.sum("own").over(W.partitionBy("k").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sums.select("k", "bucket", before.alias("before")), ["k", "bucket"])
    inside = F.sum("size").over(W.partitionBy("k", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("middle", F.col("before") + inside - F.col("size") / 2)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rows = rows.withColumn("epochs", epochs.cast("long"))
    more = (F.col("size") > 0) & (F.col("middle") <= F.col("target") - F.col("epochs") * F.col("source_size"))
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.col("epochs") + more.cast("long")).otherwise(F.lit(0)).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns.

    doc_id is the key, null included; rows that repeat one get that id's largest number of
    copies. Rows without words are never taken. An empty table gives an empty table.
    """
    columns = docs.columns
    copies, turn, key = (unused(columns, c) for c in ("copies", "turn", "key"))
    taken = mix(docs, **options).where("copies > 0").groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").cast("int").alias(copies))
    joined = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(key)))
    return joined.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(every(columns))
