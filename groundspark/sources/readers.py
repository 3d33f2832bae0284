"""Sources: traces from JSON arrays and CSV files, prediction tables, and trace views of tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TRACE = "q string, a string, c array<string>, y int, reason string"
CONTRIBUTIONS = "array<struct<feature:string,value:double,coefficient:double,contribution:double>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listed(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Files of a folder that comma-separated globs name: each glob's sorted, none twice.

    The folder may lie in any store that Spark reads; only names come to the driver.
    """
    jvm = spark.sparkContext._jvm
    found: dict[str, None] = {}
    for glob in filter(None, map(str.strip, pattern.split(","))):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{glob}")
        own = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        found |= dict.fromkeys(sorted(x.getPath().toString() for x in own or ()))
    return list(found)


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Traces of all files that the globs name, with file_no, their file's place in that order.

    One bad record fails the load, as it does for a file alone.
    """
    paths = listed(spark, folder, pattern)
    if not paths:
        raise FileNotFoundError(f"no file in {folder} fits {pattern}")
    parts = []
    for path in paths:
        rows = read_csv_traces(spark, path) if path.endswith(".csv") else read_json_traces(spark, path)
        parts.append(rows.withColumn("file_no", F.lit(len(parts))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_json_traces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Labelled traces from JSON arrays; a record without q, a, c or y, or with wrong types, fails the read."""
    rows = spark.read.schema(TRACE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return checked_traces(rows)


def checked_traces(rows: DataFrame) -> DataFrame:
    bad = F.col("q").isNull() | F.col("a").isNull() | F.col("c").isNull() | F.col("y").isNull()
    guard = F.when(bad, F.raise_error(F.lit("a trace needs q, a, c and y"))).otherwise(F.col("q"))
    return rows.withColumn("q", guard)


def chunk_columns(names: list[str]) -> list[str]:
    """Context columns of a CSV: those that start with "chunk", by number, others last."""

    def key(name: str):
        m = re.search(r"(\d+)$", name)
        return (0, int(m[1])) if m else (1, 0)

    return sorted((n for n in names if n.lower().startswith("chunk")), key=key)


def abstained_label(col: Column) -> Column:
    """0 where the answer abstained (true, 1 or yes), else 1."""
    return F.when(F.lower(F.trim(F.coalesce(col, F.lit("")))).isin("true", "1", "yes"), 0).otherwise(1)


def read_csv_traces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    chunks = [F.col(f"`{c}`") for c in chunk_columns(raw.columns)]
    c = F.filter(F.array(*chunks), lambda x: x.isNotNull() & (F.trim(x) != "")) if chunks else F.array().cast("array<string>")
    kind = F.col("answer_type") if "answer_type" in raw.columns else F.lit(None).cast("string")
    return raw.select(F.col("question").alias("q"), F.col("answer").alias("a"), c.alias("c"), abstained_label(F.col("abstained")).alias("y"), kind.alias("answer_type"), F.col("abstained"))


def valid_items(rows: DataFrame) -> DataFrame:
    """Generated items whose fields are there and whose label is 0 or 1; a missing reason reads n/a."""
    ok = F.col("q").isNotNull() & F.col("a").isNotNull() & F.col("c").isNotNull() & F.col("y").isin(0, 1)
    return rows.where(ok).withColumn("reason", F.coalesce("reason", F.lit("n/a")))


def repaired_json(text: Column) -> Column:
    """From the first [ to the last ], without commas that stand before a closing bracket."""
    return F.regexp_replace(F.regexp_extract(text, r"(?s)\[.*\]", 0), r",\s*([\]}])", "$1")


ITEM = "array<struct<q:string,a:string,c:array<string>,y:int,reason:string,answer_type:string>>"


def parsed_items(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Items of answers that hold a JSON array, as it stands or repaired; and the rows that hold
    none, with an ``error``."""
    strict = F.from_json(F.regexp_extract(F.col(column), r"(?s)\[.*\]", 0), ITEM, {"mode": "PERMISSIVE"})
    items = F.coalesce(strict, F.from_json(repaired_json(F.col(column)), ITEM, {"mode": "PERMISSIVE"}))
    marked = rows.withColumn("items", items)
    good = marked.where("items is not null").select(*[c for c in rows.columns if c != column], F.inline("items"))
    return good, marked.where("items is null").drop("items").withColumn("error", F.lit("no JSON array could be read"))


def augmented_contexts(contexts: Column, passage: str) -> Column:
    return F.transform(contexts, lambda x: F.concat(F.trim(x), F.lit(" "), F.lit(passage)))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A prediction CSV; unreadable contributions count as none, a missing answer type as unknown."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if "top_features" not in raw.columns:
        raise ValueError("the prediction file has no top_features column")
    found = F.coalesce(F.from_json("top_features", CONTRIBUTIONS), F.array().cast(CONTRIBUTIONS))
    kind = F.coalesce(F.nullif(F.trim("answer_type"), F.lit("")), F.lit("unknown")) if "answer_type" in raw.columns else F.lit("unknown")
    return raw.withColumn("top_features", found).withColumn("answer_type", kind)


def read_test_rows(spark: SparkSession, path: str) -> DataFrame:
    """A featurized CSV with its own row_id (else the hash of the row), q and a decoded from JSON
    where they are JSON strings, and a blank answer type as unknown."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", "\\").csv(path)
    text = lambda c: F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), F.col(c), F.lit("}")), "$.v"), F.col(c)).alias(c)
    kind = F.coalesce(F.nullif(F.trim("answer_type"), F.lit("")), F.lit("unknown")) if "answer_type" in raw.columns else F.lit("unknown")
    key = F.col("row_id").cast("long") if "row_id" in raw.columns else F.xxhash64(*[F.col(f"`{c}`") for c in raw.columns])
    rest = [F.col(f"`{c}`") for c in raw.columns if c not in ("row_id", "q", "a", "answer_type")]
    return raw.select(key.alias("row_id"), *[text(c) for c in ("q", "a") if c in raw.columns], kind.alias("answer_type"), *rest)


def read_stats_rows(spark: SparkSession, path: str) -> DataFrame:
    """y and answer_type of a featurized CSV; a label that is missing, empty or no number fails
    the read and is named. 1.0 reads 1."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", "\\").csv(path)
    if "y" not in raw.columns:
        raise ValueError("the file has no column y")
    number = F.expr("try_cast(trim(y) as double)")
    guard = F.when(number.isNull(), F.raise_error(F.concat(F.lit("not a label: "), F.coalesce("y", F.lit("(none)"))))).otherwise(number.cast("int"))
    kind = F.col("answer_type") if "answer_type" in raw.columns else F.lit(None).cast("string")
    return raw.select(guard.alias("y"), kind.alias("answer_type"))


def conversation_traces(conversations: DataFrame) -> DataFrame:
    """Each user turn with the assistant's next one; contexts are the assistant's earlier turns.

    Returns trace_id, conv_id, q, a, c (may be empty). One window per conversation.
    trace_id is conv_id * 1000 + turn up to turn 999, and a hash of both beyond.
    """
    w = W.partitionBy("conv_id").orderBy("turn")
    said = F.when(F.col("role") == "assistant", F.col("text"))
    rows = conversations.select(
        "conv_id",
        "turn",
        "role",
        F.col("text").alias("q"),
        F.lead("text").over(w).alias("a"),
        F.lead("role").over(w).alias("next_role"),
        F.lead("turn").over(w).alias("next_turn"),
        F.collect_list(said).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("c"),
    )
    rows = rows.where("role = 'user' and next_role = 'assistant' and next_turn = turn + 1")
    key = F.when(F.col("turn") < 1000, F.col("conv_id") * 1000 + F.col("turn")).otherwise(-F.abs(F.xxhash64("conv_id", "turn") / 2).cast("long"))
    return rows.select(key.alias("trace_id"), "conv_id", "q", "a", "c")
