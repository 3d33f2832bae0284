"""Prompts for items that a language model is to write, from seed items by category.

The model itself is not part of the engine: ``readers.parsed_items`` reads what it answers.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: What every prompt asks for.
TASK = (
    "Write {n} new items as one JSON array. Each item is an object with q (a question), c (an array of "
    "passages), a (an answer), y (1 if the passages support the whole answer, else 0) and reason (one "
    "sentence on why). Cover supported and unsupported answers alike. Reply with the array alone."
)


def pick_seeds(items: DataFrame, seed: int = 42) -> DataFrame:
    """One item of each category, by a hash of the item and the seed; reruns agree."""
    order = W.partitionBy("category").orderBy(F.xxhash64("q", "a", F.lit(seed)), "q", "a")
    return items.withColumn("turn", F.row_number().over(order)).where("turn = 1").drop("turn")


def build_prompt(seeds: DataFrame, n: int) -> str:
    """The task and the seeds, a category after another; as many rows as categories come in."""
    rows = sorted((r.asDict(True) for r in seeds.collect()), key=lambda r: r["category"])
    shown = [f"{r['category']}:\n" + json.dumps({k: r[k] for k in ("q", "c", "a", "y", "reason") if k in r}, ensure_ascii=False) for r in rows]
    return "\n\n".join([TASK.format(n=n), "Examples:", *shown])
