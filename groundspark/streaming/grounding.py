"""Grounding of traces that arrive as a stream: every score is local to its row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.functions.entities import ExtractorConfig, entities_of, entities_of_all
from groundspark.operators import matching
from groundspark.operators.metrics import simple_scores


def scored_stream(traces: DataFrame, config: ExtractorConfig = ExtractorConfig()) -> DataFrame:
    """trace_id, word overlap, confidence, completeness and entity coverage, without state."""
    rows = traces.withColumn("a_entities", entities_of(F.col("a"), config)).withColumn("c_entities", entities_of_all(F.col("c"), config))
    typed = rows.select("*", matching.numeric_match(F.col("a_entities"), F.col("c_entities")).alias("numeric_match"))
    scores = simple_scores(typed.withColumn("trace_id", F.struct("trace_id", "numeric_match")))
    return scores.select("trace_id.trace_id", "trace_id.numeric_match", "faithfulness", "confidence", "completeness")


def quality_by_window(scored: DataFrame, time: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Mean faithfulness and count by event-time window; rows later than ``late`` are not counted."""
    return scored.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.avg("faithfulness").alias("faithfulness"))
