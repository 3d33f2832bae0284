"""Evaluation of scored rows (y, p): curves, thresholds, folds and by-group tables.

Ties of p are one point of a curve. Counts are grouped by p before any running sum, so the
single ordered window sees one row per distinct score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def curve(scored: DataFrame) -> DataFrame:
    """p, precision, recall of the rule "score at least p", with tp and fp at and above p."""
    by = scored.groupBy("p").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    down = W.orderBy(F.col("p").desc()).rowsBetween(W.unboundedPreceding, 0)
    out = by.select("p", "pos", "n", F.sum("pos").over(down).alias("tp"), F.sum("n").over(down).alias("called"), F.sum("pos").over(W.partitionBy()).alias("total"))
    return out.select("p", "pos", "n", "tp", (F.col("called") - F.col("tp")).alias("fp"), (F.col("tp") / F.col("called")).alias("precision"), F.when(F.col("total") > 0, F.col("tp") / F.col("total")).otherwise(0.0).alias("recall"))


def pick_threshold(scored: DataFrame, beta: float = 1.0, min_precision: float | None = None) -> DataFrame:
    """One row: threshold, precision, recall, score of the best F-beta on the curve.

    The curve ends in precision 1 at recall 0 with threshold 1; points below min_precision
    don't compete, so if none with recall reaches it the threshold is 1 and the score 0.
    The lowest threshold wins ties.
    """
    end = scored.sparkSession.range(1).select(F.lit(1.0).alias("p"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    points = curve(scored).select("p", "precision", "recall").unionByName(end)
    b2 = beta * beta
    below = b2 * F.col("precision") + F.col("recall")
    points = points.withColumn("score", F.when(below > 0, (1 + b2) * F.col("precision") * F.col("recall") / below).otherwise(0.0))
    if min_precision is not None:
        points = points.where(F.col("precision") >= min_precision)
    best = F.max_by(F.struct("p", "precision", "recall", "score"), F.struct(F.round("score", 12), -F.col("p"))).alias("b")
    return points.agg(best).select(F.col("b.p").alias("threshold"), "b.precision", "b.recall", "b.score")


def average_precision(scored: DataFrame) -> DataFrame:
    """Sum over the curve of precision times the step in recall."""
    c = curve(scored)
    total = F.sum("pos")
    return c.agg(F.when(total > 0, F.sum(F.col("precision") * F.col("pos")) / total).otherwise(0.0).alias("average_precision"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Probability that a positive row scores above a negative one, ties half."""
    c = curve(scored).select("pos", (F.col("n") - F.col("pos")).alias("neg"), "fp")
    c = c.withColumn("negatives", F.sum("neg").over(W.partitionBy()))
    won = F.col("pos") * (F.col("negatives") - F.col("fp")) + F.col("pos") * F.col("neg") / 2
    pairs = F.sum("pos") * F.sum("neg")
    return c.agg(F.when(pairs > 0, F.sum(won) / pairs).alias("roc_auc"))


def brier(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))


def confusion_metrics(tp: Column, fp: Column, fn: Column) -> list[Column]:
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return [share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1")]


def metrics_by(scored: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """Support, precision, recall and F1 at a threshold, by the key columns; 0 where undefined."""
    hit = F.col("p") >= threshold
    count = lambda c: F.count_if(c)
    tp, fp, fn = count(hit & (F.col("y") == 1)), count(hit & (F.col("y") == 0)), count(~hit & (F.col("y") == 1))
    return scored.groupBy(*keys).agg(F.count("*").alias("support"), *confusion_metrics(tp, fp, fn))


def average_precision_by(scored: DataFrame, key: str) -> DataFrame:
    """key, pr_auc: average precision within each value of the key; null where all rows are of
    one class. Rows of equal score are one point, so windows run over distinct scores."""
    by = scored.groupBy(key, "p").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    down = W.partitionBy(key).orderBy(F.col("p").desc()).rowsBetween(W.unboundedPreceding, 0)
    steps = by.select(key, "pos", "n", (F.sum("pos").over(down) / F.sum("n").over(down)).alias("precision"))
    total, rows = F.sum("pos"), F.sum("n")
    return steps.groupBy(key).agg(F.when((total > 0) & (total < rows), F.sum(F.col("precision") * F.col("pos")) / total).alias("pr_auc"))


def by_answer_type(scored: DataFrame, threshold: float, key: str = "answer_type") -> DataFrame:
    """Support, precision, recall, F1 and pr_auc by answer type; blank types are unknown."""
    kind = F.coalesce(F.nullif(F.trim(key), F.lit("")), F.lit("unknown"))
    rows = scored.withColumn(key, kind)
    return metrics_by(rows, threshold, key).join(average_precision_by(rows, key), key)


def evaluated(scored: DataFrame, threshold: float) -> dict[str, float]:
    """Figures of scored rows at a threshold: one row each, gathered on the driver."""
    at = metrics_by(scored, threshold).first()
    return {
        "f1": at["f1"] if at else 0.0,
        "precision": at["precision"] if at else 0.0,
        "recall": at["recall"] if at else 0.0,
        "pr_auc": average_precision(scored).first()[0],
        "roc_auc": roc_auc(scored).first()[0],
        "brier": brier(scored).first()[0],
    }


def stratified_folds(rows: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """key, y, fold: rows of each class, in the order of a hash of key and seed, dealt in turn.

    The rank within a class is a running count over 2 ** 12 ranges of the hash first, then
    within each range, so that no task orders a whole class.
    """
    h = F.md5(F.concat_ws("/", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    rows = rows.select(key, "y", h.alias("h"), F.substring(h, 1, 3).alias("cell"))
    sizes = rows.groupBy("y", "cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("y").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sizes.select("y", "cell", before.alias("before")), ["y", "cell"])
    rank = F.col("before") + F.row_number().over(W.partitionBy("y", "cell").orderBy("h", key)) - 1
    return rows.select(key, "y", (rank % k).cast("int").alias("fold"))


def outcome(y: Column, predicted: Column) -> Column:
    return F.when((y == 1) & (predicted == 1), "TP").when((y == 0) & (predicted == 1), "FP").when((y == 1) & (predicted == 0), "FN").otherwise("TN")
