"""Sinks: feature tables, predictions, statistics and prompts' training items."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.operators.analysis import ANSWER_TYPES, coefficient_table


def write_features(rows: DataFrame, path: str, features: list[str]) -> None:
    """Parquet, and beside it the list of names as one JSON row."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(json.dumps(features),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/names")


def read_features(spark, path: str) -> tuple[DataFrame, list[str]]:
    names = json.loads(spark.read.text(f"{path}/names").first()[0])
    rows = spark.read.parquet(f"{path}/rows")
    if missing := set(names) - set(rows.columns):
        raise ValueError(f"the table lacks {sorted(missing)}")
    return rows, names


def write_features_csv(rows: DataFrame, path: str, features: list[str], meta: list[str]) -> None:
    """Features to six places, then the other columns; quotes escaped by a backslash."""
    six = [F.format_string("%.6f", F.col(f"`{f}`")).alias(f) for f in features]
    rows.select(*six, *meta).write.mode("overwrite").option("header", True).option("escape", "\\").csv(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    rows.withColumn("top_features", F.to_json("top_features")).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_scores(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_text(spark, text: str, path: str) -> None:
    """One small text, by Spark, so that any store serves."""
    spark.createDataFrame([(line,) for line in text.split("\n")], "value string").coalesce(1).write.mode("overwrite").text(path)


def stats_record(stats: DataFrame) -> dict:
    """Totals and, where any answer type is named, positives by type: a row a type comes in."""
    rows = stats.collect()
    total, positives = (sum(r[c] or 0 for r in rows) for c in ("total", "positives"))
    record = {"total_examples": total, "positives": positives, "negatives": total - positives}
    named = {r["answer_type"]: r["positives"] for r in rows if r["positives"]}
    if any(r["answer_type"] != "unknown" for r in rows) and named:
        record |= {"answer_type_positive_counts": dict(sorted(named.items())), "allowed_answer_types": sorted(ANSWER_TYPES)}
    return record


def write_stats(stats: DataFrame, path: str) -> None:
    """The record of dataset statistics as JSON, keys sorted."""
    write_text(stats.sparkSession, json.dumps(stats_record(stats), indent=2, sort_keys=True), path)


def stats_tables(stats: DataFrame, split: str = "split") -> tuple[DataFrame, DataFrame]:
    """Positives by split and answer type: wide (known types, other, unknown) and long."""
    known = [*ANSWER_TYPES, "other", "unknown"]
    kind = F.when(F.col("answer_type").isin(*known), F.col("answer_type")).otherwise("other")
    wide = stats.withColumn("answer_type", kind).groupBy(split).pivot("answer_type", known).agg(F.sum("positives")).fillna(0)
    return wide, stats.groupBy(split, "answer_type").agg(F.sum("positives").alias("positives"), F.sum("total").alias("total"))


def estimation_tables(spark, record: dict, coefficients: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """Tables of a training record: cv_folds, answer_types, and top_coefficients if given."""
    folds = record["cv"]["selected"]["fold_metrics"]
    names = ("f1", "precision", "recall", "pr_auc", "roc_auc", "brier", "threshold")
    out = {"cv_folds": spark.createDataFrame([(i, *(float(r[n]) for n in names)) for i, r in enumerate(folds, 1)], "fold int, " + ", ".join(f"{n} double" for n in names))}
    types = sorted(record.get("test", {}).get("by_answer_type", {}).items())
    out["answer_types"] = spark.createDataFrame([(t or "unknown", int(r["support"]), r["precision"], r["recall"], r["f1"], r["pr_auc"]) for t, r in types], "answer_type string, support int, precision double, recall double, f1 double, pr_auc double")
    if coefficients:
        out["top_coefficients"] = coefficient_table(spark, coefficients, 5)
    return out


def estimation_summary(record: dict) -> dict:
    """The figures of a training record without its folds."""
    cv = record["cv"]
    return {**{k: record.get(k) for k in ("bestC", "final_threshold", "n_train")}, **{f"cv_{k}": cv.get(k) for k in ("objective", "n_splits", "seed", "beta", "min_precision")}, "cv_mean_metrics": cv["selected"]["mean_metrics"], "test_metrics": record.get("test")}


def tex_macros(summary: dict, prefix: str = "Est") -> str:
    """The summary as TeX commands, floats to two places, n/a for what is missing."""

    def shown(v) -> str:
        return "n/a" if v is None or v == "" else f"{v:.2f}" if isinstance(v, float) else str(v)

    values = {"BestC": summary["bestC"], "FinalThreshold": summary["final_threshold"], "TrainSize": summary["n_train"], "CvNSplits": summary["cv_n_splits"], "CvObjective": summary["cv_objective"], "CvSeed": summary["cv_seed"], "CvBeta": summary["cv_beta"], "CvMinPrecision": summary["cv_min_precision"]}
    for part, found in (("Cv", summary["cv_mean_metrics"] or {}), ("Test", summary["test_metrics"] or {})):
        values |= {f"{part}{name}": found.get(key) for name, key in (("FOne", "f1"), ("Precision", "precision"), ("Recall", "recall"), ("Prauc", "pr_auc"), ("Rocauc", "roc_auc"), ("Brier", "brier"))}
    return "\n".join(f"\\newcommand{{\\{prefix}{name}}}{{{shown(v)}}}" for name, v in values.items())


def write_estimation(spark, record: dict, path: str, coefficients: dict[str, float] | None = None) -> None:
    """All of it below ``path``: CSV tables, the summary as JSON and as TeX commands."""
    for name, rows in estimation_tables(spark, record, coefficients).items():
        rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    write_text(spark, json.dumps(estimation_summary(record), indent=2, sort_keys=True), f"{path}/summary")
    write_text(spark, tex_macros(estimation_summary(record)), f"{path}/macros")


def write_training_items(rows: DataFrame, path: str) -> None:
    """Items as JSON rows, and as CSV with their contexts joined."""
    rows.write.mode("overwrite").json(f"{path}/json")
    training_items(rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/csv")


def training_items(rows: DataFrame) -> DataFrame:
    """Items with their contexts joined as one text."""
    return rows.withColumn("c", F.array_join("c", "\n---\n"))
