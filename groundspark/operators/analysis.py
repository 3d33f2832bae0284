"""Analyses of feature tables and predictions: statistics, correlations, impact of features."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ZERO_VARIANCE = 1e-12
#: Answer types kept by name in dataset statistics and in prediction analyses.
ANSWER_TYPES = ("list", "fact", "abstain", "numeric", "inference", "comparison")


def dataset_stats(rows: DataFrame) -> DataFrame:
    """answer_type, total, positives; types not on the list are other, empty ones unknown."""
    t = F.lower(F.trim(F.coalesce("answer_type", F.lit(""))))
    kind = F.when(t == "", "unknown").when(t.isin(*ANSWER_TYPES), t).otherwise("other")
    return rows.groupBy(kind.alias("answer_type")).agg(F.count("*").alias("total"), F.sum(F.coalesce("y", F.lit(0))).cast("long").alias("positives"))


def long_form(rows: DataFrame, features: list[str], *keys: str) -> DataFrame:
    return rows.unpivot(list(keys), [F.col(f"`{f}`").cast("double").alias(f) for f in features], "feature", "value")


def spread(rows: DataFrame, features: list[str]) -> DataFrame:
    """feature, var_pop, constant: one aggregate over all features, then turned."""
    one = rows.agg(*[F.struct(F.var_pop(f"`{f}`").alias("v"), (F.max(f"`{f}`") - F.min(f"`{f}`")).alias("w")).alias(f"f{i}") for i, f in enumerate(features)])
    table = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"f{i}.v").alias("var_pop"), (F.col(f"f{i}.w") <= ZERO_VARIANCE).alias("constant")) for i, f in enumerate(features)])
    return one.select(F.inline(table))


def pearson(a: str, b: str):
    """Pearson correlation of two columns; 0 where either does not vary."""
    x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def feature_correlations(rows: DataFrame, features: list[str], y: str = "y") -> DataFrame:
    """feature, r with y; 0 for a constant feature."""
    one = rows.agg(*[pearson(f, y).alias(f"f{i}") for i, f in enumerate(features)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"f{i}").alias("r")) for i, f in enumerate(features)])))


#: Features beyond which pairs are not made by default: 20,000 pairs.
MOST_FEATURES = 200


def correlated_pairs(rows: DataFrame, features: list[str], least: float = 0.9, most_features: int = MOST_FEATURES) -> DataFrame:
    """Pairs of features with |r| of ``least`` or more, by one pass over a matrix of sums.

    More than ``most_features`` features are refused: pairs grow with their square.
    """
    if len(features) > most_features:
        raise ValueError(f"{len(features)} features make too many pairs; raise most_features above {most_features}")
    if len(features) < 2:
        return rows.sparkSession.createDataFrame([], "feature_a string, feature_b string, r double")
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    flat = rows.select(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)).alias(f"f{i}") for i, f in enumerate(features)])
    vectors = VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="v").transform(flat).select("v")
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    pairs = [(a, b, float(matrix[i, j])) for i, a in enumerate(features) for j, b in enumerate(features) if i < j and abs(matrix[i, j]) >= least]
    return rows.sparkSession.createDataFrame(pairs, "feature_a string, feature_b string, r double")


def coefficient_table(spark, coefficients: dict[str, float], k: int = 15) -> DataFrame:
    """direction, rank, feature, coefficient: the k largest and the k smallest, ties by name."""
    up = sorted(coefficients.items(), key=lambda c: (-c[1], c[0]))[:k]
    down = sorted(coefficients.items(), key=lambda c: (c[1], c[0]))[:k]
    rows = [(d, i, f, float(c)) for d, part in (("positive", up), ("negative", down)) for i, (f, c) in enumerate(part, 1)]
    return spark.createDataFrame(rows, "direction string, rank int, feature string, coefficient double")


def feature_report(rows: DataFrame, features: list[str], coefficients: dict[str, float] | None = None, top: int = 20, least: float = 0.9) -> dict:
    """Diagnosis of a feature table: constant features, the strongest correlations with y, pairs
    that go together, and the outer coefficients. Lists hold ``top`` entries at most."""
    with_y = feature_correlations(rows, features).orderBy(F.abs("r").desc(), "feature").limit(top).collect() if "y" in rows.columns else []
    pairs = correlated_pairs(rows, features, least).orderBy(F.abs("r").desc(), "feature_a", "feature_b").limit(top).collect()
    out = {
        "n_rows": rows.count(),
        "n_features": len(features),
        "zero_variance_features": [r["feature"] for r in spread(rows, features).collect() if r["constant"]],
        "top_corr_with_y": [(r["feature"], r["r"]) for r in with_y],
        "high_correlation_pairs": [tuple(r) for r in pairs],
    }
    if coefficients:
        table = coefficient_table(rows.sparkSession, coefficients).collect()
        for d in ("positive", "negative"):
            out[f"top_{d}_coefficients"] = [(r["feature"], r["coefficient"]) for r in table if r["direction"] == d]
    return out


def outcome_counts(predictions: DataFrame) -> DataFrame:
    """outcome, answer_type, n; types not on the list count as other."""
    kind = F.when(F.col("answer_type").isin(*ANSWER_TYPES), F.col("answer_type")).otherwise("other")
    return predictions.groupBy("outcome", kind.alias("answer_type")).agg(F.count("*").alias("n"))


def contributions(predictions: DataFrame) -> DataFrame:
    """outcome, feature, contribution of every listed feature."""
    return predictions.select("outcome", F.inline("top_features")).select("outcome", "feature", "contribution")


def contribution_stats(predictions: DataFrame, by: str = "feature") -> DataFrame:
    """Of all outcomes but TN: counts and sums of contributions of either sign.

    by "prefix" adds up features under their first dotted part.
    """
    rows = contributions(predictions.where("outcome <> 'TN'"))
    name = F.substring_index("feature", ".", 1) if by == "prefix" else F.col("feature")
    plus = F.col("contribution") >= 0
    return rows.groupBy(name.alias(by)).agg(
        F.count_if(plus).alias("positive"),
        F.coalesce(F.sum(F.when(plus, F.col("contribution"))), F.lit(0.0)).alias("positive_sum"),
        F.count_if(~plus).alias("negative"),
        F.coalesce(F.sum(F.when(~plus, F.col("contribution"))), F.lit(0.0)).alias("negative_sum"),
        F.round(F.avg("contribution"), 6).alias("average"),
    )


def impact_matrix(predictions: DataFrame) -> DataFrame:
    """feature, mean contribution in TP and in FN, both over the largest mean, score, rank.

    The score is the difference of the two; features of one outcome only count 0 in the other.
    """
    mean = lambda o: contributions(predictions.where(F.col("outcome") == o)).groupBy("feature").agg(F.avg("contribution").alias(f"avg_{o.lower()}"))
    rows = mean("TP").join(mean("FN"), "feature", "full_outer").fillna(0.0)
    top = F.max(F.greatest(F.abs("avg_tp"), F.abs("avg_fn"))).over(W.partitionBy())
    scale = F.when(top > 0, top).otherwise(1.0)
    rows = rows.select("feature", "avg_tp", "avg_fn", (F.col("avg_tp") / scale).alias("norm_tp"), (F.col("avg_fn") / scale).alias("norm_fn"))
    rows = rows.withColumn("score", F.round(F.col("norm_tp") - F.col("norm_fn"), 10))
    return rows.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "feature")))


def top_contributions(rows: DataFrame, features: list[str], coefficients: dict[str, float], k: int = 10) -> DataFrame:
    """All columns of ``rows`` and top_features: the k largest |value * coefficient|, ties by name."""
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("value"), F.lit(float(coefficients[f])).alias("coefficient"), (F.col(f"`{f}`").cast("double") * float(coefficients[f])).alias("contribution")) for f in features])
    keyed = F.transform(each, lambda x: F.struct((-F.abs(x["contribution"])).alias("k"), x["feature"].alias("n"), x.alias("x")))
    return rows.withColumn("top_features", F.transform(F.slice(F.sort_array(keyed), 1, k), lambda s: s["x"]))


def fingerprint(names: list[str]) -> str:
    """SHA-256 of a feature list, in order."""
    return hashlib.sha256("|".join(names).encode()).hexdigest()


def reprojected(rows: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """Features by name in the given order: absent ones 0, nulls 0, further ones dropped."""
    have = set(rows.columns)
    return rows.select(*keep, *[F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)).alias(n) if n in have else F.lit(0.0).alias(n) for n in names])


def merged_features(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables with the columns that all have, in the first one's order."""
    common = [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])]
    return reduce(DataFrame.unionByName, [t.select(*[f"`{c}`" for c in common]) for t in tables])


def kept_features(names: list[str], allow=(), allow_patterns=(), deny=(), deny_patterns=()) -> list[str]:
    """Feature selection at plan time: allowed names and patterns, less the denied ones."""
    import re

    out = [n for n in names if n in allow or any(re.search(p, n) for p in allow_patterns)] if allow or allow_patterns else list(names)
    return [n for n in out if n not in deny and not any(re.search(p, n) for p in deny_patterns)]


def filtered_features(names: list[str], allow=(), deny=()) -> tuple[list[str], dict]:
    """Names that allow and deny lists leave, and a record of what they did; none left is an error."""
    allow, deny = (list(dict.fromkeys(filter(None, x))) for x in (allow, deny))
    kept = [n for n in names if (not allow or n in allow) and n not in deny]
    if not kept:
        raise ValueError("the allow and deny lists leave no feature")
    record = {"allow": allow, "deny": deny, "original_feature_count": len(names), "kept_feature_count": len(kept), "dropped_feature_count": len(names) - len(kept), "dropped_features": [n for n in names if n not in set(kept)]}
    for side, given in (("allow", allow), ("deny", deny)):
        if missing := sorted(set(given) - set(names)):
            record[f"missing_from_{side}"] = missing
    return kept, record
