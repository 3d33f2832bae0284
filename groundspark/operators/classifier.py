"""The groundedness classifier: logistic regression over feature rows, with its threshold."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.operators import analysis, evaluation


@dataclass
class GroundednessClassifier:
    """C follows the convention C * sum of losses + half the squared weights.

    Features are scaled by mean and population deviation, classes weighted to balance, so
    the strength of the penalty a row is 1 / (C * n). ``gate``: a row whose
    unsupported_numeric_rate is above 0 scores at most 0.20.
    """

    features: list[str]
    C: float = 1.0
    penalty: str = "l2"
    gate: bool = False
    threshold: float = 0.5
    means: list[float] = field(default_factory=list)
    deviations: list[float] = field(default_factory=list)
    model: LogisticRegressionModel | None = None

    def _vectors(self, rows: DataFrame, *keep: str) -> DataFrame:
        scaled = [((F.col(f"`{f}`") - m) / (d if d > 0 else 1.0)).alias(f"f{i}") for i, (f, m, d) in enumerate(zip(self.features, self.means, self.deviations))]
        flat = rows.select(*keep, *scaled)
        return VectorAssembler(inputCols=[f"f{i}" for i in range(len(self.features))], outputCol="features").transform(flat).select(*keep, "features")

    def fit(self, rows: DataFrame) -> GroundednessClassifier:
        rows = analysis.reprojected(rows, self.features, ["y"])
        stats = rows.agg(F.count("*"), F.sum("y"), *[f(F.col(f"`{c}`")) for c in self.features for f in (F.avg, F.stddev_pop)]).first()
        n, pos = stats[0], stats[1] or 0
        if not 0 < pos < n:
            raise ValueError("both classes are needed")
        self.means, self.deviations = list(stats[2::2]), list(stats[3::2])
        weight = F.when(F.col("y") == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos)))
        train = self._vectors(rows.withColumn("w", weight), "y", "w").withColumn("label", F.col("y").cast("double"))
        none = self.penalty == "none"
        self.model = LogisticRegression(weightCol="w", standardization=False, maxIter=200, tol=1e-9, regParam=0.0 if none else 1.0 / (self.C * n), elasticNetParam=1.0 if self.penalty == "l1" else 0.0).fit(train)
        return self

    def score(self, rows: DataFrame, *keep: str) -> DataFrame:
        """The kept columns, p and predicted (p at or above the threshold)."""
        aligned = analysis.reprojected(rows, self.features, list(keep) + (["y"] if "y" in rows.columns and "y" not in keep else []))
        if self.gate:
            aligned = aligned.withColumn("_gate", F.col("unsupported_numeric_rate") > 0 if "unsupported_numeric_rate" in aligned.columns else F.lit(False))
        extra = [*keep, *(["y"] if "y" in aligned.columns and "y" not in keep else []), *(["_gate"] if self.gate else [])]
        out = self.model.transform(self._vectors(aligned, *extra)).withColumn("p", vector_to_array("probability")[1])
        if self.gate:
            out = out.withColumn("p", F.when(F.col("_gate"), F.least("p", F.lit(0.20))).otherwise(F.col("p"))).drop("_gate")
        return out.select(*[c for c in extra if c != "_gate"], "p", (F.col("p") >= self.threshold).cast("int").alias("predicted"))

    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.features, map(float, self.model.coefficients)))

    def save(self, path: str) -> None:
        """The model by Spark's writer, the rest as one JSON row beside it."""
        self.model.write().overwrite().save(f"{path}/model")
        meta = {"features": self.features, "C": self.C, "penalty": self.penalty, "gate": self.gate, "threshold": self.threshold, "means": self.means, "deviations": self.deviations, "fingerprint": analysis.fingerprint(self.features)}
        spark = self.model._java_obj and __import__("pyspark").sql.SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> GroundednessClassifier:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        if meta.pop("fingerprint") != analysis.fingerprint(meta["features"]):
            raise ValueError("the feature list does not match its fingerprint")
        return cls(**meta, model=LogisticRegressionModel.load(f"{path}/model"))


METRICS = ("f1", "precision", "recall", "pr_auc", "roc_auc", "brier")


def folded(rows: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Rows with their fold, persisted: every fit and score of a fold passes over them, where each
    would work out the rows and the folds anew. Who asked for them lets them go."""
    return rows.join(evaluation.stratified_folds(rows, key, k, seed).select(key, "fold"), key).persist()


def cross_validate(rows: DataFrame, key: str, features: list[str], grid=(0.1, 0.3, 1.0, 3.0, 10.0), k: int = 5, seed: int = 42, min_precision: float | None = None, beta: float = 1.0) -> tuple[float, float, list[dict]]:
    """Best C by mean F1 (the first on ties), its mean threshold, and a record of every fold."""
    folds = folded(rows, key, k, seed)
    records = []
    try:
        for C in grid:
            for fold in range(k):
                model = GroundednessClassifier(features, C).fit(folds.where(F.col("fold") != fold))
                scored = model.score(folds.where(F.col("fold") == fold), key)
                best = evaluation.pick_threshold(scored, beta, min_precision).first()
                records.append({"C": C, "fold": fold, "threshold": best["threshold"], **evaluation.evaluated(scored, best["threshold"])})
    finally:
        folds.unpersist()
    mean = lambda C, m: sum(r[m] for r in records if r["C"] == C) / k
    best = max(grid, key=lambda C: (mean(C, "f1"), -grid.index(C)))
    return best, mean(best, "threshold"), records


def mean_metrics(records: list[dict], C: float) -> dict[str, float]:
    own = [r for r in records if r["C"] == C]
    return {m: sum(r[m] for r in own) / len(own) for m in METRICS}


def final_fit(train: DataFrame, key: str, features: list[str], test: DataFrame | None = None, gate: bool = False, **options) -> tuple[GroundednessClassifier, dict]:
    """The model of the best C on all training rows, with the mean threshold of its folds, and
    the whole record: folds, and of ``test`` its figures, by answer type where it has them."""
    C, threshold, records = cross_validate(train, key, features, **options)
    model = GroundednessClassifier(features, C, gate=gate, threshold=threshold).fit(train)
    record = {
        "bestC": C,
        "final_threshold": threshold,
        "n_train": train.count(),
        "feature_fingerprint": analysis.fingerprint(features),
        "cv": {"n_splits": options.get("k", 5), "seed": options.get("seed", 42), "objective": "f1", "beta": options.get("beta", 1.0), "min_precision": options.get("min_precision"), "selected": {"fold_metrics": [r for r in records if r["C"] == C], "mean_metrics": mean_metrics(records, C)}, "folds": records},
    }
    if test is not None:
        keep = [key, *(["answer_type"] if "answer_type" in test.columns else [])]
        scored = model.score(test, *keep)
        record["test"] = evaluation.evaluated(scored, threshold)
        if "answer_type" in keep:
            record["test"]["by_answer_type"] = {r["answer_type"]: r.asDict() for r in evaluation.by_answer_type(scored, threshold).collect()}
    return model, record


def predictions(model: GroundednessClassifier, rows: DataFrame, key: str, *keep: str, k: int = 10) -> DataFrame:
    """Kept columns, y_true, y_pred, probability and the k largest contributions of each row.

    A contribution is a coefficient times the scaled value; the value itself is as given.
    """
    aligned = analysis.reprojected(rows, model.features, [key, "y", *keep])
    scaled = {f: (F.col(f"`{f}`") - m) / (d if d > 0 else 1.0) for f, m, d in zip(model.features, model.means, model.deviations)}
    own = model.coefficients()
    each = F.array(*[F.struct((-F.abs(x * own[f])).alias("k"), F.lit(f).alias("feature"), F.col(f"`{f}`").alias("value"), F.lit(own[f]).alias("coefficient"), (x * own[f]).alias("contribution")) for f, x in scaled.items()])
    top = F.transform(F.slice(F.sort_array(each), 1, k), lambda x: F.struct(*[x[c].alias(c) for c in ("feature", "value", "coefficient", "contribution")]))
    scored = model.score(rows, key).select(key, F.col("p").alias("probability"), F.col("predicted").alias("y_pred"))
    return aligned.select(key, *keep, F.col("y").alias("y_true"), top.alias("top_features")).join(scored, key)
