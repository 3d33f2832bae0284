import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from groundspark.operators import analysis as A
from groundspark.operators import evaluation as V
from groundspark.operators.classifier import GroundednessClassifier


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        y = int(rng.random() < 0.4)
        rows.append((i, y, round(min(1.0, max(0.0, rng.gauss(0.6 if y else 0.4, 0.2))), 2)))
    return rows, spark.createDataFrame(rows, "id long, y int, p double")


def test_curve_figures(scored):
    rows, df = scored
    pos = [p for _, y, p in rows if y]
    neg = [p for _, y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(V.roc_auc(df).first()[0] - auc) < 1e-9
    ap, last, best = 0.0, 0.0, (0.0, 1.0)
    for t in sorted({p for _, _, p in rows}, reverse=True):
        tp, n = sum(p >= t for p in pos), sum(p >= t for _, _, p in rows)
        precision, recall = tp / n, tp / len(pos)
        ap += (recall - last) * precision
        last = recall
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        best = max(best, (round(f1, 12), -t))
    assert abs(V.average_precision(df).first()[0] - ap) < 1e-9
    got = V.pick_threshold(df).first()
    assert abs(got.score - best[0]) < 1e-9 and got.threshold == -best[1]
    assert abs(V.brier(df).first()[0] - sum((p - y) ** 2 for _, y, p in rows) / len(rows)) < 1e-9


def test_unreachable_precision_gives_threshold_one(spark):
    df = spark.createDataFrame([(0, 0.9), (1, 0.5), (0, 0.4)], "y int, p double")
    got = V.pick_threshold(df, min_precision=0.9).first()
    assert (got.threshold, got.score) == (1.0, 0.0)


def test_folds(scored):
    rows, df = scored
    got = {r.id: r.fold for r in V.stratified_folds(df, "id").collect()}
    for y in (0, 1):
        order = sorted((i for i, v, _ in rows if v == y), key=lambda i: (hashlib.md5(f"{i}/42".encode()).hexdigest(), i))
        assert [got[i] for i in order] == [k % 5 for k in range(len(order))]


def test_feature_tables(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 5.0, 1), (2, 2.0, 4.0, 5.0, 0), (3, 3.0, 6.5, 5.0, 1)], "id long, a double, `b.x` double, c double, y int")
    spread = {r.feature: r.constant for r in A.spread(df, ["a", "b.x", "c"]).collect()}
    assert spread == {"a": False, "b.x": False, "c": True}
    assert {r.feature: round(r.r, 6) for r in A.feature_correlations(df, ["a", "c"]).collect()} == {"a": 0.0, "c": 0.0}
    assert [(r.feature_a, r.feature_b) for r in A.correlated_pairs(df, ["a", "b.x", "c"]).collect()] == [("a", "b.x")]
    assert A.reprojected(df, ["c", "zz", "a"], ["id"]).first()[1:] == (5.0, 0.0, 1.0)
    assert A.kept_features(["a", "ab", "b"], allow_patterns=["^a"], deny=["ab"]) == ["a"]
    assert A.merged_features([df, df.drop("c")]).columns == ["id", "a", "b.x", "y"]
    top = A.top_contributions(df, ["a", "b.x", "c"], {"a": 1, "b.x": -3, "c": 0.1}, 2).first().top_features
    assert [t.feature for t in top] == ["b.x", "a"]


def test_classifier(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, x := rng.gauss(0, 1), rng.gauss(0, 1), float(i % 2), int(x + rng.gauss(0, 0.3) > 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, z double, unsupported_numeric_rate double, y int")
    model = GroundednessClassifier(["x", "z", "unsupported_numeric_rate"], C=3.0, gate=True).fit(df)
    scored = model.score(df, "id").collect()
    assert all(r.p <= 0.20 for r in scored if r.id % 2)
    assert sum(r.predicted == r.y for r in scored if r.id % 2 == 0) > 90
    model.save(str(tmp_path / "m"))
    again = GroundednessClassifier.load(spark, str(tmp_path / "m"))
    assert [round(r.p, 9) for r in again.score(df, "id").collect()] == [round(r.p, 9) for r in scored]


def test_classifier_scores_every_labelled_row_out_of_its_fold(spark, tmp_path):
    from groundspark.plans.queries import QUERIES

    rng = random.Random(3)
    docs = [(i, rng.choice(["en", "fr", "deu"]), rng.randrange(20, 900)) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(n > 400), 0) for i, _, n in docs if i < 50], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["classifier_scores"](spark, str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == list(range(50))


def table(spark, n=120, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = rng.gauss(0, 1)
        rows.append((i, x, rng.gauss(0, 1), 1.0, int(x + rng.gauss(0, 0.5) > 0), rng.choice(["fact", "list", " ", None]), f"q{i}", f"a{i}"))
    return spark.createDataFrame(rows, "trace_id long, x double, z double, k double, y int, answer_type string, q string, a string")


def test_final_fit_and_its_tables(spark, tmp_path):
    from groundspark.operators.classifier import final_fit, predictions
    from groundspark.sources import readers, sinks

    df = table(spark)
    model, record = final_fit(df.where("trace_id < 90"), "trace_id", ["x", "z"], df.where("trace_id >= 90"), grid=(0.1, 1.0), k=3)
    assert record["n_train"] == 90 and len(record["cv"]["folds"]) == 6 and record["bestC"] in (0.1, 1.0)
    best = [r for r in record["cv"]["folds"] if r["C"] == record["bestC"]]
    assert record["final_threshold"] == pytest.approx(sum(r["threshold"] for r in best) / 3) and record["cv"]["selected"]["fold_metrics"] == best
    assert set(record["test"]["by_answer_type"]) == {"fact", "list", "unknown"} and record["test"]["roc_auc"] > 0.7
    found = predictions(model, df.where("trace_id >= 90"), "trace_id", "q", "a", "answer_type", k=1)
    for r in found.collect():
        top = r.top_features[0]
        assert r.y_pred == int(r.probability >= model.threshold) and top.coefficient == model.coefficients()[top.feature]
    sinks.write_predictions(found, f"{tmp_path}/p")
    back = readers.read_predictions(spark, f"{tmp_path}/p").collect()
    assert len(back) == 30 and all(len(r.top_features) == 1 for r in back) and "unknown" in {r.answer_type for r in back}
    sinks.write_estimation(spark, record, f"{tmp_path}/e", model.coefficients())
    folds = spark.read.option("header", True).csv(f"{tmp_path}/e/cv_folds").collect()
    assert [r.fold for r in folds] == ["1", "2", "3"]
    macros = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/e/macros").collect())
    assert f"\\newcommand{{\\EstTrainSize}}{{90}}" in macros and "\\newcommand{\\EstCvMinPrecision}{n/a}" in macros


def test_by_answer_type(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.8), ("a", 1, 0.7), ("b", 1, 0.6), ("", 0, 0.1)], "answer_type string, y int, p double")
    got = {r.answer_type: r for r in V.by_answer_type(df, 0.5).collect()}
    assert got["a"].pr_auc == pytest.approx((1 + 2 / 3) / 2) and got["b"].pr_auc is None and got["unknown"].support == 1


def test_feature_report_and_filters(spark):
    df = table(spark, 60).withColumn("x2", F.col("x") * 2)
    report = A.feature_report(df, ["x", "z", "k", "x2"], {"x": 2.0, "z": -1.0, "k": 0.5, "x2": 0.0})
    assert report["zero_variance_features"] == ["k"] and [p[:2] for p in report["high_correlation_pairs"]] == [("x", "x2")]
    assert report["top_corr_with_y"][0][0] in ("x", "x2") and report["top_positive_coefficients"][0] == ("x", 2.0) and report["top_negative_coefficients"][0] == ("z", -1.0)
    with pytest.raises(ValueError):
        A.correlated_pairs(df, ["x", "z"], most_features=1)
    kept, record = A.filtered_features(["a", "b", "c"], ["a", "b", "a", "zz"], ["b", "yy"])
    assert kept == ["a"] and record["missing_from_allow"] == ["zz"] and record["missing_from_deny"] == ["yy"] and record["dropped_features"] == ["b", "c"]
    with pytest.raises(ValueError):
        A.filtered_features(["a"], deny=["a"])


def test_feature_sinks(spark, tmp_path):
    from groundspark.sources import readers, sinks

    df = table(spark, 20).withColumn("q", F.concat(F.lit('say "hi", '), "q"))
    sinks.write_features(df, f"{tmp_path}/f", ["x", "z"])
    back, names = sinks.read_features(spark, f"{tmp_path}/f")
    assert names == ["x", "z"] and back.count() == 20
    sinks.write_features_csv(df, f"{tmp_path}/c", ["x"], ["y", "q", "answer_type"])
    rows = readers.read_test_rows(spark, f"{tmp_path}/c").collect()
    assert sorted(r.q for r in rows) == sorted(r.q for r in df.collect()) and all(len(r.x.split(".")[1]) == 6 for r in rows)
    stats = A.dataset_stats(readers.read_stats_rows(spark, f"{tmp_path}/c"))
    record = sinks.stats_record(stats)
    assert record["total_examples"] == 20 and record["positives"] == df.where("y = 1").count() and set(record["answer_type_positive_counts"]) <= {"fact", "list", "unknown"}
    sinks.write_stats(stats, f"{tmp_path}/s")
    assert json.loads("\n".join(r.value for r in spark.read.text(f"{tmp_path}/s").collect())) == record
    wide, long = sinks.stats_tables(stats.withColumn("split", F.lit("train")))
    assert wide.first().split == "train" and "other" in wide.columns and long.count() == stats.count()
    bad = f"{tmp_path}/bad.csv"
    open(bad, "w").write("y,answer_type\n1,fact\nmaybe,fact\n")
    with pytest.raises(Exception, match="not a label: maybe"):
        readers.read_stats_rows(spark, bad).collect()


def test_folds_are_worked_out_once(spark):
    from groundspark.operators.classifier import cross_validate, folded

    rows = spark.range(60).selectExpr("id", "double(id % 7) as x", "int(id % 2) as y")
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    counted = rows.mapInArrow(seen, rows.schema)
    own = folded(counted, "id", k=3)
    try:
        assert "InMemoryRelation" in own._jdf.queryExecution().withCachedData().toString()
        for fold in range(3):
            model = GroundednessClassifier(["x"]).fit(own.where(f"fold != {fold}"))
            assert model.score(own.where(f"fold = {fold}"), "id").count() == 20
        # the rows, and once more for the folds' ranks and sizes
        assert calls.value <= 3 * 60
    finally:
        own.unpersist()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    cross_validate(rows, "id", ["x"], grid=(1.0,), k=3)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
