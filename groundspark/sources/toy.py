"""A few labelled traces for trying things out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PASSAGES = (
    "The reservoir holds 40 million litres and was finished in 1987.",
    "Ticket prices rose 6% to $27 in April 2022.",
    "The survey counted 312 breeding pairs on the northern island.",
    "The ferry leaves at noon and takes 45 minutes.",
    "A litre of the paint covers 12 square meters.",
    "The museum closed its east wing for repairs in March 2019.",
    "The bridge is 512 m long and carries two railway tracks.",
    "The bakery sells about 900 loaves on a Saturday.",
)
_SUPPORTED = (
    "It holds 40 million litres.", "Prices rose 6% to $27.", "The survey counted 312 breeding pairs.", "The ferry takes 45 minutes.",
    "A litre covers 12 square meters.", "The east wing closed in March 2019.", "The bridge is 512 m long.", "It sells about 900 loaves on a Saturday.",
)
_UNSUPPORTED = (
    "It was drained in 2003 after a flood.", "Prices fell 9% to $19 last year.", "Most pairs nest on the southern cliffs, 750 in all.", "The crossing needs three hours by night.",
    "Two coats of varnish last ten years.", "The director resigned over 4 million dollars.", "Lorries above 30 tons may not use it.", "Its cakes won a prize in Vienna.",
)
_QUESTIONS = (
    "How much does the reservoir hold?", "How did ticket prices change?", "How many pairs were counted?", "How long does the ferry take?",
    "How far does the paint go?", "What closed at the museum?", "How long is the bridge?", "How many loaves does the bakery sell?",
)


def toy_traces(spark: SparkSession) -> DataFrame:
    """Sixteen rows, half of them supported: trace_id, q, a, c, y."""
    rows = [(2 * i + y, _QUESTIONS[i], (_UNSUPPORTED, _SUPPORTED)[y][i], [_PASSAGES[i]], y) for i in range(8) for y in (0, 1)]
    return spark.createDataFrame(rows, "trace_id long, q string, a string, c array<string>, y int")


def smoke_train(spark: SparkSession) -> dict:
    """Fit on twelve of the toy rows and judge the other four: the model's figures and scores."""
    from groundspark.operators.classifier import GroundednessClassifier
    from groundspark.operators.evaluation import evaluated
    from groundspark.operators.report import build_report, feature_rows, varying

    rows = feature_rows(build_report(toy_traces(spark))).cache()
    names = varying(rows, [c for c in rows.columns if c not in ("trace_id", "y")])
    model = GroundednessClassifier(names, C=1.0).fit(rows.where("trace_id < 12"))
    scored = model.score(rows.where("trace_id >= 12"), "trace_id")
    out = {"test": evaluated(scored, 0.5), "scores": {r["trace_id"]: r["p"] for r in scored.collect()}}
    rows.unpersist()
    return out
