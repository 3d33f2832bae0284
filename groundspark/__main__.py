"""Command line: featurize, train, score, report, stats, merge, diagnose, smoke."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from groundspark.functions.entities import ExtractorConfig
from groundspark.operators import analysis, classifier
from groundspark.operators.classifier import GroundednessClassifier
from groundspark.operators.report import ReportConfig, build_report, feature_names, feature_rows, usable, varying
from groundspark.session import session
from groundspark.sources import readers, sinks, toy

#: A single example: question and metrics_config may be absent.
EXAMPLE = "question string, answer string, context array<string>, metrics_config map<string,boolean>"


def traces_of(spark, path: str, pattern: str | None = None):
    """Traces with a trace_id that depends on their content alone, so that it is the same
    however often a plan reads them; equal rows are numbered."""
    if pattern:
        rows = readers.read_folder(spark, path, pattern)
    else:
        rows = readers.read_csv_traces(spark, path) if path.endswith(".csv") else readers.read_json_traces(spark, path)
    content = F.xxhash64("q", "a", F.to_json("c"), "y")
    turn = F.row_number().over(W.partitionBy("h").orderBy("q"))
    return rows.withColumn("h", content).withColumn("trace_id", F.xxhash64("h", turn)).drop("h")


def config_of(args, off: tuple[str, ...] = ()) -> ReportConfig:
    """The report that the arguments ask for; off: metrics that are switched off."""
    return ReportConfig(ExtractorConfig(types=tuple(args.types.split(",")), compat=args.compat), entities=not args.no_entities, inference="enable_inference_signal" not in off, drop=off, bm25=not args.no_bm25)


def names_of(text: str) -> tuple[str, ...]:
    return tuple(filter(None, text.split(",")))


def featurize(spark, args) -> None:
    good, bad = usable(traces_of(spark, args.input, args.pattern))
    rows = feature_rows(build_report(good, config_of(args)), ("trace_id", "y", "q", "a", "answer_type"))
    names = feature_names(names_of(args.allow))
    names, record = analysis.filtered_features(varying(rows, names), deny=names_of(args.deny))
    meta = [c for c in ("trace_id", "y", "q", "a", "answer_type") if c in rows.columns]
    rows = rows.select(*meta, *[f"`{n}`" for n in names])
    sinks.write_features(rows, args.output, names)
    bad.write.mode("overwrite").json(f"{args.output}/skipped")
    if args.csv:
        sinks.write_features_csv(rows, f"{args.output}/csv", names, meta)
    print(json.dumps(record))


def train(spark, args) -> None:
    rows, names = sinks.read_features(spark, args.input)
    names, record = analysis.filtered_features(names, names_of(args.allow), names_of(args.deny))
    test = sinks.read_features(spark, args.test)[0] if args.test else None
    grid = tuple(map(float, names_of(args.grid)))
    model, report = classifier.final_fit(rows, "trace_id", names, test, args.gate, grid=grid, min_precision=args.min_precision)
    model.save(args.output)
    report |= {"features": record, "coefficients": model.coefficients()}
    sinks.write_text(spark, json.dumps(report), f"{args.output}/report")
    sinks.write_estimation(spark, report, f"{args.output}/estimation", model.coefficients())
    if test is not None:
        keep = [c for c in ("q", "a", "answer_type") if c in test.columns]
        sinks.write_predictions(classifier.predictions(model, test, "trace_id", *keep), f"{args.output}/predictions")
    print(json.dumps(report))


def score(spark, args) -> None:
    rows, _ = sinks.read_features(spark, args.input)
    sinks.write_scores(GroundednessClassifier.load(spark, args.model).score(rows, "trace_id"), args.output)


def report(spark, args) -> None:
    """Reports of a file of traces, or of one example with its own switches."""
    example = spark.read.schema(EXAMPLE).option("multiLine", True).json(args.input) if args.example else None
    if example is None:
        build_report(traces_of(spark, args.input, args.pattern), config_of(args)).write.mode("overwrite").json(args.output)
        return
    row = example.first()
    off = tuple(k for k, v in (row["metrics_config"] or {}).items() if not v)
    one = spark.createDataFrame([(1, row["question"] or "", row["answer"], row["context"])], "trace_id long, q string, a string, c array<string>")
    build_report(one, config_of(args, off)).write.mode("overwrite").json(args.output)


def stats(spark, args) -> None:
    if args.from_csv:
        rows = readers.read_stats_rows(spark, args.input)
    else:
        rows = traces_of(spark, args.input, args.pattern)
        rows = rows if "answer_type" in rows.columns else rows.withColumn("answer_type", F.lit(None).cast("string"))
    sinks.write_stats(analysis.dataset_stats(rows), args.output)


def merge(spark, args) -> None:
    merged = analysis.merged_features([sinks.read_features(spark, p)[0] for p in args.input.split(",")])
    meta = [c for c in merged.columns if c in ("trace_id", "y", "q", "a", "answer_type")]
    names = [c for c in merged.columns if c not in meta]
    sinks.write_features(merged, args.output, names)
    if args.csv:
        sinks.write_features_csv(merged, f"{args.output}/csv", names, ["y"])


def diagnose(spark, args) -> None:
    rows, names = sinks.read_features(spark, args.input)
    coefficients = GroundednessClassifier.load(spark, args.model).coefficients() if args.model else None
    found = json.dumps(analysis.feature_report(rows, names, coefficients))
    sinks.write_text(spark, found, args.output)
    print(found)


def smoke(spark, args) -> None:
    print(json.dumps(toy.smoke_train(spark)))


COMMANDS = {f.__name__: f for f in (featurize, train, score, report, stats, merge, diagnose, smoke)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="groundspark")
    p.add_argument("command", choices=list(COMMANDS))
    p.add_argument("--input", default="")
    p.add_argument("--output", default="")
    p.add_argument("--pattern", help="comma-separated globs: input is a folder")
    p.add_argument("--model")
    p.add_argument("--test")
    p.add_argument("--grid", default="0.1,0.3,1,3,10")
    p.add_argument("--types", default=",".join(ExtractorConfig().types))
    p.add_argument("--allow", default="")
    p.add_argument("--deny", default="")
    p.add_argument("--min-precision", type=float)
    for switch in ("compat", "no-entities", "no-bm25", "gate", "csv", "example", "from-csv"):
        p.add_argument(f"--{switch}", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    COMMANDS[args.command](session(), args)


if __name__ == "__main__":
    main()
