import json

import pytest
from pyspark.sql import functions as F

from groundspark import __main__ as cli
from groundspark.sources import prompts, readers, sinks, toy


def write_traces(spark, path, rows):
    path.write_text(json.dumps([r.asDict(True) | {"reason": "r"} for r in rows]))


def test_folder_of_traces(spark, tmp_path):
    rows = [r.asDict(True) for r in toy.toy_traces(spark).drop("trace_id").collect()]
    for name, part in (("b.json", rows[:3]), ("a.json", rows[3:5])):
        (tmp_path / name).write_text(json.dumps(part))
    (tmp_path / "c.csv").write_text("question,answer,chunk1,abstained,answer_type\nq,a,one,False,fact\n")
    assert [p.rsplit("/", 1)[1] for p in readers.listed(spark, str(tmp_path), "b*.json, *.json,*.csv")] == ["b.json", "a.json", "c.csv"]
    got = readers.read_folder(spark, str(tmp_path), "b*.json,*.json,*.csv").collect()
    assert sorted(r.file_no for r in got) == [0, 0, 0, 1, 1, 2]
    with pytest.raises(FileNotFoundError):
        readers.read_folder(spark, str(tmp_path), "*.txt")
    (tmp_path / "d.json").write_text('[{"q": "x", "a": "y", "y": 1}]')
    with pytest.raises(Exception, match="needs q, a, c and y"):
        readers.read_folder(spark, str(tmp_path), "*.json").collect()


def test_items_of_a_model(spark, tmp_path):
    answers = [(1, '```json [{"q": "a", "a": "b", "c": ["x", "y"], "y": 1},] ```'), (2, "sorry"), (3, '[{"q": "k", "a": "l", "c": [], "y": 2}]')]
    good, bad = readers.parsed_items(spark.createDataFrame(answers, "id long, text string"), "text")
    assert [(r.id, r.q) for r in good.orderBy("id").collect()] == [(1, "a"), (3, "k")]
    assert [(r.id, bool(r.error)) for r in bad.collect()] == [(2, True)]
    items = readers.valid_items(good)
    assert [(r.q, r.reason) for r in items.collect()] == [("a", "n/a")]
    assert sinks.training_items(items).first().c == "x\n---\ny"
    sinks.write_training_items(items, str(tmp_path / "items"))
    assert spark.read.json(str(tmp_path / "items" / "json")).first().c == ["x", "y"]
    assert spark.createDataFrame([([" a ", "b"],)], "c array<string>").select(readers.augmented_contexts(F.col("c"), "more")).first()[0] == ["a more", "b more"]


def test_prompts(spark):
    rows = [(c, f"{c} question {i}", "answer", ["ctx"], 1, "why") for c in ("dates", "sums") for i in range(3)]
    items = spark.createDataFrame(rows, "category string, q string, a string, c array<string>, y int, reason string")
    seeds = prompts.pick_seeds(items, 7)
    assert sorted(r.category for r in seeds.collect()) == ["dates", "sums"] and seeds.collect() == prompts.pick_seeds(items, 7).collect()
    text = prompts.build_prompt(seeds, 5)
    assert "Write 5 new items" in text and text.index("dates:") < text.index("sums:")


def test_conversations_keep_apart_long_ones(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "and"), (1, 3, "assistant", "no"), (0, 1000, "user", "late"), (0, 1001, "assistant", "here"), (1, 1000, "user", "late"), (1, 1001, "assistant", "there")]
    got = readers.conversation_traces(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert len({r.trace_id for r in got}) == len(got) == 4
    assert {r.trace_id: r.c for r in got}[1002] == ["yes"]


def run(spark, monkeypatch, *args):
    monkeypatch.setattr(cli, "session", lambda: spark)
    cli.main([str(a) for a in args])


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    rows = [r.asDict(True) for r in toy.toy_traces(spark).drop("trace_id").collect()]
    (tmp_path / "t.json").write_text(json.dumps(rows + rows[:1]))
    features = tmp_path / "features"
    run(spark, monkeypatch, "featurize", "--input", tmp_path / "t.json", "--output", features, "--deny", "a_len", "--csv")
    record = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert record["dropped_features"] == ["a_len"]
    table, names = sinks.read_features(spark, str(features))
    assert table.count() == 17 and len({r.trace_id for r in table.collect()}) == 17 and "a_len" not in names
    run(spark, monkeypatch, "train", "--input", features, "--test", features, "--output", tmp_path / "model", "--grid", "1", "--allow", "precision_token,recall_context,unsupported_mass")
    report = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert report["bestC"] == 1.0 and report["features"]["kept_feature_count"] <= 3 and report["test"]["roc_auc"] > 0.5
    assert readers.read_predictions(spark, str(tmp_path / "model" / "predictions")).count() == 17
    run(spark, monkeypatch, "score", "--input", features, "--model", tmp_path / "model", "--output", tmp_path / "scores")
    assert spark.read.json(str(tmp_path / "scores")).count() == 17
    run(spark, monkeypatch, "merge", "--input", f"{features},{features}", "--output", tmp_path / "merged")
    assert sinks.read_features(spark, str(tmp_path / "merged"))[0].count() == 34
    run(spark, monkeypatch, "diagnose", "--input", features, "--model", tmp_path / "model", "--output", tmp_path / "diagnosis")
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["n_rows"] == 17
    run(spark, monkeypatch, "stats", "--input", tmp_path / "t.json", "--output", tmp_path / "stats")
    run(spark, monkeypatch, "stats", "--input", features / "csv", "--from-csv", "--output", tmp_path / "stats2")
    read = lambda p: json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / p)).collect()))
    assert read("stats") == read("stats2") == {"total_examples": 17, "positives": 8, "negatives": 9}


def test_report_of_one_example(spark, tmp_path, monkeypatch):
    (tmp_path / "one.json").write_text(json.dumps({"answer": "It cost $5.", "context": ["The price was $5."], "metrics_config": {"a_len": False, "enable_inference_signal": False}}))
    run(spark, monkeypatch, "report", "--example", "--input", tmp_path / "one.json", "--output", tmp_path / "out")
    found = json.loads(spark.read.text(str(tmp_path / "out")).first()[0])
    assert found["numeric_match"] == 1.0 and "a_len" not in found and "inference_score" not in found and found["q"] == ""


def test_smoke(spark):
    out = toy.smoke_train(spark)
    assert len(out["scores"]) == 4 and out["test"]["roc_auc"] >= 0.75
