"""Quality rules: a table of thresholds compiled into one projection of SQL functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document fails if the measure lies outside [low, high]; None leaves a side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Function words of the languages that a corpus may hold (fixed values).
STOP_WORDS = (
    "the of and to in a is that it for on with as was be by this are at from or an "
    "der die das und in zu den mit von ist ein eine nicht auf des im für dem "
    "le la les de des et un une du en que qui pour dans est sur par au "
    "el los las y del un una que por con para es se su al"
).split()

#: The rules of a production run. Ratios are a word unless named otherwise.
RULES = (
    Rule("mean_word_chars", low=1.5, high=25.0),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_word_ratio", low=0.005),
    Rule("dup_line_ratio", high=0.5),
    Rule("repeat_word_ratio", high=0.3),
)


def verdict(rules) -> str:
    """One boolean SQL expression over the measures: true if every rule holds."""
    tests = [f"{r.measure} {op} {bound:g}D" for r in rules for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
    return " and ".join(f"({t})" for t in tests) or "true"


def quality_rules(docs: DataFrame, rules=RULES, stop_words=STOP_WORDS, min_words: int = 20) -> DataFrame:
    """Measure every whole text and judge it.

    docs: doc_id, text; other columns are not read. Returns doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the ratios of the rules.
    A null text counts as empty: no words, base_failed, not kept. Ratios of a text without
    words are 0. Repeated rows are judged alike; an empty table gives an empty table.
    A repeated word window is found by its 64-bit hash within its own text.
    """
    out = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    pattern = F.lit(WORD_PATTERN)
    out = out.withColumn("w", F.regexp_extract_all("t", pattern, F.lit(0)))
    out = out.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    last = F.size("h") - F.lit(WINDOW)
    out = out.withColumn(
        "g",
        F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice("h", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")),
    )
    # sorted (hash, place) pairs of a text that repeats any window at all
    out = out.withColumn(
        "s",
        F.when(
            F.size(F.array_distinct("g")) < F.size("g"),
            F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<x:bigint,i:int>>")),
    )
    same = lambda k: F.get("s", k)["x"]
    out = out.withColumn(
        "p",
        F.sort_array(
            F.transform(
                F.filter("s", lambda x, k: x["x"].eqNullSafe(same(k - 1)) | x["x"].eqNullSafe(same(k + 1))),
                lambda x: x["i"],
            )
        ),
    )
    # words under windows that start at p: each adds what the one before leaves of eight
    covered = F.aggregate(
        F.transform("p", lambda i, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), i - F.get("p", k - 1)))),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD_PATTERN))
    out = out.withColumn("l", lines)
    stops = F.size(F.filter("w", lambda x: F.lower(x).isin(*stop_words)))
    out = out.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("l").alias("n_lines"),
        stops.alias("n_stop_words"),
    )
    each = lambda x, n: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(n).cast("double")), F.lit(0.0))
    out = out.select(
        *("doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words".split()),
        ((F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        each("word_chars", "n_words").alias("mean_word_chars"),
        each("n_symbols", "word_chars").alias("symbol_ratio"),
        each("n_stop_words", "n_words").alias("stop_word_ratio"),
        each("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        each("n_repeat_words", "n_words").alias("repeat_word_ratio"),
    )
    kept = F.col("base_failed") == F.lit(False)
    return out.select(*out.columns[:7], (kept & F.expr(verdict(rules))).alias("kept"), *out.columns[7:])
