"""Registered queries of the grounding operators over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.functions import text as X
from groundspark.operators import analysis as A
from groundspark.operators import evaluation as V
from groundspark.operators import metrics as M
from groundspark.operators.vectors import similar
from groundspark.sources.readers import conversation_traces, table

FEATURES = ["chars", "phase", "lang_len", "chars2", "quality"]
COEFFICIENTS = {"chars": 0.001, "phase": -0.5, "lang_len": 0.25, "chars2": -0.0004, "quality": 1.5}


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_traces(table(spark, sf_dir, "conversations"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, answer_type, y (quality), p: a score with many ties made from the length."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", F.col("lang").alias("answer_type"), F.col("quality").alias("y"), ((F.col("n_chars") % 97) / 97.0).alias("p"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    d = lambda c: c.cast("double")
    return rows.select("doc_id", d(F.col("n_chars")).alias("chars"), d(F.col("doc_id") % 7).alias("phase"), d(F.length("lang")).alias("lang_len"), d(F.col("n_chars") * 2 + 1).alias("chars2"), d(F.col("quality")).alias("quality"), F.col("quality").alias("y"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("outcome", V.outcome(F.col("y"), (F.col("p") >= 0.5).cast("int")))
    one = lambda f, m: F.struct(F.lit(f).alias("feature"), (((F.col("doc_id") * m) % 201 - 100) / 100.0).alias("contribution"))
    return rows.withColumn("top_features", F.array(one("lex.a", 7), one("lex.b", 13), one("num.c", 29)))


def tokens(spark, sf_dir):
    rows = M.parts(traces(spark, sf_dir))
    t = X.tokens(F.col("text"))
    return rows.select("trace_id", "part", "no", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def lemma_counts(spark, sf_dir):
    rows = M.facts(traces(spark, sf_dir)).select(F.inline("terms"))
    return rows.groupBy("term").agg(F.sum(F.col("a") + F.col("q") + F.col("c")).alias("cnt"), F.count("*").alias("n_traces"))


def idf(spark, sf_dir):
    return M.profile(traces(spark, sf_dir)).select("trace_id", "term", "df", F.round("idf", 6).alias("idf"))


def precision_token(spark, sf_dir):
    return M.facts(traces(spark, sf_dir)).select("trace_id", F.round("precision_token", 4).alias("precision_token"))


def qa_cosine(spark, sf_dir):
    return M.facts(traces(spark, sf_dir)).select("trace_id", F.round("cosine_tfidf", 4).alias("cosine_tfidf"), F.round("answer_covers_question", 4).alias("answer_covers_question"))


def bm25_scores(spark, sf_dir):
    return M.bm25(traces(spark, sf_dir)).select("trace_id", "no", F.round("score", 6).alias("score"))


def bm25_best_context(spark, sf_dir):
    return M.best_context(traces(spark, sf_dir))


def recall_best_context(spark, sf_dir):
    return M.recall_context(traces(spark, sf_dir)).select("trace_id", F.round("recall_context", 4).alias("recall_context"))


def sentences(spark, sf_dir):
    return M.answer_sentences(traces(spark, sf_dir)).select("trace_id", "sentence", "text")


def sentence_precision(spark, sf_dir):
    return M.sentence_precision(traces(spark, sf_dir))


def sentence_buckets(spark, sf_dir):
    return M.sentence_summary(traces(spark, sf_dir))


def unsupported_terms(spark, sf_dir):
    return M.unsupported_terms(M.profile(traces(spark, sf_dir)))


def supported_terms(spark, sf_dir):
    return M.supported_terms(M.profile(traces(spark, sf_dir)))


def unsupported_extras(spark, sf_dir):
    return M.unsupported_extras(traces(spark, sf_dir)).drop("unsupported_to_supported_ratio")


def quickwins(spark, sf_dir):
    return M.quickwins(traces(spark, sf_dir))


def simple_scores(spark, sf_dir):
    return M.simple_scores(traces(spark, sf_dir))


def inference_signal(spark, sf_dir):
    lex = M.facts(traces(spark, sf_dir)).select("trace_id", "precision_token", "cosine_tfidf")
    typed = F.when(F.col("trace_id") % 3 == 0, 1.0).when(F.col("trace_id") % 3 == 1, 0.95)
    return M.inference_signal(lex.withColumns({"numeric_match": typed, "entity_overall": F.lit(0.5), "cosine_tfidf": F.col("cosine_tfidf") + 0.35}))


def pr_curve(spark, sf_dir):
    return V.curve(scored(spark, sf_dir)).select(F.round("p", 6).alias("p"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def pr_threshold(spark, sf_dir):
    return V.pick_threshold(scored(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("threshold", "precision", "recall", "score")])


def average_precision(spark, sf_dir):
    return V.average_precision(scored(spark, sf_dir)).select(F.round("average_precision", 6).alias("average_precision"))


def roc_auc(spark, sf_dir):
    return V.roc_auc(scored(spark, sf_dir)).select(F.round("roc_auc", 6).alias("roc_auc"))


def brier(spark, sf_dir):
    return V.brier(scored(spark, sf_dir)).select(F.round("brier", 6).alias("brier"))


def metrics_by_type(spark, sf_dir):
    return V.metrics_by(scored(spark, sf_dir), 0.5, "answer_type").select("answer_type", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def stratified_folds(spark, sf_dir):
    return V.stratified_folds(scored(spark, sf_dir), "doc_id")


def dataset_stats(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("answer_type", F.when(F.col("answer_type") == "en", "Fact").when(F.col("answer_type") == "de", " ").otherwise(F.col("answer_type")))
    return A.dataset_stats(rows)


def zero_variance(spark, sf_dir):
    return A.spread(features(spark, sf_dir), FEATURES).select("feature", F.round("var_pop", 4).alias("var_pop"), "constant")


def feature_corr(spark, sf_dir):
    return A.feature_correlations(features(spark, sf_dir), FEATURES).select("feature", (F.round("r", 6) + 0.0).alias("r"))


def corr_pairs(spark, sf_dir):
    return A.correlated_pairs(features(spark, sf_dir), FEATURES).select("feature_a", "feature_b", F.round("r", 6).alias("r"))


def outcome_counts(spark, sf_dir):
    return A.outcome_counts(predictions(spark, sf_dir))


def contribution_stats(spark, sf_dir):
    return A.contribution_stats(predictions(spark, sf_dir)).select("feature", "positive", F.round("positive_sum", 4).alias("positive_sum"), "negative", F.round("negative_sum", 4).alias("negative_sum"), "average")


def prefix_rollup(spark, sf_dir):
    return A.contribution_stats(predictions(spark, sf_dir), "prefix").select("prefix", "positive", "negative", F.round("average", 5).alias("average"))


def impact_matrix(spark, sf_dir):
    return A.impact_matrix(predictions(spark, sf_dir)).select("feature", *[F.round(c, 6).alias(c) for c in ("avg_tp", "avg_fn", "norm_tp", "norm_fn", "score")], "rank")


def top_contributions(spark, sf_dir):
    rows = A.top_contributions(features(spark, sf_dir), FEATURES, COEFFICIENTS, 2)
    return rows.select("doc_id", F.posexplode("top_features").alias("place", "f")).select("doc_id", "place", "f.feature", F.round("f.contribution", 6).alias("contribution"))


def reproject(spark, sf_dir):
    return A.reprojected(features(spark, sf_dir), ["quality", "absent", "chars"], ["doc_id"])


def merge_features(spark, sf_dir):
    rows = features(spark, sf_dir)
    return A.merged_features([rows.where("y = 1").drop("phase"), rows.where("y = 0").drop("chars2")])


def cosine_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return similar(vectors.where("vec_id % 50 = 0"), vectors)


QUERIES = {
    f.__name__: f
    for f in (
        tokens, lemma_counts, idf, precision_token, qa_cosine, bm25_scores, bm25_best_context, recall_best_context, sentences, sentence_precision, sentence_buckets, unsupported_terms, supported_terms,
        unsupported_extras, quickwins, simple_scores, inference_signal, pr_curve, pr_threshold, average_precision, roc_auc, brier, metrics_by_type, stratified_folds, dataset_stats, zero_variance, feature_corr,
        corr_pairs, outcome_counts, contribution_stats, prefix_rollup, impact_matrix, top_contributions, reproject, merge_features, cosine_topk,
    )
}


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and contexts written from orders; amounts, dates and weights differ by the key's remainders."""
    o = dealt(table(spark, sf_dir, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.to_date("o_orderdate").alias("day"))

    def sentence(cents, day, weight):
        money = F.concat(F.lit("$"), F.format_number(F.floor(cents / 100).cast("long"), 0), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
        return F.concat(F.lit("Order "), F.col("k").cast("string"), F.lit(" cost "), money, F.lit(" on "), F.date_format(day, "yyyy-MM-dd"), F.lit(", "), (F.col("k") % 30 + 1).cast("string"), F.lit("% off, "), weight.cast("string"), F.lit(" kg."))

    w = F.col("k") % 40 + 2
    context = sentence(F.col("cents") + F.when(F.col("k") % 3 == 0, 500).otherwise(0), F.date_add("day", F.when(F.col("k") % 4 == 0, 1).otherwise(0)), w + F.when(F.col("k") % 5 == 0, 1).otherwise(0))
    return o.select(F.col("k").alias("trace_id"), F.lit("What did the order cost?").alias("q"), sentence(F.col("cents"), F.col("day"), w).alias("a"), F.array(context).alias("c"))


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table that comes in fewer files than there are cores, dealt to all of them, for
    what follows costs far more than to move them; a table of many files stays as it is. They go
    by a key: dealt in turn, each task would sort all its rows first."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * cores, key) if len(rows.inputFiles()) < cores else rows


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from groundspark.operators.matching import matches

    return rendered(spark, sf_dir).select("trace_id", matches(F.col("a"), F.col("c")).alias("m"))


def _typed(spark, sf_dir, kind: str) -> DataFrame:
    """Entities of one kind; kinds of lower rank, which cannot take its place, aren't read."""
    from groundspark.functions.entities import RANK, ExtractorConfig, with_entities

    config = ExtractorConfig(types=tuple(t for t in ExtractorConfig().types if RANK[t] >= RANK[kind]))
    return with_entities(rendered(spark, sf_dir), "a", config=config, only=kind).select("trace_id", F.inline("entities"))


def money_entities(spark, sf_dir):
    return _typed(spark, sf_dir, "MONEY").select("trace_id", F.round(F.col("num") * 100).cast("long").alias("cents"), "currency")


def date_entities(spark, sf_dir):
    return _typed(spark, sf_dir, "DATE").select("trace_id", "iso")


def percent_entities(spark, sf_dir):
    return _typed(spark, sf_dir, "PERCENT").select("trace_id", F.col("num").cast("long").alias("percent"))


def quantity_entities(spark, sf_dir):
    return _typed(spark, sf_dir, "QUANTITY").select("trace_id", F.col("num").cast("long").alias("weight"), "unit")


def entity_spans(spark, sf_dir):
    return _typed(spark, sf_dir, "MONEY").select("trace_id", F.col("text").alias("surface"), "start", "end")


def numeric_match(spark, sf_dir):
    from groundspark.operators.matching import NUMERIC, share_of

    return _matches(spark, sf_dir).select("trace_id", F.round(share_of(F.col("m"), NUMERIC), 4).alias("numeric_match"))


def entity_coverage(spark, sf_dir):
    from groundspark.operators.matching import coverage_in

    return _matches(spark, sf_dir).select("trace_id", coverage_in(F.col("m"))["overall"].alias("overall"), F.size("m.lost").cast("long").alias("n_unsupported"))


def relative_weekday(spark, sf_dir):
    day = F.to_date("o_orderdate")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.next_day(day, "FRI").alias("next_friday"), F.next_day(F.date_sub(day, 8), "FRI").alias("last_friday"))
    return rows.select("o_orderkey", F.col("next_friday").cast("string").alias("next_friday"), F.col("last_friday").cast("string").alias("last_friday"))


#: Columns of a report that follow from texts alone.
LEXICAL = ("precision_token", "recall_context", "cosine_tfidf", "answer_covers_question", "n_sentences", "min_sentence_precision", "mean_sentence_precision", "p90_sentence_precision", "unsupported_mass", "unsupported_topk_impact", "unsupported_topk_count", "unsupported_term_rate", "unsupported_term_count", "supported_topk_impact", "num_contexts", "avg_ctx_len_tokens", "q_len", "a_len", "qa_len_ratio", "best_context_len", "best_context_share", "faithfulness", "confidence", "completeness")


def grounding_report(spark, sf_dir):
    from groundspark.operators.report import build_report

    return build_report(traces(spark, sf_dir)).select("trace_id", *LEXICAL)


def entity_report(spark, sf_dir):
    from groundspark.operators.report import build_report

    report = build_report(rendered(spark, sf_dir))
    state = lambda t: F.col("entity_match.all_matched_by_type")[t].alias(f"all_{t.lower()}")
    return report.select("trace_id", F.round("numeric_match", 4).alias("numeric_match"), "entity_overall", "unsupported_numeric_count", "unsupported_entity_count", F.size("supported_entities.items").cast("long").alias("n_supported"), *map(state, ("MONEY", "PERCENT", "DATE", "QUANTITY")))


def feature_matrix(spark, sf_dir):
    from groundspark.operators.report import build_report, feature_rows

    return feature_rows(build_report(traces(spark, sf_dir)))


def lexical_features(spark, sf_dir):
    from groundspark.operators.report import ReportConfig, build_report, feature_rows

    report = build_report(traces(spark, sf_dir), ReportConfig(entities=False))
    return feature_rows(report, allow=("*sentence_precision", "*_frac", "unsupported_topk*", "unsupported_term*", "supported_topk_impact", "precision_token", "recall_context", "best_context*", "qr_alignment", "?_len"))


def sentence_unsupported(spark, sf_dir):
    rows = M.facts(traces(spark, sf_dir)).select("trace_id", F.inline("sentences"))
    return rows.select("trace_id", F.col("no").alias("sentence"), F.inline("unsupported")).select("trace_id", "sentence", "term", "cnt", "impact")


def supported_spans(spark, sf_dir):
    from groundspark.operators.report import ReportConfig, build_report

    report = build_report(traces(spark, sf_dir), ReportConfig(entities=False))
    rows = report.select("trace_id", F.posexplode("supported_terms_per_sentence").alias("sentence", "s"))
    return rows.select("trace_id", "sentence", F.inline("s.supported_terms"))


def best_context_plain(spark, sf_dir):
    rows = M.with_facts(traces(spark, sf_dir).where("size(c) > 0"))
    rows = rows.withColumn("b", M.best_of(F.col("contexts"), F.size("c"), bm25=False))
    return rows.select("trace_id", F.col("b.no").cast("long").alias("best_no"), F.col("b.dl").alias("best_context_len"))


def semantic_metrics(spark, sf_dir):
    from groundspark.operators.report import semantic

    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    at = lambda k, name: v.select((F.col("vec_id") - k).alias("vec_id"), F.col("e").alias(name))
    rows = v.withColumnRenamed("e", "qe").join(at(1, "ae"), "vec_id").join(at(2, "c0"), "vec_id").join(at(3, "c1"), "vec_id")
    k = F.col("vec_id")
    rows = rows.select(k.alias("trace_id"), "qe", "ae", F.array("c0", "c1").alias("ce"), ((k % 11) / 11).alias("precision_token"), ((k % 7) / 7).alias("answer_covers_question"), (k % 2 * 3).alias("n_sentences"), (k % 9).alias("best_context_len"), F.when(k % 3 > 0, (k % 5) / 5).alias("entity_overall"))
    names = ("cosine_embed", "best_context_similarity", "answer_context_similarity", "per_sentence_semantic_alignment", "answer_novelty_ratio", "semantic_gap", "qa_context_coverage_gap", "inference_sem_score")
    return semantic(rows).select("trace_id", *[F.round(n, 4).alias(n) for n in names])


def pr_auc_by_type(spark, sf_dir):
    return V.by_answer_type(scored(spark, sf_dir), 0.5).select("answer_type", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "pr_auc")])


def top_coefficients(spark, sf_dir):
    return A.coefficient_table(spark, COEFFICIENTS, 2).select("direction", F.col("rank").cast("long").alias("rank"), "feature", "coefficient")


def canonical_dates(spark, sf_dir):
    from groundspark.functions.entities import canonical_date

    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 2 == 0, "T10:30").otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", canonical_date(iso).alias("day"))


def classifier_scores(spark, sf_dir):
    from groundspark.operators.classifier import GroundednessClassifier, folded

    own = ["chars", "phase", "lang_len"]
    # kept for the five fits and for the scores, which are read when the caller asks for them
    rows = folded(features(spark, sf_dir).select("doc_id", "y", *own), "doc_id")
    out = None
    for fold in range(5):
        model = GroundednessClassifier(own, C=3.0).fit(rows.where(F.col("fold") != fold))
        scored = model.score(rows.where(F.col("fold") == fold), "doc_id")
        out = scored if out is None else out.unionByName(scored)
    return out


QUERIES |= {
    f.__name__: f
    for f in (money_entities, date_entities, percent_entities, quantity_entities, entity_spans, numeric_match, entity_coverage, relative_weekday, grounding_report, entity_report, feature_matrix, lexical_features, sentence_unsupported, supported_spans, best_context_plain, semantic_metrics, pr_auc_by_type, top_coefficients, canonical_dates, classifier_scores)
}


#: Counters and places that results state as long.
_LONG = {"no", "best_no", "sentence", "n_sentences", "rank", "place", "start", "end"}


def _stated(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = query(spark, sf_dir)
        return rows.withColumns({c: F.col(c).cast("long") for c, t in rows.dtypes if c in _LONG and t == "int"})

    return run


QUERIES = {name: _stated(query) for name, query in QUERIES.items()}
