"""The grounding report: one row a trace with every metric, and its flat feature row.

A trace without an answer has null scores; one without contexts has its question-answer
figures and no grounding. Nulls stay in the report and become 0 in the feature row.
"""

from __future__ import annotations

import fnmatch
import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.functions import text as X
from groundspark.functions.entities import ExtractorConfig, entities_of, entities_of_all
from groundspark.operators import matching
from groundspark.operators import metrics as M
from groundspark.operators.vectors import cosine

#: Columns that only an answer with contexts has.
GROUNDED = (
    "precision_token", "recall_context", "unsupported_mass", "best_context_share", *M.EXTRAS, *M.SIZES, "entity_overall", "unsupported_entities", "unsupported_term_count", "unsupported_numeric_count",
    "unsupported_entity_count", "min_sentence_precision", "mean_sentence_precision", "p90_sentence_precision", "low_frac", "medium_frac", "high_frac", "inference_score", "inference_likely",
)
POS = ("content_precision_token", "content_unsupported_mass", "content_term_support_rate", "head_noun_support_rate")
#: Least cosine with the answer at which a term of the question counts as covered.
TERM_COSINE = 0.5


@dataclass(frozen=True)
class ReportConfig:
    """What a report holds.

    extractor: which entities; entities: whether to match them; inference: whether to judge
    inference; drop: columns left out; bm25: choose the best context by BM25, else by the share
    of its weight that the answer has. embed gives, once a worker, a function list of texts ->
    list of vectors; pos one of text -> (content terms, head nouns). Without them the columns
    that need them are null.
    """

    extractor: ExtractorConfig = field(default_factory=ExtractorConfig)
    entities: bool = True
    inference: bool = True
    drop: tuple[str, ...] = ()
    bm25: bool = True
    embed: Callable[[], Callable] | None = None
    pos: Callable[[], Callable] | None = None


@lru_cache(maxsize=4)
def _loaded(load: Callable) -> Callable:
    return load()


def _cosine(x: list[float], y: list[float]) -> float:
    size = math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
    return sum(a * b for a, b in zip(x, y)) / size if size > 0 else 0.0


def with_vectors(rows: DataFrame, embed: Callable) -> DataFrame:
    """qa, near and term_cosines: cosines of the answer with the question, with each context and
    with the question's terms; null without the texts. A batch's texts go to the model in one call."""

    @F.arrow_udf("struct<qa:double,near:array<double>,terms:map<string,double>>")
    def run(q: pa.Array, a: pa.Array, c: pa.Array, asked: pa.Array) -> pa.Array:
        rows = [(q or "", a or "", c or [], t or []) for q, a, c, t in zip(q.to_pylist(), a.to_pylist(), c.to_pylist(), asked.to_pylist())]
        flat = [x or "" for q, a, c, t in rows for x in (q, a, *c, *t)]
        vectors, made = iter(_loaded(embed)(flat) if flat else ()), []
        for q, a, c, t in rows:
            qe, ae = next(vectors), next(vectors)
            ce, te = [next(vectors) for _ in c], [next(vectors) for _ in t]
            made.append({"qa": _cosine(qe, ae) if q and a else None, "near": [_cosine(ae, x) for x in ce] if a and c else None, "terms": [(k, _cosine(x, ae)) for k, x in zip(t, te)] if a else None})
        return pa.array(made, pa.struct([("qa", pa.float64()), ("near", pa.list_(pa.float64())), ("terms", pa.map_(pa.string(), pa.float64()))]))

    asked = F.transform(F.filter("terms", lambda t: t["q"] > 0), lambda t: t["term"])
    rows = rows.withColumn("cosines", run(F.col("q"), F.col("a"), F.col("c"), asked))
    return rows.withColumns({"qa": F.col("cosines.qa"), "near": F.col("cosines.near"), "term_cosines": F.col("cosines.terms")}).drop("cosines")


def build_report(traces: DataFrame, config: ReportConfig = ReportConfig()) -> DataFrame:
    """traces: trace_id (a key), q, a, c and, for the semantic part without a model, qe, ae
    (vectors) and ce (array of them).

    Terms are counted in the row (``metrics.with_facts``), every metric is an expression over it,
    and no row moves; what a reader of the report leaves out is not worked out.
    """
    base = traces.withColumn("c", F.coalesce("c", F.array().cast("array<string>")))
    out = lexical(M.with_facts(base), config)
    blank = F.coalesce(F.trim("a"), F.lit("")) == ""
    alone = (F.size("c") == 0) & ~blank
    answered, grounded = ~blank, ~blank & ~alone
    if config.entities:
        out = out.withColumns({"a_entities": entities_of(F.col("a"), config.extractor), "c_entities": entities_of_all(F.col("c"), config.extractor)})
        out = out.withColumn("found", matching.matches(F.col("a"), F.col("c"), config.extractor))
        found = F.col("found")
        out = out.withColumns({"coverage": matching.coverage_in(found), "numeric_match": F.when(answered, matching.share_of(found, matching.NUMERIC)), "unsupported_numbers": F.when(answered, found["lost_numbers"])})
        match, supported = matching.alignment(F.col("coverage"), found)
        out = out.withColumns({"entity_match": F.when(grounded, match), "supported_entities": F.when(grounded, supported)}).drop("found")
        out = out.withColumns({"entity_overall": F.col("entity_match.overall"), "unsupported_entities": F.col("entity_match.unsupported"), "unsupported_numeric_count": F.size("unsupported_numbers").cast("long"), "unsupported_entity_count": F.size("entity_match.unsupported").cast("long")})
    else:
        out = out.withColumns({"numeric_match": F.lit(None).cast("double"), "entity_overall": F.lit(None).cast("double")})
    if config.inference:
        score, likely = M.inference(*map(F.col, ("precision_token", "numeric_match", "entity_overall", "cosine_tfidf")))
        out = out.withColumns({"inference_score": score, "inference_likely": likely})
    always = {n: F.when(answered, F.col(n)) for n in ("cosine_tfidf", "answer_covers_question")}
    out = out.withColumns({n: F.when(grounded, F.col(n)) for n in GROUNDED if n in out.columns} | always)
    if config.embed is not None or {"qe", "ae", "ce"} <= set(out.columns):
        # parts the plan here: else the optimizer writes out all of the report in each vector metric
        out = out.repartition("trace_id")
    if config.embed is not None:
        out = with_vectors(out, config.embed)
    if "qa" in out.columns or {"qe", "ae", "ce"} <= set(out.columns):
        out = semantic(out, config)
    else:
        out = out.withColumn("qa_context_coverage_gap", F.round("answer_covers_question", 4))
    out = pos_stats(out, config.pos)
    out = out.withColumn("summary", summary(out.columns, blank, alone))
    rounded = ("precision_token", "recall_context", "numeric_match", "cosine_tfidf", "answer_covers_question")
    return out.withColumns({c: F.round(c, 4) for c in rounded}).drop("terms", "contexts", "sentences", *config.drop)


def answer_report(rows: DataFrame, config: ReportConfig = ReportConfig()) -> DataFrame:
    """The report of answers alone, as with an empty question."""
    return build_report(rows.withColumn("q", F.lit("")), config)


def lexical(rows: DataFrame, config: ReportConfig) -> DataFrame:
    """Everything that follows from a trace's terms, contexts and sentences."""
    rows = rows.withColumns({
        "every": X.sentences(F.col("a")),
        "best": M.best_of(F.col("contexts"), F.size("c"), config.bm25),
        "supported_terms": M.answer_terms(True),
        "unsupported_terms": M.answer_terms(False),
        "per_sentence": F.transform("sentences", lambda x: x["precision"]),
    })
    known = F.transform(F.filter("terms", lambda t: (t["a"] > 0) & (t["c"] > 0)), lambda t: t["term"])
    by_sentence = M.precision_summary(F.col("per_sentence"))
    none = ("min_sentence_precision", "mean_sentence_precision", "p90_sentence_precision")
    rows = rows.withColumns({
        "recall_context": F.coalesce("best.recall", F.lit(0.0)),
        **M.size_columns(),
        "unsupported_terms_per_sentence": F.zip_with("every", "sentences", lambda x, own: F.struct(x.alias("sentence"), own["unsupported"].alias("unsupported_terms"))),
        **by_sentence,
        **{n: F.coalesce(by_sentence[n], F.lit(0.0)) for n in none},
        "supported_terms_per_sentence": X.spans_of_sentences(F.col("a"), F.col("every"), known),
        **M.term_columns(F.col("supported_terms"), F.col("unsupported_terms")),
        "unsupported_term_count": F.size("unsupported_terms").cast("long"),
        **M.simple_columns(),
    })
    return rows.drop("best", "every")


def semantic(rows: DataFrame, config: ReportConfig = ReportConfig()) -> DataFrame:
    """Vector metrics from the cosines qa and near, or from the vectors qe, ae and ce:
    similarities, gaps, novelty and inference."""
    out = rows
    if "qa" not in rows.columns:
        both = lambda x, y: F.when(x.isNotNull() & y.isNotNull(), cosine(x, y))
        out = rows.withColumns({"qa": both(F.col("qe"), F.col("ae")), "near": F.transform("ce", lambda v: both(F.col("ae"), v))})
    some = F.nullif(F.size("near"), F.lit(0))
    out = out.withColumn("cosine_embed", F.round("qa", 4))
    out = out.withColumn("best_context_similarity", F.round(F.array_max("near"), 4))
    out = out.withColumn("answer_context_similarity", F.round(M.total(F.col("near"), lambda x: x) / some, 4))
    out = out.withColumn("per_sentence_semantic_alignment", F.round(F.col("best_context_similarity") / F.nullif(F.col("n_sentences"), F.lit(0)), 4))
    out = out.withColumn("answer_novelty_ratio", F.round(F.when(F.col("cosine_embed") > 0, F.col("precision_token") / F.col("cosine_embed")), 4))
    if "contexts" in out.columns:
        # the length of the context that is nearest by vector, the first on ties
        at = F.array_position("near", F.array_max("near")).cast("int")
        length = F.coalesce(F.get(F.filter("contexts", lambda x: x["no"] == at - 1), F.lit(0))["dl"], F.lit(0))
    else:
        length = F.col("best_context_len")
    out = out.withColumn("semantic_gap", F.round(F.col("answer_context_similarity") * F.col("precision_token") / F.greatest(F.lit(1), length), 4))
    gap = F.greatest(F.lit(0.0), F.col("answer_covers_question") - F.col("best_context_similarity"))
    out = out.withColumn("qa_context_coverage_gap", F.round(F.coalesce(F.when(F.col("best_context_similarity").isNotNull(), gap), F.col("answer_covers_question")), 4))
    if {"term_cosines", "terms"} <= set(out.columns):
        asked = F.filter("terms", lambda t: t["q"] > 0)
        covered = M.total(asked, lambda t: F.when(F.try_element_at("term_cosines", t["term"]) >= TERM_COSINE, t["idf"] * t["q"]).otherwise(0.0))
        whole = M.total(asked, lambda t: t["idf"] * t["q"])
        out = out.withColumn("answer_covers_question_sem", F.round(F.when(F.col("cosine_embed").isNotNull(), F.when(whole > 0, covered / whole).otherwise(1.0)), 4))
    if config.inference and "entity_overall" in out.columns:
        any_entity = F.size("a_entities") > 0 if "a_entities" in out.columns else F.lit(False)
        score, likely = M.inference_sem(F.col("precision_token"), F.col("entity_overall"), any_entity, F.col("cosine_embed"))
        out = out.withColumns({"inference_sem_score": score, "inference_sem_likely": likely})
    return out.drop("qa", "near", "term_cosines")


def pos_stats(rows: DataFrame, pos: Callable | None) -> DataFrame:
    """Support of the answer's content words and head nouns; null without a tagger."""
    if pos is None:
        return rows.withColumns({c: F.lit(None).cast("double") for c in POS})

    @F.arrow_udf(f"struct<{','.join(f'{c}:double' for c in POS)}>")
    def run(a: pa.Array, c: pa.Array, terms: pa.Array, idf: pa.Array) -> pa.Array:
        tag, made = _loaded(pos), []
        for a, c, terms, idf in zip(a.to_pylist(), c.to_pylist(), terms.to_pylist(), idf.to_pylist()):
            own, heads = tag(a or "")
            rest = [tag(t or "") for t in c or []]
            weight = dict(zip(terms or [], idf or []))
            have, known = Counter(own), Counter(t for ts, _ in rest for t in ts)
            share = lambda x, y: len(set(x) & set(y)) / len(set(x)) if x else None
            mass = sum(weight.get(t, 1.0) * n for t, n in have.items())
            precision = sum(weight.get(t, 1.0) * min(n, known[t]) for t, n in have.items()) / mass if mass else None
            values = (precision, None if precision is None else 1 - precision, share(own, known), share(heads, [h for _, hs in rest for h in hs]))
            made.append({k: None if v is None else round(v, 4) for k, v in zip(POS, values)})
        return pa.array(made, pa.struct([(k, pa.float64()) for k in POS]))

    rows = rows.withColumn("tagged", run(F.col("a"), F.col("c"), F.transform("terms", lambda t: t["term"]), F.transform("terms", lambda t: t["idf"])))
    return rows.withColumns({k: F.col(f"tagged.{k}") for k in POS}).drop("tagged")


def summary(columns: list[str], blank: Column, alone: Column) -> Column:
    """The report in one line."""
    pct = lambda c: F.concat(F.round(F.coalesce(F.col(c), F.lit(0.0)) * 100, 1).cast("string"), F.lit("% "))
    two = lambda c: F.round(c, 2).cast("string")
    parts = [F.concat(pct(c), F.lit(what)) for c, what in (("precision_token", "grounded"), ("recall_context", "best-context recall"), ("numeric_match", "numeric"), ("entity_overall", "entity"))]
    plain = F.concat(F.lit("Q↔A tfidf "), two("cosine_tfidf"))
    if "cosine_embed" in columns:
        by_vector = F.concat(F.lit("Q↔A embed "), two("cosine_embed"), F.coalesce(F.concat(F.lit("; A↔C embed "), two("answer_context_similarity")), F.lit("")))
        plain = F.coalesce(by_vector, plain)
    return F.when(blank, "N/A (No answer generated)").when(alone, "N/A (No retrieved context provided).").otherwise(F.concat(F.concat_ws("; ", *parts, plain), F.lit(".")))


#: Feature name and the expression over a report row that gives it.
FLAT = {
    **dict.fromkeys(
        "precision_token recall_context numeric_match unsupported_mass unsupported_topk_impact unsupported_topk_count unsupported_term_rate supported_topk_impact unsupported_to_supported_ratio num_contexts avg_ctx_len_tokens "
        "q_len a_len qa_len_ratio best_context_len best_context_share min_sentence_precision mean_sentence_precision p90_sentence_precision low_frac medium_frac high_frac inference_score "
        "unsupported_term_count unsupported_numeric_count unsupported_entity_count qa_context_coverage_gap semantic_gap answer_novelty_ratio per_sentence_semantic_alignment inference_sem_score".split()
    ),
    **dict.fromkeys(POS),
    "qr_alignment.cosine_tfidf": "cosine_tfidf",
    "qr_alignment.answer_covers_question": "answer_covers_question",
    "qr_alignment.cosine_embed": "cosine_embed",
    "qr_alignment.answer_covers_question_sem": "answer_covers_question_sem",
    "context_alignment.answer_context_similarity": "answer_context_similarity",
    "context_alignment.best_context_similarity": "best_context_similarity",
    "inference_likely_bool": "cast(inference_likely as double)",
    "inference_sem_likely_bool": "cast(inference_sem_likely as double)",
    "per_sentence__len": "n_sentences",
    "supported_terms__len": "size(supported_terms)",
    "unsupported_terms__len": "size(unsupported_terms)",
    "unsupported_numeric_rate": "1 - numeric_match",
    "entity_match.overall": "entity_overall",
    "unsupported_entity_mass": "1 - entity_overall",
    "entity_match.unsupported__len": "size(unsupported_entities)",
    **{f"entity_match.{t}__len": f"coverage.by_type.{t}.found" for t in matching.TYPES},
    **{f"entity_match.presence_by_type.{t}": f"int(coverage.by_type.{t}.asked > 0)" for t in matching.TYPES},
    **{f"entity_match.all_matched_by_type.{t}": f"int(coverage.by_type.{t}.asked > 0 and coverage.by_type.{t}.asked = coverage.by_type.{t}.found)" for t in matching.TYPES},
}


def feature_names(allow: tuple[str, ...] = (), names: list[str] | None = None) -> list[str]:
    """The features that an allow-list of dotted paths and globs lets through; all without one.

    A path lets through itself and what lies below it; a glob is held against the whole path,
    whose dots are letters like others.
    """
    names = list(FLAT) if names is None else names
    ok = lambda n: any(n == p or n.startswith((p + ".", p + "__")) or fnmatch.fnmatchcase(n, p) for p in allow)
    return [n for n in names if not allow or ok(n)]


def feature_rows(report: DataFrame, keep: tuple[str, ...] = ("trace_id", "y"), allow: tuple[str, ...] = ()) -> DataFrame:
    """Flat doubles in a fixed order; what a report lacks or holds as null is 0."""
    have = set(report.columns)

    def value(name: str, how):
        text = how or name
        # the column that the expression starts from, behind any function
        root = next(w for w in re.findall(r"[A-Za-z_]\w*", text) if w not in ("size", "cast", "int"))
        return F.greatest(F.coalesce(F.expr(text).cast("double"), F.lit(0.0)), F.lit(-1e300)).alias(name) if root in have else F.lit(0.0).alias(name)

    return report.select(*[k for k in keep if k in have], *[value(n, FLAT[n]) for n in feature_names(allow)])


def usable(traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Traces that a report can be made of, and the others with what is wrong in ``error``."""
    wrong = F.when(F.col("trace_id").isNull(), "no trace_id").when(F.col("q").isNull(), "no question").when(F.col("a").isNull(), "no answer").when(F.col("c").isNull(), "no contexts")
    marked = traces.withColumn("error", wrong)
    return marked.where("error is null").drop("error"), marked.where("error is not null")


def varying(rows: DataFrame, features: list[str]) -> list[str]:
    """Features whose largest and least value differ by more than 1e-12: one aggregate."""
    one = rows.agg(*[(F.max(f"`{f}`") - F.min(f"`{f}`")).alias(f"w{i}") for i, f in enumerate(features)]).first()
    return [f for i, f in enumerate(features) if one[i] is not None and one[i] > 1e-12]
