"""Lexical grounding of answers.

All weights are per trace (its contexts, question and answer are the documents), so terms are
counted where the row is (``facts_of``, in Arrow batches) and every metric is an expression over
that row: nothing is shuffled, and a task holds a few rows at a time, however many there are.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.functions import text as X

BM25_K1, BM25_B = 1.2, 0.75
TOP_K = 5
#: Columns of ``unsupported_extras`` and ``quickwins`` that only a grounded trace has.
EXTRAS = ("unsupported_topk_impact", "unsupported_topk_count", "unsupported_term_rate", "supported_topk_impact", "unsupported_to_supported_ratio")
SIZES = ("num_contexts", "avg_ctx_len_tokens", "q_len", "a_len", "qa_len_ratio", "best_context_len")


def parts(traces: DataFrame) -> DataFrame:
    """trace_id, part (q, a or c), no, text."""
    q, a = (F.array(F.struct(F.lit(p).alias("part"), F.lit(0).alias("no"), F.col(p).alias("text"))) for p in ("q", "a"))
    c = F.transform("c", lambda x, i: F.struct(F.lit("c").alias("part"), i.alias("no"), x.alias("text")))
    return traces.select("trace_id", F.inline(F.concat(q, a, c)))


def profile(traces: DataFrame) -> DataFrame:
    """trace_id, term, counts in answer (a), question (q) and all contexts (c), df, n, idf and,
    of terms of the answer, the rank among its supported or unsupported ones (impact down, term up)."""
    has = lambda test: F.filter("terms", lambda t: test(t))
    key = lambda t: F.struct((-F.round(t["a"] * t["idf"], 10)).alias("key"), t["term"].alias("term"), t.alias("t"))
    fields = lambda t: [t[f].alias(f) for f in ("term", "a", "q", "c", "df")]
    entry = lambda t, rank: F.struct(*fields(t), t["idf"].alias("idf"), rank.alias("rank"))
    placed = lambda test: F.transform(F.sort_array(F.transform(has(lambda t: (t["a"] > 0) & test(t)), key)), lambda x, i: entry(x["t"], i + 1))
    rest = F.transform(has(lambda t: t["a"] == 0), lambda t: entry(t, F.lit(None).cast("int")))
    rows = with_facts(traces.select("trace_id", "q", "a", "c")).select("trace_id", (F.size("c") + 2).alias("n"), F.inline(F.concat(placed(lambda t: t["c"] > 0), placed(lambda t: t["c"] == 0), rest)))
    return rows.select("trace_id", "term", "a", "q", "c", "df", "n", "idf", "rank")


def ratio(num, den):
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def lexical(prof: DataFrame) -> DataFrame:
    """Per trace: precision_token, qa_cosine, answer_covers_question, lengths, unsupported figures."""
    idf, a, q, c = (F.col(x) for x in ("idf", "a", "q", "c"))
    s = lambda x: F.sum(x)
    dot, na, nq = s(idf * idf * a * q), s(idf * idf * a * a), s(idf * idf * q * q)
    out = prof.groupBy("trace_id").agg(
        ratio(s(idf * F.least(a, c)), s(idf * a)).alias("precision_token"),
        F.when((na > 0) & (nq > 0), dot / F.sqrt(na * nq)).otherwise(F.lit(0.0)).alias("cosine_tfidf"),
        ratio(s(idf * F.least(a, q)), s(idf * q)).alias("answer_covers_question"),
        s(a).alias("a_len"),
        s(q).alias("q_len"),
        F.count_if(a > 0).alias("a_terms"),
        F.count_if((a > 0) & (c == 0)).alias("unsupported_term_count"),
    )
    return out


def bm25_score(context: Column, mean: Column) -> Column:
    """Score of a context of ``facts`` for the answer's terms, from the mean length of all."""
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.when(mean > 0, context["dl"] / mean).otherwise(1.0))
    return total(context["found"], lambda h: h["idf"] * h["cnt"] * (BM25_K1 + 1) / (h["cnt"] + norm))


def bm25(traces: DataFrame) -> DataFrame:
    """trace_id, no, score of each context for the answer's terms, dl (informative terms)."""
    rows = with_facts(traces.select("trace_id", "q", "a", "c").where(F.size("c") > 0), every=True)
    mean = ratio(total(F.col("contexts"), lambda x: x["dl"]), F.size("contexts"))
    scored = let(mean, lambda m: F.transform("contexts", lambda x: F.struct(x["no"].alias("no"), bm25_score(x, m).alias("score"), x["dl"].alias("dl"))))
    return rows.select("trace_id", F.inline(scored))


def best_context(traces: DataFrame) -> DataFrame:
    """trace_id, best_no, best_context_len: the highest BM25 score (12 places), the first on ties."""
    return recall_context(traces).drop("recall_context")


def recall_context(traces: DataFrame) -> DataFrame:
    """trace_id, best_no, best_context_len, recall_context: share of the best context's weight
    that the answer has."""
    rows = with_facts(traces.select("trace_id", "q", "a", "c").where(F.size("c") > 0)).withColumn("b", best_of(F.col("contexts"), F.size("c")))
    return rows.select("trace_id", F.col("b.no").alias("best_no"), F.col("b.dl").alias("best_context_len"), F.col("b.recall").alias("recall_context"))


def answer_sentences(traces: DataFrame) -> DataFrame:
    return traces.select("trace_id", F.posexplode(X.sentences(F.col("a"))).alias("sentence", "text"))


def sentence_precision(traces: DataFrame) -> DataFrame:
    """trace_id, sentence, precision against all contexts, rounded to 4; without terms 0."""
    rows = with_facts(traces.select("trace_id", "q", "a", "c")).select("trace_id", F.inline("sentences"))
    return rows.select("trace_id", F.col("no").alias("sentence"), "precision")


def precision_summary(values: Column) -> dict[str, Column]:
    """Of the precisions of sentences: number, least, mean and 90 %, and shares below .3, below
    .6, above; null without any."""
    n = F.nullif(F.size(values), F.lit(0))
    units = F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + F.round(x * 10000).cast("long"))
    share = lambda test: F.round(F.size(F.filter(values, test)) / n, 4)
    return {
        "n_sentences": F.size(values).cast("long"),
        "min_sentence_precision": F.array_min(values),
        # the mean of values of four places, rounded half up in whole numbers
        "mean_sentence_precision": F.floor((2 * units + n) / (2 * n)) / 10000,
        "p90_sentence_precision": F.get(F.sort_array(values), F.floor(F.lit(0.9) * (n - 1)).cast("int")),
        "low_frac": share(lambda x: x < 0.3),
        "medium_frac": share(lambda x: (x >= 0.3) & (x < 0.6)),
        "high_frac": share(lambda x: x >= 0.6),
    }


def sentence_summary(traces: DataFrame) -> DataFrame:
    """Per trace with a sentence: ``precision_summary``."""
    rows = with_facts(traces.select("trace_id", "q", "a", "c")).withColumn("v", F.transform("sentences", lambda x: x["precision"])).where(F.size("v") > 0)
    return rows.select("trace_id", *[c.alias(name) for name, c in precision_summary(F.col("v")).items()])


def unsupported_terms(prof: DataFrame) -> DataFrame:
    """Answer terms that no context has: count, idf, impact, rank (impact down, term up)."""
    raw = F.round(F.col("a") * F.col("idf"), 10)
    return prof.where("a > 0 and c = 0").select("trace_id", "term", F.col("a").alias("cnt"), F.round("idf", 4).alias("idf"), F.round(raw, 4).alias("impact"), "rank")


def supported_terms(prof: DataFrame) -> DataFrame:
    """Answer terms that some context has: count, idf, rank (count times idf down, term up)."""
    return prof.where("a > 0 and c > 0").select("trace_id", "term", F.col("a").alias("cnt"), F.round("idf", 4).alias("idf"), "rank")


def answer_terms(supported: bool) -> Column:
    """The answer's terms of a row of ``facts`` that some context has, or that none has, in order."""
    keep = lambda t: (t["a"] > 0) & ((t["c"] > 0) if supported else (t["c"] == 0))
    return in_order(F.transform(F.filter("terms", keep), lambda t: ranked(t["term"], t["a"], t["idf"])))


def term_columns(supported: Column, unsupported: Column) -> dict[str, Column]:
    """From ``answer_terms`` of both kinds: unsupported mass, impact of the top five, term rate
    and, of as many supported terms, the impact and the ratio of both."""
    top = F.slice(unsupported, 1, TOP_K)
    impact = total(top, lambda t: t["impact"])
    # as many supported terms as there are among the largest unsupported ones
    known = total(F.slice(supported, F.lit(1), F.size(top)), lambda t: t["cnt"] * t["idf"])
    return {
        "unsupported_mass": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("precision_token"))), 4),
        "unsupported_topk_impact": F.round(impact, 4),
        "unsupported_topk_count": F.size(top).cast("long"),
        "unsupported_term_rate": F.round(ratio(F.size(unsupported), F.size(supported) + F.size(unsupported)), 4),
        "supported_topk_impact": F.round(known, 4),
        "unsupported_to_supported_ratio": F.round(impact / (known + 1e-6), 4),
    }


def unsupported_extras(traces: DataFrame) -> DataFrame:
    """Per trace that has any term: ``term_columns``."""
    rows = facts(traces).withColumns({"su": answer_terms(True), "un": answer_terms(False)})
    return rows.select("trace_id", *[c.alias(name) for name, c in term_columns(F.col("su"), F.col("un")).items()])


def size_columns() -> dict[str, Column]:
    """Sizes and shares of a trace from its texts, ``facts`` and best context."""
    raw = F.aggregate(F.transform("c", lambda x: F.size(X.tokens(x))), F.lit(0), lambda s, x: s + x)
    return {
        "num_contexts": F.size("c").cast("long"),
        "avg_ctx_len_tokens": F.round(ratio(raw, F.size("c")), 4),
        "q_len": F.col("q_len"),
        "a_len": F.col("a_len"),
        "qa_len_ratio": F.round(F.col("a_len") / F.greatest(F.lit(1), "q_len"), 4),
        "best_context_len": F.coalesce("best.dl", F.lit(0)).cast("long"),
        "best_context_share": F.round(F.col("precision_token") * F.coalesce("best.recall", F.lit(0.0)), 4),
    }


def quickwins(traces: DataFrame) -> DataFrame:
    """Sizes and shares per trace."""
    rows = with_facts(traces.select("trace_id", "q", "a", "c")).withColumn("best", best_of(F.col("contexts"), F.size("c")))
    return rows.select("trace_id", *[c.alias(name) for name, c in size_columns().items()])


def simple_columns() -> dict[str, Column]:
    """Over all contexts joined by a space: word overlap, confidence and completeness."""
    ctx = F.array_join("c", " ")
    words, n_a, n_c, n_q = X.word_set(F.col("a")), X.word_count(F.col("a")), X.word_count(ctx), X.word_count(F.col("q"))
    overlap = F.size(F.array_intersect(words, X.word_set(ctx)))
    return {
        "faithfulness": F.round(ratio(overlap, F.size(words)), 4),
        "confidence": F.when((n_a > 10) & (n_c > 50), "High").when((n_a > 5) & (n_c > 20), "Medium").otherwise("Low"),
        "completeness": F.round(F.when((n_a == 0) | (n_q == 0), 0.0).otherwise(F.least(F.lit(1.0), n_a / F.when(n_q < 5, 20).otherwise(30))), 4),
    }


def simple_scores(traces: DataFrame) -> DataFrame:
    return traces.select("trace_id", *[c.alias(name) for name, c in simple_columns().items()])


def inference(precision: Column, numeric: Column, overall: Column, cosine: Column) -> tuple[Column, Column]:
    """Score and flag of an answer that is inferred rather than paraphrased; nulls are 0."""
    precision, numeric, overall, cosine = (F.coalesce(x, F.lit(0.0)) for x in (precision, numeric, overall, cosine))
    typed = F.greatest(numeric, overall)
    fits = (precision < 0.45) & (typed >= 0.9) & (cosine >= 0.35)
    score = F.when(fits, F.least(F.lit(1.0), 0.5 * (1 - precision) + 5.0 * (typed - 0.9))).otherwise(0.0)
    return F.round(score, 4), score >= 0.5


def inference_signal(rows: DataFrame) -> DataFrame:
    """trace_id, inference_score, inference_likely of rows with trace_id, precision_token,
    numeric_match, entity_overall, cosine_tfidf."""
    score, likely = inference(*map(F.col, ("precision_token", "numeric_match", "entity_overall", "cosine_tfidf")))
    return rows.select("trace_id", score.alias("inference_score"), likely.alias("inference_likely"))


def inference_sem(precision: Column, overall: Column, has_entities: Column, cosine: Column) -> tuple[Column, Column]:
    """Score and flag of inference by vectors: the typed gap (1 without entities) times the
    share of precision in the cosine of question and answer; null without such a cosine."""
    bound = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    gap = F.when(~has_entities | overall.isNull(), 1.0).otherwise(bound(1 - bound(overall)))
    score = F.when(precision.isNotNull() & (cosine > 1e-6), bound(gap * F.least(F.lit(1.0), bound(precision) / cosine)))
    return F.round(score, 4), score >= 0.5


def total(items: Column, of) -> Column:
    """Sum of ``of(x)`` over an array."""
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + of(x))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, where a lambda would do so at every element."""
    return F.transform(F.array(value), body)[0]


_TERM = "array<struct<term:string,idf:double,a:bigint,q:bigint,c:bigint,df:bigint>>"
_CONTEXT = "array<struct<no:int,dl:bigint,weight:double,hit:double,found:array<struct<idf:double,cnt:bigint>>>>"
_SENTENCE = "array<struct<no:int,known:double,weight:double,lost:array<struct<term:string,cnt:bigint,idf:double>>>>"
FACTS = f"struct<precision_token:double,cosine_tfidf:double,answer_covers_question:double,a_len:bigint,q_len:bigint,terms:{_TERM},contexts:{_CONTEXT},sentences:{_SENTENCE}>"


def _structs(rows: list[tuple], **kinds: pa.DataType) -> pa.StructArray:
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds.values())], names=list(kinds))


def _facts(rows: pa.StructArray) -> pa.Array:
    """FACTS of rows of q, sentences and c."""
    seen: dict[str | None, dict[str, int]] = {}

    def counts(text: str | None) -> dict[str, int]:
        # the traces of a conversation have contexts in common
        if (own := seen.get(text)) is None:
            own = seen[text] = X.term_counts(text)
        return own

    scores, terms, contexts, found, sentences, lost = [], [], [], [], [], []
    ends, found_ends, lost_ends = ([0], [0], [0]), [0], [0]
    for question, every, texts in zip(*(rows.field(i).to_pylist() for i in range(3))):
        q, own, others = X.term_counts(question), [X.term_counts(t) for t in every or ()], [counts(t) for t in texts or ()]
        a, c, df = {}, {}, {}
        for counted, into in ((own, a), (others, c)):
            for x in counted:
                for t, n in x.items():
                    into[t] = into.get(t, 0) + n
        for x in (a, q, *others):
            for t in x:
                df[t] = df.get(t, 0) + 1
        weights = [math.log((len(others) + 3) / (k + 1)) + 1 for k in range(len(others) + 3)]
        idf = {t: weights[k] for t, k in df.items()}
        ac = aw = dot = aa = qq = qa = qw = 0.0
        for t, k in df.items():
            w, x, y, z = idf[t], a.get(t, 0), q.get(t, 0), c.get(t, 0)
            terms.append((t, w, x, y, z, k))
            ac, aw, qa, qw = ac + w * min(x, z), aw + w * x, qa + w * min(x, y), qw + w * y
            dot, aa, qq = dot + w * w * x * y, aa + w * w * x * x, qq + w * w * y * y
        scores.append((ac / aw if aw > 0 else 0.0, dot / math.sqrt(aa * qq) if aa > 0 and qq > 0 else 0.0, qa / qw if qw > 0 else 0.0, sum(a.values()), sum(q.values())))
        for no, x in enumerate(others):
            shared = [(t, n) for t, n in x.items() if t in a]
            found += [(idf[t], n) for t, n in shared]
            found_ends.append(len(found))
            contexts.append((no, sum(x.values()), math.fsum(idf[t] * n for t, n in x.items()), math.fsum(idf[t] * min(n, a[t]) for t, n in shared)))
        for no, x in enumerate(own):
            lost += [(t, n, idf[t]) for t, n in x.items() if t not in c]
            lost_ends.append(len(lost))
            sentences.append((no, math.fsum(idf[t] * min(n, c[t]) for t, n in x.items() if t in c), math.fsum(idf[t] * n for t, n in x.items())))
        for end, values in zip(ends, (terms, contexts, sentences)):
            end.append(len(values))
    text, real, whole, place = pa.string(), pa.float64(), pa.int64(), pa.int32()
    context, sentence = _structs(contexts, no=place, dl=whole, weight=real, hit=real), _structs(sentences, no=place, known=real, weight=real)
    with_list = lambda own, name, x: pa.StructArray.from_arrays([*own.flatten(), x], names=[*(f.name for f in own.type), name])
    score = _structs(scores, precision_token=real, cosine_tfidf=real, answer_covers_question=real, a_len=whole, q_len=whole)
    made = {
        "terms": X.listed(ends[0], _structs(terms, term=text, idf=real, a=whole, q=whole, c=whole, df=whole)),
        "contexts": X.listed(ends[1], with_list(context, "found", X.listed(found_ends, _structs(found, idf=real, cnt=whole)))),
        "sentences": X.listed(ends[2], with_list(sentence, "lost", X.listed(lost_ends, _structs(lost, term=text, cnt=whole, idf=real)))),
    }
    return pa.StructArray.from_arrays([*score.flatten(), *made.values()], names=[*(f.name for f in score.type), *made])


def facts_of(q: Column, sentences: Column, c: Column) -> Column:
    """FACTS of a question, an answer's sentences and contexts."""
    # said not to be deterministic, or a filter on what it gives would run it once more
    return X.stepwise(FACTS, _facts, q, sentences, c, steady=False)


def with_facts(traces: DataFrame, every: bool = False) -> DataFrame:
    """The rows of traces with all that their terms tell, worked out row by row.

    Columns: precision_token, cosine_tfidf, answer_covers_question, a_len, q_len; terms (term,
    idf, a, q, c, df) of the whole trace; the contexts (no, dl, weight, hit, found), of those
    with terms unless ``every``; and the answer's sentences (no, precision, unsupported).
    """
    own = lambda x: F.struct(x["no"].alias("no"), F.round(ratio(x["known"], x["weight"]), 4).alias("precision"), in_order(F.transform(x["lost"], lambda t: ranked(t["term"], t["cnt"], t["idf"]))).alias("unsupported"))
    rows = traces.withColumn("_facts", facts_of(F.col("q"), X.sentences(F.col("a")), F.col("c")))
    plain = {n: F.col(f"_facts.{n}") for n in ("precision_token", "cosine_tfidf", "answer_covers_question", "a_len", "q_len", "terms", "contexts")}
    if not every:
        plain["contexts"] = F.filter("_facts.contexts", lambda x: x["dl"] > 0)
    return rows.withColumns(plain | {"sentences": F.transform("_facts.sentences", own)}).drop("_facts")


def facts(traces: DataFrame) -> DataFrame:
    """One row a trace that has any term: trace_id and the columns of ``with_facts``."""
    return with_facts(traces.select("trace_id", "q", "a", "c")).where(F.size("terms") > 0).drop("q", "a", "c")


def best_of(contexts: Column, size: Column, bm25: bool = True) -> Column:
    """Struct (no, dl, recall) of the best of ``size`` contexts, of which those with terms are
    given: by BM25 for the answer's terms or by the share of the weight that the answer has, to
    12 places, the first on ties. One that has nothing of the answer counts as 0, like one
    without terms, and then the first of all is the best."""
    some = F.filter(contexts, lambda x: F.size(x["found"]) > 0)

    def scored(mean: Column) -> Column:
        def of(x: Column) -> Column:
            score = bm25_score(x, mean) if bm25 else ratio(x["hit"], x["weight"])
            return F.struct(F.round(score, 12).alias("score"), (-x["no"]).alias("first"), x["dl"].alias("dl"), ratio(x["hit"], x["weight"]).alias("recall"))

        return F.array_max(F.transform(some, of))

    best = scored(ratio(total(contexts, lambda x: x["dl"]), size))
    first = F.filter(contexts, lambda x: x["no"] == 0)
    none = F.struct(F.lit(0).alias("no"), F.coalesce(F.get(first, F.lit(0))["dl"], F.lit(0).cast("long")).alias("dl"), F.lit(0.0).alias("recall"))
    made = let(best, lambda b: F.when(b.isNull(), none).otherwise(F.struct((-b["first"]).alias("no"), b["dl"].alias("dl"), b["recall"].alias("recall"))))
    return F.when(size > 0, made)


def ranked(term: Column, count: Column, idf: Column) -> Column:
    """A term's entry with its sort key first: impact down, then the term."""
    impact = F.round(count * idf, 10)
    return F.struct((-impact).alias("key"), term.alias("term"), count.alias("cnt"), F.round(idf, 4).alias("idf"), F.round(impact, 4).alias("impact"))


def in_order(entries: Column) -> Column:
    """``ranked`` entries sorted, without their key."""
    return F.transform(F.sort_array(entries), lambda x: F.struct(*[x[f].alias(f) for f in ("term", "cnt", "idf", "impact")]))
