import math
import random

from pyspark.sql import functions as F

from groundspark.functions import text as X
from groundspark.operators import metrics as M
from groundspark.operators.report import FLAT, ReportConfig, answer_report, build_report, feature_names, feature_rows, semantic, usable, varying
from groundspark.sources import readers
from groundspark.streaming.grounding import scored_stream

TRACE = "trace_id long, q string, a string, c array<string>, y int"


def test_lemmas(spark):
    cases = {"Reported": "report", "companies": "companie", "20,000": "20000", "$1,200.00": "$120000", "12.5%": "12.5%", "thing": "thing", "running": "runn", "was": "was", "this": "thi", "bus": "bus", "(x)": "x"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.lemma(F.col("t")).alias("l")).collect()
    assert {r.t: r.l for r in rows} == cases


def test_tokens_and_sentences(spark):
    row = spark.createDataFrame([("Été was $5.2B-up, 12% of a_b. Next one! no. 24th May",)], "t string").select(X.tokens(F.col("t")), X.sentences(F.col("t")), X.strip_ordinals(F.col("t")), X.word_count(F.col("t"))).first()
    assert row[0] == ["Été", "was", "5.2B-up", "12", "of", "a_b", "Next", "one", "no", "24th", "May"]
    assert row[1] == ["Été was $5.2B-up, 12% of a_b.", "Next one! no.", "24th May"]
    assert row[2].endswith("24 May") and row[3] == 11


#: Words and the terms they count as; none for stop words.
TERMS = {"revenue": "revenue", "growth": "growth", "margin": "margin", "was": None, "the": None, "reported": "report", "5.2b": "5.2b", "costs": "cost", "running": "runn", "prices": "price"}


def terms(text):
    return [TERMS[w] for w in (text or "").split() if TERMS[w]]


def random_traces(n=20, seed=2):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(list(TERMS)) for _ in range(n))
    return [(i, text(6), text(9), [text(8) for _ in range(i % 4)], 1) for i in range(n)]


def test_profile_by_hand(spark):
    rows = random_traces()
    df = spark.createDataFrame(rows, TRACE)
    got = {r.trace_id: r for r in M.lexical(M.profile(df)).collect()}
    facts = {r.trace_id: r for r in M.facts(df).collect()}
    best = {r.trace_id: r.recall_context for r in M.recall_context(df).collect()}
    for i, q, a, c, _ in rows:
        docs = [terms(x) for x in (*c, a, q)]
        idf = {t: math.log((len(docs) + 1) / (sum(t in d for d in docs) + 1)) + 1 for d in docs for t in d}
        A, Q, C = terms(a), terms(q), [t for x in c for t in terms(x)]
        over = lambda x, y: sum(idf[t] * min(x.count(t), y.count(t)) for t in set(x)) / max(1e-300, sum(idf[t] * x.count(t) for t in set(x)))
        for have in (got[i], facts[i]):
            assert abs(have.precision_token - over(A, C)) < 1e-9
            assert abs(have.answer_covers_question - over(Q, A)) < 1e-9
        assert len(facts[i].contexts) == sum(bool(terms(x)) for x in c)
        for f in facts[i].contexts:
            x = terms(c[f.no])
            assert f.dl == len(x) and abs(f.hit / f.weight - over(x, A)) < 1e-9
        if c:
            sizes = [len(terms(x)) for x in c]
            mean = sum(sizes) / len(sizes)
            score = lambda x: round(sum(idf[t] * x.count(t) * 2.2 / (x.count(t) + 1.2 * (0.25 + 0.75 * (len(x) / mean if mean else 1))) for t in set(A) if t in x), 12)
            top = max(range(len(c)), key=lambda k: (score(terms(c[k])), -k))
            assert abs(best[i] - over(terms(c[top]), A)) < 1e-9


def test_report_equals_its_parts(spark):
    df = spark.createDataFrame([r for r in random_traces(16, 5) if r[3]], TRACE)
    report = {r.trace_id: r for r in build_report(df, ReportConfig(entities=False)).collect()}
    for part in (M.unsupported_extras(df), M.quickwins(df), M.sentence_summary(df), M.simple_scores(df), M.recall_context(df)):
        for r in part.collect():
            for name in (c for c in part.columns if c in report[r.trace_id].__fields__):
                x, y = r[name], report[r.trace_id][name]
                assert x == y or abs(x - y) < 1e-4, name
    for part, name in ((M.supported_terms(M.profile(df)), "supported_terms"), (M.unsupported_terms(M.profile(df)), "unsupported_terms")):
        found = {}
        for r in sorted(part.collect(), key=lambda r: r["rank"]):
            found.setdefault(r.trace_id, []).append((r.term, r.cnt, r.idf))
        for i, r in report.items():
            assert [(t.term, t.cnt, t.idf) for t in r[name]] == found.get(i, [])


def test_report_paths(spark):
    rows = [
        (1, "What was revenue?", "Revenue was $5.2B. Growth was 12%.", ["Revenue of $5.2B was reported, growth 12%."], 1),
        (2, "q", None, ["ctx"], 0),
        (3, "q", "  ", [], 0),
        (4, "What now?", "Costs rose 3% now.", [], 0),
        (5, "What now?", "Costs rose 3% now.", [""], 0),
        (6, None, "words here", None, 1),
    ]
    report = build_report(spark.createDataFrame(rows, TRACE))
    got = {r.trace_id: r for r in report.collect()}
    assert len(got) == 6
    assert got[1].numeric_match == 1.0 and got[1].entity_overall == 1.0 and 0 < got[1].precision_token <= 1
    assert got[2].precision_token is None and got[2].numeric_match is None
    assert got[4].precision_token is None and got[4].numeric_match == 0.0 and got[4].entity_overall is None
    assert got[5].precision_token == 0.0 and got[5].entity_overall == 0.0
    assert got[6].precision_token is None and got[6].num_contexts is None
    flat = feature_rows(report)
    assert flat.columns == ["trace_id", "y", *FLAT]
    values = flat.collect()
    assert all(v is not None for r in values for v in r)
    assert "precision_token" in varying(flat, list(FLAT)) and "entity_match.PHONE__len" not in varying(flat, list(FLAT))


def test_figures_of_one_record(spark):
    """Four documents; a term in k of them weighs ln(5 / (k + 1)) + 1."""
    one, two, three = (math.log(5 / (k + 1)) + 1 for k in (1, 2, 3))
    row = (1, "How tall is the tower?", "The tower is tall, red and haunted.", ["The tower was painted red.", "A tall mast stands nearby."], 1)
    df = spark.createDataFrame([row], TRACE)
    r = build_report(df).first()
    whole = 2 * three + two + one  # tower, tall, red, haunt
    assert r.precision_token == round((2 * three + two) / whole, 4)
    assert r.answer_covers_question == round(2 * three / (2 * three + one), 4)  # how, tall, tower
    assert r.cosine_tfidf == round(2 * three**2 / math.sqrt((2 * three**2 + two**2 + one**2) * (2 * three**2 + one**2)), 4)
    # tower, paint, red is the context that the answer has most of
    assert r.recall_context == round((three + two) / (three + two + one), 4) and r.best_context_len == 3
    assert [(t.term, t.impact) for t in r.unsupported_terms] == [("haunt", round(one, 4))]
    assert (r.a_len, r.q_len, r.qa_len_ratio, r.unsupported_term_rate, r.unsupported_mass) == (4, 3, 1.3333, 0.25, round(1 - r.precision_token, 4))
    assert r.summary == f"{round(r.precision_token * 100, 1)}% grounded; {round((three + two) / (three + two + one) * 100, 1)}% best-context recall; 100.0% numeric; 100.0% entity; Q↔A tfidf {round(r.cosine_tfidf, 2)}."


def test_unsupported_and_supported_split_the_answer(spark):
    df = spark.createDataFrame([(1, "q word", "alpha beta beta gamma", ["beta delta"], 1)], TRACE)
    prof = M.profile(df)
    un, su = M.unsupported_terms(prof).collect(), M.supported_terms(prof).collect()
    assert [(r.term, r.cnt, r["rank"]) for r in sorted(un, key=lambda r: r["rank"])] == [("alpha", 1, 1), ("gamma", 1, 2)]
    assert [(r.term, r.cnt) for r in su] == [("beta", 2)]
    extras = M.unsupported_extras(df).first()
    assert abs(extras.unsupported_mass + M.lexical(prof).first().precision_token - 1) < 1e-4


def test_sources(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"q": "a", "a": "b", "c": ["x"], "y": 1, "reason": "r"}]')
    assert readers.read_json_traces(spark, str(tmp_path / "t.json")).first().c == ["x"]
    (tmp_path / "t.csv").write_text('question,answer,chunk2,chunk10,chunk1,abstained,answer_type\nq,a,two,ten,,True,fact\n')
    row = readers.read_csv_traces(spark, str(tmp_path / "t.csv")).first()
    assert row.c == ["two", "ten"] and row.y == 0 and row.answer_type == "fact"
    assert readers.chunk_columns(["chunkx", "Chunk3", "chunk1", "other"]) == ["chunk1", "Chunk3", "chunkx"]
    fixed = spark.createDataFrame([('noise [{"a": 1,},] tail',)], "t string").select(readers.repaired_json(F.col("t"))).first()[0]
    assert fixed == '[{"a": 1}]'


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "q one two three four", "Paid $5 for it", ["It cost $5"], 1)], TRACE)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = scored_stream(stream).writeStream.format("memory").queryName("scores").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("scores").first().numeric_match == 1.0


def test_spans_and_sentences_of_a_report(spark):
    a = "Costs rose. Ships sailed on. Costs rose."
    rows = [(1, "q", a, ["The costs rose."], 1), (2, "q", "Été ended.", ["nothing"], 1)]
    got = {r.trace_id: r for r in build_report(spark.createDataFrame(rows, TRACE)).collect()}
    per = got[1].supported_terms_per_sentence
    assert [s.sentence for s in per] == ["Costs rose.", "Ships sailed on.", "Costs rose."]
    assert [[(t.term, a[t.start : t.end]) for t in s.supported_terms] for s in per] == [[("cost", "Costs"), ("rose", "rose")], [], [("cost", "Costs"), ("rose", "rose")]]
    assert [[t.term for t in s.unsupported_terms] for s in got[1].unsupported_terms_per_sentence] == [[], ["sail", "ship"], []]
    assert got[1].per_sentence == [1.0, 0.0, 1.0]
    spans = spark.createDataFrame(rows, TRACE).select(X.token_spans(F.col("a")).alias("s"), X.tokens(F.col("a")).alias("t"), "a").collect()
    for r in spans:
        assert [s.token for s in r.s] == r.t and all(r.a[s.start : s.end] == s.token for s in r.s)


def test_entities_of_a_report(spark):
    rows = [(1, "q", "It cost $20, then $30 and 5%.", ["It cost $20 at first.", "Later 5% more, or $31."], 1), (2, "q", "No figure here.", ["ctx $5"], 1)]
    got = {r.trace_id: r for r in build_report(spark.createDataFrame(rows, TRACE)).collect()}
    m = got[1].entity_match
    assert m.overall == 0.6667 and m.unsupported == ["MONEY:30.0:USD"] and got[1].unsupported_numbers == ["MONEY:30.0:USD"]
    assert m.presence_by_type["MONEY"] == m.presence_by_type["PERCENT"] == 1 and m.presence_by_type["DATE"] == 0
    assert m.all_matched_by_type["MONEY"] == 0 and m.state_by_type["PERCENT"] == 1.0
    assert got[1].supported_entities["count"] == 2 and got[1].supported_entities.by_type == {"MONEY": 1, "PERCENT": 1}
    assert got[2].entity_match.overall == 1.0 and got[2].entity_match.presence_by_type == {}


def _lengths():
    return lambda texts: [[float(len(t)), 1.0 + t.count("a")] for t in texts]


def _words():
    return lambda text: ([w for w in text.lower().split() if len(w) > 3], text.lower().split()[:1])


def test_models_as_hooks(spark):
    rows = [(1, "abc anna", "a banana tree", ["trees are tall", "banana cake"], 1), (2, "", "only an answer", ["only"], 1)]
    config = ReportConfig(embed=_lengths, pos=_words)
    got = {r.trace_id: r for r in build_report(spark.createDataFrame(rows, TRACE), config).collect()}
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
    v = lambda t: [float(len(t)), 1.0 + t.count("a")]
    near = [cos(v(rows[0][2]), v(c)) for c in rows[0][3]]
    assert got[1].cosine_embed == round(cos(v(rows[0][1]), v(rows[0][2])), 4)
    assert got[1].best_context_similarity == round(max(near), 4) and got[1].answer_context_similarity == round(sum(near) / 2, 4)
    assert got[1].answer_covers_question_sem == 1.0 and got[1].inference_sem_score is not None and "A↔C embed" in got[1].summary
    longest = near.index(max(near))
    size = len([w for w in rows[0][3][longest].split() if w not in X.STOPWORDS])
    precision = M.lexical(M.profile(spark.createDataFrame(rows[:1], TRACE))).first().precision_token
    assert abs(got[1].semantic_gap - round(sum(near) / 2 * precision / size, 4)) <= 1e-4
    assert got[1].content_term_support_rate == 0.5 and got[1].head_noun_support_rate == 0.0
    assert got[2].cosine_embed is None and got[2].answer_novelty_ratio is None and got[2].head_noun_support_rate == 1.0


def test_semantic_of_given_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 1.0], [[1.0, 0.0], [0.0, 1.0]], 0.5, 0.9, 2, 4)], "trace_id long, qe array<double>, ae array<double>, ce array<array<double>>, precision_token double, answer_covers_question double, n_sentences long, best_context_len long")
    r = semantic(rows).first()
    assert r.cosine_embed == r.best_context_similarity == r.answer_context_similarity == 0.7071
    assert (r.per_sentence_semantic_alignment, r.answer_novelty_ratio, r.semantic_gap, r.qa_context_coverage_gap) == (0.3536, 0.7071, 0.0884, 0.1929)


def test_feature_lists_and_skipped_rows(spark):
    assert feature_names(("qr_alignment",)) == [n for n in FLAT if n.startswith("qr_alignment.")]
    assert feature_names(("entity_match.*DATE",)) == ["entity_match.presence_by_type.DATE", "entity_match.all_matched_by_type.DATE"]
    assert feature_names(("*_frac", "a_len")) == ["a_len", "low_frac", "medium_frac", "high_frac"]
    rows = spark.createDataFrame([(1, "q", "a", ["c"], 1), (2, "q", None, ["c"], 1), (None, "q", "a", ["c"], 0), (4, "q", "a", None, 0)], TRACE)
    good, bad = usable(rows)
    assert [r.trace_id for r in good.collect()] == [1]
    assert sorted(r.error for r in bad.collect()) == ["no answer", "no contexts", "no trace_id"]
    alone = answer_report(good.drop("q")).first()
    assert alone.q_len == 0 and alone.answer_covers_question == 0.0


def test_best_context_without_bm25(spark):
    # the short context lies in the answer as a whole, the long one shares more of it
    df = spark.createDataFrame([(1, "q", "alpha beta gamma delta", ["alpha beta gamma omega sigma tau", "delta"], 1)], TRACE)
    assert build_report(df).first().best_context_len == 6
    assert build_report(df, ReportConfig(bm25=False)).first().best_context_len == 1


def test_terms_in_python_are_those_of_catalyst(spark):
    rng = random.Random(3)
    alphabet = "abcsdengiSEDING0123456789$%.-_,'éÉßΣσς٣ "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(400)] + ["The 1,200.5 ships; this 5% of $1,200.00 was Running"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.tokens(F.col("t")).alias("k")).select("t", "k", F.transform("k", lambda x: X.lemma(x)).alias("l")).withColumn("i", F.filter("l", lambda x: X.informative(x))).collect()
    for r in rows:
        assert [X.lemma_of(k) for k in r.k] == r.l and [t for k in r.k if (t := X.term_of(k))] == r.i
        assert X.term_counts(r.t) == {t: r.i.count(t) for t in r.i}
    for k in range(X.REMEMBERED + 5):
        X.term_of(f"w{k}x")
    assert len(X._known) <= X.REMEMBERED


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_metrics_stay_with_their_row(spark):
    df = spark.createDataFrame(random_traces(6), TRACE)
    prof = M.profile(df)
    local = {"profile": prof, "supported": M.supported_terms(prof), "unsupported": M.unsupported_terms(prof), "facts": M.facts(df), "extras": M.unsupported_extras(df), "quickwins": M.quickwins(df), "bm25": M.bm25(df), "best": M.best_context(df), "recall": M.recall_context(df), "sentence": M.sentence_precision(df), "summary": M.sentence_summary(df), "report": feature_rows(build_report(df))}
    for name, made in local.items():
        plan = _plan(made)
        assert not any(x in plan for x in ("Join", "Aggregate", "Window", "Repartition", "Sort ")), name
        assert plan.count("run(") <= 3, name
    # the report's entities ask nothing of its terms
    assert "precision_token" not in _plan(build_report(df, ReportConfig(inference=False)).select("trace_id", "unsupported_entity_count"))


def test_steps_give_every_row(spark):
    rows = [(i, "one two", "alpha beta. Gamma delta" if i % 3 else None, ["alpha", None, ""][: i % 4], 1) for i in range(2 * X.STEP + 7)]
    df = spark.createDataFrame(rows, TRACE).coalesce(1)
    got = {r.trace_id: r for r in build_report(df, ReportConfig(entities=False)).collect()}
    assert len(got) == len(rows)
    for i, *_ in rows:
        per = got[i].supported_terms_per_sentence
        assert [s.sentence for s in per] == (["alpha beta.", "Gamma delta"] if i % 3 else [])
        assert [t.term for s in per for t in s.supported_terms] == (["alpha"] if i % 3 and i % 4 else [])
    scores = M.bm25(df).where("trace_id = 7").orderBy("no").collect()
    assert [r.no for r in scores] == [0, 1, 2] and scores[0].score > 0 == scores[1].score and scores[1].dl == 0
