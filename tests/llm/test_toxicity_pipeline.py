import random
import zlib

import numpy as np

import pyarrow as pa
import public_tokenizers

import corpus_pipeline
from groundspark.llm import common
from groundspark.llm.bpe import Codec, encode_documents
from groundspark.llm.minhash import Circulant, signatures
from groundspark.llm.toxicity import Field, features, fit, fit_chain, marginals, score_documents, train, training_rows, without_toxic

from .conftest import prose


def test_marginals_equal_dense_forward_backward():
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 40):
        model = Field(bias=-1.5, start=rng.standard_normal(2), move=rng.standard_normal((2, 2)))
        places = np.unique(rng.integers(0, n, 4))
        scores = rng.standard_normal(len(places)) * 3
        u = np.full(n, model.bias)
        u[places] += scores
        emit = np.exp(np.stack([np.zeros(n), u], axis=1))
        step = np.exp(model.move)
        ahead, behind = [np.exp(model.start) * emit[0]], [np.ones(2)]
        for t in range(1, n):
            ahead.append((ahead[-1] @ step) * emit[t])
        for t in range(n - 1, 0, -1):
            behind.append(step @ (emit[t] * behind[-1]))
        both = np.array(ahead) * np.array(behind[::-1])
        assert np.allclose(marginals(model, places, scores, n), (both / both.sum(1, keepdims=True))[places, 1])


def labelled(spark, n=400):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(30, 90)).split()
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["vilefolk", "vilething", "nasty,"]))
        docs.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, 1, int(toxic)))
    docs += [(1000, None, "en", "a", 1), (1001, "", "en", "a", 1), (1002, "nasty", None, None, None), (None, "calm words", "en", "a", 1)]
    labels += [(None, 1, 1), (1001, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = train(docs, labels)
    got = {r.doc_id: r for r in score_documents(docs, model).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.toxic is not None}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i in truth)
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert got[1000].predicted == got[1001].predicted == 0 and 0 <= got[1000].score <= 1
    texts = {r.doc_id: r.text for r in docs.collect()}
    spans = [texts[i][s.start : s.end] for i in held for s in got[i].spans]
    assert spans and all(s.startswith(("vile", "nasty")) for s in spans)
    left = without_toxic(docs, model)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, r in got.items() if r.predicted == 0}
    assert score_documents(docs.limit(0), model).count() == 0


def test_nothing_to_learn(spark):
    docs, labels = labelled(spark, 20)
    model = train(docs, labels.limit(0))
    assert all(r.score == 0.0 and r.predicted == 0 for r in score_documents(docs, model).collect())
    assert fit([], []).weights == {} and features("...") == []


def test_pipeline(spark, tmp_path):
    docs, labels = labelled(spark, 150)
    rng = random.Random(5)
    passage = prose(rng, 70)
    more = [(2000 + i, prose(rng, 40) + " " + passage + " " + prose(rng, 40), "en", "b", 1) for i in range(3)]
    copy = prose(rng, 80)
    more += [(3000 + i, copy, "en", "b", 1) for i in range(3)]
    docs = docs.where("doc_id is not null").unionByName(spark.createDataFrame(more, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        seen.append({r.doc_id for r in out.collect()})
        if name != "bpe":
            assert out.columns == now.columns
        now = out
        if name == "suffix_array_dedup":
            assert not any(passage in (r.text or "") for r in out.collect())
    assert not any(i % 5 == 0 for i in seen[0] if i < 150)
    assert {i for i in seen[1] if i >= 3000} == {3000} and {i for i in seen[1] if 2000 <= i < 3000} == {2000, 2001, 2002}
    assert seen[2] == seen[1]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_keeps_one_of_rows_that_share_an_id_or_have_none(spark):
    rng = random.Random(15)
    texts = [prose(rng, 90) for _ in range(4)]
    rows = [(1, texts[0]), (1, texts[0]), (None, texts[1]), (None, texts[1]), (2, texts[2]), (None, texts[2]), (3, texts[3]), (3, prose(rng, 90)), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    one = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    want = sorted(map(str, [rows[0], rows[2], rows[4], *rows[6:]]))
    assert one.columns == docs.columns and sorted(str((r.doc_id, r.text)) for r in one.collect()) == want
    left = corpus_pipeline.drop_repeats(spark, one, "")
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == want


def test_support_counts_all_contexts():
    rng = random.Random(21)
    toxic = [" ".join(f"{prose(rng, 1)}{rng.randrange(10**6)} vilething {prose(rng, 1)}{rng.randrange(10**6)}" for _ in range(30)) for _ in range(100)]
    clean = [" ".join([prose(rng, 90)] + ["vilething"] * (i < 70)) for i in range(500)]
    model = fit(toxic + clean, [1] * 100 + [0] * 500)
    assert model.weights.get("wvilething", 0) > 0
    assert fit(["", "calm words"], [1, 0]).weights == {}


def chain_likelihood(weights, bias, start, move, chains, ridge=1e-3):
    """Penalised log likelihood of labelled chains by all their label sequences."""
    from itertools import product

    total = -ridge / 2 * (np.sum(weights**2) + np.sum(move**2))
    for ids, owners, y in chains:
        u = np.full(len(y), bias)
        np.add.at(u, owners, weights[ids])

        def score(z):
            return start[z[0]] + sum(u[i] for i in range(len(z)) if z[i]) + sum(move[z[i - 1], z[i]] for i in range(1, len(z)))

        every = np.array([score(z) for z in product((0, 1), repeat=len(y))])
        total += score(tuple(y)) - (every.max() + np.log(np.exp(every - every.max()).sum()))
    return total


def test_fit_is_a_maximum():
    rng = np.random.default_rng(12)
    chains = []
    for n in (6, 7, 5, 8, 6, 7):
        own = np.sort(rng.choice(n, 3, replace=False))
        ids = rng.integers(0, 3, 3)
        y = np.zeros(n, np.int8)
        y[own] = (ids == 0) | (rng.random(3) < 0.3)
        chains.append((ids, own, y))
    fitted = fit_chain([c[0] for c in chains], [c[1] for c in chains], [c[2] for c in chains], 3, rounds=3000)
    best = chain_likelihood(*map(np.asarray, fitted), chains)
    for _ in range(100):
        w, b, s, m = (np.asarray(x) + rng.standard_normal(np.shape(x)) * 0.1 for x in fitted)
        assert chain_likelihood(w, b, s, m, chains) <= best + 1e-2


def test_sample_is_bounded_by_ids(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(3, "x"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (4, 0), (None, 1)], "doc_id long, toxic int")
    rows = training_rows(docs, labels, 2, 2)
    assert len(rows) == len({r[2] for r in rows}) <= 3 and [r for r in rows if r[2] == 1] in ([("text 0", 1, 1)], [])


def test_stages_on_every_awkward_row(spark, docs, empty, tmp_path):
    """Nulls, repeats, ties, empty and long texts, clashing names; then an empty table."""
    spark.createDataFrame([(i, 1, int(i % 2)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "bpe":
            assert out.columns == docs.columns
            assert all(r["a.b"] == r["_runs"] == r["_copy"] == r["row_number"] == "clash" for r in out.collect())
        rows = out.count()
        assert rows > 0
        if name == "minhash_near_dedup":
            kept = [(r.doc_id, r.text) for r in out.collect()]
            assert len([k for k in kept if k[0] == 5]) == 1 and (70, None) in kept and (71, "") in kept
        assert stage(spark, empty, str(tmp_path)).count() == 0
        now = out


def test_workers_drop_what_other_operators_kept(spark, docs):
    """Workers live on from stage to stage; of the large things that one builds, the next must not hold any."""

    def make():
        def each(batch):
            import gc
            import os

            n = [sum(isinstance(x, kind) for x in gc.get_objects()) for kind in (Codec, Circulant)]
            yield common.batch_of(["worker", "codecs", "circulants"], [pa.array([x]) for x in (os.getpid(), *n)])

        return each

    rows = docs.select("doc_id", "text").repartition(8)
    probe = common.arrow_map(spark.range(8).repartition(8), make, "worker long, codecs long, circulants long")
    for run in (lambda: signatures(rows, 5), lambda: encode_documents(spark, rows, public_tokenizers.path("byte_bpe_50k.json"))):
        run().collect()
        assert all(r.codecs == r.circulants == 0 for r in probe.collect())


def test_a_worker_keeps_for_tasks_of_one_kind():
    built = []

    def build():
        built.append(object())
        return built[-1]

    common.keep_only("a")
    first = common.kept("a", build)
    common.keep_only("a")
    assert common.kept("a", build) is first and len(built) == 1
    common.keep_only(None)
    assert common.kept("a", build) is not first and len(built) == 2
    common.keep_only(None)


def test_a_batch_is_not_held_while_the_next_is_read():
    class Rows:
        columns = ["x"]

        def toDF(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return run

    def batches():
        for _ in range(3):
            held.append(pa.total_allocated_bytes() - before)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(1 << 17)).take(pa.array(np.arange(1 << 17)))], ["x"])
        held.append(pa.total_allocated_bytes() - before)

    def make():
        return lambda batch: iter([batch.num_rows])

    before, held = pa.total_allocated_bytes(), []
    assert sum(common.arrow_map(Rows(), make, "x double")(batches())) == 3 << 17
    assert max(held) < 1 << 20
