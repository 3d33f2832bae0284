import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from groundspark.llm import suffix, vector_dedup
from groundspark.llm.common import components
from groundspark.llm.minhash import minhash_groups
from groundspark.llm.substring import substring_dedup
from groundspark.llm.suffix import front_code, front_decode, merge_runs, suffix_dedup, without_repeats
from groundspark.llm.vector_dedup import planned_passes, vector_groups


def roots(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("local", [0, 1000])
def test_components(spark, local):
    rng = random.Random(local)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(12)] + [(5, 5)]
    got = components(spark.createDataFrame(edges, "a long, b long"), local_edges=local).collect()
    touched = {x for a, b in edges if a != b for x in (a, b)}
    want = roots(touched, edges)
    assert {r.id: r.component_id for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long"), local_edges=local).count() == 0


@pytest.mark.parametrize("k", [2, 5])
def test_minhash(spark, docs, empty, k):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*(w[j:] for j in range(k)))) if len(w) >= k else {tuple(w)} if w else set()
    ids = [i for i in sets if i is not None]
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(ids, links)
    got = minhash_groups(docs, k).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id == r.component_id)
    assert minhash_groups(empty, k).count() == 0


def test_substring(spark, docs, empty):
    unique = {}
    for r in docs.collect():
        unique[r.doc_id] = r.text
    seen, want = set(), {}
    for i in sorted(unique, key=lambda i: (i is not None, i or 0)):
        w = (unique[i] or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    got = substring_dedup(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
    assert substring_dedup(empty).count() == 0


def brute_suffix(texts, window=200):
    count = Counter(b[k : k + window] for b in texts for k in range(len(b) - window + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1):
            if count[b[k : k + window]] > 1:
                gone[k : k + window] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left))
    return out


@pytest.mark.parametrize("group", [suffix.GROUP, 1])
def test_suffix(spark, docs, empty, group, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP", group)
    rows = docs.collect()
    want = defaultdict(set)
    found = brute_suffix([(r.text or "").encode() for r in rows])
    for r, f in zip(rows, found):
        want[r.doc_id].add(f[:4])
    got = suffix_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] in want[r.doc_id]
    if group > 1:
        cut = without_repeats(docs)
        assert cut.columns == docs.columns and cut.count() == len(rows)
        texts = {r.doc_id: f[4].decode("utf-8", "ignore") for r, f in zip(rows, found) if r.text is not None}
        assert all(r.text == texts.get(r.doc_id) for r in cut.collect())
        assert suffix_dedup(empty).count() == 0


def test_merge_runs():
    rng = random.Random(9)
    for runs in (1, 2, 3, 7):
        made = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30))) for _ in range(runs)]
        merged = list(merge_runs([front_decode(*front_code(r)) for r in made]))
        order, lcps, strings = [m[:2] for m in merged], [m[2] for m in merged], [m[3] for m in merged]
        assert strings == sorted(s for r in made for s in r)
        assert [made[a][b] for a, b in order] == strings
        last = b""
        for k, s in zip(lcps, strings):
            assert k == next((i for i, (x, y) in enumerate(zip(last, s)) if x != y), min(len(last), len(s)))
            last = s


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 16))
    rows = []
    for i in range(120):
        v = base[i % 30] + rng.standard_normal(16) * (0.02 if i % 3 else 1.0)
        rows.append((i, [float(x) for x in v], i % 2, "clash"))
    rows += [(200 + i, rows[7][1], 1, "c") for i in range(5)] + [(300, None, 1, "c"), (301, [0.0] * 16, 1, "c"), (302, [float("nan")] * 16, 1, "c"), (303, [1.0, None], 1, "c"), (304, rows[7][1], None, "c"), (305, [], 0, "c"), (306, [1.0, 2.0], 1, "c"), (307, [1.0, 2.1], 1, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string")
    good = [(i, np.array(v), l) for i, v, l, _ in rows if v and l is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for a, x, l in good for b, y, m in good if a < b and l == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93]
    want, degree = roots([r[0] for r in rows], links), Counter(x for p in links for x in p)
    got = vector_groups(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.component_id, r.n_links, r.kept) == (want[r.vec_id], degree[r.vec_id], r.vec_id == want[r.vec_id])
    assert vector_groups(df.limit(0)).count() == 0
    assert planned_passes(10**9, 0.93) > planned_passes(10**5, 0.93) >= 12


@pytest.mark.parametrize("n, whole", [(24_000, 0), (101_000, vector_dedup.WHOLE)])
def test_vectors_that_share_a_direction(spark, n, whole, monkeypatch, tmp_path):
    """Pairs at the threshold in one label whose mean cosine is 0.7, by passes alone and whole."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    monkeypatch.setattr(vector_dedup, "WHOLE", whole)
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = unit(np.sqrt(0.7) * unit(np.ones((1, 64))) + np.sqrt(0.3) * unit(rng.standard_normal((n, 64))))
    first = rows[:1000]
    aside = rng.standard_normal((1000, 64))
    aside = unit(aside - (aside * first).sum(axis=1, keepdims=True) * first)
    rows[1000:2000] = 0.935 * first + np.sqrt(1 - 0.935**2) * aside
    flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), 64).cast(pa.list_(pa.float64()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": flat, "label": np.zeros(n, np.int32)}), f"{tmp_path}/v.parquet", row_group_size=8192)
    to = {r.vec_id: r.component_id for r in vector_groups(spark.read.parquet(f"{tmp_path}/v.parquet")).where("vec_id < 2000").collect()}
    assert sum(to[i] != to[1000 + i] for i in range(1000)) == 0


@pytest.mark.parametrize("whole", [0, vector_dedup.WHOLE])
def test_vectors_of_any_size_on_one_path(spark, whole, monkeypatch):
    """Every label goes through the passes, and none loses a link that few small blocks meet."""
    calls, passes = [], vector_dedup.pass_edges
    monkeypatch.setattr(vector_dedup, "pass_edges", lambda *given: calls.append(1) or passes(*given))
    for name, value in (("WHOLE", whole), ("BLOCK", 4), ("AHEAD", 1), ("SQUARE", 100)):
        monkeypatch.setattr(vector_dedup, name, value)
    rng = np.random.default_rng(31)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.standard_normal((3, 64)))
    rows = unit(base[np.arange(600) % 3] + np.sqrt(0.16 / 64) * rng.standard_normal((600, 64)))
    rows[597:] = rows[594] + 0.01 * rows[:3]
    label = np.where(np.arange(600) < 591, 0, np.where(np.arange(600) < 597, 1, 2))
    cosine = unit(rows) @ unit(rows).T
    near = (cosine >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(600, dtype=bool)
    want = roots(range(600), np.argwhere(np.triu(near)).tolist())
    assert near[:591].any() and near[597:].any() and abs(cosine - 0.93).min() > 1e-9
    df = spark.createDataFrame([(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(rows, label))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.component_id, r.n_links, r.kept) for r in vector_groups(df).collect()}
    assert calls
    assert {i: g for i, g in got.items() if g != (want[i], near[i].sum(), want[i] == i)} == {} and len(got) == 600


def test_suffix_tells_rows_of_one_id_apart(spark):
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = letters(300)
    texts = [letters(400) + passage, passage[:250], None, "short", letters(700), letters(90) + passage + letters(500)]
    docs = spark.createDataFrame([(None if i < 4 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = brute_suffix([(t or "").encode() for t in texts])
    want = Counter((None if i < 4 else 7, *f[:4]) for i, f in enumerate(found))
    assert Counter(map(tuple, suffix_dedup(docs).collect())) == want
    left = Counter(f[4].decode() if t is not None else None for t, f in zip(texts, found))
    assert Counter(r.text for r in without_repeats(docs).collect()) == left


def test_minhash_at_a_low_percent(spark):
    """Pairs at 0.4 and more that share their buckets with smaller ids of other texts."""
    rng = random.Random(17)
    vocabulary = [f"w{i}" for i in range(100)]
    sets = {i: set(rng.sample(vocabulary, 30)) for i in range(60)}
    for i in range(10):
        own = rng.sample(vocabulary, 42)
        sets[100 + i], sets[200 + i] = set(own[:30]), set(own[12:])
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 40 * len(sets[a] | sets[b])]
    df = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in sets.items()], "doc_id long, text string")
    got = minhash_groups(df, k=1, percent=40, bands=140, rows=1).collect()
    assert {r.doc_id: r.component_id for r in got} == roots(sets, links)


def test_minhash_of_a_large_group_edited_more_and_less(spark):
    """Three thousand copies of one text, from untouched to changed in a third: no link is lost
    that joins components, and nothing is joined that doesn't link."""
    rng = random.Random(31)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = []
    for i in range(3000):
        own = list(base)
        for _ in range(rng.randrange(22)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(own)
    sets = [set(zip(t, t[1:])) for t in texts]
    common = {g: k for k, g in enumerate(g for g, n in Counter(g for s in sets for g in s).items() if n > 1)}
    held = np.zeros((len(sets), len(common)), np.float32)
    for i, s in enumerate(sets):
        held[i, [common[g] for g in s if g in common]] = 1
    both, sizes = held @ held.T, np.array([len(s) for s in sets])
    a, b = np.nonzero(100 * both >= 80 * (sizes[:, None] + sizes[None, :] - both))
    want = roots(range(len(sets)), [(int(x), int(y)) for x, y in zip(a, b) if x < y])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.component_id for r in minhash_groups(df, k=2).collect()}
    assert 100 < len(set(want.values())) < 2900
    assert sum(got[i] != want[i] for i in want) == 0


def test_substring_tells_rows_without_an_id_apart(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    passage = words(30)
    rows = [(None, words(50) + " " + passage), (None, words(3)), (None, None), (4, passage + " " + words(5)), (5, passage), (5, passage), (6, words(400) + " " + passage + " " + words(9) + " " + passage)]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(None, 80, 0), (None, 3, 0), (None, 0, 0), (4, 35, 30), (5, 30, 30), (5, 30, 30), (6, 469, 60)])


def test_anchors_do_not_depend_on_what_stands_around():
    from groundspark.llm.anchors import anchors

    rng = np.random.default_rng(8)
    text = rng.integers(0, 3, 500).astype(np.uint64)
    alone = anchors(text, np.array([500]), 40, 8)
    for before in (1, 1000, 70_000):
        around = rng.integers(0, 3, before).astype(np.uint64)
        at, index, place, hashes = anchors(np.concatenate([around, text]), np.array([before, 500]), 40, 8)
        own = at >= before
        assert (at[own] - before == alone[0]).all() and (place[index[own]] - before == alone[2][alone[1]]).all()


def test_the_sketch_loses_no_repeat_when_full(spark):
    from groundspark.llm import substring

    rng = random.Random(14)
    texts = [" ".join(f"t{rng.randrange(60)}" for _ in range(400)) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:20])], "doc_id long, text string")
    bits = substring.sketch(df, substring.anchor_hashes(20, 6), 11)
    assert all(np.unpackbits(b).mean() > 0.5 for b in bits)
    found = substring.suspects(df, spark.sparkContext.broadcast(bits), 20, 6).where("hash is not null")
    assert found.count() > 0.5 * 60 * 381  # most windows pass, repeated or not
    got = {r.doc_id: r.n_removed for r in substring_dedup(df).collect()}
    assert all(got[60 + i] == 400 for i in range(20)) and not any(got[i] for i in range(60))
