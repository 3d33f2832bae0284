"""Toxicity by a linear-chain conditional random field.

Labels mark documents, so tokens are labelled first: a feature (a word or the start of
one) that occurs in many different contexts of toxic documents and hardly ever in clean
ones marks its tokens in toxic documents; all tokens of clean documents are clean. The
field is fitted to these labelled tokens. A document's score comes from the
forward-backward marginals of its tokens; tokens whose marginal is high are its
offending spans.
"""

from __future__ import annotations

import math
from array import array
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, arrow_map, batch_of, words_of

#: Most labelled toxic and clean documents that the fit sees; the only bounds on its input.
TOXIC_ROWS, CLEAN_ROWS = 500, 2500
#: Contexts in toxic documents that a marking feature needs, its odds against clean ones, and
#: by how much (natural log) it must fit better than a feature that toxicity doesn't move.
MIN_CONTEXTS, MIN_ODDS, MIN_GAIN = 4, 20.0, 12.0
PREFIXES = (4, 5)
SEGMENT = 128
#: Words whose evidence a worker remembers.
MEMO_ENTRIES = 200_000
_EDGE = ".,:;!?|()[]{}\"'`*-_"
_WORD = re.compile(WORD_PATTERN)


def features(word: str) -> list[str]:
    """The word itself and its starts, without case and outer punctuation."""
    word = word.lower().strip(_EDGE)
    return ["w" + word, *(f"p{word[:k]}" for k in PREFIXES if len(word) > k)] if word else []


@dataclass
class Field:
    """Weights of state 1 over state 0, and log potentials of start and of moves."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: Logistic of the document score: constant, of the largest marginal's logit, of the log of the marginals' sum.
    link: np.ndarray = field(default_factory=lambda: np.array([-6.0, 1.0, 1.0]))

    def evidence(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))


def marginals(model: Field, places: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """P(state 1) of the tokens at ``places`` of a chain of ``n`` tokens.

    The tokens between have no evidence, so a gap multiplies by a power of one 2 x 2 matrix,
    and forward-backward visits only the tokens with evidence. Exact for the whole chain.
    """
    neutral = np.exp(model.move) * np.exp([0.0, model.bias])[None, :]  # from row to column, then emit
    values, vectors = np.linalg.eig(neutral)
    inverse = np.linalg.inv(vectors)
    scale = np.abs(values).max()

    def gap(k: int) -> np.ndarray:
        return np.real(vectors @ np.diag((values / scale) ** k) @ inverse)

    emit = np.exp(np.stack([np.zeros(len(scores)), np.clip(scores, -60, 60)], axis=1))
    m = len(places)
    ahead = np.zeros((m, 2))
    v = np.exp(model.start) * np.exp([0.0, model.bias])  # the first token, before its evidence
    at = 0
    for i in range(m):
        v = v @ gap(int(places[i]) - at) * emit[i]
        v = v / v.sum()
        ahead[i], at = v, int(places[i])
    behind = np.zeros((m, 2))
    v = gap(n - 1 - at) @ np.ones(2) if m else np.ones(2)
    for i in range(m - 1, -1, -1):
        behind[i] = v / v.sum()
        if i:
            v = gap(int(places[i]) - int(places[i - 1])) @ (emit[i] * behind[i])
    both = ahead * behind
    return both[:, 1] / both.sum(axis=1)


def document_score(model: Field, peak: float, total: float) -> float:
    peak = min(max(peak, 1e-9), 1 - 1e-9)
    z = model.link @ np.array([1.0, math.log(peak / (1 - peak)), math.log1p(total)])
    return float(1 / (1 + math.exp(-min(max(z, -40), 40))))


def fit_chain(ids: list[np.ndarray], owners: list[np.ndarray], labels: list[np.ndarray], n_features: int, rounds: int = 60, ridge: float = 1e-3):
    """Maximum conditional likelihood by AdaGrad; each step is one forward-backward pass.

    ids, owners: features of a segment's tokens and the token each belongs to.
    """
    size, count = max(map(len, labels)), len(labels)
    y, live = np.zeros((count, size), np.int8), np.zeros((count, size), bool)
    feature = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    token = np.concatenate([o + k * size for k, o in enumerate(owners)])
    for k, row in enumerate(labels):
        y[k, : len(row)], live[k, : len(row)] = row, True
    weights, bias, start, move = np.zeros(n_features), -2.0, np.zeros(2), np.zeros((2, 2))
    sums = [np.full(n_features, 1e-8), 1e-8, np.full(2, 1e-8), np.full((2, 2), 1e-8)]
    pair_live = live[:, 1:]
    seen_moves = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pair_live).sum() for b in (0, 1)] for a in (0, 1)], float)
    seen_start = np.array([(y[:, 0] == a).sum() for a in (0, 1)], float)
    for _ in range(rounds):
        u = bias + np.bincount(token, weights[feature], minlength=count * size).reshape(count, size)
        emit = np.stack([np.ones_like(u), np.exp(np.clip(u, -30, 30))], axis=2)
        emit[~live] = 1.0
        step = np.exp(move)
        ahead, behind = np.zeros((count, size, 2)), np.ones((count, size, 2))
        v = np.exp(start) * emit[:, 0]
        ahead[:, 0] = v / v.sum(1, keepdims=True)
        for t in range(1, size):
            v = np.where(live[:, t, None], (ahead[:, t - 1] @ step) * emit[:, t], ahead[:, t - 1])
            ahead[:, t] = v / v.sum(1, keepdims=True)
        for t in range(size - 2, -1, -1):
            v = np.where(live[:, t + 1, None], (emit[:, t + 1] * behind[:, t + 1]) @ step.T, 1.0)
            behind[:, t] = v / v.sum(1, keepdims=True)
        p = ahead * behind
        p = p[:, :, 1] / p.sum(2)
        q = ahead[:, :-1, :, None] * step[None, None] * (emit[:, 1:] * behind[:, 1:])[:, :, None, :]
        q = (q / q.sum((2, 3), keepdims=True))[pair_live].sum(0)
        miss = np.where(live, y - p, 0.0)
        slopes = [
            np.bincount(feature, miss.reshape(-1)[token], minlength=n_features) - ridge * weights,
            miss.sum(),
            seen_start - np.array([(1 - p[:, 0]).sum(), p[:, 0].sum()]),
            seen_moves - q - ridge * move,
        ]
        for k, g in enumerate(slopes):
            sums[k] = sums[k] + g * g
        weights = weights + 0.5 * slopes[0] / np.sqrt(sums[0])
        bias = bias + 0.5 * slopes[1] / math.sqrt(sums[1])
        start, move = start + 0.5 * slopes[2] / np.sqrt(sums[2]), move + 0.5 * slopes[3] / np.sqrt(sums[3])
    return weights, float(bias), start, move


def fit(texts: list[str | None], toxic: list[int]) -> Field:
    """Fit on labelled texts. Without both classes the model has no evidence: all score low."""
    model = Field()
    if len(set(toxic)) < 2:
        return model
    docs = [[w.decode("utf-8", "replace") for w in words_of(t)] for t in texts]
    number: dict[str, int] = {}
    numbered: dict[str, list] = {}
    places, around = array("i"), array("q")
    sizes = [0, 0]
    for words, y in zip(docs, toxic):
        sizes[y] += len(words)
        if y:
            for i, w in enumerate(words):
                # copies of a text repeat contexts, so they don't add support
                context = hash((words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""))
                if w not in numbered:
                    numbered[w] = [number.setdefault(f, len(number)) for f in features(w)]
                for f in numbered[w]:
                    places.append(f)
                    around.append(context)
    # all distinct contexts count, as all uses in clean rows do
    own, context = np.array(places, np.int32), np.array(around, np.int64)
    by = np.lexsort((context, own))
    own, context = own[by], context[by]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (context[1:] != context[:-1])
    distinct = np.bincount(own[new], minlength=len(number)).tolist()
    support = {f: distinct[k] for f, k in number.items() if distinct[k] >= MIN_CONTEXTS}
    del own, context, by, new, places, around, numbered
    clean = dict.fromkeys(support, 0)
    known = {w: [f for f in features(w) if f in support] for w in {w for words in docs for w in words}}
    for words, y in zip(docs, toxic):
        if not y:
            for w in words:
                for f in known[w]:
                    clean[f] += 1
    share = sizes[1] / max(1, sum(sizes))

    def marks(f: str) -> bool:
        t, c = support[f], clean[f]
        own = t / (t + c)
        gain = t * math.log(own / share) + (c * math.log((1 - own) / (1 - share)) if c else 0.0)
        return t * (1 - share) >= MIN_ODDS * c * share and own > share and gain >= MIN_GAIN

    chosen = {f: k for k, f in enumerate(sorted(filter(marks, support)))}
    if not chosen:
        return model
    ids, owners, labels = [], [], []
    for words, y in zip(docs, toxic):
        for k in range(0, len(words), SEGMENT):
            part = words[k : k + SEGMENT]
            found = [(chosen[f], i) for i, w in enumerate(part) for f in known[w] if f in chosen]
            if not found and (k or len(labels) % 2):
                continue  # the first segments show the fit what text without evidence is
            ids.append(np.array([f for f, _ in found], np.int64))
            owners.append(np.array([i for _, i in found], np.int64))
            row = np.zeros(len(part), np.int8)
            if y and found:
                row[owners[-1]] = 1
            labels.append(row)
    weights, model.bias, model.start, model.move = fit_chain(ids, owners, labels, len(chosen))
    model.weights = {f: float(weights[k]) for f, k in chosen.items() if abs(weights[k]) > 1e-3}
    # the document's logistic, by Newton steps on the same rows
    rows = []
    for words in docs:
        peak, total, _, _ = _document(model, words, {})
        peak = min(max(peak, 1e-9), 1 - 1e-9)
        rows.append([1.0, math.log(peak / (1 - peak)), math.log1p(total)])
    x, t, b = np.array(rows), np.array(toxic, float), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (t - p) - 0.1 * b
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.1 * np.eye(3)
        b = b + np.linalg.solve(curve, slope)
    model.link = b
    return model


def _document(model: Field, words: list, memo: dict) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Largest marginal, sum of marginals, places with evidence and their marginals."""
    scores = []
    for w in words:
        s = memo.get(w)
        if s is None:
            s = model.evidence(w if isinstance(w, str) else w.decode("utf-8", "replace"))
            if len(memo) >= MEMO_ENTRIES:
                memo.clear()
            if len(w) <= 64:
                memo[w] = s
        scores.append(s)
    flat = np.array(scores)
    places = np.flatnonzero(flat)
    if not len(places):
        # no evidence at all: the middle of a neutral chain
        n = max(1, len(words))
        p = marginals(model, np.array([n // 2 if n > 1 else 0]), np.zeros(1), n)
        return float(p[0]), float(p[0]), places, np.zeros(0)
    p = marginals(model, places, flat[places], len(words))
    return float(p.max()), float(p.sum()), places, p


def training_rows(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> list:
    """(text, toxic, doc_id) of at most so many labelled toxic and clean documents.

    Only rows whose crc32 of the doc_id as text leaves a remainder other than 2 by 4 are
    ever read for labels. Which rows, a hash of doc_id decides. Null doc_ids and labels
    other than 0 and 1 are passed over; an id labelled twice counts as toxic if either
    label says so; of rows that repeat a doc_id the least text stands for all, so the
    bounds hold for what reaches the driver. Empty tables give an empty list.
    """
    allowed = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(allowed).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(n)
    picked = pick(1, toxic_rows).unionByName(pick(0, clean_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect()
    return sorted(((r["text"], int(r["toxic"]), r["doc_id"]) for r in rows), key=lambda r: (r[2], r[0] or ""))


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Field:
    rows = training_rows(docs, labels, toxic_rows, clean_rows)
    return fit([r[0] for r in rows], [r[1] for r in rows])


def score_documents(docs: DataFrame, model: Field, threshold: float = 0.3) -> DataFrame:
    """Score every whole text.

    docs: doc_id, text; other columns are not read. Returns doc_id, held_out, score,
    predicted, and spans: character offsets (start, end, marginal) of tokens that are
    toxic with a marginal of one half or more. Null and empty texts score as a text
    without evidence. Repeated rows score alike; an empty table gives an empty table.
    """
    names = ["doc_id", "score", "spans"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def make():
        memo: dict[bytes, float] = {}
        plain: dict[int, float] = {}

        def each(batch):
            scores, spans = [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                if model.weights and any(map(_evidence(model, memo), words)):
                    peak, total, places, p = _document(model, words, memo)
                    scores.append(document_score(model, peak, total))
                    hot = {int(i): float(m) for i, m in zip(places, p) if m >= 0.5}
                    spans.append([{"start": m.start(), "end": m.end(), "marginal": hot[i]} for i, m in enumerate(_WORD.finditer(text)) if i in hot] if hot else [])
                else:
                    n = len(words)
                    if n not in plain:
                        peak, total, _, _ = _document(model, [b""] * n, {})
                        plain[n] = document_score(model, peak, total) if model.weights else 0.0
                    scores.append(plain[n])
                    spans.append([])
            yield batch_of(names, [batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, span)])

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = arrow_map(docs.select("doc_id", "text"), make, f"doc_id {kind}, score double, spans array<struct<start:int,end:int,marginal:double>>")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def _evidence(model: Field, memo: dict):
    """Score of a word, remembered; bound once a document so that ``any`` stays in C."""

    def of(w: bytes) -> float:
        s = memo.get(w)
        if s is None:
            s = model.evidence(w.decode("utf-8", "replace"))
            if len(memo) >= MEMO_ENTRIES:
                memo.clear()
            if len(w) <= 64:
                memo[w] = s
        return s

    return of


def without_toxic(docs: DataFrame, model: Field, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, with all their columns.

    Only text is read: null and empty texts hold no evidence and stay, rows that repeat a
    doc_id or have none are judged by their texts, repeated rows alike. A score that equals
    the threshold rejects. An empty table gives an empty table.
    """

    at = docs.columns.index("text")

    def make():
        memo: dict[bytes, float] = {}

        def each(batch):
            keep = []
            for text in batch.column(at).to_pylist():
                words = words_of(text)
                if not (model.weights and any(map(_evidence(model, memo), words))):
                    keep.append(True)
                    continue
                peak, total, _, _ = _document(model, words, memo)
                keep.append(document_score(model, peak, total) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

        return each

    return arrow_map(docs, make, docs.schema)
