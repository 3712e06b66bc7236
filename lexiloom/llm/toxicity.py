"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels mark documents, so tokens are labelled first: in a bounded sample without near copies, a token or a prefix of a
token (a stem) is a mark if it is much more frequent, by documents, in toxic than in other documents; a token of a
toxic document is toxic if it, or a prefix, is a mark. The field has two states. Its emission is a sum of weights of
hashed features of the token (the token and its prefixes), its transitions are four numbers; both are fitted by
stochastic gradient ascent on the likelihood.

With two states, only the difference of the two forward messages matters, and it obeys a scalar recurrence; the same
holds backward. So forward-backward runs over all documents of a batch in step, the longest deciding the number of
steps. A token's marginal is the logistic of the sum of both differences. The document score is a calibrated function
of the largest marginal and of the expected number of toxic tokens; spans are runs of tokens with a marginal of at
least one half, as byte offsets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import labelled_sample, logistic, map_texts, prefix_hash, range_hash, remainder, table

BITS = 22
IS_LETTER = np.zeros(256, bool)
IS_LETTER[ord("A") : ord("Z") + 1] = IS_LETTER[ord("a") : ord("z") + 1] = IS_LETTER[128:] = True
IS_LETTER[ord("0") : ord("9") + 1] = True
#: Lengths in bytes of the prefixes that are features beside the whole token.
PREFIXES = (4, 5, 6, 7)
ROWS = 1 + len(PREFIXES)


class Tokens:
    """Letter runs of several texts: place, document, hash, and the hashed features of each."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer((b"\n".join(texts) + b"\n").lower(), np.uint8)
        edge = np.flatnonzero(np.diff(IS_LETTER[data].astype(np.int8), prepend=0))
        self.start, self.end = edge[::2], edge[1::2]
        bounds = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        self.doc = np.searchsorted(bounds, self.start, side="right")
        self.base = np.concatenate([[0], bounds[:-1]]).astype(np.int64)
        sums = prefix_hash(data)
        word = range_hash(sums, self.start, self.end)
        rows = [word]
        for n in PREFIXES:
            short = range_hash(sums, self.start, np.minimum(self.start + n, self.end)) + np.uint64(n)
            rows.append(np.where(self.end - self.start > n, short, word))
        self.features = (np.stack(rows) >> np.uint64(64 - BITS)).astype(np.int32)
        self.length = np.bincount(self.doc, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64)


def _step(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The message difference after a transition; t[s, r] is the weight of state s followed by r."""
    return np.logaddexp(t[0, 1], t[1, 1] + x) - np.logaddexp(t[0, 0], t[1, 0] + x)


def forward_backward(emission: np.ndarray, first: np.ndarray, length: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward difference (with emission) and backward difference of each token, all documents in step."""
    ahead, back = np.empty_like(emission), np.empty_like(emission)
    order = np.argsort(-length, kind="stable")
    begin, size = first[order], length[order]
    active = int((size > 0).sum())
    if not active:
        return ahead, back
    live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # documents longer than each step
    at = begin[:active]
    ahead[at] = x = emission[at]
    for k in range(1, int(size[0])):
        n = live[k]
        at = begin[:n] + k
        ahead[at] = x = emission[at] + _step(x[:n], t)
    stop = begin + size - 1
    at = stop[:active]
    back[at] = x = np.zeros(active)
    for k in range(1, int(size[0])):
        n = live[k]
        at = stop[:n] - k
        back[at] = x = _step(emission[at + 1] + x[:n], t.T)
    return ahead, back


class SpanModel:
    def __init__(self, weights: np.ndarray, bias: float, transitions: np.ndarray):
        self.weights, self.bias, self.transitions = weights, bias, transitions
        self.curve = np.array([1.0, 0.0, 0.0])

    def emission(self, tokens: Tokens) -> np.ndarray:
        return self.weights[tokens.features].sum(0) + self.bias

    def marginals(self, tokens: Tokens) -> np.ndarray:
        ahead, back = forward_backward(self.emission(tokens), tokens.first, tokens.length, self.transitions)
        return logistic(ahead + back)

    def evidence(self, tokens: Tokens, marginal: np.ndarray) -> np.ndarray:
        """Columns of each document: logit of the largest marginal, log of 1 + expected toxic tokens, 1."""
        n = len(tokens.length)
        most = np.full(n, 1e-6)
        np.maximum.at(most, tokens.doc, np.clip(marginal, 1e-6, 1 - 1e-6))
        expected = np.bincount(tokens.doc, marginal, n)
        return np.stack([np.log(most / (1 - most)), np.log1p(expected), np.ones(n)], 1)

    def scores(self, tokens: Tokens, marginal: np.ndarray) -> np.ndarray:
        return logistic(self.evidence(tokens, marginal) @ self.curve)


def without_copies(words: list[np.ndarray], places: int = 8, alike: int = 5) -> list[int]:
    """Indexes of documents of which no earlier kept one shares ``alike`` of ``places`` minimum hashes."""
    seen: dict[tuple[int, int], list[int]] = {}
    kept = []
    for i, w in enumerate(words):
        x = w.astype(np.uint64)
        marks = [(k, int(((x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF) >> np.uint64(20)).min())) for k in range(places)]
        votes: dict[int, int] = {}
        for m in marks:
            for j in seen.get(m, ()):
                votes[j] = votes.get(j, 0) + 1
        if max(votes.values(), default=0) < alike:
            kept.append(i)
            for m in marks:
                seen.setdefault(m, []).append(i)
    return kept


def marks_of(units: list[np.ndarray], toxic: np.ndarray, share: float = 0.02, odds: float = 40.0, least: int = 4) -> np.ndarray:
    """Whether each hashed feature is a mark; ``units`` holds the distinct features of each document."""
    size = 1 << BITS
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    bad, good = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for u, t in zip(units, toxic, strict=True):
        (bad if t else good)[u] += 1
    return (bad >= max(least, share * n_bad)) & (bad / n_bad >= odds * (good + 0.5) / n_good)


def fit(sample: DataFrame, label: str, text_col: str = "text", epochs: int = 6, batch: int = 50, rate: float = 0.5, seed: int = 3) -> SpanModel:
    """Fit on ``sample`` (label 0 or 1, text). Without toxic rows, every marginal is small and every score 0.02 or less."""

    def lists(texts: list[bytes]) -> dict:
        tokens = Tokens(texts)
        cut = np.concatenate([tokens.first, [len(tokens.doc)]])
        parts = [slice(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return {"features": [tokens.features[:, p].tobytes() for p in parts]}

    rows = map_texts(sample.select(label, text_col), lists, "features binary", text_col).collect()
    rows = sorted((r for r in rows if r["features"]), key=lambda r: (r[label], len(r["features"]), bytes(r["features"])))
    order = np.random.RandomState(seed).permutation(len(rows))
    features = [np.frombuffer(rows[i]["features"], np.int32).reshape(ROWS, -1) for i in order]
    toxic = np.array([rows[i][label] == 1 for i in order], bool)
    model = SpanModel(np.zeros(1 << BITS, np.float32), -6.0, np.zeros((2, 2)))
    if not toxic.any() or toxic.all():
        model.curve = np.array([0.0, 0.0, 4.0 if toxic.any() else -4.0])
        return model
    units = [np.unique(f) for f in features]
    single = without_copies([np.unique(f[0]) for f in features])
    mark = marks_of([units[i] for i in single], toxic[single])
    gold = [mark[f].any(0) & t for f, t in zip(features, toxic, strict=True)]
    fold = [i for i in single if i % 4]
    fold.sort(key=lambda i: features[i].shape[1])  # documents of a batch are about as long, so few batches take many steps
    batches = [fold[a : a + batch] for a in range(0, len(fold), batch)]
    rng = np.random.RandomState(seed)
    for epoch in range(epochs):
        for own in (batches[k] for k in rng.permutation(len(batches))):
            length = np.array([features[i].shape[1] for i in own])
            first = np.concatenate([[0], np.cumsum(length)[:-1]])
            x, y = np.concatenate([features[i] for i in own], 1), np.concatenate([gold[i] for i in own]).astype(float)
            emission, t = model.weights[x].sum(0) + model.bias, model.transitions
            ahead, back = forward_backward(emission, first, length, t)
            error = y - logistic(ahead + back)
            inner = np.ones(len(y), bool)
            inner[first] = False
            now = np.flatnonzero(inner)
            u, v = ahead[now - 1], emission[now] + back[now]
            joint = np.stack([np.full(len(now), t[0, 0]), t[0, 1] + v, t[1, 0] + u, t[1, 1] + u + v])
            joint = np.exp(joint - joint.max(0))
            joint /= joint.sum(0)
            pair = (2 * y[now - 1] + y[now]).astype(int)
            step = rate * (1 - epoch / epochs)
            model.transitions = t + 0.1 * step * (np.bincount(pair, minlength=4) - joint.sum(1)).reshape(2, 2) / len(own)
            model.bias += 0.1 * step * error.sum() / len(own)
            np.add.at(model.weights, x, np.broadcast_to((error * step).astype(np.float32), x.shape))
    kept = [i for i in single if i % 4 == 0]  # not in the fit
    tokens = Tokens([])
    tokens.features = np.concatenate([features[i] for i in kept], 1)
    tokens.length = np.array([features[i].shape[1] for i in kept])
    tokens.first = np.concatenate([[0], np.cumsum(tokens.length)[:-1]])
    tokens.doc = np.repeat(np.arange(len(kept)), tokens.length)
    x, y = model.evidence(tokens, model.marginals(tokens)), toxic[kept].astype(float)
    curve = np.zeros(3)
    for _ in range(50):  # Newton's method with a small ridge
        p = logistic(x @ curve)
        hessian = (x.T * (p * (1 - p) + 1e-4)) @ x + 0.05 * np.eye(3)
        curve -= np.linalg.solve(hessian, x.T @ (p - y) + 0.05 * curve)
    model.curve = curve
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", bad: int = 800, good: int = 2400, id_col: str = "doc_id") -> SpanModel:
    """The model of the labelled rows whose remainder modulo 5 is not 0; the drawn ids are bounded and are broadcast."""
    drawn = labelled_sample(labels.where(remainder(id_col, 5) != 0), label, id_col, {1: bad, 0: good}).select(id_col, label)
    return fit(docs.select(id_col, "text").join(F.broadcast(drawn), id_col).select(label, "text"), label)


def score_toxicity(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """``docs`` without its text and with score, predicted, and begins and ends (byte offsets of toxic spans).

    Null text counts as empty; a text without letters gets the score of no evidence. Every row stays; other columns
    pass, those with the names of the new ones are replaced.
    """

    def run(texts: list[bytes]) -> dict:
        tokens = Tokens(texts)
        marginal = model.marginals(tokens)
        bad = marginal >= 0.5
        joined = np.zeros(len(bad), bool)  # continues the span of the token before
        joined[1:] = bad[1:] & bad[:-1] & (tokens.doc[1:] == tokens.doc[:-1])
        heads = np.flatnonzero(bad & ~joined)
        tails = np.flatnonzero(bad & ~np.append(joined[1:], False)) if len(bad) else heads
        own = tokens.doc[heads]
        cut = np.searchsorted(own, np.arange(len(texts) + 1))
        begins, ends = tokens.start[heads] - tokens.base[own], tokens.end[tails] - tokens.base[own]
        parts = list(zip(cut[:-1], cut[1:], strict=True))
        return {"score": model.scores(tokens, marginal), "begins": [begins[a:b] for a, b in parts], "ends": [ends[a:b] for a, b in parts]}

    out = map_texts(docs.drop("predicted"), run, "score double, begins array<int>, ends array<int>", text_col)
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_toxicity(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
