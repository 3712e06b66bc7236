"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of all its hashed character n-grams; a linear layer and softmax give the
language. Both are fitted by stochastic gradient descent in numpy on a sample of ``per_label`` documents a language.
Because the average and the layer are linear, the fitted model is one row of logits a bucket, and a text's logits are
the mean of its n-grams' rows: scoring is one scan, and the table (fixed size) is all that tasks get.

Rejection is calibrated on a part of the sample kept out of the fit: a temperature makes the scores probabilities, and
the threshold is the score that all but ``reject`` of those documents reach.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import labelled_sample, map_texts, remainder, table

BUCKETS, SIZES = 1 << 14, (2, 3, 4)


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document index) of every n-gram of every text, lower-cased in A-Z."""
    joined = b"".join(t.lower() + b" " for t in texts)
    data = np.frombuffer(joined, np.uint8).astype(np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
    buckets, docs = [], []
    for n in SIZES:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        own = doc[: len(h)] == doc[n - 1 :]
        buckets.append(h[own] & np.uint32(BUCKETS - 1))
        docs.append(doc[: len(h)][own])
    return np.concatenate(buckets or [np.zeros(0, np.uint32)]), np.concatenate(docs or [np.zeros(0, np.int32)])


def _counts(texts: list[bytes]) -> dict:
    out: dict[str, list] = {"buckets": [], "counts": []}
    bucket, doc = ngrams(texts)
    keys, n = np.unique(doc.astype(np.int64) * BUCKETS + bucket, return_counts=True)
    cut = np.searchsorted(keys, np.arange(len(texts) + 1) * BUCKETS)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        out["buckets"].append((keys[a:b] % BUCKETS).astype(np.int32).tobytes())
        out["counts"].append(n[a:b].astype(np.float32).tobytes())
    return out


class LanguageModel:
    def __init__(self, labels: list[str], logits: np.ndarray, offset: np.ndarray, temperature: float, threshold: float):
        self.labels, self.logits, self.offset, self.temperature, self.threshold = labels, logits, offset, temperature, threshold

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(label number, probability) of each text."""
        bucket, doc = ngrams(texts)
        per_doc = np.bincount(doc, minlength=len(texts))
        z = np.stack([np.bincount(doc, self.logits[:, k][bucket], len(texts)) for k in range(len(self.labels))], 1)
        z = (z / np.maximum(per_doc, 1)[:, None] + self.offset) * self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(texts)), best]


def fit(sample: DataFrame, label: str = "lang", text_col: str = "text", dim: int = 16, epochs: int = 6, rate: float = 2.0, reject: float = 0.001, seed: int = 7) -> LanguageModel | None:
    """Fit on ``sample`` (label, text); None if it has no rows. The n-gram counts are made by tasks."""
    rows = map_texts(sample.select(label, text_col), _counts, "buckets binary, counts binary", text_col, 1 << 19).collect()
    rows = sorted((r for r in rows if len(r["buckets"])), key=lambda r: (r[label], len(r["buckets"]), bytes(r["buckets"])))
    labels = sorted({r[label] for r in rows})
    if not labels:
        return None
    rng = np.random.RandomState(seed)
    order = rng.permutation(len(rows))
    xs = [(np.frombuffer(rows[i]["buckets"], np.int32), np.frombuffer(rows[i]["counts"], np.float32)) for i in order]
    ys = [labels.index(rows[i][label]) for i in order]
    embed = rng.uniform(-0.1, 0.1, (BUCKETS, dim))
    layer, offset = rng.uniform(-0.1, 0.1, (dim, len(labels))), np.zeros(len(labels))
    fold = [i for i in range(len(xs)) if i % 5] or [0]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in fold:
            (idx, n), y = xs[i], ys[i]
            part = n / n.sum()
            hidden = part @ embed[idx]
            z = hidden @ layer + offset
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= step * np.outer(hidden, p)
            offset -= 0.1 * step * p
            embed[idx] -= step * part[:, None] * back * 10
    logits = embed @ layer
    kept = [i for i in range(len(xs)) if i % 5 == 0]
    z = np.array([(xs[i][1] / xs[i][1].sum()) @ logits[xs[i][0]] + offset for i in kept])
    y = np.array([ys[i] for i in kept])

    def top(t: float) -> np.ndarray:
        p = np.exp(t * (z - z.max(1, keepdims=True)))
        return p / p.sum(1, keepdims=True)

    temperature = min((0.25 * 2 ** (k / 2) for k in range(13)), key=lambda t: -np.log(top(t)[np.arange(len(y)), y] + 1e-12).sum())
    threshold = float(min(0.5, np.quantile(top(temperature).max(1), reject)))
    return LanguageModel(labels, np.ascontiguousarray(logits), offset, temperature, threshold)


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and accepted; every row stays.

    A null text, or one without a letter, gets ``und`` with score 0 and is not accepted; so does every row if there
    was nothing to learn from. Otherwise lang_pred is a learned value even if the score is under the threshold.
    Columns with the names of the new ones are replaced.
    """
    docs = docs.drop("lang_pred", "score", "accepted").withColumn("_letters", F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}"))
    if model is None:
        return docs.drop("_letters").withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "accepted": F.lit(False)})

    def run(texts: list[bytes]) -> dict:
        best, score = model.scores(texts)
        return {"_best": [model.labels[k] for k in best], "_score": score}

    kept = docs.withColumn("_text", F.col(text_col))
    out = map_texts(kept, run, "_best string, _score double", "_text", 1 << 19)
    letters = F.col("_letters")
    return out.withColumns({
        "lang_pred": F.when(letters, F.col("_best")).otherwise("und"),
        "score": F.when(letters, F.col("_score")).otherwise(0.0),
        "accepted": letters & (F.col("_score") >= model.threshold),
    }).drop("_letters", "_best", "_score")


def learn(docs: DataFrame, per_label: int = 500, id_col: str = "doc_id") -> LanguageModel | None:
    """The model of the rows of ``docs`` with a language, a text, and remainder other than 2 of 4."""
    rows = docs.where((remainder(id_col, 4) != 2) & F.col("text").isNotNull())
    return fit(labelled_sample(rows, "lang", id_col, per_label).select("lang", "text"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")
