"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by naive-Bayes log-count ratios.

Features are the presence of word 1- and 2-grams and of 1- to 3-grams of word shapes, hashed. A word's shape is its
sequence of character classes without repeats (``U`` capital, ``l`` other letter, ``d`` digit, a sign itself); a word
equal to the one before it has the shape ``=``. Each indicator is multiplied by the log ratio of its smoothed shares
in the two classes, and a support-vector model is fitted by dual coordinate descent. Both use a sample of
``per_label`` documents a label; the sums of a part of the sample kept out of the descent calibrate the score.
Scoring is one scan with a table of fixed size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import BASE, calibrate, labelled_sample, logistic, map_texts, mix, prefix_hash, range_hash, remainder, table, words_of

WORD_BITS, SHAPE_BITS = 17, 15
SPACE = (1 << WORD_BITS) + (1 << SHAPE_BITS)

CLASS = np.arange(256, dtype=np.uint8)
CLASS[ord("A") : ord("Z") + 1] = ord("U")
CLASS[ord("a") : ord("z") + 1] = ord("l")
CLASS[128:] = ord("l")
CLASS[ord("0") : ord("9") + 1] = ord("d")


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (document index * SPACE + feature), and the number of features of each document."""
    data, starts, ends, doc, word = words_of(texts, lower=False)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    kind = CLASS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    shape = range_hash(prefix_hash(kind[keep]), at[starts], at[ends])
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    shape[again] = np.uint64(0x3D)
    found = []
    for grams, most, low, bits in ((word, 2, 0, WORD_BITS), (shape, 3, 1 << WORD_BITS, SHAPE_BITS)):
        h = np.zeros(len(grams), np.uint64)
        for n in range(1, most + 1):
            h = h[: len(grams) - n + 1] * BASE + grams[n - 1 :]
            own = doc[: len(h)] == doc[n - 1 :]
            bucket = mix(h + np.uint64(n)) >> np.uint64(64 - bits)
            found.append(doc[: len(h)][own] * np.int64(SPACE) + bucket[own].astype(np.int64) + low)
    keys = np.concatenate(found)
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys, np.bincount(keys // SPACE, minlength=len(texts))


def _lists(texts: list[bytes]) -> dict:
    keys, _ = features(texts)
    cut = np.searchsorted(keys, np.arange(len(texts) + 1) * SPACE)
    return {"features": [(keys[a:b] % SPACE).astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]}


def log_count_ratios(rows: list[np.ndarray], positive: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Log ratio of the smoothed shares of each feature in positive and negative documents."""
    share = []
    for side in (True, False):
        own = [x for x, y in zip(rows, positive, strict=True) if y == side]
        n = np.bincount(np.concatenate(own), minlength=SPACE) if own else np.zeros(SPACE)
        share.append((n + alpha) / (len(own) + 2 * alpha))
    return np.log(share[0] / share[1])


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, positive: np.ndarray, cost: float, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Weights of the hinge-loss support-vector model of rows of indicators times ``scale``.

    Each step solves the dual problem for one document exactly and clips its multiplier to [0, cost].
    """
    w, a = np.zeros(len(scale)), np.zeros(len(rows))
    sign = np.where(positive, 1.0, -1.0)
    norm = np.array([np.square(scale[x]).sum() for x in rows])
    rng = np.random.RandomState(seed)
    for _ in range(rounds):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            if norm[i] == 0:
                continue
            x = rows[i]
            gradient = sign[i] * (w[x] @ scale[x]) - 1
            new = min(max(a[i] - gradient / norm[i], 0.0), cost)
            if new != a[i]:
                w[x] += (new - a[i]) * sign[i] * scale[x]
                largest = max(largest, abs(new - a[i]) * norm[i])
                a[i] = new
        if largest < 1e-3:
            break
    return w


class QualityModel:
    """One number a feature, and the calibration of the sum."""

    def __init__(self, table: np.ndarray, slope: float, offset: float):
        self.table, self.slope, self.offset = table.astype(np.float32), slope, offset

    def margins(self, keys: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(keys // SPACE, self.table[keys % SPACE], n)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        keys, count = features(texts)
        m = self.margins(keys, len(texts)) / np.sqrt(np.maximum(count, 1))
        return logistic(self.slope * m + self.offset)


def fit(sample: DataFrame, label: str, text_col: str = "text", cost: float = 0.1) -> QualityModel:
    """Fit on ``sample`` (label 0 or 1, text); with one class only, or no row, every score is one constant.

    Documents are scaled to the length 1 of their indicator vector, so long ones do not dominate.
    """
    rows = map_texts(sample.select(label, text_col), _lists, "features binary", text_col).collect()
    rows = sorted(((int(r[label]), r["features"]) for r in rows), key=lambda r: (r[0], len(r[1]), bytes(r[1])))
    order = np.random.RandomState(5).permutation(len(rows))
    xs = [np.frombuffer(rows[i][1], np.int32).astype(np.int64) for i in order]
    y = np.array([rows[i][0] == 1 for i in order], bool)
    if not len(y) or y.all() or not y.any():
        slope, offset = calibrate(np.zeros(len(y)), y)
        return QualityModel(np.zeros(SPACE), slope, offset)
    fold = [i for i in range(len(xs)) if i % 4]
    ratio = log_count_ratios([xs[i] for i in fold], y[fold])
    w = dual_coordinate_descent([xs[i] for i in fold], ratio, y[fold], cost)
    table_ = w * ratio
    margin = np.array([table_[x].sum() / np.sqrt(max(len(x), 1)) for x in xs])
    kept = np.arange(len(xs)) % 4 == 0
    slope, offset = calibrate(margin[kept], y[kept])
    return QualityModel(table_, slope, offset)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = 1500, id_col: str = "doc_id") -> QualityModel:
    """The model of the labelled rows whose remainder modulo 5 is not 0; the drawn ids are bounded and are broadcast."""
    drawn = labelled_sample(labels.where(remainder(id_col, 5) != 0), label, id_col, per_label).select(id_col, label)
    return fit(docs.select(id_col, "text").join(F.broadcast(drawn), id_col).select(label, "text"), label)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without its text and with score and predicted (1 if score >= threshold).

    Null text counts as empty and gets the calibrated score of a document without features. Every row stays; other
    columns pass, those with the names of the new ones are replaced.
    """
    out = map_texts(docs.drop("predicted"), lambda texts: {"score": model.scores(texts)}, "score double", text_col, 1 << 20)
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_quality(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
