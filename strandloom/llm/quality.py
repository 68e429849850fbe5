"""Quality classifier: naive Bayes support vectors (NBSVM).

N-gram indicators are scaled by the log ratio of their smoothed frequencies in the two classes, and
a linear model with hinge loss is fitted to them by dual coordinate descent. N-grams: 1 to 3
characters, and 1 to 2 word shapes (letter case, digits and punctuation, runs shortened) with a mark
where a word repeats the one before. They are hashed to ``SLOTS`` indicators.

Edge cases. A null text scores as the empty text, by the model's bias. Null labels are not learned
from. Without labels of both classes every score is the share of the one there is (0.5 if there is
none). Equal texts get equal scores; texts are read whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_lists, sampled

SLOTS = 1 << 18
#: The classifier is fitted on about this many labelled rows, and characters of them, at most.
TRAINING_ROWS, TRAINING_CHARACTERS = 6_000, 40_000_000
THRESHOLD = 0.7
SEED = 7

_WORD = re.compile(r"\S+")
_SHAPE = str.maketrans({**{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "0" for c in "0123456789"}})
_RUN = re.compile(r"(.)\1+", re.S)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slot(code: np.ndarray) -> np.ndarray:
    """Multiplicative hashing into the slots."""
    return ((code.astype(np.uint64) * _MIX) >> np.uint64(64 - 18)).astype(np.int64)


class Features:
    """Slots of a text's n-grams; repeats of a slot may occur in what it returns."""

    def __init__(self):
        self.shapes: dict[str, int] = {}

    def shape(self, word: str) -> int:
        found = self.shapes.get(word)
        if found is None:
            if len(self.shapes) > 200_000:
                self.shapes.clear()
            shape = _RUN.sub(r"\1", re.sub(r"[^\W\d_a]", lambda m: "A" if m[0].isupper() else "a", word.translate(_SHAPE)))[:12]
            code = 0
            for c in shape:
                code = (code * 1_000_003 + ord(c) + 1) & 0xFFFFFFFF
            found = self.shapes[word] = code
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        one = points + np.uint64(1)
        parts = [one]
        if len(one) > 1:
            parts.append(one[:-1] << np.uint64(21) | one[1:])
        if len(one) > 2:
            parts.append(parts[1][:-1] << np.uint64(21) | one[2:])
        words = _WORD.findall(text)
        if words:
            shapes = np.array([self.shape(w) for w in words], np.uint64)
            parts.append(shapes | np.uint64(1 << 63))
            if len(words) > 1:
                again = np.array([a == b for a, b in zip(words[:-1], words[1:], strict=True)], np.uint64)
                parts.append((shapes[:-1] * np.uint64(31) + shapes[1:]) * np.uint64(2) + again | np.uint64(3 << 62))
        return _slot(np.concatenate(parts))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40))))


def log_count_ratios(slots: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)), p and q the smoothed numbers of texts of each class with a slot."""
    p, q = np.full(SLOTS, smooth), np.full(SLOTS, smooth)
    for s, y in zip(slots, labels, strict=True):
        (p if y > 0 else q)[s] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(slots: list[np.ndarray], scale: np.ndarray, labels: np.ndarray, cost: float = 1.0, passes: int = 30, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + cost * sum of hinge losses.

    Texts are scaled to length 1. Each step solves one dual variable in [0, cost]; the rarer class
    has its cost raised by the ratio of the class sizes, so that it counts as much as the other.
    """
    rare = np.sum(labels > 0), np.sum(labels < 0)
    most = np.where(labels > 0, cost * max(1.0, rare[1] / max(rare[0], 1)), cost * max(1.0, rare[0] / max(rare[1], 1)))
    # Of one array: the driver's memory doesn't come back from thousands of small ones.
    values = _parts(np.empty(sum(map(len, slots))), [len(s) for s in slots])
    for s, v in zip(slots, values, strict=True):
        v[:] = scale[s]
        v /= max(np.sqrt((v * v).sum()), 1e-9)
    square = np.array([(v * v).sum() + 1.0 for v in values])
    w, b, alpha = np.zeros(SLOTS), 0.0, np.zeros(len(slots))
    order = np.random.default_rng(SEED)
    for _ in range(passes):
        widest = 0.0
        for i in order.permutation(len(slots)):
            y, s, v = labels[i], slots[i], values[i]
            gradient = y * (w[s] @ v + b) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), most[i])
            step = new - alpha[i]
            if step:
                widest = max(widest, abs(step))
                alpha[i] = new
                w[s] += step * y * v
                b += step * y
        if widest < tolerance:
            break
    return w, b


def _parts(flat: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    ends = np.cumsum([0, *sizes]).tolist()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def calibrate(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margins to the share of label 1 (Newton steps)."""
    good, bad = np.sum(labels > 0), np.sum(labels < 0)
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    beta = np.array([1.0, np.log((good + 1) / (bad + 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(slots: list[np.ndarray], labels: np.ndarray) -> Model:
    labels = np.where(np.asarray(labels) > 0, 1, -1)
    good, bad = int((labels > 0).sum()), int((labels < 0).sum())
    if not good or not bad:
        share = 0.5 if not len(labels) else np.clip(good / len(labels), 1e-6, 1 - 1e-6)
        return Model(np.zeros((2, SLOTS), np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))

    def train(rows: np.ndarray) -> tuple[np.ndarray, float]:
        part = [slots[i] for i in rows]
        ratio = log_count_ratios(part, labels[rows])
        w, b = dual_coordinate_descent(part, ratio, labels[rows])
        return w * ratio, b, ratio

    def margin(model, s: np.ndarray) -> float:
        w, b, ratio = model
        return w[s].sum() / max(np.sqrt((ratio[s] ** 2).sum()), 1e-9) + b

    everything = np.arange(len(slots))
    folds = everything % 3
    held = np.empty(len(slots))
    for k in range(3):  # the curve is fitted to margins of rows that their model hasn't seen
        rows = everything[folds != k]
        if len(set(labels[rows])) < 2:
            held[folds == k] = 0.0
            continue
        model = train(rows)
        held[folds == k] = [margin(model, slots[i]) for i in everything[folds == k]]
    slope, offset = calibrate(held, labels)
    w, b, ratio = train(everything)
    return Model(np.stack([w, ratio**2]).astype(np.float32), b, slope, offset)


def learn(labelled: DataFrame, rows: int = TRAINING_ROWS, text: str = "text", label: str = "quality", key: str = "doc_id", characters: int = TRAINING_CHARACTERS, size: str | None = None) -> Model:
    """A model from the labelled rows. ``size`` names a column with the texts' lengths, if there is one: to
    bound the sample then no text is read. Features are made on the executors; those of the bounded
    sample come to the driver, where the steps of the descent follow each other."""
    length = F.length(text) if size is None else F.col(size)
    known = labelled.where(F.col(label).isNotNull()).select(key, text, label, length.alias("length"))
    used = sampled(known, key, rows, "length", characters)

    def make():
        features = Features()

        def each(texts, labels):
            found = [np.unique(features(x)) for x in texts]
            return [[x.astype("<i4").tobytes() for x in found], labels]

        return each

    got = map_lists(used.select(F.col(text), F.col(label).cast("int").alias("label")), make, {"slots": "binary", "label": "int"}).collect()
    got.sort(key=lambda r: (bytes(r["slots"]), r["label"]))
    got = [got[i] for i in np.random.default_rng(SEED).permutation(len(got))]
    labels, sizes = np.array([r["label"] for r in got]), [len(r["slots"]) // 4 for r in got]
    flat = np.frombuffer(b"".join(r["slots"] for r in got), "<i4").astype(np.int64)
    del got
    return fit(_parts(flat, sizes), labels)


def scorer(model: Model):
    features = Features()
    mark = np.zeros(SLOTS, bool)
    weights = model.weights

    def each(text: str | None) -> float:
        spots = features(text)
        # The distinct slots, without a sort: those first to set their mark.
        mark[spots] = True
        own = np.flatnonzero(mark) if len(spots) > 1_000 else np.unique(spots)
        mark[spots] = False
        total, square = weights[0][own].sum(dtype=np.float64), weights[1][own].sum(dtype=np.float64)
        return round(model.score(total / max(np.sqrt(square), 1e-9) + model.bias), 6)

    return each


def predict(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, score and predicted (1 from ``threshold`` on) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        each = scorer(shared.value)

        def run(texts):
            scores = [each(x) for x in texts]
            return [[*range(len(texts))], scores, [int(s >= threshold) for s in scores]]

        return run

    return map_lists(documents.select(key, text), make, {"score": "double", "predicted": "int"}, keep=key)


def keep_good(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns as they are, that score ``threshold`` or more."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        global _SCORER
        if _SCORER is None or _SCORER[0] is not shared.value:
            _SCORER = (shared.value, scorer(shared.value))
        return pd.Series([_SCORER[1](x) >= threshold for x in texts.tolist()])

    return documents.where(good("text"))


_SCORER = None
