"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) the vectors of
its letters, each permuted (rotated) by its place. A text's vector bundles (adds) those of all its
n-grams, and a language's prototype bundles the texts of the language. A text is of the language
whose prototype, less the mean of all prototypes' directions, has the largest cosine with it.

Edge cases. A null text and one without a letter are ``und`` with score 0. Shorter texts than an
n-gram are padded by word boundaries, so one letter is enough. Rows with a null language are never
learned from. With nothing to learn from, every row is ``und``. Equal texts get equal results; ties
go to the smaller language by code point. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_lists, parts_of, sampled, spread

UNKNOWN = "und"
DIMENSION = 1024
ORDER = 3
#: The prototypes are a classifier; they are fitted on about this many of the labelled rows at most.
TRAINING_ROWS = 20_000
SEED = 20_011
#: How often two n-grams of a language are equal, for the cosine that a text of so many is expected to
#: have; the share of it that makes a language known; standard deviations of chance cosines allowed.
COLLISION = 0.002
LEAST_SHARE = 0.5
CHANCE = 3.0


class Profiles:
    """Vectors of n-grams, made when first met and kept up to a bound."""

    def __init__(self, dimension: int = DIMENSION, order: int = ORDER, kept: int = 20_000):
        self.dimension, self.order, self.kept = dimension, order, kept
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((1024, dimension), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.Generator(np.random.Philox(key=[SEED, code])).integers(0, 2, self.dimension, np.int8)
            self.letters[code] = 2 * bits - 1
        return self.letters[code]

    def ngram(self, code: int) -> np.ndarray:
        """Bound from its letters, 21 bits each, the first letter rotated the furthest."""
        bound = np.ones(self.dimension, np.int8)
        for place in range(self.order):
            bound = bound * np.roll(self.letter(code >> 21 * place & 0x1FFFFF), place)
        return bound

    def places(self, codes: np.ndarray) -> np.ndarray:
        if len(self.rows) + len(codes) > max(self.kept, len(codes)):
            self.rows.clear()
        out = np.empty(len(codes), np.int64)
        for i, code in enumerate(codes.tolist()):
            at = self.rows.get(code)
            if at is None:
                at = self.rows[code] = len(self.rows)
                if at >= len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                self.table[at] = self.ngram(code)
            out[i] = at
        return out

    def codes(self, text: str) -> np.ndarray:
        """The n-grams of a text: letters in lower case, other runs as one boundary (0)."""
        points = np.frombuffer(f" {text} ".lower().encode("utf-32-le"), np.uint32).astype(np.int64)
        letters = is_letter(points)
        points = np.where(letters, points, 0)
        points = points[letters | np.concatenate([[True], letters[:-1]])]
        n = len(points) - self.order + 1
        if n < 1 or not letters.any():
            return np.empty(0, np.int64)
        code = np.zeros(n, np.int64)
        for place in range(self.order):
            code = code << 21 | points[place : place + n]
        return code

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The vector of each text, and its number of n-grams."""
        found = [np.unique(self.codes(x), return_counts=True) if x else (np.empty(0, np.int64), np.empty(0, np.int64)) for x in texts]
        vectors = np.zeros((len(texts), self.dimension), np.float32)
        for at in range(0, len(texts), 64):  # one product for some texts: it shares the look-ups
            part = found[at : at + 64]
            codes, inverse = np.unique(np.concatenate([c for c, _ in part]), return_inverse=True)
            for low in range(0, len(codes), 4096):  # bounds the product whatever the texts hold
                here = (inverse >= low) & (inverse < low + 4096)
                counts = np.zeros((len(part), min(4096, len(codes) - low)), np.float32)
                who = np.repeat(np.arange(len(part)), [len(c) for c, _ in part])
                counts[who[here], inverse[here] - low] = np.concatenate([n for _, n in part])[here]
                places = self.places(codes[low : low + 4096])
                vectors[at : at + 64] += counts @ self.table[places]
        return vectors, np.array([n.sum() for _, n in found], np.int64)


_LETTERS = np.zeros(0, bool)


def is_letter(points: np.ndarray) -> np.ndarray:
    global _LETTERS
    if not len(_LETTERS):
        _LETTERS = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTERS[points]


@dataclass(frozen=True)
class Prototypes:
    languages: list[str]
    vectors: np.ndarray  # unit rows
    dimension: int
    order: int


def learn(labelled: DataFrame, dimension: int = DIMENSION, order: int = ORDER, rows: int = TRAINING_ROWS, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Prototypes:
    """Prototypes from the rows of ``labelled`` that have a language and a text.

    Tasks bundle what they read; the bundles of a language are added up coordinate by coordinate.
    What reaches the driver is a vector per language.
    """
    used = sampled(labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, text, lang), key, rows)

    def make():
        profiles = Profiles(dimension, order)

        def each(texts, languages):
            vectors, size = profiles.bundle(texts)
            vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            names = sorted(set(languages))
            of = np.array([names.index(x) for x in languages])
            return [names, [np.rint(vectors[(of == i) & (size > 0)].sum(axis=0) * 1e6).astype(np.int64).tolist() for i in range(len(names))]]

        return each

    parts = map_lists(spread(used.select(text, lang)), make, {"lang": "string", "bundle": "array<long>"})
    sums = (
        parts.select("lang", F.posexplode("bundle"))
        .groupBy("lang", "pos")
        .agg(F.sum("col").alias("total"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "total"))).alias("bundle"))
        .collect()
    )
    found = sorted((r["lang"], np.array([x["total"] for x in r["bundle"]], float)) for r in sums)
    vectors = np.array([v / max(np.linalg.norm(v), 1e-9) for _, v in found]).reshape(len(found), dimension)
    return Prototypes([name for name, _ in found], vectors.astype(np.float32), dimension, order)


def scorer(model: Prototypes) -> Callable[[list[str | None]], list[list]]:
    """A function from texts to predicted languages, scores and numbers of n-grams.

    The score is the cosine of the text with its language's prototype, at least 0.
    """
    profiles = Profiles(model.dimension, model.order)
    centred = model.vectors - model.vectors.mean(axis=0) if len(model.languages) > 1 else model.vectors
    centred = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)

    def each(texts: list[str | None]) -> list[list]:
        vectors, size = profiles.bundle(texts)
        if not model.languages:
            return [[UNKNOWN] * len(texts), [0.0] * len(texts), size.tolist()]
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        best = np.argmax(np.round(vectors @ centred.T, 5), axis=1)
        cosine = np.round(np.clip((vectors * model.vectors[best]).sum(axis=1), 0, 1).astype(float), 5)
        return [
            [model.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), size.tolist(), strict=True)],
            [c if n else 0.0 for c, n in zip(cosine.tolist(), size.tolist(), strict=True)],
            size.tolist(),
        ]

    return each


def predict(documents: DataFrame, model: Prototypes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        each = scorer(shared.value)
        return lambda texts: [[*range(len(texts))], *each(texts)[:2]]

    return map_lists(documents.select(key, text), make, {"lang_pred": "string", "score": "double"}, keep=key)


def least_cosine(n: int, dimension: int, share: float = LEAST_SHARE) -> float:
    """The cosine with its language's prototype from which a text of n n-grams is identified.

    A text whose n-grams are drawn from the language has an expected cosine of sqrt(n c / (1 + n c)),
    c being the chance that two are equal, and chance adds a deviation of 1 / sqrt(dimension). So a few
    n-grams say nothing, and many have to come near to the prototype.
    """
    expected = (n * COLLISION / (1 + n * COLLISION)) ** 0.5
    return max(0.0, share * expected - CHANCE / dimension**0.5)


def keep_identified(documents: DataFrame, model: Prototypes, share: float = LEAST_SHARE, text: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose language is known: that have letters and a cosine of
    ``least_cosine`` or more with its prototype. Null and empty texts go; repeated rows stay."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        global _SCORER
        if _SCORER is None or _SCORER[0] is not shared.value:
            _SCORER = (shared.value, scorer(shared.value))
        out: list[bool] = []
        for part in parts_of(texts.tolist()):
            out += [name != UNKNOWN and score >= least_cosine(n, shared.value.dimension, share) for name, score, n in zip(*_SCORER[1](part), strict=True)]
        return pd.Series(out)

    return documents.where(known(text))


_SCORER = None
