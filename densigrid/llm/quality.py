"""Text quality by positive-unlabelled learning: the non-negative unbiased risk of a linear model.

With trusted positives P, unlabelled web text U and a class prior pi (the share of good text, estimated from labelled
rows that may be learned from) the risk is

    pi * E_P[loss(+)]  +  max(0, E_U[loss(-)] - pi * E_P[loss(-)])

and where the second term would fall below zero, a step is taken against it, as non-negative PU learning asks.  The loss
is logistic.  The prior is estimated by the share of label 1 among those labels, as they are there; labels 0 are used for
it, and for the last step alone: the score is mapped to a probability by a logistic fit on rows of both labels.

A text's features: shares of hashed word shapes (letter runs by case, digits, marks as they are) and eight figures on
marks, case, repetition and word length, of the whole text, however long.  An empty or null text has all features zero, so all of
them have one score; repeated rows and ties have equal scores, and an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densigrid.llm.bpe import Memo
from densigrid.llm.learn import first_by_hash, labelled_sample, learned_from, logistic, remainder, sigmoid
from densigrid.llm.ship import map_texts

SHAPES = 256
FIGURES = 8
#: The sample that a model is fitted on: at most so many positives, labelled negatives (prior, calibration) and unlabelled texts.
TRAIN_ROWS = 3000


def shape(word: str) -> str:
    """``Hello,`` -> ``Xx,``; ``ABC!!`` -> ``X!``: runs of one kind count once."""
    kinds = ("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return "".join(k for k, _ in groupby(kinds))[:8]


def word_row(word: str) -> bytes:
    """Bucket of the shape; characters, capitals, digits, marks."""
    up, digits = sum(c.isupper() for c in word), sum(c.isdigit() for c in word)
    marks = sum(not c.isalnum() for c in word)
    return np.array([zlib.crc32(shape(word).encode()) % SHAPES, len(word), up, digits, marks], np.int32).tobytes()


def features_of(text: str, memo: dict) -> np.ndarray:
    out = np.zeros(SHAPES + FIGURES)
    words = text.split()
    if not words:
        return out
    rows = np.frombuffer(b"".join(map(memo.__getitem__, words)), np.int32).reshape(-1, 5)
    out[:SHAPES] = np.sqrt(np.bincount(rows[:, 0], minlength=SHAPES) / len(words))
    chars, up, digits, marks = rows[:, 1:].sum(0, dtype=np.float64) / rows[:, 1].sum()
    lines = [x for x in text.split("\n") if x.strip()]
    n = len(words)
    out[SHAPES:] = (
        up,
        digits,
        marks,
        rows[:, 1].mean() / 10,
        1 - len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.mean([a == b for a, b in zip(words, words[1:])])) if n > 1 else 0.0,
        np.log1p(n) / 10,
    )
    return out


def pu_fit(pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int = 60, rate: float = 0.02, ridge: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights and bias, by Adam on mini-batches of the non-negative risk."""
    rng = np.random.default_rng(seed)
    add = lambda x: np.hstack([x, np.ones((len(x), 1))])
    pos, unl = add(pos), add(unl)
    w = np.zeros(pos.shape[1])
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    batches = max(1, len(unl) // 256)
    for _ in range(epochs):
        for p_rows, u_rows in zip(np.array_split(rng.permutation(len(pos)), batches), np.array_split(rng.permutation(len(unl)), batches)):
            if not len(p_rows) or not len(u_rows):
                continue
            p, u = pos[p_rows], unl[u_rows]
            zp, zu = p @ w, u @ w
            down = lambda z: np.logaddexp(0, z)  # noqa: E731  loss of calling it positive
            negative = down(zu).mean() - prior * down(zp).mean()
            g_neg = u.T @ sigmoid(zu) / len(u) - prior * p.T @ sigmoid(zp) / len(p)
            g = -prior * p.T @ sigmoid(-zp) / len(p) + g_neg if negative >= 0 else -g_neg
            g = g + ridge * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class Model:
    def __init__(self, weights: np.ndarray, centre: np.ndarray, spread: np.ndarray, map_to: tuple[float, float], learned: bool = True):
        self.weights, self.centre, self.spread, self.map_to, self.learned = weights, centre, spread, map_to, learned

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -8, 8) @ self.weights[:-1] + self.weights[-1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.map_to[0] * self.raw(x) + self.map_to[1])

    def scorer(self, name: str):
        memo = Memo(word_row)
        return lambda texts: {name: pa.array(self.probability(np.array([features_of(t, memo) for t in texts])), pa.float64())}


def fit(docs: DataFrame, labels: DataFrame, m: int = 4, held: int = 2) -> Model:
    """Learn labels only from rows that are not held out; samples are bounded by TRAIN_ROWS of each kind.

    Without a positive or an unlabelled text nothing can be learned: the model is marked so and gives every text the prior.
    """

    def vector():
        memo = Memo(word_row)
        return lambda text: features_of(text, memo).tobytes()

    good = labelled_sample(docs, labels, "quality", 1, m, held, TRAIN_ROWS, vector)
    bad = labelled_sample(docs, labels, "quality", 0, m, held, TRAIN_ROWS, vector)
    learnable = labels.where(F.col("quality").isin(0, 1) & (remainder("doc_id", m) != held))
    n, ones = learnable.agg(F.count("*"), F.sum("quality")).first()
    prior = min(0.98, max(0.02, (ones or 0) / n)) if n else 0.5
    others = first_by_hash(docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", m) != held)).select("doc_id").distinct(), TRAIN_ROWS, "doc_id")
    web = learned_from(docs, others, TRAIN_ROWS, vector)
    if not good or not web:
        return Model(np.zeros(SHAPES + FIGURES + 1), np.zeros(SHAPES + FIGURES), np.ones(SHAPES + FIGURES), (1.0, float(np.log(prior / (1 - prior)))), learned=False)
    p, u, b = (np.array([np.frombuffer(v) for v in x]).reshape(len(x), -1) for x in (good, web, bad))
    centre, spread = u.mean(0), u.std(0) + 1e-3
    scale = lambda x: np.clip((x - centre) / spread, -8, 8)
    model = Model(pu_fit(scale(p), scale(u), prior), centre, spread, (1.0, 0.0))
    if len(bad):
        # Both kinds were sampled up to the same bound: weigh them back to the prior by repeating the fit's offset.
        z, y = np.concatenate([model.raw(p), model.raw(b)]), np.concatenate([np.ones(len(p)), np.zeros(len(b))])
        a, c = logistic(z[:, None], y)
        model.map_to = (float(max(a, 1e-3)), float(c + np.log(prior / (1 - prior)) - np.log(len(p) / len(b))))
    return model


def score(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """Columns ``keep`` and the score, under ``name`` (choose one that ``keep`` lacks)."""
    return map_texts(docs, lambda: model.scorer(name), f"{name} double", keep)
