"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A word gives the byte n-grams of ``<word>`` (lengths GRAMS), hashed into BUCKETS rows of an embedding.  A text is the
mean over all its n-grams; as mean and softmax layer are linear up to the softmax, a trained model is folded to one row
of class scores for each bucket, and a text's scores are a mean over those.

``lang_pred`` is the likeliest language, ``und`` for a null text or one without letters (score 0).  ``score`` is its
probability after temperature scaling on rows kept from training; ``rejected`` marks scores below the least threshold at
which the accepted rows kept from training are right in at least ACCEPTED_RIGHT of cases.  Of equally likely languages the
first by name is given.  Texts of any length count as a whole, repeated rows get equal results, an empty table gives no
rows, and without a language to learn every text is ``und``.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densigrid.llm.bpe import Memo
from densigrid.llm.learn import made_in_tasks, remainder
from densigrid.llm.ship import map_texts

GRAMS = (2, 3, 4)
BUCKETS = 1 << 12
DIM = 16
#: The sample that a model is fitted on: at most so many rows of each language.
TRAIN_ROWS = 400
ACCEPTED_RIGHT = 0.995

_LETTER = re.compile(r"[^\W\d_]")


def buckets(word: str) -> np.ndarray:
    data = f"<{word}>".encode()
    return np.array([zlib.crc32(data[i : i + n]) % BUCKETS for n in GRAMS for i in range(len(data) - n + 1)], np.int64)


def words_of(text: str) -> list[str]:
    return text.lower().split()


def bag(text: str, memo: dict) -> np.ndarray:
    """Share of each bucket among a text's n-grams."""
    found = np.frombuffer(b"".join(map(memo.__getitem__, words_of(text))), np.int64)
    return np.bincount(found, minlength=BUCKETS).astype(np.float32) / max(1, len(found))


def train(bags: np.ndarray, y: np.ndarray, classes: int, epochs: int = 12, rate: float = 5.0, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Class scores for each bucket, and biases."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, classes), np.float32), np.zeros(classes, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            x = bags[rows]
            mean = x @ emb
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = p @ out.T
            out -= step * mean.T @ p
            bias -= step * 0.1 * p.sum(0)
            emb -= step * x.T @ back
    return emb @ out, bias


class Model:
    def __init__(self, langs: list[str], scores: np.ndarray, bias: np.ndarray):
        self.langs, self.scores, self.bias, self.heat, self.least = langs, scores.astype(np.float32), bias, 1.0, 0.0

    def logits(self, bags: np.ndarray) -> np.ndarray:
        return (bags @ self.scores + self.bias) / self.heat

    def calibrate(self, bags: np.ndarray, y: np.ndarray) -> None:
        if not len(y):
            return
        z = self.logits(bags)
        rows = np.arange(len(y))

        def loss(heat):
            s = z / heat
            return -(s[rows, y] - np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) - s.max(1)).mean()

        self.heat = float(min(np.geomspace(0.2, 20, 60), key=loss))
        p = probabilities(self.logits(bags))
        best, right = p.max(1), p.argmax(1) == y
        order = np.argsort(-best, kind="stable")
        good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= ACCEPTED_RIGHT)
        self.least = 1.0 if not len(good) else 0.0 if good[-1] == len(y) - 1 else float(best[order][good[-1]])

    def scorer(self):
        """A function of texts; it remembers the summed rows of words."""
        k = len(self.langs)

        def word(w: str) -> bytes:
            rows = buckets(w)
            return np.append(self.scores[rows].sum(0), np.float32(len(rows))).astype(np.float32).tobytes()

        memo = Memo(word)

        def work(texts: list[str | None]) -> dict:
            z, known = np.zeros((len(texts), k)), np.zeros(len(texts), bool)
            for i, t in enumerate(texts):
                if t and _LETTER.search(t):
                    sums = np.frombuffer(b"".join(map(memo.__getitem__, words_of(t))), np.float32).reshape(-1, k + 1).sum(0, dtype=np.float64)
                    z[i], known[i] = (sums[:k] / sums[k] + self.bias) / self.heat, True
            p = probabilities(z)
            best, score = p.argmax(1), np.where(known, p.max(1), 0.0)
            return {
                "lang_pred": pa.array([self.langs[b] if f else "und" for b, f in zip(best, known)], pa.string()),
                "score": pa.array(score, pa.float64()),
                "rejected": pa.array((score < self.least) | ~known),
            }

        return work


def probabilities(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(docs: DataFrame, m: int = 5, held: int = 0, calibrate_on: int = 1) -> Model:
    """Learn from text and non-null lang of rows that are not held out; bounded by TRAIN_ROWS of each language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", m) != held))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    langs = sorted(r.lang for r in counts.collect())  # one row for each language
    if not langs:
        return Model(["und"], np.zeros((BUCKETS, 1)), np.zeros(1))
    # Of each language the rows of least hash: a share of hashes that surely has enough of them, and their order in it.
    chance = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) / (1 << 30)
    some = known.select("doc_id", "lang", "text").join(F.broadcast(counts), "lang").where(chance * F.col("n") < 2 * TRAIN_ROWS).select("doc_id", "lang").distinct()
    least = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "lang"), "doc_id")
    sample = some.withColumn("place", F.row_number().over(least)).where(F.col("place") <= TRAIN_ROWS).drop("place")
    rows = known.select("doc_id", "text", "lang", remainder("doc_id", m).alias("part")).join(F.broadcast(sample), ["doc_id", "lang"], "left_semi")

    def bag_of():
        memo = Memo(lambda w: buckets(w).tobytes())
        return lambda text: bag(text, memo).tobytes()

    # A row of each text, whatever number of rows an id has.
    found = made_in_tasks(rows, bag_of, ["lang", "part"]).dropDuplicates(["lang", "text_hash"]).orderBy("lang", "text_hash").limit(TRAIN_ROWS * len(langs)).collect()
    bagged = sorted({(r.text_hash, r.lang): (r.part, r.made) for r in sorted(found, key=lambda r: r.part)}.items())
    y, part = np.array([langs.index(k[1]) for k, _ in bagged]), np.array([p for _, (p, _) in bagged])
    bags = np.array([np.frombuffer(x, np.float32) for _, (_, x) in bagged])
    learn = part != calibrate_on
    if not learn.any():
        learn[:] = True
    model = Model(langs, *train(bags[learn], y[learn], len(langs)))
    model.calibrate(bags[~learn], y[~learn])
    return model


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    return map_texts(docs, model.scorer, "lang_pred string, score double, rejected boolean", keep, null=None)
