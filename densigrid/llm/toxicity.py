"""Toxicity by compression distance: how much shorter a text's windows get with a dictionary of toxic text.

Two zstandard dictionaries are made, each from labelled text of its own class.  The ordinary one holds the words most
frequent in ordinary texts, and those ordinary words that would else profit from the other one.  The toxic one holds the
words most frequent in toxic texts, and the spaced word beginnings that occur in more toxic documents than ordinary ones,
by a factor of LEAST_LIFT and beyond chance: a binomial test, at a false discovery rate of FALSE among all beginnings that
LEAST toxic documents have.  A window is one spaced word, or two
neighbouring characters of a script that is written without spaces, followed by a constant tail that both dictionaries
hold, so that even a short window is compressed and not stored.  A window's gain is its length under the ordinary
dictionary less that under the toxic one; a word of fewer letters than SHORTEST has none.  A text's score is a logistic
function of how many windows, and which share of them, gain 2, 3, 4 and 5 bytes.  It is fitted on labelled texts that the
dictionaries behind their figures were not made from: each half of the sample is measured with those of the other half.
On the same figures the threshold is calibrated, which is where the score is 0.5: toxic texts are rare, and where precision
and recall are best together is not where a text of even odds stands.

A null text is an empty one, which has no windows, and all such texts have one low score; repeated rows and ties have
equal scores, a text of any length is scored as a whole, and an empty table gives no rows.  Without a labelled text of
either class nothing is toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from math import lgamma

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from densigrid.llm.bpe import Memo
from densigrid.llm.learn import labelled_sample, logistic, sigmoid
from densigrid.llm.ship import map_texts

#: The sample that dictionaries and thresholds are learned from: at most so many texts of each label.
TRAIN_ROWS = 2500
#: Bytes of frequent words in the ordinary dictionary; words added in each round that shields ordinary words.
BASE_BYTES, SHIELDED, ROUNDS = 8192, 500, 2
#: A beginning is toxic material if so many toxic texts have it, so many times the ordinary share, and not by chance.
LEAST, LEAST_LIFT, FALSE = 5, 5.0, 0.05
SHORTEST, LONGEST = 4, 14
GAINS = (2, 3, 4, 5)
TAIL = bytes(range(128, 176))

_MARKS = re.compile(r"[\W\d_]+")
#: Letters of Thai, Lao, Burmese, Khmer, kana and Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]+")


def windows(text: str) -> list[str]:
    words = _MARKS.sub(" ", text.lower())
    if not words.isascii():
        words = _UNSPACED.sub(lambda m: f" {' '.join(pairs(m[0]))} ", words)
    return words.split()


def pairs(run: str) -> list[str]:
    return [run[i : i + 2] for i in range(max(1, len(run) - 1))]


def beginnings(words: set[str]) -> set[str]:
    return {f" {w} "[:k] for w in words for k in range(4, min(len(w) + 2, LONGEST) + 1)}


def lengths(dictionary: bytes):
    """Compressed length of a spaced word, frame included, with this dictionary."""
    params = zstandard.ZstdCompressionParameters(
        window_log=18, strategy=zstandard.STRATEGY_BTLAZY2, min_match=5, hash_log=16, chain_log=16, search_log=6, target_length=32, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    held = zstandard.ZstdCompressionDict(dictionary + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    z = zstandard.ZstdCompressor(compression_params=params, dict_data=held)
    return lambda word: len(z.compress(f" {word} ".encode() + TAIL))


def gains(ordinary: bytes, toxic: bytes):
    a, b = lengths(ordinary), lengths(toxic)
    return lambda word: a(word) - b(word) if len(word) >= SHORTEST or _UNSPACED.match(word) else 0


def tail(k: int, n: int, p: float) -> float:
    """Probability of k or more among n where each comes with probability p."""
    log = lambda i: lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * np.log(p) + (n - i) * np.log1p(-p)
    return float(sum(np.exp(log(i)) for i in range(k, n + 1)))


def toxic_material(toxic: list[set[str]], ordinary: list[set[str]]) -> list[str]:
    """Beginnings with enough lift, rarest first; one that nearly always goes on as a longer one of them is left out."""
    have, other = Counter(), Counter()
    for words in toxic:
        have.update(beginnings(words))
    for words in ordinary:
        other.update(beginnings(words))
    tested = {s: n for s, n in have.items() if n >= LEAST}
    lifted = {s for s, n in tested.items() if n / len(toxic) >= LEAST_LIFT * (other[s] + 1) / len(ordinary)}
    p0 = len(toxic) / (len(toxic) + len(ordinary))
    chance = {s: tail(tested[s], tested[s] + other[s], p0) for s in lifted}
    # Benjamini and Hochberg: the most beginnings of which FALSE are expected to be there by chance.
    ranked = sorted(chance.values())
    bound = max((p for k, p in enumerate(ranked, 1) if p <= FALSE * k / len(tested)), default=-1.0)
    found = {s: tested[s] for s in lifted if chance[s] <= bound}
    covered = {s[:-1] for s, n in found.items() if n >= 0.8 * found.get(s[:-1], 1 << 60)}
    return sorted(set(found) - covered, key=lambda s: (found[s], s))


def total(docs: list[Counter]) -> Counter:
    out = Counter()
    for words in docs:
        out.update(words)
    return out


class Model:
    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights

    def features(self, words: Counter, memo: dict) -> np.ndarray:
        got, often = np.fromiter(map(memo.__getitem__, words), np.int16), np.fromiter(words.values(), np.int64)
        counts, n = np.array([often[got >= g].sum() for g in GAINS]), often.sum()
        return np.concatenate([np.sqrt(counts / (n + 20)), np.log1p([*counts, n])])

    def scorer(self):
        memo = Memo(gains(self.ordinary, self.toxic), 400_000)

        def work(texts: list[str]) -> dict:
            x = np.array([self.features(Counter(windows(t)), memo) for t in texts])
            return {"score": pa.array(sigmoid(x @ self.weights[:-1] + self.weights[-1]), pa.float64())}

        return work


def frequent(words: Counter) -> list[str]:
    """The most frequent words that fit into BASE_BYTES."""
    out, size = [], 0
    for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0])):
        size += len(w.encode()) + 1
        if size > BASE_BYTES:
            break
        out.append(w)
    return out


def dictionaries(bad: list[Counter], fine: list[Counter]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary."""
    material = "".join(toxic_material([set(w) for w in bad], [set(w) for w in fine]))
    often, often_bad = total(fine), total(bad)
    # What stands last in a dictionary is cheapest to refer to: the most frequent words, and toxic material.
    spaced = lambda words: " " + " ".join(words) + " "
    common, toxic = frequent(often)[::-1], (spaced(frequent(often_bad)[::-1]) + material).encode()
    shielded: list[str] = []
    for _ in range(ROUNDS):
        gain = gains(spaced([*shielded, *common]).encode(), toxic)
        hurt = sorted((-n * (g - 1), w) for w, n in often.items() if often_bad[w] / len(bad) < 4 * n / len(fine) and (g := gain(w)) >= 2)
        known = set(shielded)
        shielded += [w for _, w in hurt[:SHIELDED] if w not in known]
    return spaced([*shielded, *common]).encode(), toxic


def fit(docs: DataFrame, labels: DataFrame, m: int = 5, held: int = 0) -> Model:
    """Learn from labelled rows that are not held out, TRAIN_ROWS of each label at most."""
    count = lambda: lambda text: "\n".join(f"{w} {n}" for w, n in Counter(windows(text)).items()).encode()
    counted = lambda made: Counter({w: int(n) for w, n in (x.split() for x in made.decode().splitlines())})
    bad, fine = ([counted(x) for x in labelled_sample(docs, labels, "toxic", value, m, held, TRAIN_ROWS, count)] for value in (1, 0))
    return learned(bad, fine)


def learned(bad: list[Counter], fine: list[Counter]) -> Model:
    if not bad or not fine:
        return Model(b" ", b" ", np.array([*[0.0] * (2 * len(GAINS) + 1), -5.0]))
    x, y = [], []
    for half in (0, 1) if min(len(bad), len(fine)) > 1 else (None,):
        made = dictionaries(*(([d for i, d in enumerate(side) if i % 2 != half]) for side in (bad, fine)))
        model, memo = Model(*made, np.zeros(1)), Memo(gains(*made), 400_000)
        for label, side in ((1.0, bad), (0.0, fine)):
            kept = [d for i, d in enumerate(side) if half is None or i % 2 == half]
            x += [model.features(d, memo) for d in kept]
            y += [label] * len(kept)
    x, y = np.array(x), np.array(y)
    weights = logistic(x, y, ridge=0.1)
    weights[-1] -= threshold(x @ weights[:-1] + weights[-1], y)
    return Model(*dictionaries(bad, fine), weights)


def threshold(margins: np.ndarray, y: np.ndarray) -> float:
    """The margin from which texts are called toxic: where precision and recall are best together (F1, of equal ones the lowest).

    Half way between two texts, so that neither stands on it; 0 where it would be best to call all texts toxic, as nothing is told then.
    """
    order = np.argsort(-margins, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(margins[order][1:] < margins[order][:-1], True)  # of equal margins all or none are called
    f1[~last] = -1.0
    best = len(f1) - 1 - int(np.argmax(f1[::-1]))
    return float((margins[order][best] + margins[order][best + 1]) / 2) if best + 1 < len(y) else 0.0


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    return map_texts(docs, model.scorer, "score double", keep)
