"""What the classifiers of this folder share: which rows they may learn from, bounded samples, a logistic fit in numpy.

Samples are bounded in rows, not in the length of texts: tasks turn each sampled text, whole, into what a model learns
from, and only that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densigrid.llm.ship import map_texts


def remainder(doc_id: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % m


def first_by_hash(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """At most n rows, the same ones in every run: those of least hash.  A top-n, so no shuffle of all rows."""
    return df.orderBy(F.xxhash64(*cols), *cols).limit(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, value: int, m: int, held: int, n: int, make: Callable) -> list[bytes]:
    """What ``make`` gives for at most n rows with this label, none of them held out; rows without a label or text are left out.

    Labels of documents that are not there do not count towards n.
    """
    ids = labels.where((F.col(label) == value) & F.col("doc_id").isNotNull() & (remainder("doc_id", m) != held)).select("doc_id").distinct()
    there = ids.join(docs.where(F.col("text").isNotNull()).select("doc_id"), "doc_id", "left_semi")
    return learned_from(docs, first_by_hash(there, n, "doc_id"), n, make)


def learned_from(docs: DataFrame, few_ids: DataFrame, n: int, make: Callable) -> list[bytes]:
    """What ``make`` gives for the distinct texts of a bounded list of ids, in order of id, at most n; the list is small by
    its limit, so it is broadcast.  An id that stands in very many rows is made one row of each text before it moves."""
    found = made_in_tasks(docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(few_ids), "doc_id", "left_semi"), make, ["doc_id"])
    few = found.dropDuplicates(["doc_id", "text_hash"]).orderBy("doc_id", "text_hash").limit(n)
    first: dict[int, bytes] = {}
    for r in few.collect():
        first.setdefault(r.text_hash, r.made)
    return list(first.values())


def made_in_tasks(rows: DataFrame, make: Callable, keep: list[str]) -> DataFrame:
    """Columns ``keep``, text_hash, and in ``made`` the bytes that the function of ``make()`` gives for the text."""

    def work() -> Callable[[list[str]], dict]:
        one = make()
        return lambda texts: {"made": pa.array([one(t) for t in texts], pa.binary())}

    return map_texts(rows.withColumn("text_hash", F.xxhash64("text")), work, "made binary", [*keep, "text_hash"])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression, by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w
