"""Labelled rows for training, the held-out fold, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick


def held_out() -> Column:
    """Rows whose crc32(doc_id as text) mod 4 is 2 are never learned from. A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, bounds: tuple[int, int]) -> list[tuple[str, int]]:
    """At most bounds[y] distinct texts labelled y, y in (0, 1), those first by a hash of doc_id.

    Only the bounded list of ids is broadcast; texts come from one scan. Labels other than 0
    and 1, ids without a document and null texts are passed over.
    """
    marked = pick(labels, doc_id="bigint", **{label: "int"}).where(~held_out() & F.col("doc_id").isNotNull())
    first = F.xxhash64("doc_id", F.lit(label))
    chosen = [r for y in (0, 1) for r in marked.where(F.col(label) == y).orderBy(first, "doc_id").limit(bounds[y]).select("doc_id", label).collect()]
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame([(r[0], r[1]) for r in chosen], "doc_id bigint, y int")
    rows = pick(docs, doc_id="bigint", text="string").join(F.broadcast(ids), "doc_id").where("text is not null").select("text", "y").collect()
    return sorted({(r["text"], r["y"]) for r in rows})


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the intercept first), centre and scale of a ridge logistic regression, by Newton steps."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - centre) / scale])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge * len(x) / 100)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w, centre, scale


def probability(x: np.ndarray, fit: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    w, centre, scale = fit
    return 1 / (1 + np.exp(-np.clip(w[0] + (x - centre) / scale @ w[1:], -30, 30)))
