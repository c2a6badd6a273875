"""Labelled samples and a small network, for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def sample(labels: DataFrame, id_col: str, label_col: str, allowed: Column, most: dict[int, int], seed: int) -> tuple[list[tuple], dict[int, int]]:
    """([(id, label)] of at most `most[label]` rows of each label, rows of each label in all); only ids and labels are collected."""
    known = labels.filter(allowed & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = []
    for label, n in most.items():
        picked += [(r.id, r.label) for r in known.filter(F.col("label") == label).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).collect()]
    return picked, totals


class Network:
    """Inputs, one hidden layer of tanh, a logit; then a temperature and a shift of the prior."""

    def __init__(self, width: int = 24, seed: int = 3):
        self.width, self.seed, self.temperature, self.shift = width, seed, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 300, rate: float = 0.01, decay: float = 1e-3) -> Network:
        """Adam on four fifths of the rows; the temperature is set on the others."""
        rng = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        order = rng.permutation(len(z))
        held, used = order[: len(z) // 5], order[len(z) // 5 :]
        params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], self.width)), np.zeros(self.width), rng.normal(0, 0.1, self.width), np.zeros(1)]
        self.params = params
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            mine = rng.permutation(used)
            for batch in np.array_split(mine, max(1, len(mine) // 512)):
                if not len(batch):
                    continue
                h = np.tanh(z[batch] @ params[0] + params[1])
                error = (1 / (1 + np.exp(-(h @ params[2] + params[3]))) - y[batch]) / len(batch)
                back = np.outer(error, params[2]) * (1 - h * h)
                t += 1
                for k, g in enumerate((z[batch].T @ back + decay * params[0], back.sum(0), h.T @ error + decay * params[2], error.sum(keepdims=True))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    params[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        if len(held):
            logit = self.logit(x[held])
            losses = {s: np.mean(np.logaddexp(0, np.where(y[held] > 0, -logit, logit) / s)) for s in np.geomspace(0.5, 5, 40)}
            self.temperature = float(min(losses, key=losses.get))
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.params[0] + self.params[1]) @ self.params[2] + self.params[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature + self.shift, -40, 40)))


class Constant:
    """Stands in for a model where the labels hold one class only, or none."""

    def __init__(self, value: float):
        self.value = value

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)
