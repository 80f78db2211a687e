"""Unsupervised pair scoring: Fellegi-Sunter with m and u by expectation-maximisation.

Agreement patterns are counted once (2^columns rows at most); the iterations run on those counts.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pattern_counts(bits: DataFrame, columns: list[str]) -> DataFrame:
    """The columns' patterns and how many pairs have each."""
    return bits.groupBy(*columns).agg(F.count("*").alias("n"))


def fit_em(patterns: np.ndarray, n: np.ndarray, iterations: int = 100, tolerance: float = 1e-4, prior: float = 0.1) -> tuple[np.ndarray, np.ndarray, float]:
    """m, u and the share of matches, from (patterns, columns) of 0 and 1 and their counts."""
    x, n = patterns.astype(float), n.astype(float)
    m, u = np.full(x.shape[1], 0.9), np.full(x.shape[1], 0.1)

    def safe(p):
        return np.clip(p, 1e-9, 1 - 1e-9)

    for _ in range(iterations):
        a = prior * np.prod(np.where(x > 0, safe(m), 1 - safe(m)), 1)
        b = (1 - prior) * np.prod(np.where(x > 0, safe(u), 1 - safe(u)), 1)
        g = a / (a + b)
        old = np.concatenate([m, u, [prior]])
        hits, misses = (g * n).sum(), ((1 - g) * n).sum()
        m = (g * n) @ x / max(hits, 1e-300)
        u = ((1 - g) * n) @ x / max(misses, 1e-300)
        prior = float(np.clip(hits / n.sum(), 1e-9, 1 - 1e-9))
        if np.abs(np.concatenate([m, u, [prior]]) - old).max() < tolerance:
            break
    return m, u, prior


def score_bits(bits: DataFrame, columns: list[str], m: dict[str, float], u: dict[str, float]) -> DataFrame:
    """bits with score: the logistic of the summed log odds, without the prior."""
    def safe(p: float) -> float:
        return min(max(p, 1e-9), 1 - 1e-9)

    odds = sum(F.when(F.col(c) > 0, float(np.log(safe(m[c]) / safe(u[c])))).otherwise(float(np.log((1 - safe(m[c])) / (1 - safe(u[c]))))) for c in columns)
    return bits.withColumn("score", 1 / (1 + F.exp(-odds)))


def fellegi_sunter(bits: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, float], dict[str, float]]:
    counts = pattern_counts(bits, columns).toPandas().sort_values(columns)  # 2^columns rows at most
    m, u, _ = fit_em(counts[columns].to_numpy(), counts["n"].to_numpy())
    m, u = dict(zip(columns, m.tolist())), dict(zip(columns, u.tolist()))
    return score_bits(bits, columns, m, u), m, u
