"""Staged tuning of threshold, one-to-one threshold and singleton rule."""
from __future__ import annotations

from pyspark.sql import DataFrame

from . import decision, metrics

#: Multiples of 0.05 as they come from repeated steps, which hold 0.30000000000000004.
STEPS = [0.1 + 0.05 * i for i in range(17)]


def staged(scored: DataFrame, truth: DataFrame, spine: DataFrame, min_scores=(0.3, 0.4, 0.5, 0.6, 0.7, 0.8), min_margins=(0.0, 0.05, 0.1, 0.15)) -> dict[str, float]:
    """threshold, one_to_one_threshold, min_score, min_margin and f05; the first best of each stage stays."""
    first = metrics.best(metrics.sweep(scored, truth, spine, STEPS, one_to_one=False)).first()["threshold"]
    near = sorted({round(first + 0.05 * k, 10) for k in range(-4, 5) if 0 < first + 0.05 * k < 1})
    best = metrics.best(metrics.sweep(scored, truth, spine, near)).first()
    out = {"threshold": first, "one_to_one_threshold": best["threshold"], "min_score": 0.0, "min_margin": 0.0, "f05": best["macro_f05"]}
    for s in min_scores:
        for m in min_margins:
            f = metrics.summary(decision.singleton_rule(scored, best["threshold"], s, m), truth, spine).first()["macro_f05"]
            if f > out["f05"]:
                out |= {"min_score": s, "min_margin": m, "f05": f}
    return out
