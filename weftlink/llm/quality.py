"""Quality rules: base rules, then robust multivariate outliers.

One pass over the texts gives word, symbol, line and repetition counts.  Texts that pass the base
rules become vectors of transformed statistics (VECTOR), and for every language and source the
minimum-covariance-determinant estimate is found by concentration steps: with the present centre
and scatter all distances are taken, the h = 3/4 of the group with the least distances gives the
next centre and scatter, whose determinant can't be larger.  A text is rejected if its squared
Mahalanobis distance is over CUTOFF, the chi-square quantile at QUANTILE.

Every step is one aggregation over all rows of all groups: rows are binned by distance, and each
(group, bin) gets its count and the sums of values and products, in fixed-point integers, which are
exact whatever the order.  The bins of a group, a bounded number, then give the next estimate; no
group is ever gathered or sorted.

Every group has an estimate of its own, whatever its size: its centre and scatter are averaged with
those of all texts, which weigh as much as PRIOR texts of the group.  So a large group stands for
itself and one text alone is judged by all.  Directions in which a group spreads less than FLOOR are
widened to it, and no others, as most clean texts have no symbols or repeated lines at all and would
make the scatter singular.

Edge cases: a null text has no words and fails the base rules; null language and source are values
of their own; repeated rows count as often as they occur, and equal distances are within or without the
nearest h together; a very long text is counted whole; columns with other names don't matter; an empty
table gives an empty one.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, col, mapped, materialise, mix, pieces, range_hash, window_hash

#: mean word length (log), then roots of: symbols a word, repeated lines a line, repeated words a
#: word, capitals a letter.
VECTOR = ("word_length", "symbols", "dup_lines", "repeats", "capitals")
FLOOR = (0.06, 0.08, 0.1, 0.1, 0.05)
PRIOR, STEPS, H, QUANTILE = 100, 6, 0.75, 0.999
#: Fixed-point scale of the vectors, and bins a unit of ln(1 + squared distance).
SCALE, BINS = 4096, 64
MOST_BROADCAST = 10_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[0xC3:0xF5] = True  # the first byte of other letters


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return total[off[1:]] - total[off[:-1]]


def _dup_lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each text, its lines with a word, and those equal to an earlier line."""
    data, off = w.data, w.off
    if not len(w.start):
        return np.zeros(w.n, np.int64), np.zeros(w.n, np.int64)
    feed = data == 10
    start = np.union1d(off[:-1][off[:-1] < len(data)], np.flatnonzero(feed) + 1)
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))
    h = range_hash(data, start, np.where(feed[end - 1], end - 1, end))
    words = np.bincount(np.searchsorted(start, w.start, "right") - 1, minlength=len(start)) > 0
    doc = np.searchsorted(off, start, "right") - 1
    h, doc = h[words], doc[words]
    _, first = np.unique(mix(h + mix(doc.astype(U))), return_index=True)
    lines = np.bincount(doc, minlength=w.n)
    return lines, lines - np.bincount(doc[first], minlength=w.n)


def _repeat_words(w: Words, k: int = 3) -> np.ndarray:
    """For each text, its words in k-word windows that occur twice or more."""
    if len(w.hash) < k:
        return np.zeros(w.n, np.int64)
    h = window_hash(w.hash, k)
    same = w.doc[k - 1:] == w.doc[:len(h)]
    at = np.flatnonzero(same)
    _, place, n = np.unique(mix(h[at] + mix(w.doc[at].astype(U))), return_inverse=True, return_counts=True)
    at = at[n[place.reshape(-1)] > 1]
    covered = np.zeros(len(w.hash), bool)
    for j in range(k):
        covered[at + j] = True
    return np.bincount(w.doc[covered], minlength=w.n)


def text_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    w = Words(texts)
    lead = (w.data & 0xC0) != 0x80
    blank = (w.data == 32) | ((w.data >= 9) & (w.data <= 13))
    lines, dup = _dup_lines(w)
    upper = _UPPER[w.data]
    upper[1:] |= (w.data[:-1] == 0xC3) & (w.data[1:] >= 0x80) & (w.data[1:] <= 0x9E)  # accented capitals
    return {
        "n_words": np.diff(w.first), "word_chars": _per_text(lead & ~blank, w.off), "n_symbols": _per_text(_SYMBOL[w.data], w.off),
        "n_dup_lines": dup, "n_repeat_words": _repeat_words(w), "n_lines": lines,
        "n_upper": _per_text(upper, w.off), "n_letters": _per_text(_LETTER[w.data], w.off),
    }


def _vector(s: dict[str, np.ndarray]) -> np.ndarray:
    n = np.maximum(s["n_words"], 1)
    return np.stack([
        np.log(np.maximum(s["word_chars"], 1) / n), np.sqrt(s["n_symbols"] / n), np.sqrt(s["n_dup_lines"] / np.maximum(s["n_lines"], 1)),
        np.sqrt(s["n_repeat_words"] / n), np.sqrt(s["n_upper"] / np.maximum(s["n_letters"], 1)),
    ], 1)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, and the vector in fixed point as x."""
    names = ["doc_id", "lang", "source", *COUNTS, "base_failed", "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                s = text_statistics(col(part, "text"))
                failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
                x = np.rint(_vector(s) * SCALE).astype(np.int64)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([col(part, "doc_id"), col(part, "lang"), col(part, "source"), *(pa.array(s[c], pa.int64()) for c in COUNTS), pa.array(failed), rows], names)

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "lang", "source")}
    schema = ", ".join([*(f"{c} {k}" for c, k in kinds.items()), *(f"{c} long" for c in COUNTS), "base_failed boolean", "x array<long>"])
    return mapped(docs.select("doc_id", "lang", "source", "text"), run, schema)


Estimate = tuple[np.ndarray, np.ndarray]


def _start(bins: pd.DataFrame, prior: Estimate | None) -> pd.DataFrame:
    """Median and median absolute deviation of each value, from (i, bin, n)."""
    p = len(VECTOR)
    mu, sd = np.zeros(p), np.zeros(p)
    for i, b in bins.groupby("i"):
        v, n = (b["bin"].to_numpy() + 0.5) / BINS, b["n"].to_numpy()

        def median(v, n):
            o = np.argsort(v, kind="stable")
            return v[o][np.searchsorted(np.cumsum(n[o]), n.sum() / 2)]

        mu[i] = median(v, n)
        sd[i] = 1.4826 * median(np.abs(v - mu[i]), n)
    return _model(bins, mu, np.diag(np.maximum(sd, FLOOR) ** 2), bins["n"].sum() / p, prior)


def _model(bins: pd.DataFrame, mu: np.ndarray, cov: np.ndarray, n: float, prior: Estimate | None) -> pd.DataFrame:
    """The estimate of n texts, averaged with the prior one."""
    if prior is not None:
        own = n / (n + PRIOR)
        gap = mu - prior[0]
        mu, cov = own * mu + (1 - own) * prior[0], own * cov + (1 - own) * prior[1] + own * (1 - own) * np.outer(gap, gap)
    return pd.DataFrame({"g": [bins["g"].iloc[0]], "mu": [mu.tolist()], "cov": [cov.reshape(-1).tolist()], "prec": [np.linalg.inv(cov).reshape(-1).tolist()]})


def _concentrate(bins: pd.DataFrame, prior: Estimate | None) -> pd.DataFrame:
    """The centre and scatter of the nearest h rows; their bins come with sums of values and products."""
    p = len(VECTOR)
    bins = bins.sort_values("bin")
    cum = bins["n"].cumsum().to_numpy()
    part = bins.iloc[:int(np.searchsorted(cum, np.ceil(H * cum[-1]))) + 1]
    n = float(part["n"].sum())
    s = np.array([sum(map(int, part[f"s{i}"])) for i in range(p)], float) / SCALE
    mu = s / n
    cov = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cov[i, j] = cov[j, i] = sum(map(int, part[f"s{i}_{j}"])) / SCALE ** 2 / n - mu[i] * mu[j]
    # consistency: the scatter of the inner h is too small by a factor that depends on h and p alone
    scale = np.outer(FLOOR, FLOOR)
    wide, axes = np.linalg.eigh(cov * _consistency(H, p) / scale)
    return _model(bins, mu, axes * np.maximum(wide, 1) @ axes.T * scale, float(cum[-1]), prior)


def _chi2_cdf(x: float, k: int) -> float:
    """By the series of the lower incomplete gamma function."""
    from math import exp, lgamma, log

    a, y = k / 2, x / 2
    term = total = 1 / a
    for n in range(1, 500):
        term *= y / (a + n)
        total += term
    return total * exp(-y + a * log(y) - lgamma(a)) if y > 0 else 0.0


def _chi2_quantile(h: float, p: int) -> float:
    lo, hi = 0.0, 100.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, p) < h else (lo, mid)
    return lo


def _consistency(h: float, p: int) -> float:
    return h / _chi2_cdf(_chi2_quantile(h, p), p + 2)


CUTOFF = _chi2_quantile(QUANTILE, len(VECTOR))


def _distance():
    """Squared Mahalanobis distance of x, in fixed point, from mu under prec."""
    p = len(VECTOR)
    d = [F.col("x")[i] / float(SCALE) - F.col("mu")[i] for i in range(p)]
    return sum(d[i] * d[j] * F.col("prec")[i * p + j] for i in range(p) for j in range(p))


_SHAPE = "g string, mu array<double>, cov array<double>, prec array<double>"


def estimates(fit: DataFrame, prior: Estimate | None, steps: int, fold) -> DataFrame:
    """The estimate of each group from (g, x) rows; fold: how a table of one row a group is joined."""
    p = len(VECTOR)
    bins = fit.select("g", F.posexplode("x").alias("i", "v")).groupBy("g", "i", F.floor(F.col("v") * BINS / SCALE).alias("bin")).agg(F.count("*").alias("n"))
    model = materialise(bins.groupBy("g").applyInPandas(lambda b: _start(b, prior), _SHAPE), "quality-mcd")
    x = [F.col("x")[i] for i in range(p)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(p)] + [F.sum((x[i] * x[j]).cast("decimal(38,0)")).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]
    for _ in range(steps):
        near = fit.join(fold(model), "g").withColumn("bin", F.floor(F.log1p(_distance()) * BINS))
        model = materialise(near.groupBy("g", "bin").agg(F.count("*").alias("n"), *sums).groupBy("g").applyInPandas(lambda b: _concentrate(b, prior), _SHAPE), "quality-mcd")
    return model


def judged(docs: DataFrame, cutoff: float = CUTOFF, steps: int = STEPS) -> DataFrame:
    """doc_id, the counts, base_failed, distance (null if none was taken) and kept."""
    p = len(VECTOR)
    rows = materialise(statistics(docs).withColumn("g", F.to_json(F.struct("lang", "source"))), "quality-statistics")
    fit = rows.filter("not base_failed").select("g", "x")
    all_ = estimates(fit.withColumn("g", F.lit("")), None, steps, F.broadcast).first()  # one row
    prior = (np.array(all_["mu"]), np.array(all_["cov"]).reshape(p, p)) if all_ else None
    few = fit.select("g").distinct().limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    model = estimates(fit, prior, steps, F.broadcast if few else lambda x: x)
    out = rows.join(F.broadcast(model) if few else model, "g", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return out.select("doc_id", *COUNTS, "base_failed", "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"))
