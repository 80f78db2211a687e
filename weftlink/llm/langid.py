"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of WINDOW bytes.  In each, one recurrent layer runs
forward and one backward (gates and candidates use the soft sign x / (1 + |x|) in place of tanh and
its half in place of the sigmoid: cheap, and trained as such); from both states every byte gets
probabilities of all languages.  A document pools them over all its bytes: the language with the
largest mean log probability, and its mean probability as the score.

The network is trained in numpy by backpropagation through time on the driver, on windows from
about SAMPLE labelled rows that a hash of the id chooses (a documented bound; fewer if there are
fewer).  All else runs over whole texts, one pass, without a shuffle; the weights, a few thousand
numbers, go with the task.

Edge cases: null texts and texts without a letter are `und` with score 0; rows with a null language
teach nothing; without any labelled row all are `und`; repeated rows and columns with other names
don't matter; an empty table gives an empty one.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, crc_mod, pieces, mapped, text_bytes

SAMPLE, HIDDEN, WINDOW, STEPS, BATCH, SEED = 3000, 8, 96, 260, 96, 7
Weights = dict[str, np.ndarray]


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _layer(x: np.ndarray, w: np.ndarray, u: np.ndarray, c: np.ndarray, keep: bool = False):
    """States after each of T steps. x: (T, N) bytes; w: (256, 3H); u: (H, 3H); c: (3H,) on the recurrent side."""
    steps, n = x.shape
    size = u.shape[0]
    h = np.zeros((n, size), np.float32)
    out = np.empty((steps, n, size), np.float32)
    kept = []
    for t in range(steps):
        a = w[x[t]]
        g = h @ u
        g += c
        zr = a[:, :2 * size] + g[:, :2 * size]
        gates = zr / (1 + np.abs(zr))
        gates *= 0.5
        gates += 0.5
        z, r = gates[:, :size], gates[:, size:]
        pre = r * g[:, 2 * size:]
        pre += a[:, 2 * size:]
        cand = pre / (1 + np.abs(pre))
        if keep:
            kept.append((h, zr, z, r, g[:, 2 * size:].copy(), pre, cand))
        h = h - cand
        h *= z
        h += cand
        out[t] = h
    return (out, kept) if keep else out


def _layer_back(d: np.ndarray, x: np.ndarray, u: np.ndarray, kept: list, dw: np.ndarray, du: np.ndarray, dc: np.ndarray) -> None:
    """Backpropagation through time; d: (T, N, H) from above."""
    steps, n, size = d.shape
    dh = np.zeros((n, size), np.float32)
    for t in range(steps - 1, -1, -1):
        h, zr, z, r, gn, pre, cand = kept[t]
        dh = dh + d[t]
        dpre = dh * (1 - z) / (1 + np.abs(pre)) ** 2
        dz = dh * (h - cand)
        dr = dpre * gn
        dzr = 0.5 * np.concatenate([dz, dr], 1) / (1 + np.abs(zr)) ** 2
        da = np.concatenate([dzr, dpre], 1)
        dg = np.concatenate([dzr, dpre * r], 1)
        np.add.at(dw, x[t], da)
        du += h.T @ dg
        dc += dg.sum(0)
        dh = dh * z + dg @ u.T


def _softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, n_labels: int, steps: int = STEPS, hidden: int = HIDDEN, seed: int = SEED) -> Weights:
    """windows: (M, WINDOW) bytes; every position is taught its document's label; Adam."""
    rng = np.random.default_rng(seed)
    p: Weights = {}
    for side in "fb":
        p[f"w{side}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        p[f"u{side}"] = rng.normal(0, 0.3, (hidden, 3 * hidden)).astype(np.float32)
        p[f"c{side}"] = np.zeros(3 * hidden, np.float32)
        p[f"c{side}"][:hidden] = 1  # remember at first
    p["v"] = rng.normal(0, 0.3, (2 * hidden, n_labels)).astype(np.float32)
    p["b"] = np.zeros(n_labels, np.float32)
    m = {k: np.zeros_like(a) for k, a in p.items()}
    s = {k: np.zeros_like(a) for k, a in p.items()}
    by_label = [np.flatnonzero(labels == k) for k in range(n_labels)]
    for step in range(1, steps + 1):
        # as many windows of each language
        pick = np.concatenate([rng.choice(rows, max(1, BATCH // n_labels)) for rows in by_label])
        x, y = np.ascontiguousarray(windows[pick].T), labels[pick]
        back = np.ascontiguousarray(x[::-1])
        hf, kf = _layer(x, p["wf"], p["uf"], p["cf"], True)
        hb, kb = _layer(back, p["wb"], p["ub"], p["cb"], True)
        both = np.concatenate([hf, hb[::-1]], 2)
        q = _softmax(both @ p["v"] + p["b"])
        q[:, np.arange(len(y)), y] -= 1
        q /= q.shape[0] * q.shape[1]
        g = {k: np.zeros_like(a) for k, a in p.items()}
        g["v"] = np.einsum("tnh,tnl->hl", both, q)
        g["b"] = q.sum((0, 1))
        d = q @ p["v"].T
        _layer_back(np.ascontiguousarray(d[..., :hidden]), x, p["uf"], kf, g["wf"], g["uf"], g["cf"])
        _layer_back(np.ascontiguousarray(d[::-1, :, hidden:]), back, p["ub"], kb, g["wb"], g["ub"], g["cb"])
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1))) * min(1.0, 1.0 / max(norm, 1e-9))
        for k, a in g.items():
            m[k] = 0.9 * m[k] + 0.1 * a
            s[k] = 0.99 * s[k] + 0.01 * a * a
            p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-6)
    return p


def position_scores(p: Weights, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, sums of log probabilities and of probabilities over its bytes."""
    size = np.diff(off)
    n_windows = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), n_windows)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    start = off[:-1][doc] + nth * WINDOW
    length = np.minimum(off[1:][doc] - start, WINDOW)
    labels = len(p["b"])
    logs, probs = np.zeros((len(size), labels)), np.zeros((len(size), labels))
    most = 8192
    for lo in range(0, len(doc), most):
        st, ln, dc = start[lo:lo + most], length[lo:lo + most], doc[lo:lo + most]
        at = st[:, None] + np.arange(WINDOW)
        real = np.arange(WINDOW) < ln[:, None]
        x = np.where(real, data[np.minimum(at, len(data) - 1)], 0).T
        x = np.ascontiguousarray(x)
        hf = _layer(x, p["wf"], p["uf"], p["cf"])
        hb = _layer(np.ascontiguousarray(x[::-1]), p["wb"], p["ub"], p["cb"])[::-1]
        half = hf.shape[2]
        a = hf.reshape(-1, half) @ p["v"][:half] + np.ascontiguousarray(hb).reshape(-1, half) @ p["v"][half:] + p["b"]
        a = [np.ascontiguousarray(a[:, k]) for k in range(labels)]  # label by label: long vectors
        top = a[0]
        for b in a[1:]:
            top = np.maximum(top, b)
        e = [np.exp(b - top) for b in a]
        total = sum(e[1:], e[0].copy())
        log_total = np.log(total)
        mask = real.T.reshape(-1)
        for k in range(labels):
            lp = np.where(mask, a[k] - top - log_total, 0).reshape(WINDOW, -1).sum(0)
            pr = np.where(mask, e[k] / total, 0).reshape(WINDOW, -1).sum(0)
            logs[:, k] += np.bincount(dc, lp, len(size))
            probs[:, k] += np.bincount(dc, pr, len(size))
    return logs, probs


def fit(docs: DataFrame, held_out: int | None = 2, sample: int = SAMPLE) -> tuple[list[str], Weights]:
    """Languages and weights, from rows outside the held-out part (crc32(doc_id) mod 4)."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if held_out is not None:
        rows = rows.filter(crc_mod("doc_id", 4) != held_out)
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 40))
    n = rows.count()
    if not n:
        return [], {}
    rows = rows.filter(draw < int(min(1.0, sample / n) * (1 << 40)))
    # one window of each chosen text, at a place that its hash chooses
    at = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1
    got = rows.select("lang", F.col("text").substr(at.cast("int"), F.lit(WINDOW)).alias("w"), F.xxhash64("doc_id", "text").alias("h")).toPandas().sort_values("h")
    names = sorted(got["lang"].unique())
    x = np.zeros((len(got), WINDOW), np.uint8)
    for i, w in enumerate(got["w"]):
        raw = np.frombuffer(w.encode()[:WINDOW], np.uint8)
        x[i, :len(raw)] = raw
    return names, train(x, got["lang"].map({k: i for i, k in enumerate(names)}).to_numpy(), len(names))


def _letters(texts: pa.Array) -> np.ndarray:
    data, off = text_bytes(texts)
    ascii_ = ((data | 32) >= 97) & ((data | 32) <= 122)
    total = np.append(0, np.cumsum(ascii_))
    out = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~out & (np.diff(off) > 0)).tolist():
        out[i] = any(c.isalpha() for c in texts[i].as_py())
    return out


def predicted(docs: DataFrame, model: tuple[list[str], Weights], names_of: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs with the predicted language and its score, named as names_of says; columns
    of docs with these names are replaced, so a caller who keeps them gives other names."""
    names, weights = model
    docs = docs.drop(*names_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                texts = col(part, "text")
                data, off = text_bytes(texts)
                label, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if names and len(data):
                    logs, probs = position_scores(weights, data, off)
                    best = logs.argmax(1)
                    letters = _letters(texts)
                    score = np.where(letters, probs[np.arange(len(best)), best] / np.maximum(np.diff(off), 1), 0).clip(0, 1)
                    label = [names[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(label, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, *names_of])

    schema = docs.limit(0).withColumns({names_of[0]: F.lit("").cast("string"), names_of[1]: F.lit(0.0)}).schema
    return mapped(docs, run, schema)


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """The columns of op3."""
    rows = predicted(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return rows.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
