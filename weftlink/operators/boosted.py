"""Gradient-boosted trees over all pairs of two tables that meet by equal keys, as matrices.

A pair's features are its score, its rank within its entity and its gap to 1.  The trees see bins alone, as
those of models.fit_trees do, so all that they learn from is how many pairs of either label lie in a cell of
bins: three passes find the exact quantiles of the scores, a fourth ranks the pairs and counts the cells, and
the trees are fitted on at most 32^3 cells.  A last pass ranks the pairs again and gives each its cell's
probability; only that one makes rows of Spark.

Rows of one key and value have the same scores: they share a block, where their scores and ranks are made once
and count as often as there are rows.
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import decision
from .graph import checkpointed
from .matrix import Pairs, numbers, tiles
from .models import BINS

#: Pairs that a block of the left is to have, the least and most rows of it, and pairs of a list of results.
SHARE, LEAST, MOST, OUT = 1 << 22, 256, 8192, 1 << 16

#: Bits of a score that the first and the second pass leave open.
WIDE, NARROW = 48, 34


@dataclass(frozen=True)
class Dealt:
    """The pairs of both tables, dealt into blocks of entities, each with all rows of its key.

    met: l (structs of id, value and the ids of links), r (structs of id and value)
    rows: s1_id, cand_id, score, rank and is_match of the pairs of entities that have several rows, or None
    sizes: how many entities have how many pairs"""
    met: DataFrame
    rows: DataFrame | None
    sizes: list[tuple[int, int]]
    score: Callable[[np.ndarray, np.ndarray], np.ndarray]

    def mapped(self, block: Callable, rows: Callable, schema: str) -> DataFrame:
        """block(columns of l, columns of r) and rows(columns of rows) yield record batches of the schema."""
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    sides = (batch.column(c).slice(i, 1).flatten() for c in (0, 1))
                    yield from block(*({f.name: x for f, x in zip(s.type, s.flatten())} for s in sides))

        def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from rows({f.name: x for f, x in zip(batch.schema, batch.columns)})

        out = self.met.mapInArrow(task, schema)
        return out if self.rows is None else out.unionByName(self.rows.mapInArrow(plain, schema))

    def counted(self, keys: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray | None]], cells: int) -> dict[int, int]:
        """How many scores have each key: keys gives, for an array of scores, their keys (under `cells`, or any if that
        is 0) and a mask of those that count, or None for all."""
        score = self.score

        def found(many: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(cells)
            for s, w in many:
                k, of = keys(s)
                if of is not None:
                    k, w = k[of], w[of]
                if cells:
                    n += np.bincount(k, w, cells)
                elif len(k):
                    k, at = np.unique(k, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.bincount(at, w).astype(np.int64))], ["k", "n"])
            if cells:
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[k].astype(np.int64))], ["k", "n"])

        def block(a: dict, b: dict) -> Iterator[pa.RecordBatch]:
            (x, v), (y, w) = (np.unique(numbers(c["value"]), return_counts=True) for c in (a, b))
            return found((score(x[lo:hi, None], y[None, :]).ravel(), np.outer(v[lo:hi], w).ravel()) for lo, hi in tiles(len(x), len(y)))

        out = self.mapped(block, lambda c: found([(numbers(c["score"]), np.ones(len(c["score"])))]), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
        return {r["k"]: r["n"] for r in out.toLocalIterator()}


def dealt(pairs: Pairs, truth: DataFrame) -> Dealt:
    """truth: (s1_id, cand_id)."""
    tasks = int(truth.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = pairs.left.select("id", "key", "value").filter("key IS NOT NULL").withColumn("alike", F.count("*").over(Window.partitionBy("id")))
    left, right = checkpointed(left), checkpointed(pairs.right.select("id", "key", "value").filter("key IS NOT NULL"))
    truth = checkpointed(truth.groupBy(F.col("s1_id").alias("id")).agg(F.collect_set("cand_id").alias("links")))
    met = right.groupBy("key").agg(F.count("*").alias("width"))
    one = left.filter("alike = 1").drop("alike")
    n = one.groupBy("key").agg(F.count("*").alias("rows")).join(met, "key")
    sizes = [(r["width"], r["n"]) for r in n.groupBy("width").agg(F.sum("rows").alias("n")).collect()]
    most = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.floor(F.lit(SHARE) / F.col("width"))))
    n = checkpointed(n.select("key", F.ceil(F.col("rows") / most).cast("long").alias("n")))
    same = one.groupBy(F.col("key").alias("k"), F.col("value").alias("v")).agg(F.count("*").alias("same"))
    l = one.join(n, "key").join(same, (F.col("key") == F.col("k")) & F.col("value").eqNullSafe(F.col("v")))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("same") / MOST).cast("long"))  # a common value has several blocks
    l = l.withColumn("at", F.pmod(F.xxhash64("value", part), F.col("n"))).join(truth, "id", "left")
    l = l.groupBy("key", "at").agg(F.collect_list(F.struct("id", "value", "links")).alias("l"))
    r = right.groupBy("key").agg(F.collect_list(F.struct("id", "value")).alias("r"))
    r = r.join(n, "key").select("key", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("at"))
    # dealt by number: few bytes make much work, so adaptive execution must not put the blocks into one task
    met = checkpointed(l.repartition(tasks, "key", "at").join(r.repartition(tasks, "key", "at"), ["key", "at"])).repartition(tasks, "key", "at").select("l", "r")
    several = left.filter("alike > 1")
    if several.isEmpty():
        return Dealt(met, None, sizes, pairs.score)

    score, columns = pairs.score, "s1_id string, cand_id string, score double"

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score(numbers(b["a"]), numbers(b["b"]))
            yield pa.RecordBatch.from_arrays([b["s1_id"], b["cand_id"], pa.array(s, mask=np.isnan(s))], ["s1_id", "cand_id", "score"])

    both = several.select(F.col("id").alias("s1_id"), "key", F.col("value").alias("a")).join(right.select(F.col("id").alias("cand_id"), "key", F.col("value").alias("b")), "key")
    links = truth.select(F.col("id").alias("s1_id"), F.explode("links").alias("cand_id"))
    rows = checkpointed(decision.with_labels(decision.ranked(both.select("s1_id", "cand_id", "a", "b").mapInArrow(scores, columns)), links))
    sizes += [(r["n"], r["m"]) for r in rows.groupBy("s1_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("m")).collect()]
    return Dealt(met, rows, sizes, pairs.score)


def ordered(s: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles."""
    k = (s + 0.0).view(np.int64)  # no negative zero
    return k ^ ((k >> 63) & 0x7FFFFFFFFFFFFFFF)


def double(k: int) -> float:
    """What ordered() gives k for."""
    return float(np.array(k ^ ((k >> 63) & 0x7FFFFFFFFFFFFFFF), np.int64).view(np.float64))


#: Kinds of scores that are no cells: missing or infinite, and those under 0 and over 1, which are counted besides.
BAD = 1 << 16


def _least(counts: list[tuple[int, int]], places: list[int]) -> list[tuple[int, int]]:
    """For each place (from 1) among as many values as are counted, in ascending order, the value and the place among its equals."""
    values, upto = [v for v, _ in counts], np.cumsum([n for _, n in counts])
    at = np.searchsorted(upto, places, "left")
    return [(values[i], int(p - (upto[i - 1] if i else 0))) for i, p in zip(at, places)]


def quantiles(d: Dealt) -> tuple[list[float], list[float], list[float]]:
    """The least values of the bins, but the first, of score, rank and gap: exact quantiles of all pairs, missing and
    infinite ones being 0."""
    total = sum(n * m for n, m in d.sizes)
    places = [max(1, -(-k * total // BINS)) for k in range(BINS)]
    zero = int(ordered(np.zeros(1))[0])

    def wide(s: np.ndarray) -> tuple[np.ndarray, None]:
        return np.where(np.isfinite(s), (ordered(s) >> WIDE) + (BAD >> 1), BAD), None

    first = d.counted(wide, BAD + 1)
    bad = first.pop(BAD, 0)
    found: dict[int, float] = {}  # the finite score of a place in ascending order

    def search(wanted: list[int]) -> None:
        wanted = sorted({p for p in wanted if p not in found})
        if not wanted:
            return
        in_first = _least(sorted(first.items()), wanted)
        cells = sorted({c for c, _ in in_first})
        of, step = np.full(BAD + 1, -1), 1 << (WIDE - NARROW)
        of[cells] = np.arange(len(cells))

        def narrow(s: np.ndarray) -> np.ndarray:
            k = ordered(s)
            cell = of[(k >> WIDE) + (BAD >> 1)]
            return np.where(np.isfinite(s) & (cell >= 0), cell * step + ((k >> NARROW) & (step - 1)), -1)

        def second_keys(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            k = narrow(s)
            return k, k >= 0

        second = d.counted(second_keys, len(cells) * step)
        by = {c: [(k, n) for k, n in sorted(second.items()) if k // step == i] for i, c in enumerate(cells)}
        in_second = [_least(by[c], [p])[0] for c, p in in_first]
        near = np.zeros(len(cells) * step + 1, bool)  # -1 is none
        near[sorted({k for k, _ in in_second})] = True
        third: dict[int, list] = {}
        for k, n in sorted(d.counted(lambda s: (ordered(s), near[narrow(s)]), 0).items()):
            cell = of[(k >> WIDE) + (BAD >> 1)] * step + ((k >> NARROW) & (step - 1))
            third.setdefault(int(cell), []).append((k, n))
        found.update({p: double(_least(third[k], [q])[0][0]) for p, (k, q) in zip(wanted, in_second)})

    some = total - bad
    if not bad:
        search([*places, *[total + 1 - p for p in places]])
        scores, gaps = [found[p] for p in places], [1 - found[total + 1 - p] for p in places]
    else:
        below = sum(n for k, n in first.items() if k < (zero >> WIDE) + (BAD >> 1))
        over = sum(n for _, n in d.counted(lambda s: (np.ones(len(s), int), (s > 1) & np.isfinite(s)), 2).items())

        def merged(place: int, less: int) -> int:
            """The place among finite values, 0 for a missing one, `less` of which are under 0."""
            return place if place <= less else 0 if place <= less + bad else place - bad

        s, g = [merged(p, below) for p in places], [merged(p, over) for p in places]
        search([*[p for p in s if p], *[some + 1 - p for p in g if p]])
        scores, gaps = [found[p] if p else 0.0 for p in s], [1 - found[some + 1 - p] if p else 0.0 for p in g]
    ranks = [bisect_left(range(1, max(n for n, _ in d.sizes) + 1), p, key=lambda r: sum(m * min(r, n) for n, m in d.sizes)) + 1 for p in places]
    return tuple(sorted({float(x) for x in v if x > v[0]}) for v in (scores, ranks, gaps))


@dataclass(frozen=True)
class Cells:
    """Bins of score, rank and gap; score and gap make a level, as both hang on the score alone."""
    scores: np.ndarray
    ranks: np.ndarray
    gaps: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        """The least scores of the levels but the first."""
        def first(gap: float) -> float:
            """The least score whose gap is under `gap`."""
            lo, hi = (int(ordered(np.array([x]))[0]) for x in (-np.finfo(float).max, np.finfo(float).max))
            while lo < hi:
                k = (lo + hi) // 2
                lo, hi = (lo, k) if 1 - double(k) < gap else (k + 1, hi)
            return double(lo)

        return np.unique(np.concatenate([self.scores, [first(g) for g in self.gaps]]))

    def features(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bins of score and of gap of each level; the last is that of missing and infinite scores."""
        at, gap = np.append(np.append(-np.inf, ends), 0.0), np.append(1 - np.append(-np.inf, ends), 0.0)
        return np.searchsorted(self.scores, at, "right"), np.searchsorted(self.gaps, gap, "right")


def _levels(ends: np.ndarray, s: np.ndarray) -> np.ndarray:
    out, fine = np.searchsorted(ends, s, "right"), np.isfinite(s)
    return out if fine.all() else np.where(fine, out, len(ends) + 1)


def best_first(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns of each row by descending score, missing ones last, equals in the order of the columns; and the scores so."""
    order = np.argsort(-s, axis=1)
    v = np.take_along_axis(s, order, 1)
    same = v[:, 1:] == v[:, :-1]
    if np.isnan(v[:, -1]).any():
        same |= np.isnan(v[:, 1:]) & np.isnan(v[:, :-1])
    if same.any():
        run, bits = np.zeros(s.shape, np.int64), int(s.shape[1]).bit_length()
        np.cumsum(~same, axis=1, out=run[:, 1:])
        run <<= bits
        run |= order
        run.sort(axis=1)
        order = run & ((1 << bits) - 1)
    return order, v


def _ranked_tiles(score: Callable, x: np.ndarray, b: dict) -> tuple[pa.Array, Iterator[tuple[int, int, np.ndarray, np.ndarray]]]:
    """Ids of the right in order, and of each tile of x the first row, the end, the ids' places by rank and the scores by rank."""
    to = pc.sort_indices(b["id"], null_placement="at_start")
    y = numbers(b["value"])[to.to_numpy()]
    return b["id"].take(to), ((lo, hi, *best_first(score(x[lo:hi, None], y[None, :]))) for lo, hi in tiles(len(x), len(y)))


def cell_counts(d: Dealt, cells: Cells) -> np.ndarray:
    """How many pairs of each label (last) lie in each level and bin of ranks."""
    score, ends, ranks = d.score, cells.ends, cells.ranks
    width = len(ranks) + 1
    shape = (len(ends) + 2, width, 2)
    size = int(np.prod(shape))

    def given(n: np.ndarray) -> Iterator[pa.RecordBatch]:
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[k].astype(np.int64))], ["k", "n"])

    def block(a: dict, b: dict) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size)
        bins = np.searchsorted(ranks, np.arange(1, len(b["id"]) + 1), "right") * 2
        x, of, alike = np.unique(numbers(a["value"]), return_inverse=True, return_counts=True)
        ids, parts = _ranked_tiles(score, x, b)
        names = pc.value_counts(ids)  # in the order of ids
        many = names.field("counts").to_numpy()
        first = np.cumsum(many) - many
        linked = pc.fill_null(pc.index_in(a["links"].flatten(), value_set=names.field("values")), -1).to_numpy()
        row = np.repeat(of, pc.fill_null(pc.list_value_length(a["links"]), 0).to_numpy())[linked >= 0]
        linked = linked[linked >= 0]
        by = np.argsort(row, kind="stable")
        row, linked = row[by], linked[by]
        for lo, hi, order, s in parts:
            at = _levels(ends, s) * (2 * width) + bins
            n += np.bincount(at.ravel(), np.repeat(alike[lo:hi], at.shape[1]), size)
            here = slice(*np.searchsorted(row, (lo, hi)))
            r, c = row[here] - lo, linked[here]
            if len(r):
                of_id = np.empty_like(order)
                np.put_along_axis(of_id, order, np.arange(order.shape[1])[None, :], 1)
                each = many[c]  # an id may have several rows
                r, place = np.repeat(r, each), np.repeat(first[c] - np.cumsum(each) + each, each) + np.arange(each.sum())
                true = np.bincount(at[r, of_id[r, place]], minlength=size)
                n -= true
                n[1:] += true[:-1]
        yield from given(n)

    def rows(c: dict) -> Iterator[pa.RecordBatch]:
        at = (_levels(ends, numbers(c["score"])) * width + np.searchsorted(ranks, numbers(c["rank"]), "right")) * 2 + numbers(c["is_match"]).astype(int)
        yield from given(np.bincount(at, minlength=size))

    out = np.zeros(size)
    for r in d.mapped(block, rows, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # as many rows as cells
        out[r["k"]] = r["n"]
    return out.reshape(shape)


def _grow(x: list[np.ndarray], w: np.ndarray, r: np.ndarray, q: np.ndarray, depth: int) -> np.ndarray:
    """A regression tree's value of each cell: bins x of each feature, weights, weighted sums of targets and of their squares."""
    node, bins = np.zeros(len(w), np.int64), [int(f.max()) + 1 for f in x]
    for _ in range(depth):
        count = int(node.max()) + 1
        best, by, cut = np.zeros(count), np.full(count, -1), np.zeros(count, np.int64)
        for f, (at, n) in enumerate(zip(x, bins)):
            if n < 2:
                continue
            lw, lr, lq = (np.bincount(node * n + at, v, count * n).reshape(count, n).cumsum(1) for v in (w, r, q))
            tw, tr, tq = (v[:, -1:] for v in (lw, lr, lq))
            lw, lr, lq = lw[:, :-1], lr[:, :-1], lq[:, :-1]
            rw = tw - lw
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (tq - tr * tr / tw - (lq - lr * lr / lw) - ((tq - lq) - (tr - lr) ** 2 / rw)) / tw
            gain = np.where((lw > 0) & (rw > 0), gain, -1.0)
            j = gain.argmax(1)
            got = gain[np.arange(count), j]
            won = got > best
            best, by, cut = np.where(won, got, best), np.where(won, f, by), np.where(won, j, cut)
        if (by < 0).all():
            break
        right = np.zeros(len(w), np.int64)
        for f, at in enumerate(x):
            right |= (by[node] == f) & (at > cut[node])
        node = np.unique(node * 2 + right, return_inverse=True)[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        return (np.bincount(node, r) / np.bincount(node, w))[node]


def fit(x: list[np.ndarray], counts: np.ndarray, trees: int = 150, depth: int = 6, rate: float = 0.1) -> np.ndarray:
    """The probability of a match of each cell, by the boosting of Spark's GBTClassifier: least squares on labels of
    -1 and 1, then on the gradients of the log loss.  x: bins of each feature; counts: pairs of label 0 and 1."""
    no, yes = counts[:, 0].astype(float), counts[:, 1].astype(float)
    margin = _grow(x, no + yes, yes - no, no + yes, depth)
    for _ in range(trees - 1):
        up, down = 4 / (1 + np.exp(2 * margin)), -4 / (1 + np.exp(-2 * margin))
        margin = margin + rate * _grow(x, no + yes, yes * up + no * down, yes * up * up + no * down * down, depth)
    return 1 / (1 + np.exp(-2 * margin))


def tree_scores(pairs: Pairs, truth: DataFrame, digits: int | None = None, **options) -> DataFrame:
    """(s1_id, cand_id, score) of all pairs, by trees that are fitted on all of them; truth: (s1_id, cand_id).

    digits: as Spark's round(); options go to fit."""
    d, schema = dealt(pairs, truth), "s1_id string, cand_id string, score double"
    if not d.sizes:
        return truth.sparkSession.createDataFrame([], schema)
    cells = Cells(*map(np.array, quantiles(d)))
    n = cell_counts(d, cells)
    ends, ranks, score = cells.ends, cells.ranks, d.score
    of_score, of_gap = cells.features(ends)
    level, rank = (v.ravel() for v in np.indices(n.shape[:2]))
    p = fit([of_score[level], rank, of_gap[level]], n.reshape(-1, 2), **options)
    if digits is not None:
        p = np.array([float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in p])
    width = n.shape[1]

    # entities of one value share a list of candidates; Spark makes the rows, at most OUT of a list at once
    def block(a: dict, b: dict) -> Iterator[pa.RecordBatch]:
        bins = np.searchsorted(ranks, np.arange(1, len(b["id"]) + 1), "right")
        x, of, alike = np.unique(numbers(a["value"]), return_inverse=True, return_counts=True)
        own, start = a["id"].take(pa.array(np.argsort(of, kind="stable"))), np.append(0, np.cumsum(alike))
        step, wide = max(1, OUT // len(bins)), min(OUT, len(bins))
        ids, parts = _ranked_tiles(score, x, b)
        for lo, hi, order, s in parts:
            given = p[_levels(ends, s) * width + bins]
            many = -(-alike[lo:hi] // step)
            at = np.repeat(np.arange(hi - lo), many)
            first = start[lo + at] + step * (np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many))
            first = np.append(first, start[hi])
            for i in range(0, len(at), step):
                some = at[i:i + step]
                names = first[i:i + len(some) + 1]
                names = pa.ListArray.from_arrays(pa.array(names - names[0], pa.int32()), own.slice(names[0], names[-1] - names[0]))
                for j in range(0, len(bins), wide):
                    places, chances = order[some, j:j + wide], given[some, j:j + wide]
                    cut = pa.array(np.arange(len(some) + 1) * places.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(cut, ids.take(pa.array(places.ravel()))), pa.ListArray.from_arrays(cut, pa.array(chances.ravel()))], ["n", "c", "p"])

    def rows(c: dict) -> Iterator[pa.RecordBatch]:
        at = _levels(ends, numbers(c["score"])) * width + np.searchsorted(ranks, numbers(c["rank"]), "right")
        cut = pa.array(np.arange(len(at) + 1), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(cut, v) for v in (c["s1_id"], c["cand_id"], pa.array(p[at]))], ["n", "c", "p"])

    out = d.mapped(block, rows, "n array<string>, c array<string>, p array<double>").select("c", "p", F.explode("n").alias("s1_id"))
    return out.select("s1_id", "p", F.posexplode("c").alias("i", "cand_id")).select("s1_id", "cand_id", F.col("p")[F.col("i")].alias("score"))
