"""Substring dedup by recompression: words of a window that starts in an earlier document go.

Texts are sequences of words, named by 64-bit hashes.  A first round names the runs of equal words,
ROUNDS more name pairs: symbols are dealt into a left and a right half (a bit of the name decides,
drawn anew each round), and a left one with a right one after it becomes one symbol.  A name is a
hash of what it stands for, so names are global: equal in every task, without a table of names or a
shuffle for each round.  All else about a symbol depends on its neighbours alone, and every symbol
knows the range of words on which its being there depends: a run on the words beside it, an unpaired
symbol on the neighbour that it could have been paired with.  Where all of that range repeats, so
does the symbol, wherever the repeat stands; at a text's border the range is open.

The key of a window of WINDOW words is the name of the first among its interior symbols (those whose
range the window holds) of the highest round that has any; words themselves are symbols, so there is
always one.  It depends on the window alone.  So a key that two distinct texts share reveals each
possible repeat, and a window whose key isn't shared needs no more work.  The others are verified:
the least doc_id is found for each window's words (named by 96 bits of two hashes), and a word goes
if one of its windows has a lesser one than its own.

Exact copies are settled first: their windows all start in the first copy, which alone goes on.
Only texts with a shared key are read again.  Joins are by key or window, of which one may be in all
texts: a text brings each but once, counts are combined before they are shuffled, and adaptive
execution splits the join of a hot one.

Edge cases: a null text has no words; a null id counts as larger than all others; equal texts under
one id are judged alike, and a window never counts against its own id; a text of under WINDOW words
keeps all; a very long text is read whole, by itself; columns with other names don't matter; an empty
table gives an empty one.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, col, materialise, mix, pieces, mapped, window_hash

WINDOW, ROUNDS = 50, 10
_LAST = (1 << 63) - 1
_EMPTY = hashlib.sha256(b"").hexdigest()


class Symbols(NamedTuple):
    """One round's symbols in order: name, text, and the words on which each depends, lo to hi (exclusive)."""
    name: np.ndarray
    doc: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def _beside(s: Symbols, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Where the range of each symbol's left neighbour begins and that of its right one ends; beyond the text if there is none."""
    same = s.doc[1:] == s.doc[:-1]
    before, after = words.first[s.doc] - 1, words.first[s.doc + 1] + 1
    before[1:][same] = s.lo[:-1][same]
    after[:-1][same] = s.hi[1:][same]
    return before, after


def _runs(s: Symbols, words: Words) -> Symbols:
    """Equal neighbours become one symbol; all depend on the symbols beside them."""
    new = np.ones(len(s.name), bool)
    new[1:] = (s.name[1:] != s.name[:-1]) | (s.doc[1:] != s.doc[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(s.name)))
    before, after = _beside(s, words)
    name = np.where(size > 1, mix(s.name[at] + size.astype(U) * U(0xA0761D6478BD642F)), s.name[at])
    return Symbols(name, s.doc[at], before[at], after[at + size - 1])


def _pairs(s: Symbols, words: Words, draw: int) -> Symbols:
    """A left symbol and a right one after it become one; others depend on the neighbour they might have had."""
    right = (mix(s.name ^ U(draw * 0x9E37 + 1)) >> U(63)).astype(bool)
    first = np.zeros(len(s.name), bool)
    first[:-1] = ~right[:-1] & right[1:] & (s.doc[:-1] == s.doc[1:])
    at = np.flatnonzero(first)
    before, after = _beside(s, words)
    name, lo, hi = s.name.copy(), np.where(right, before, s.lo), np.where(right, s.hi, after)
    name[at] = mix(s.name[at] * U(0x9E3779B97F4A7C15) + s.name[at + 1] + U(draw))
    lo[at], hi[at] = s.lo[at], s.hi[at + 1]
    keep = np.ones(len(s.name), bool)
    keep[at + 1] = False
    return Symbols(name[keep], s.doc[keep], lo[keep], hi[keep])


def rounds(words: Words) -> list[Symbols]:
    """The words, their runs, and the pairs of each round."""
    n = len(words.hash)
    out = [Symbols(words.hash, words.doc, np.arange(n), np.arange(n) + 1)]
    if n:
        out.append(_runs(out[0], words))
        for draw in range(1, ROUNDS + 1):
            out.append(_pairs(out[-1], words, draw))
    return out


def window_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each window that lies in one text, and the window's key."""
    n = len(words.hash)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.flatnonzero(words.doc[WINDOW - 1:] == words.doc[:n - WINDOW + 1])
    key, todo = np.zeros(len(at), U), np.arange(len(at))
    for s in reversed(rounds(words)):
        # ranges are in order, so the first that begins in the window ends first
        k = np.searchsorted(s.lo, at[todo])
        inside = s.hi[np.minimum(k, len(s.hi) - 1)] <= at[todo] + WINDOW
        inside &= k < len(s.lo)
        key[todo[inside]] = s.name[k[inside]]
        todo = todo[~inside]
    return at, key


def _lists(values: np.ndarray, group: np.ndarray, n: int) -> pa.Array:
    """Values by group (ascending), as one list for each of n groups."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(group, np.arange(n + 1)), pa.int32()), pa.array(values.astype(np.int64)))


def _joined(words: Words, i: int, keep: np.ndarray | None = None) -> bytes:
    a, b = int(words.first[i]), int(words.first[i + 1])
    if a == b:
        return b""
    lo = int(words.start[a])
    raw = words.data[lo:int(words.end[b - 1])]
    start, end = words.start[a:b] - lo, words.end[a:b] - lo
    if keep is not None:
        start, end = start[keep], end[keep]
    if not len(start):
        return b""
    size = end - start + 1
    stop = np.cumsum(size)
    at = np.arange(int(stop[-1])) + np.repeat(start - (stop - size), size)
    out = raw[np.minimum(at, len(raw) - 1)]
    out[stop - 1] = 32
    return out[:-1].tobytes()


def _once(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places of the first of equal values of each owner, in order."""
    _, once = np.unique(mix(values + mix(owner.astype(U))), return_index=True)
    once.sort()
    return once


def _described(docs: DataFrame) -> DataFrame:
    """dg, doc_id, n_words, kept_sha256 as if nothing went, and the distinct keys of the windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                w = Words(col(part, "text"))
                at, key = window_keys(w)
                once = _once(key, w.doc[at])
                sha = [hashlib.sha256(_joined(w, i)).hexdigest() for i in range(w.n)]
                yield pa.RecordBatch.from_arrays([col(part, "dg"), col(part, "doc_id"), pa.array(np.diff(w.first), pa.int64()), pa.array(sha, pa.string()), _lists(key[once].view(np.int64), w.doc[at[once]], w.n)], ["dg", "doc_id", "n_words", "sha", "symbols"])

    return mapped(docs, run, "dg binary, doc_id long, n_words long, sha string, symbols array<long>")


def _named(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two names of the words of each window, of 64 and 32 bits."""
    return window_hash(words.hash, WINDOW), (window_hash(mix(words.hash ^ U(0xD6E8FEB86659FD93)), WINDOW) >> U(32)).astype(np.uint32).view(np.int32)


def _windows(texts: DataFrame) -> DataFrame:
    """window, more, first, tid: the distinct windows of each text whose key is shared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                w = Words(col(part, "text"))
                at, key = window_keys(w)
                p = at[_among(key, w.doc[at], col(part, "shared"))]
                h, more = _named(w)
                h, more = (h[p], more[p]) if len(p) else (np.zeros(0, U), np.zeros(0, np.int32))
                once = _once(h, w.doc[p])
                own = pa.array(w.doc[p[once]])
                yield pa.RecordBatch.from_arrays([pa.array(h[once].view(np.int64)), pa.array(more[once]), col(part, "first").take(own), col(part, "tid").take(own)], ["window", "more", "first", "tid"])

    return mapped(texts.select("first", "tid", "text", "shared"), run, "window long, more int, first long, tid long")


def _among(values: np.ndarray, owner: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each value is in its owner's list."""
    flat = lists.flatten().to_numpy().view(U)
    of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return np.isin(mix(values + mix(owner.astype(U))), mix(flat + mix(of.astype(U))))


def _removed(texts: DataFrame) -> DataFrame:
    """dg, gone, new_sha, from each text and its windows that start earlier."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                w = Words(col(part, "text"))
                h = window_hash(w.hash, WINDOW)
                at = np.flatnonzero(w.doc[WINDOW - 1:] == w.doc[:len(h)])
                at = at[_among(h[at], w.doc[at], col(part, "windows"))]
                edge = np.zeros(len(w.hash) + 1, np.int64)
                edge[at] += 1
                edge[at + WINDOW] -= 1
                covered = np.cumsum(edge[:-1]) > 0
                gone = np.bincount(w.doc[covered], minlength=w.n)
                sha = [hashlib.sha256(_joined(w, i, ~covered[w.first[i]:w.first[i + 1]])).hexdigest() for i in range(w.n)]
                yield pa.RecordBatch.from_arrays([col(part, "dg"), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["dg", "gone", "new_sha"])

    return mapped(texts.select("dg", "text", "windows"), run, "dg binary, gone long, new_sha string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    spark = docs.sparkSession
    rows = docs.select(F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("dg"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = materialise(_described(rows), "recompression-symbols")
    order = F.coalesce("doc_id", F.lit(_LAST))
    # one row for each distinct text that can have a window; its first copy stands for all
    texts = told.filter(F.col("n_words") >= WINDOW).groupBy("dg").agg(F.min(order).alias("first"), F.first("symbols").alias("symbols"))
    texts = materialise(texts, "recompression-texts")
    # (first, tid) names a text: where ids are each of one text, they do alone, else a hash of the text is added
    ties = told.groupBy(order.alias("id")).agg(F.min("dg").alias("a"), F.max("dg").alias("z")).filter("a <> z")
    tid = (F.xxhash64("dg") if ties.limit(1).count() else F.lit(0).cast("long")).alias("tid")
    symbols = texts.select(tid, "first", F.explode("symbols").alias("symbol"))
    shared = symbols.groupBy("symbol").agg(F.min("first").alias("a"), F.max("first").alias("z")).filter("a < z").select("symbol")
    marked = symbols.join(shared, "symbol").groupBy("first", "tid").agg(F.collect_set("symbol").alias("shared"))
    # both keys, so that copies of one text don't meet in one task
    source = rows.filter(F.length("text") >= 2 * WINDOW - 1).select(order.alias("first"), tid, "dg", "text")

    def again(lists: DataFrame) -> DataFrame:
        """The first copy of each text that has a list; read again, as a table of texts would take more room."""
        return source.join(lists, ["first", "tid"]).dropDuplicates(["first", "tid"])

    windows = materialise(_windows(again(marked)), "recompression-windows")
    least = windows.groupBy("window", "more").agg(F.min("first").alias("least"), F.max("first").alias("most")).filter("least < most").select("window", "more", "least")
    places = windows.join(least, ["window", "more"]).filter(F.col("least") < F.col("first")).groupBy("first", "tid").agg(F.collect_set("window").alias("windows"))
    gone = _removed(again(places))
    firsts = texts.select(F.col("dg").alias("tdg"), "first")
    firsts = materialise(firsts.join(gone, F.col("dg") == F.col("tdg"), "left").drop("dg"), "recompression-removed")
    out = told.drop("symbols").join(firsts, F.col("dg") == F.col("tdg"), "left")
    copy = F.coalesce(order > F.col("first"), F.lit(False))
    return out.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
                      F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256"))
