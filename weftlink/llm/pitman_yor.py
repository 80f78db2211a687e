"""Language-model scoring by a hierarchical Pitman-Yor model.

A token is predicted from the word before it.  Restaurants form a tree: one for each of CLASSES x
FINE contexts (the word's ending class and a hash of the word), whose parent is the restaurant of
the ending class, whose parent is the root, over a uniform base of 1 / (V + 1).  In restaurant u

    p(w | u) = (c_uw - d t_uw + (theta + d t_u) p(w | parent)) / (theta + c_u),

c customers and t tables, each table of a child being a customer of its parent.  Seating is sampled:
a Gibbs sweep reseats all customers of a dish in a restaurant, one after another, with a new table's
odds (theta + d t_u) p(w | parent) to c - d t, given the seating of all else after the last sweep.
Scores average the predictive probabilities of the sweeps after BURN.

What makes it distributed: the number of restaurants is fixed, so their totals (c_u, t_u) are small
and global, and everything else about a dish is local to the dish.  Word occurrences are dealt by
word, once, in packed blocks (word, context, document within its chunk); a sweep is one job over them
that returns totals only.  Seating is drawn from counters (bucket, sweep), so a job repeats the
sweeps before it instead of storing them, and lost executors change nothing.  Words of at least
1 / HOT_SHARE of all tokens (so HOT_SHARE at most) are not dealt: their counts by context are summed
where they are, seated on the driver, and scored by the pass that returns the documents.

Documents are told apart by their place in the scan, which that last pass repeats; it fails loudly
if the tokens it sees are not those that were dealt.

Edge cases: a null text is empty and has one token, the end; a null id is in training; without any
training document V = N = 0 and every token has probability 1; repeated rows count as often as they
occur; a very long text is scored whole, by itself; equal texts outside and inside the held-out part
have equal scores; columns with other names don't matter; an empty table gives an empty one.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, _table, col, crc_mod, materialise, mix, pieces, mapped

CLASSES, FINE = 64, 64
CONTEXTS = CLASSES * FINE
#: Discounts and strengths of the root, the classes and the contexts.
DISCOUNT, STRENGTH = (0.6, 0.7, 0.8), (10.0, 10.0, 5.0)
SWEEPS, BURN, HOT_SHARE = 3, 1, 2048
#: Tokens of a chunk of documents, and of a bucket of words, about.
CHUNK, BUCKET = 600_000, 300_000
_END, _BEGIN = (int(x) for x in _table(77, 2))
_TRAIN = np.uint16(1 << 15)


class Tokens:
    """Tokens of some texts, the end of each included: name, context (of CONTEXTS) and text."""

    def __init__(self, texts: pa.Array):
        w = Words(texts, lower=True)
        n = len(w.hash) + w.n
        place = np.arange(len(w.hash)) + w.doc
        self.name = np.full(n, _END, U)
        self.name[place] = w.hash
        self.doc = np.zeros(n, np.int64)
        self.doc[place] = w.doc
        ends = w.first[1:] + np.arange(w.n)
        self.doc[ends] = np.arange(w.n)
        # the word before, and how it ends
        before = np.full(n, _BEGIN, U)
        before[1:] = self.name[:-1]
        ending = np.zeros(n, U)
        if len(w.end):
            tail = (w.data[w.end - 1].astype(U) << U(8)) | w.data[np.maximum(w.end - 2, w.start)]
            ending[place] = tail
        tail = np.zeros(n, U)
        tail[1:] = ending[:-1]
        starts = np.append(0, ends[:-1] + 1)[:w.n]
        before[starts], tail[starts] = _BEGIN, 0
        kind = (mix(tail + U(3)) % U(CLASSES)).astype(np.int64)
        self.context = kind * FINE + (mix(before) % U(FINE)).astype(np.int64)
        self.count = np.diff(w.first) + 1


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(place of the first document, names, contexts, documents within the chunk, training flag of each document, batch columns)."""
    base = TaskContext.get().partitionId() << 40
    held, n_docs, n_tokens = [], 0, 0

    def flush() -> tuple:
        shift = np.cumsum([0, *(len(t.count) for t, _ in held)])
        return (base, np.concatenate([t.name for t, _ in held]), np.concatenate([t.context for t, _ in held]),
                np.concatenate([t.doc + s for (t, _), s in zip(held, shift)]), np.concatenate([~col(p, "held_out").to_numpy(zero_copy_only=False) for _, p in held]), [p for _, p in held])

    for batch in batches:
        for part in pieces(batch):
            t = Tokens(col(part, "text"))
            if held and (n_tokens + len(t.name) > CHUNK or n_docs + part.num_rows > 60_000):
                yield flush()
                base += n_docs
                held, n_docs, n_tokens = [], 0, 0
            held.append((t, part))
            n_docs += part.num_rows
            n_tokens += len(t.name)
    if held:
        yield flush()


# --- finding hot words -----------------------------------------------------------------------
def _hot_words(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Words of at least 1 / HOT_SHARE of all tokens (sorted), and the number of tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, name, *_ in chunks(batches):
            value, n = np.unique(name, return_counts=True)
            hit = n >= max(2, len(name) / (2 * HOT_SHARE))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(value[hit].view(np.int64), 0)), pa.array(np.append(n[hit], 0)), pa.array(np.append(np.zeros(hit.sum(), np.int64), len(name)))], ["name", "n", "total"])

    found = materialise(mapped(rows, run, "name long, n long, total long").groupBy("name").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "py-hot")
    total = int(found.agg(F.sum("total")).first()[0] or 0)
    hot = found.filter(F.col("n") >= max(2.0, total / HOT_SHARE)).select("name").toPandas()["name"].to_numpy(np.int64).view(U)
    return np.sort(hot), total


def _place(hot: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Index among the hot words, or -1."""
    if not len(hot):
        return np.full(len(name), -1)
    at = np.minimum(np.searchsorted(hot, name), len(hot) - 1)
    return np.where(hot[at] == name, at, -1)


# --- dealing occurrences by word -------------------------------------------------------------
def _blocks(rows: DataFrame, hot: np.ndarray, bits: int) -> DataFrame:
    """bucket, block: the other words' occurrences in a chunk, by word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for base, name, context, doc, train, _ in chunks(batches):
            rare = np.flatnonzero(_place(hot, name) < 0)
            rare = rare[np.argsort(name[rare], kind="stable")]
            name, context, doc = name[rare], context[rare].astype(np.uint16), doc[rare].astype(np.uint16)
            context = np.where(train[doc], context | _TRAIN, context)
            bucket = (name >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(name), np.int64)
            cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
            ids, blocks = [], []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                value, n = np.unique(name[a:b], return_counts=True)
                ids.append(int(bucket[a]))
                blocks.append(np.array([base, len(value), b - a], np.int64).tobytes() + value.tobytes() + n.astype(np.uint32).tobytes() + context[a:b].tobytes() + doc[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blocks, pa.binary())], ["bucket", "block"])

    return mapped(rows, run, "bucket long, block binary")


class Dishes:
    """Training counts of some words by context: the types (word, context) with customers."""

    def __init__(self, word: np.ndarray, context: np.ndarray, count: np.ndarray, n_words: int):
        self.n_words = n_words
        self.word, self.context, self.count = word, context, count
        kind = word * CLASSES + context // FINE
        self.kinds, self.kind = np.unique(kind, return_inverse=True)
        self.kind_word, self.kind_class = self.kinds // CLASSES, self.kinds % CLASSES


def read_blocks(blocks: list[bytes]) -> tuple:
    """(names, word, context, training flag, chunk, document within it) of all occurrences in a bucket."""
    names, word, context, doc, base = [], [], [], [], []
    for raw in blocks:
        first, n_words, n = np.frombuffer(raw, np.int64, 3).tolist()
        at = 24
        names.append(np.frombuffer(raw, U, n_words, at))
        at += 8 * n_words
        word.append(np.frombuffer(raw, np.uint32, n_words, at))
        at += 4 * n_words
        context.append(np.frombuffer(raw, np.uint16, n, at))
        doc.append(np.frombuffer(raw, np.uint16, n, at + 2 * n))
        base.append(first)
    every, place = np.unique(np.concatenate(names), return_inverse=True)
    of = np.repeat(place.reshape(-1), np.concatenate(word))
    context = np.concatenate(context)
    sizes = [len(d) for d in doc]
    return every, of, (context & ~_TRAIN).astype(np.int64), context >= _TRAIN, np.repeat(np.arange(len(base)), sizes), np.concatenate(doc), np.array(base)


def dishes_of(n_words: int, word: np.ndarray, context: np.ndarray, train: np.ndarray) -> Dishes:
    key, n = np.unique(word[train] * CONTEXTS + context[train], return_counts=True)
    return Dishes(key // CONTEXTS, key % CONTEXTS, n, n_words)


# --- seating ---------------------------------------------------------------------------------
def seat(count: np.ndarray, odds: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after so many customers sat down one by one; a new table has odds `odds` to c - d t."""
    t = (count > 0).astype(float)
    live = np.flatnonzero(count > 1)
    j = 1
    while len(live):
        if j < 32:  # customer by customer
            p = odds[live] / (odds[live] + j - d * t[live])
            t[live] += rng.random(len(live)) < p
            j += 1
        else:  # a doubling number of customers: new tables come as a Poisson process
            to = np.minimum(count[live], 2 * j)
            mean = odds[live] * np.log((odds[live] + to - d * t[live]) / (odds[live] + j - d * t[live]))
            t[live] += np.minimum(rng.poisson(np.maximum(mean, 0)), to - j)
            j *= 2
        live = live[count[live] > j]
    return t


class Totals:
    """Customers and tables of each restaurant; contexts, then classes, then the root."""

    def __init__(self):
        self.c2, self.t2, self.t1 = np.zeros(CONTEXTS), np.zeros(CONTEXTS), np.zeros(CLASSES)
        self.t0 = 0.0
        self.words, self.tokens = 0, 0

    def numbers(self) -> np.ndarray:
        return np.concatenate([self.c2, self.t2, self.t1, [self.t0, self.words, self.tokens]])

    @classmethod
    def of(cls, x: np.ndarray) -> Totals:
        out = cls()
        out.c2, out.t2, out.t1 = x[:CONTEXTS], x[CONTEXTS:2 * CONTEXTS], x[2 * CONTEXTS:2 * CONTEXTS + CLASSES]
        out.t0, out.words, out.tokens = float(x[-3]), int(x[-2]), int(x[-1])
        return out

    @property
    def c1(self) -> np.ndarray:
        return self.t2.reshape(CLASSES, FINE).sum(1)

    @property
    def c0(self) -> float:
        return float(self.t1.sum())

    def back_off(self) -> tuple[np.ndarray, np.ndarray, float]:
        """theta + d t_u of contexts, classes and the root."""
        return STRENGTH[2] + DISCOUNT[2] * self.t2, STRENGTH[1] + DISCOUNT[1] * self.t1, STRENGTH[0] + DISCOUNT[0] * self.t0


class Seating(Dishes):
    """The sampled tables of some dishes."""

    t2: np.ndarray
    t1: np.ndarray
    t0: np.ndarray

    def parents(self, totals: Totals) -> tuple[np.ndarray, np.ndarray]:
        """p(w) of each word, and p(w | class) of each (word, class) that has customers."""
        _, b1, b0 = totals.back_off()
        c0 = np.bincount(self.kind_word, self.t1, self.n_words)
        p0 = (c0 - DISCOUNT[0] * self.t0 + b0 / (totals.words + 1)) / (STRENGTH[0] + totals.c0)
        c1 = np.bincount(self.kind, self.t2, len(self.kinds))
        p1 = (c1 - DISCOUNT[1] * self.t1 + b1[self.kind_class] * p0[self.kind_word]) / (STRENGTH[1] + totals.c1[self.kind_class])
        return p0, p1

    def sweep(self, totals: Totals | None, rng: np.random.Generator) -> None:
        if totals is None:  # at first everyone of a dish shares a table, up to the discount's share of them
            self.t2 = np.maximum(1.0, np.floor(self.count ** DISCOUNT[2]))
            self.t1 = np.maximum(1.0, np.floor(np.bincount(self.kind, self.t2, len(self.kinds)) ** DISCOUNT[1]))
            self.t0 = np.minimum(1.0, np.bincount(self.kind_word, self.t1, self.n_words))
            return
        b2, b1, b0 = totals.back_off()
        p0, p1 = self.parents(totals)
        self.t2 = seat(self.count, b2[self.context] * p1[self.kind], DISCOUNT[2], rng)
        c1 = np.bincount(self.kind, self.t2, len(self.kinds)).astype(np.int64)
        self.t1 = seat(c1, b1[self.kind_class] * p0[self.kind_word], DISCOUNT[1], rng)
        c0 = np.bincount(self.kind_word, self.t1, self.n_words).astype(np.int64)
        self.t0 = seat(c0, np.full(self.n_words, b0 / (totals.words + 1)), DISCOUNT[0], rng)

    def add_to(self, x: Totals) -> None:
        x.c2 += np.bincount(self.context, self.count, CONTEXTS)
        x.t2 += np.bincount(self.context, self.t2, CONTEXTS)
        x.t1 += np.bincount(self.kind_class, self.t1, CLASSES)
        x.t0 += self.t0.sum()
        x.words += len(np.unique(self.word))
        x.tokens += int(self.count.sum())

    def predict(self, totals: Totals, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """p(w | u) of any (word, context)."""
        b2, b1, _ = totals.back_off()
        p0, p1 = self.parents(totals)
        kind = word * CLASSES + context // FINE
        base = b1[context // FINE] * p0[word] / (STRENGTH[1] + totals.c1[context // FINE])
        if len(self.kinds):
            at = np.minimum(np.searchsorted(self.kinds, kind), len(self.kinds) - 1)
            base = np.where(self.kinds[at] == kind, p1[at], base)
        out = b2[context] * base
        if len(self.word):
            types, key = self.word * CONTEXTS + self.context, word * CONTEXTS + context
            at = np.minimum(np.searchsorted(types, key), len(types) - 1)
            out = out + np.where(types[at] == key, self.count[at] - DISCOUNT[2] * self.t2[at], 0)
        return out / (STRENGTH[2] + totals.c2[context])


def reseated(d: Dishes, history: list[np.ndarray], bucket: int) -> Iterator[tuple[Seating, Totals | None]]:
    """The seating after the start and after each sweep, with the totals it was drawn under."""
    s = Seating(d.word, d.context, d.count, d.n_words)
    for k, x in enumerate([None, *history]):
        s.sweep(None if x is None else Totals.of(x), np.random.default_rng((bucket + 1, k)))
        yield s, x


def _totals(dealt: DataFrame, history: list[np.ndarray], hot: Dishes) -> np.ndarray:
    """Totals after the sweeps so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = Totals()
        for batch in batches:
            for bucket, blocks in zip(col(batch, "bucket").to_pylist(), col(batch, "blocks")):
                names, word, context, train, *_ = read_blocks(blocks.as_py())
                for s, _ in reseated(dishes_of(len(names), word, context, train), history, bucket):
                    pass
                s.add_to(x)
        x = x.numbers()
        at = np.flatnonzero(x)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(x[at])], ["k", "x"])

    out = Totals()
    for s, _ in reseated(hot, history, -1):
        pass
    s.add_to(out)
    out = out.numbers()
    for k, x in mapped(dealt, run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
        out[k] += x
    return out


def _predictive(d: Dishes, history: list[np.ndarray], last: np.ndarray, bucket: int, word: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Predictive probabilities, averaged over the seatings after BURN."""
    after = [Totals.of(x) for x in [*history, last]]
    total, n = np.zeros(len(word)), 0
    for k, (s, _) in enumerate(reseated(d, history, bucket)):
        if k > BURN or k == len(history):
            total += s.predict(after[k], word, context)
            n += 1
    return total / n


def _dealt_scores(dealt: DataFrame, history: list[np.ndarray], last: np.ndarray) -> DataFrame:
    """chunk, part: for each document of a chunk sums over the words of a task, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_all = Totals.of(last)
        by_chunk: dict[int, np.ndarray] = {}
        for batch in batches:
            for bucket, blocks in zip(col(batch, "bucket").to_pylist(), col(batch, "blocks")):
                names, word, context, train, chunk, doc, base = read_blocks(blocks.as_py())
                d = dishes_of(len(names), word, context, train)
                key, place = np.unique(word * CONTEXTS + context, return_inverse=True)
                p = np.log10(_predictive(d, history, last, bucket, key // CONTEXTS, key % CONTEXTS))[place.reshape(-1)]
                c = np.bincount(d.word, d.count, len(names))
                b = np.log10((c + 1) / (n_all.tokens + n_all.words + 1))[word]
                known = (c > 0)[word]
                for k in range(len(base)):
                    lo, hi = np.searchsorted(chunk, [k, k + 1])
                    own = doc[lo:hi].astype(np.int64)
                    n = int(own.max()) + 1
                    add = np.stack([np.bincount(own, p[lo:hi], n), np.bincount(own, b[lo:hi], n), np.bincount(own, known[lo:hi], n), np.bincount(own, minlength=n)])
                    old = by_chunk.get(int(base[k]))
                    if old is not None:
                        if old.shape[1] < n:
                            old, add = add, old
                        old[:, :add.shape[1]] += add
                        add = old
                    by_chunk[int(base[k])] = add
        ids, parts = [], []
        for k, x in by_chunk.items():
            at = np.flatnonzero(x[3])
            ids.append(k)
            parts.append(np.array([len(at)], np.int64).tobytes() + at.astype(np.uint16).tobytes() + x[0, at].tobytes() + x[1, at].tobytes() + x[2, at].astype(np.uint32).tobytes() + x[3, at].astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.binary())], ["chunk", "part"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, parts in zip(col(batch, "chunk").to_pylist(), col(batch, "parts")):
                x = np.zeros((4, 1 << 16))
                for raw in parts.as_py():
                    n = int(np.frombuffer(raw, np.int64, 1)[0])
                    at = np.frombuffer(raw, np.uint16, n, 8)
                    start = 8 + 2 * n
                    for k, kind in enumerate((np.float64, np.float64, np.uint32, np.uint32)):
                        x[k, at] += np.frombuffer(raw, kind, n, start)
                        start += n * np.dtype(kind).itemsize
                at = np.flatnonzero(x[3])
                yield pa.RecordBatch.from_arrays([pa.array(at + chunk), *(pa.array(x[k, at]) for k in range(4))], ["place", "p", "b", "known", "n"])

    parts = mapped(dealt, run, "chunk long, part binary").groupBy("chunk").agg(F.collect_list("part").alias("parts"))
    return mapped(parts, summed, "place long, p double, b double, known double, n double")


def scored(docs: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """The columns of op7."""
    rows = docs.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "text")
    hot, total = _hot_words(rows)
    bits = max(4, int(np.ceil(np.log2(max(total, 1) / BUCKET))))

    def hot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(hot) * CONTEXTS, np.int64)
        for _, name, context, doc, train, _ in chunks(batches):
            at = _place(hot, name)
            ok = (at >= 0) & train[doc]
            n += np.bincount(at[ok] * CONTEXTS + context[ok], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["k", "n"])

    found = mapped(rows, hot_counts, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas().sort_values("k")
    k = found["k"].to_numpy(np.int64)
    hot_dishes = Dishes(k // CONTEXTS, k % CONTEXTS, found["n"].to_numpy(np.int64), len(hot))
    dealt = materialise(_blocks(rows, hot, bits).groupBy("bucket").agg(F.collect_list("block").alias("blocks")), "py-dealt")
    history: list[np.ndarray] = []
    for _ in range(sweeps):
        history.append(_totals(dealt, history, hot_dishes))
    last = _totals(dealt, history, hot_dishes)
    n_all = Totals.of(last)
    # predictive probabilities of hot words in all contexts, and their base
    w, u = np.divmod(np.arange(len(hot) * CONTEXTS), CONTEXTS)
    hot_p = np.log10(_predictive(hot_dishes, history, last, -1, w, u)).astype(np.float32) if len(hot) else np.zeros(0, np.float32)
    hot_c = np.bincount(hot_dishes.word, hot_dishes.count, len(hot))
    hot_b = np.log10((hot_c + 1) / (n_all.tokens + n_all.words + 1))
    sent = docs.sparkSession.sparkContext.broadcast((hot, hot_p, hot_c, hot_b))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_p, hot_c, hot_b = sent.value
        for base, name, context, doc, train, parts in chunks(batches):
            at = _place(hot, name)
            ok = at >= 0
            n = len(train)
            own = doc[ok]
            x = [np.bincount(own, hot_p[at[ok] * CONTEXTS + context[ok]], n), np.bincount(own, hot_b[at[ok]], n), np.bincount(own, hot_c[at[ok]] > 0, n), np.bincount(own, minlength=n).astype(float)]
            ids = pa.concat_arrays([col(p, "doc_id") for p in parts])
            yield pa.RecordBatch.from_arrays([ids, pa.array(~train), pa.array(base + np.arange(n)), pa.array(np.bincount(doc, minlength=n)), *map(pa.array, x)], ["doc_id", "held_out", "place", "n_tokens", "hp", "hb", "hk", "hn"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = mapped(rows, finish, f"doc_id {kind}, held_out boolean, place long, n_tokens long, hp double, hb double, hk double, hn double")
    sums = _dealt_scores(dealt, history, last).withColumnRenamed("place", "at")
    out = out.join(sums, F.col("place") == F.col("at"), "left")

    def part(c: str):
        return F.coalesce(F.col(c), F.lit(0.0))

    same = F.col("hn") + part("n") == F.col("n_tokens")
    n_tokens = F.when(same, F.col("n_tokens")).otherwise(F.raise_error(F.lit("the scan changed between passes")).cast("long"))
    return out.select("doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("hk") + part("known")).cast("long").alias("n_known"), F.lit(n_all.tokens).cast("long").alias("train_tokens"),
                      (F.col("hb") + part("b")).alias("base_score"), (F.col("hp") + part("p")).alias("score"))
