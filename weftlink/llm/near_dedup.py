"""Near-duplicate classes by improved consistent weighted sampling.

Texts are weighted sets of five-word shingles (a shorter text is one shingle): tf times idf, with a
smoothed idf that is 1 up to a document frequency of COMMON of all documents and falls with its
logarithm to IDF_FLOOR for a shingle that all documents hold.  Only common shingles have to be
counted for it, of which there are at most (mean length / COMMON): a first pass names those that
may be, a second counts them over all rows.  None is missed, however the rows are parted: a part
tells all that over COMMON / 2 of its documents hold (a part of under 2 / COMMON documents: all),
so what parts leave out is at most COMMON / 2 of all documents, and a common shingle is told of by
more than that many.

Equal texts are settled first.  Each distinct text draws BANDS x ROWS samples by consistent weighted
sampling: for each sample every shingle gets r, c from Gamma(2, 1) and b from U(0, 1), chosen by a
hash of shingle and sample; t = floor(ln w / r + b), ln a = ln c - r (t - b) - r, and the least a is
sampled together with its t.  Two texts agree in a sample as often as their weighted Jaccard
similarity says.  ROWS samples make a band, and texts that agree in a band meet in a bucket.

Two texts of a bucket are closed against each other once they are in one component, as a link more
would change no class, or once one of them has led the bucket: then it was compared, exactly, on the
whole shingle sets, with all members of other components.  First each text meets the most central member
of its largest bucket alone, which joins most of a large group; after every round the links found are
one for each pair of components, and stars within them, so no group has more links than texts times
leaders' components.  The LEADERS most central members (whose
buckets are the largest in all, as an original's are among its edited copies) lead first; then the
links found so far are joined to components, and in every bucket whose other members are not all in
one, the most central of those outside its largest component lead, MORE times as many each round,
until no bucket is open.  Pairs that can't be similar are never made: with W the weight of a text and s what of it other
texts in buckets have too, a pair's similarity is at most m / (W + W' - m), m = min(s, s'), which is
part of the join's condition.  So is a sketch, one bit of each of SKETCH further samples: a pair must
not differ in more bits than one of similarity THRESHOLD does by SPREAD standard deviations (which
one in thirty thousand such pairs does), so that edited copies of one original, each with changes
of its own, make few pairs among themselves.  Texts that share several buckets are paired in the first
of them alone, which stays open for them as any other.  Pairs of weighted Jaccard similarity THRESHOLD or more
are links, and connected components, found by spreading least labels with pointer jumping, are the
classes.

Edge cases: a null text is an empty one; texts without words are in a class with equal ones only;
a class is named by its least doc_id (a null id counts as larger than all others, and a class of
null ids alone has a null name); repeated rows are copies; columns with other names don't matter; an
empty table gives an empty one.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, Words, _table, col, discard, materialise, mix, pieces, mapped, window_hash

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 16, 5
LEADERS, MORE, SKETCH, SPREAD = 2, 16, 1024, 4.0
COMMON, IDF_FLOOR = 0.005, 0.8
_LAST = (1 << 63) - 1
#: Documents after which a part of the rows is judged for common shingles.
_PART = 2000
#: Rows below which a task isn't worth its start: shuffled tables of so few are written by fewer tasks.
_TASK = 2000
#: Up to so many links (some MB) the driver joins to components; more are joined by shuffles.
_FEW = 50_000


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text, times it occurs), by text and shingle."""
    n = np.diff(words.first)
    size = np.where(n < SHINGLE, n > 0, n - SHINGLE + 1).astype(np.int64)
    doc = np.repeat(np.arange(words.n), size)
    start = np.cumsum(size) - size
    h = np.empty(len(doc), U)
    whole = window_hash(words.hash, SHINGLE)
    h[np.repeat(n >= SHINGLE, size)] = whole[words.doc[SHINGLE - 1:] == words.doc[:len(whole)]] if len(whole) else whole
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):  # all words of a short text are one shingle
        short = np.zeros(len(few), U)
        for j in range(SHINGLE - 1):
            has = n[few] > j
            short[has] = mix(short[has] + words.hash[words.first[few[has]] + j])
        h[start[few]] = short
    for a, b in zip(start.tolist(), (start + size).tolist()):  # text by text: many small sorts are cheaper than one
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.append(at, len(h)))


# --- common shingles -------------------------------------------------------------------------
def _suspects(docs: DataFrame) -> DataFrame:
    """shingle, n: what over COMMON / 2 of the documents of some part of the rows hold, and in how many of its documents."""
    def told(parts: list[np.ndarray], n_docs: int) -> pa.RecordBatch:
        value, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, U), np.zeros(0, np.int64))
        hit = n > COMMON / 2 * n_docs
        return pa.RecordBatch.from_arrays([pa.array(value[hit].view(np.int64)), pa.array(n[hit], pa.int64())], ["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_n, now, now_n = [], 0, [], 0  # the last full part waits: a small rest joins it
        for batch in batches:
            for part in pieces(batch):
                h, _, _ = shingles(Words(col(part, "text")))
                now.append(h)
                now_n += part.num_rows
                if now_n >= _PART or sum(map(len, now)) > 3_000_000:
                    if held:
                        yield told(held, held_n)
                    held, held_n, now, now_n = now, now_n, [], 0
        if now_n < _PART // 2:
            held, held_n, now, now_n = held + now, held_n + now_n, [], 0
        for parts, n in ((held, held_n), (now, now_n)):
            if n:
                yield told(parts, n)

    return mapped(docs.select("text"), run, "shingle long, n long")


def _counted(docs: DataFrame, values: np.ndarray) -> DataFrame:
    """shingle, n: in how many documents of a task each of the given (sorted) shingles is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(values), np.int64)
        for batch in batches:
            for part in pieces(batch):
                h, _, _ = shingles(Words(col(part, "text")))
                at = np.minimum(np.searchsorted(values, h), len(values) - 1)
                total += np.bincount(at[values[at] == h], minlength=len(values))
        hit = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(values[hit].view(np.int64)), pa.array(total[hit])], ["shingle", "n"])

    return mapped(docs.select("text"), run, "shingle long, n long")


def common_idf(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, sorted, and their idf; all others have 1."""
    n = docs.count()
    floor = max(2.0, COMMON * n)
    # small partitions are read together, as larger parts tell less
    told = _suspects(docs.coalesce(max(1, 2 * n // _PART))).groupBy("shingle").agg(F.sum("n").alias("n"))
    found = told.filter(F.col("n") > COMMON / 2 * n).select("shingle").toPandas()
    values = np.sort(found["shingle"].to_numpy(np.int64).view(U))
    if not len(values):
        return values, np.zeros(0)
    counted = _counted(docs, values).groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") > floor).toPandas()
    values = counted["shingle"].to_numpy(np.int64).view(U)
    order = np.argsort(values)
    idf = IDF_FLOOR + (1 - IDF_FLOOR) * np.log(n / counted["n"].to_numpy(float)) / np.log(n / floor) if len(values) else np.zeros(0)
    return values[order], np.clip(idf, IDF_FLOOR, 1)[order] if len(values) else idf


def weights(h: np.ndarray, times: np.ndarray, idf: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    w = times.astype(float)
    values, factor = idf
    if len(values) and len(h):
        at = np.minimum(np.searchsorted(values, h), len(values) - 1)
        hit = values[at] == h
        w[hit] *= factor[at[hit]]
    return w


# --- consistent weighted sampling ------------------------------------------------------------
_draws: list[np.ndarray] = []


def _draw_table() -> list[np.ndarray]:
    """r, b, ln c and ln a at weight 1, for each of 2^16 values of a hash, by ascending ln a."""
    if not _draws:
        u = [(_table(100 + i, 1 << 16) >> U(11)).astype(float) / float(1 << 53) + 2.0 ** -54 for i in range(5)]
        r, ln_c, b = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]
        one = ln_c + r * b - r
        order = np.argsort(one, kind="stable")
        _draws.extend(x[order] for x in (r, b, ln_c, one))
    return _draws


_SEEDS = _table(5, 2 * (BANDS * ROWS + SKETCH))


def samples(h: np.ndarray, w: np.ndarray, start: np.ndarray, first: int = 0, n: int = BANDS * ROWS) -> Iterator[np.ndarray]:
    """n samples from number `first` on: each text's sampled (shingle, t), as 64 bits; texts begin at start.

    The top 16 bits of a hash choose the draws, whose table is in the order of ln a at weight 1 (where
    t = 0): so the hash itself is in that order, and only other weights need the formula."""
    r, b, ln_c, one = _draw_table()
    odd = np.flatnonzero(w != 1)
    ln_w = np.log(w[odd])
    for k in range(first, first + n):
        x = h ^ _SEEDS[2 * k]
        x *= _SEEDS[2 * k + 1] | U(1)
        x ^= x >> U(29)
        if len(odd):
            y = x[odd]
            i = (y >> U(48)).astype(np.int64)
            t = np.floor(ln_w / r[i] + b[i])
            rank, far = i.copy(), np.flatnonzero(t)
            if len(far):
                f = i[far]
                rank[far] = np.searchsorted(one, ln_c[f] - r[f] * (t[far] - b[f]) - r[f])
            tie = (y + t.astype(np.int64).view(U) * U(0x9E3779B97F4A7C15)) & U((1 << 48) - 1)
            x[odd] = np.minimum(rank, (1 << 16) - 1).astype(U) << U(48) | tie
        yield np.minimum.reduceat(x, start)


def sketch(h: np.ndarray, w: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(texts, SKETCH / 64): a bit of each of SKETCH samples that the bands don't use."""
    out = np.zeros((len(start), SKETCH // 64), U)
    for k, x in enumerate(samples(h, w, start, BANDS * ROWS, SKETCH)):
        out[:, k // 64] |= (mix(x) >> U(63)) << U(k % 64)
    return out.view(np.int64)


def _signed(docs: DataFrame, idf: Broadcast) -> DataFrame:
    """dg, doc_id and the keys of the bands (none for a text without words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                h, doc, times = shingles(Words(col(part, "text")))
                has = np.unique(doc)
                keys = np.zeros((0, BANDS), U)
                if len(h):
                    s = list(samples(h, weights(h, times, idf.value), np.searchsorted(doc, has)))
                    keys = np.empty((len(has), BANDS), U)
                    for band in range(BANDS):
                        key = np.full(len(has), band, U)
                        for row in s[band * ROWS:(band + 1) * ROWS]:
                            key = mix(key * U(0x9E3779B97F4A7C15) + row)
                        keys[:, band] = key
                count = np.zeros(part.num_rows, np.int64)
                count[has] = BANDS
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([col(part, "dg"), col(part, "doc_id"), lists], ["dg", "doc_id", "bands"])

    return mapped(docs.select("dg", "doc_id", "text"), run, "dg binary, doc_id long, bands array<long>")


# --- exact verification ----------------------------------------------------------------------
def _sets(docs: DataFrame, idf: Broadcast) -> DataFrame:
    """dg, its shingles (uint64, ascending) and times (uint32) as bytes, its weight in all and its sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                h, doc, times = shingles(Words(col(part, "text")))
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1)).tolist()
                hs = [h[a:b].tobytes() for a, b in zip(cut, cut[1:])]
                # times are left out where all are 1
                ts = [times[a:b].astype(np.uint32).tobytes() if b > a and times[a:b].max() > 1 else b"" for a, b in zip(cut, cut[1:])]
                total = np.bincount(doc, weights(h, times, idf.value), part.num_rows)
                bits = np.zeros((part.num_rows, SKETCH // 64), np.int64)
                has = np.unique(doc)
                if len(has):
                    bits[has] = sketch(h, weights(h, times, idf.value), np.searchsorted(doc, has))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * bits.shape[1], pa.int32()), pa.array(bits.reshape(-1)))
                yield pa.RecordBatch.from_arrays([col(part, "dg"), pa.array(hs, pa.binary()), pa.array(ts, pa.binary()), pa.array(total), lists], ["dg", "h", "t", "weight", "bits"])

    return mapped(docs.select("dg", "text"), run, "dg binary, h binary, t binary, weight double, bits array<long>")


def _own(sets: DataFrame, idf: Broadcast) -> DataFrame:
    """x, the hash of dg, and the weight of its shingles that no other text of sets has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = col(batch, "h").to_pylist()
            flat = np.frombuffer(b"".join(raw), np.int64)
            x = np.repeat(col(batch, "x").to_numpy(), [len(r) // 8 for r in raw])
            times = [np.frombuffer(t, np.uint32) if t else np.ones(len(r) // 8, np.uint32) for r, t in zip(raw, col(batch, "t").to_pylist())]
            w = weights(flat.view(U), np.concatenate(times), idf.value) if times else np.zeros(0)
            for lo in range(0, len(flat), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(flat[lo:lo + (1 << 16)]), pa.array(x[lo:lo + (1 << 16)]), pa.array(w[lo:lo + (1 << 16)])], ["h", "x", "w"])

    rows = mapped(sets.select("h", "t", F.xxhash64("dg").alias("x")), run, "h long, x long, w double")
    alone = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("w").alias("w")).filter("n = 1")
    return alone.groupBy("x").agg(F.sum("w").alias("own"))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (shingles, weights), shingles ascending."""
    total = a[1].sum() + b[1].sum()
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    return float(shared / (total - shared)) if total > 0 else 0.0


def _verified(pairs: DataFrame, idf: Broadcast, threshold: float) -> DataFrame:
    """compa, compb, similar."""
    def load(h: bytes, t: bytes) -> tuple[np.ndarray, np.ndarray]:
        h = np.frombuffer(h, U)
        return h, weights(h, np.frombuffer(t, np.uint32) if t else np.ones(len(h)), idf.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [similarity(load(*x[:2]), load(*x[2:])) >= threshold for x in zip(*(col(batch, c).to_pylist() for c in ("ah", "at", "bh", "bt")))]
            yield pa.RecordBatch.from_arrays([col(batch, "compa"), col(batch, "compb"), pa.array(hits, pa.bool_())], ["compa", "compb", "similar"])

    return mapped(pairs, run, "compa binary, compb binary, similar boolean")


def _linked(texts: DataFrame, rows: DataFrame, idf: Broadcast, threshold: float, tasks: int) -> DataFrame:
    """dg, label: the least dg of the component of each linked distinct text. texts: dg, first, bands."""
    bands = texts.select("dg", "first", F.explode("bands").alias("key"))
    full = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = materialise(bands.join(full, "key").select("key", "dg", "first", "n").coalesce(tasks), "near-met")
    central = met.groupBy("dg", "first").agg(F.sum("n").alias("met"), F.max(F.struct("n", "key"))["key"].alias("home"))
    order = F.coalesce("doc_id", F.lit(_LAST))
    wanted = central.select(F.col("dg").alias("w"), "first")
    source = rows.withColumn("order", order).join(wanted, (F.col("dg") == F.col("w")) & (F.col("order") == F.col("first"))).dropDuplicates(["dg", "order"])
    sets = materialise(_sets(source.coalesce(tasks), idf), "near-sets")
    known = central.join(sets.select(F.col("dg").alias("sdg"), "weight", "bits"), F.col("dg") == F.col("sdg")).join(_own(sets, idf), F.xxhash64("dg") == F.col("x"), "left")
    known = known.join(texts.select(F.col("dg").alias("tdg"), "bands"), F.col("dg") == F.col("tdg"))
    known = known.select("dg", "home", (-F.col("met")).alias("rank"), F.xxhash64("dg").alias("tie"), "weight", "bits", "bands", (F.col("weight") - F.coalesce("own", F.lit(0))).alias("shared"))
    state = materialise(met.select("key", "dg").join(known, "dg").withColumns({"led": F.lit(False), "comp": F.col("dg")}).coalesce(tasks), "near-members")
    discard(met)

    def beside(pairs: DataFrame, table: DataFrame, names: dict[str, str]) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(table.select(F.col("dg").alias(side), *[F.col(x).alias(side + y) for x, y in names.items()]), side)
        return pairs

    p = (1 - threshold) / 2
    far = int(SKETCH * p + SPREAD * (SKETCH * p * (1 - p)) ** 0.5) + 1
    first = F.struct("rank", "tie", "dg")

    def side(rows: DataFrame, x: str, *more: str) -> DataFrame:
        return rows.select(F.col("key").alias(f"key{x}"), F.col("home").alias(f"home{x}"), F.col("dg").alias(x), first.alias(f"first{x}"), F.col("led").alias(f"led{x}"), F.col("comp").alias(f"comp{x}"), *[F.col(c).alias(c + x) for c in ("weight", "shared", "bits", "bands", *more)])

    labels, main, lead, members = None, None, 1, state
    while True:
        if main is None:  # every text is a component still, and meets the first of its largest bucket alone
            outside = state.withColumn("main", F.lit(None).cast("binary")).join(state.select(F.col("home").alias("key")).distinct(), "key", "left_semi")
        else:
            outside = state.filter("not led").join(main, "key").filter("comp <> main")
        place = F.row_number().over(Window.partitionBy("key").orderBy("rank", "tie", "dg"))
        heads = outside.withColumn("place", place).filter(F.col("place") <= lead).drop("place")
        heads = materialise(heads.coalesce(tasks), "near-leaders")
        most = F.least("shareda", "sharedb")
        can = most >= (threshold - 1e-9) * (F.col("weighta") + F.col("weightb") - most)
        differ = sum(F.bit_count(F.col("bitsa")[i].bitwiseXOR(F.col("bitsb")[i])) for i in range(SKETCH // 64))
        bucket = F.coalesce(*[F.when(F.col("bandsa")[i] == F.col("bandsb")[i], F.col("bandsa")[i]) for i in range(BANDS)])
        # who has led is compared already; of two leaders (all that precede one outside the largest component) the first alone makes the pair
        once = ~F.col("ledb") & (F.coalesce(F.col("compb") == F.col("maina"), F.lit(False)) | (F.col("firsta") < F.col("firstb")))
        pairs = side(heads, "a", "main")
        here = F.col("keyb") == F.col("homeb") if main is None else once & (F.col("keya") == bucket)
        pairs = pairs.join(side(state, "b"), (F.col("keya") == F.col("keyb")) & (F.col("a") != F.col("b")) & (F.col("compa") != F.col("compb")) & can & here & (differ <= far))
        pairs = pairs.select("a", "b", "compa", "compb")
        both = beside(pairs, sets, {"h": "h", "t": "t"}).select("a", "b", "ah", "at", "bh", "bt", "compa", "compb")
        now = _verified(both.coalesce(tasks), idf, threshold).filter("similar")
        # one link joins two components, and a component found before is a star
        now = now.select(F.least("compa", "compb").alias("a"), F.greatest("compa", "compb").alias("b")).distinct()
        now = now.coalesce(tasks)
        links = materialise(now if labels is None else now.unionByName(labels.filter("dg <> label").select(F.col("label").alias("a"), F.col("dg").alias("b"))), "near-found")
        labels = components(links).select(F.col("node").alias("dg"), "label")
        discard(links)
        if main is not None:
            led = heads.select("key", "dg", F.lit(True).alias("now"))
            state = state.join(led, ["key", "dg"], "left").withColumn("led", F.col("led") | F.col("now").isNotNull()).drop("now")
        state = state.join(labels, "dg", "left").withColumn("comp", F.coalesce("label", "dg")).drop("label")
        state = materialise(state.coalesce(tasks), "near-members")
        discard(members, heads)
        members = state
        sizes = state.filter("not led").groupBy("key", "comp").agg(F.count("*").alias("n"))
        main = sizes.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("top")).filter("comps > 1")
        main = materialise(main.select("key", F.col("top.comp").alias("main")).coalesce(tasks), "near-open")
        if not main.limit(1).count():
            discard(members, sets)
            return labels
        lead = LEADERS if lead < LEADERS else lead * MORE


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node that can be reached."""
    if links.count() <= _FEW:
        return _few_components(links)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both, "near-links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "near-labels")
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(seen, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("n2"), F.col("label").alias("further"))
        step = step.join(jump, F.col("label") == F.col("n2"), "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        step = materialise(step, "near-labels")
        labels = step.select("node", "label")
        if not step.filter("old != label").limit(1).count():
            return labels


def _few_components(links: DataFrame) -> DataFrame:
    """components() of links that fit the driver: there each round of shuffles costs more than all of it."""
    up: dict[bytes, bytes] = {}

    def least(x: bytes) -> bytes:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    got = links.select("a", "b").toArrow()
    for a, b in zip(got["a"].to_pylist(), got["b"].to_pylist()):
        a, b = least(a), least(b)
        up[max(a, b)] = min(a, b)
    labels = pa.table([pa.array(list(up), pa.binary()), pa.array([least(x) for x in up], pa.binary())], ["node", "label"])
    return materialise(links.sparkSession.createDataFrame(labels, "node binary, label binary"), "near-labels")


def _with_digest(docs: DataFrame) -> DataFrame:
    return docs.withColumn("dg", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(dg, doc_id) of each row, and for each distinct text dg, first, copies, class_first and
    class_dg (the least id of the class, and its text)."""
    rows = _with_digest(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("dg", "doc_id", "text")
    # at most mean length / COMMON shingles
    idf = docs.sparkSession.sparkContext.broadcast(common_idf(rows))
    told = materialise(_signed(rows, idf), "near-signatures")
    order = F.coalesce("doc_id", F.lit(_LAST))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, told.count() // _TASK)
    texts = told.groupBy("dg").agg(F.min(order).alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    texts = materialise(texts.coalesce(tasks), "near-texts")
    discard(told)
    labels = _linked(texts, rows, idf, threshold, tasks).withColumnRenamed("dg", "node")
    info = texts.drop("bands").join(labels, F.col("dg") == F.col("node"), "left")
    info = info.select("dg", "first", "copies", F.coalesce("label", "dg").alias("class"))
    info = materialise(info.coalesce(tasks), "near-classes")
    least = info.groupBy(F.col("class").alias("c")).agg(F.min(F.struct("first", "dg")).alias("m"))
    info = info.join(least, F.col("class") == F.col("c")).select("dg", "first", "copies", F.col("m.first").alias("class_first"), F.col("m.dg").alias("class_dg"))
    return rows.select("dg", "doc_id"), materialise(info.coalesce(tasks), "near-result")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the class's least doc_id), copies (rows of equal text)."""
    rows, info = classes(docs, threshold)
    name = F.when(F.col("class_first") < _LAST, F.col("class_first")).alias("class_id")
    return rows.join(info.withColumnRenamed("dg", "d"), F.col("dg") == F.col("d")).select("doc_id", name, "copies")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that stand for their classes: those of the least id, one row each."""
    _, info = classes(docs, threshold)
    keep = info.filter(F.col("dg") == F.col("class_dg")).select(F.col("dg").alias("d"), F.col("first").alias("f"))
    # the columns of docs travel in a struct, where no name can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("dg"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("o"))
    rows = rows.join(keep, (F.col("dg") == F.col("d")) & (F.col("o") == F.col("f"))).dropDuplicates(["dg", "o"])
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
