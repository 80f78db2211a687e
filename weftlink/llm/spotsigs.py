"""Document fingerprints by SpotSigs.

Letters are lower-cased and ASCII punctuation parts words.  Each common word (ANCHORS) in a text
starts a signature: the anchor and the chain of the next CHAIN words that are not common.  A text
in which no anchor has a whole chain takes every word as an anchor.  The fingerprint is the sorted
set of the signatures' 32-bit hashes, as hexadecimal text; likeness is the Jaccard similarity of
two sets, whose lengths alone bound it: min / max.

The similarity join puts fingerprints into partitions by length (each a factor of the threshold
longer than the last), so that a text only meets its own and the next partition, there only through
a signature of its prefix (the first n - ceil(threshold n) + 1 in hash order), and is compared only
if the bound allows.

The query that edits texts needs each document's successor by doc_id.  Ids alone are range
partitioned to learn where the ranges begin; every row then goes to its range's task, and the first
row of a range also to the task before, so that neighbours always meet.

Edge cases: a null text is empty; a text without words has an empty fingerprint, and two empty ones
are alike (1.0), an empty and another are not (0.0); rows of one id follow each other by their text;
a null id comes first, and rows of one id are one range; a very long text is taken whole; a single
document is its own successor; columns with other names don't
matter; an empty table gives an empty one.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, U, Words, col, materialise, mix, pieces, mapped, text_bytes

CHAIN = 2
#: Common words of English, German, French and Spanish.
ANCHORS = """a an the and or of to in on at by for from with is are was be that this it as not have has he she they you we i
der die das den dem des ein eine und oder zu mit von für auf ist im in sich nicht als auch es an werden aus er sie
le la les un une des du de et ou à en dans pour par sur est que qui avec au aux il elle pas ce cette plus
el los las una unos y o del al por con para se es lo su más como pero"""
#: Ranges of ids: so many to a shuffle partition, as they are dealt by hash, or more, of about RANGE_BYTES each.
RANGES, RANGE_BYTES = 16, 1 << 22
_FIRST = -(1 << 63)

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
for _b in range(128):
    if not chr(_b).isalnum():
        _PLAIN[_b] = 32


def _plain(texts: pa.Array) -> pa.Array:
    """Texts with letters in lower case and ASCII punctuation as blanks, byte for byte."""
    data, off = text_bytes(texts)
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(_PLAIN[data]))


_anchors = np.unique(Words(pa.array([" ".join(ANCHORS.split())])).hash)


def signatures(texts: pa.Array) -> list[np.ndarray]:
    """The sorted set of signature hashes of each text."""
    w = Words(_plain(texts))
    h, doc = w.hash, w.doc
    if not len(h):
        return [np.zeros(0, np.uint32)] * w.n
    common = np.isin(h, _anchors)

    def chains(anchor: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of anchors (places) through the content words (places), and their texts."""
        nxt = np.searchsorted(content, anchor, "right")
        ok = nxt + CHAIN <= len(content)
        anchor, nxt = anchor[ok], nxt[ok]
        ok = doc[content[nxt + CHAIN - 1]] == doc[anchor] if len(anchor) else np.zeros(0, bool)
        anchor, nxt = anchor[ok], nxt[ok]
        s = h[anchor]
        for j in range(CHAIN):
            s = mix(s * U(0x9E3779B97F4A7C15) + h[content[nxt + j]])
        return s, doc[anchor]

    s, owner = chains(np.flatnonzero(common), np.flatnonzero(~common))
    bare = np.bincount(owner, minlength=w.n) == 0
    if bare.any():
        # no signature: every word is an anchor, and a text of few words is one signature
        at = np.flatnonzero(bare[doc])
        own = doc[at]
        more, more_owner = [], []
        for size in range(1, CHAIN + 2):
            head = at[:len(at) - size + 1]
            same = own[:len(head)] == own[size - 1:]
            if size <= CHAIN:  # only texts of just so many words
                n = np.diff(w.first)[own[:len(head)]]
                same = same & (n == size)
            t = h[head[same]]
            for j in range(1, size):
                t = mix(t * U(0x9E3779B97F4A7C15) + h[head[same] + j])
            more.append(t), more_owner.append(own[:len(head)][same])
        s, owner = np.concatenate([s, *more]), np.concatenate([owner, *more_owner])
    s = (s >> U(32)).astype(np.uint32)
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[new], owner[new]
    cut = np.searchsorted(owner, np.arange(w.n + 1)).tolist()
    return [s[a:b] for a, b in zip(cut, cut[1:])]


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0.0 at once if their lengths keep it under `least`."""
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def fingerprint_text(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, signatures array<long>, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                rows = [s.astype(np.int64) for s in signatures(col(part, "text"))]
                yield pa.RecordBatch.from_arrays([col(part, "doc_id"), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "signatures"])

    return mapped(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, signatures array<long>")


def similar_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class_id) of every row, a class being all rows of one fingerprint, named by its least id;
    and (a, b, likeness) of all pairs of classes from the threshold on.  Empty fingerprints have no pairs."""
    prints = materialise(fingerprints(docs), "spot-prints")
    sets = materialise(prints.groupBy("signatures").agg(F.min("doc_id").alias("id")), "spot-sets")
    rows = prints.join(sets, "signatures").select("doc_id", F.col("id").alias("class_id"))
    n = F.size("signatures")
    sets = sets.filter(n > 0).withColumn("n", n).withColumn("part", F.floor(F.log("n") / -math.log(threshold)))
    prefix = F.slice("signatures", F.lit(1), (n - F.ceil(n * threshold) + 1).cast("int"))
    heads = sets.select("id", "n", "part", F.explode(prefix).alias("s"))
    left = heads.select(F.col("id").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    met = left.join(heads.select(F.col("id").alias("b"), F.col("n").alias("nb"), "s", "part"), ["part", "s"])
    met = met.filter((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))).filter(F.col("na") >= threshold * F.col("nb")).select("a", "b").distinct()
    pairs = met.join(sets.select(F.col("id").alias("a"), F.col("signatures").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("signatures").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    pairs = pairs.withColumn("likeness", shared / (F.size("sa") + F.size("sb") - shared)).filter(F.col("likeness") >= threshold).select("a", "b", "likeness")
    return rows, pairs


def _range_starts(docs: DataFrame) -> np.ndarray:
    """Where ranges of ids begin: the least id of each partition of a range partitioning of the ids alone."""
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n = max(RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("id")).repartitionByRange(n, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = None
        for batch in batches:
            if batch.num_rows:
                here = int(col(batch, "id").to_numpy().min())
                least = here if least is None else min(least, here)
        if least is not None:
            yield pa.RecordBatch.from_arrays([pa.array([least], pa.int64())], ["id"])

    return np.unique(mapped(ids, run, "id long").toPandas()["id"].to_numpy(np.int64))


def _placed(docs: DataFrame, starts: np.ndarray) -> DataFrame:
    """range, next (whether the row is only there as the last one's successor), id, doc_id, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id = col(batch, "doc_id")
            ids = doc_id.fill_null(_FIRST).to_numpy()
            at = np.searchsorted(starts, ids, "right") - 1
            first = np.flatnonzero(starts[at] == ids)
            rows = np.concatenate([np.arange(len(ids)), first])
            where = np.concatenate([at, (at[first] - 1) % len(starts)])
            after = np.arange(len(rows)) >= len(ids)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(after), pa.array(ids[rows], pa.int64()), doc_id.take(take), col(batch, "text").take(take)], ["range", "next", "id", "doc_id", "text"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "range long, next boolean, id long, doc_id long, text string")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of op6."""
    starts = _range_starts(docs)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(col(batch, c).to_pylist() for c in ("range", "next", "doc_id", "text")))

    def told(rows: list[tuple]) -> pa.RecordBatch:
        """From rows in order, each with its successor after it; a row that is only a successor, or the last, gives none."""
        texts = [r[3] or "" for r in rows]
        at = [i for i in range(len(rows) - 1) if not rows[i][1]]
        edited = []
        for i in at:
            t = texts[i]
            half = len(t) // 2
            edited.append(t[:len(t) - half] + texts[i + 1][:half])
        own, new = signatures(pa.array(texts, pa.string())), signatures(pa.array(edited, pa.string()))
        return pa.RecordBatch.from_arrays([
            pa.array([rows[i][2] for i in at], pa.int64()), pa.array([len(texts[i]) for i in at], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([fingerprint_text(own[i]) for i in at], pa.string()), pa.array([fingerprint_text(s) for s in new], pa.string()),
            pa.array([likeness(own[i], s) for i, s in zip(at, new)], pa.float64()), pa.array([likeness(own[i], own[i + 1]) for i in at], pa.float64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for row in rows_of(batches):
            if held and held[-1][0] != row[0]:  # another range
                yield told(held)
                held, size = [], 0
            if held and held[-1][1]:  # the successor of the range's last row is known
                continue
            held.append(row)
            size += len(row[3] or "")
            if size > PIECE:
                yield told(held)
                held, size = held[-1:], len(row[3] or "")
        if held:
            yield told(held)

    placed = _placed(docs, starts).repartition("range").sortWithinPartitions("range", "next", "id", "text")
    return mapped(placed, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
