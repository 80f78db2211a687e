"""Toxicity scores from a lexicon trie intersected with Levenshtein automata.

The lexicon is learned: words, and stems (beginnings of words), that occur far oftener in texts
labelled toxic than in others, with the log ratio of their rates as weights; every term counts whose
presence in toxic texts is significant at a false discovery rate of FALSE, however many (near copies
of a text are one piece of evidence, unless no term is significant so).  Its trie is
intersected with Levenshtein automata (words of 5 letters or more may have one error, of 9 or more
two; stems none) by subset construction into one table of states and byte classes, so that all
words of a text run through it side by side, one byte a step, and most die after a few.  Capitals,
and digits and signs that stand for letters, count as the letters.  A misspelled hit weighs less.

A hit's context window tells quotation from abuse: quotation marks around it, or a reporting word
(SPEECH) within CONTEXT words, leave it QUOTED of its weight.  A text's features (its hits' weight in
all, for its length, and the largest one) go through a logistic regression.

Labels are learned from at most about SAMPLE labelled rows, which a hash of the id chooses (a
documented bound), and of those only from rows outside the held-out part.  Scores read text alone.

Edge cases: null and empty texts have no hits and get the score of that; without labels of both
kinds every score is the share of toxic ones (0 if there are none); conflicting labels of one id
count as toxic if any is; null labels teach nothing; repeated rows don't matter; columns with other
names don't matter; an empty table gives an empty one.
"""
from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from math import lgamma
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, col, crc_mod, materialise, mix, pieces, mapped, text_bytes, window_hash

SAMPLE, FALSE, CONTEXT, QUOTED, ERROR = 12_000, 0.01, 4, 0.25, 0.7
STEM = range(4, 9)
#: Letters that digits and signs stand for, and words that report speech.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
SPEECH = "said says quote quoted quotes wrote called word term sagte sagt zitat wort schrieb dit mot citation écrit dijo dice palabra cita"

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
for _b in range(128):
    if not chr(_b).isalnum():
        _PLAIN[_b] = 32
_ALNUM = _PLAIN != 32
_INNER = np.zeros(256, bool)
_INNER[list(b"@$*")] = True
_FOLD = _PLAIN.copy()
for _a, _b in LEET.items():
    _FOLD[ord(_a)] = ord(_b)
_FOLD[ord("*")] = ord("*")


class Tokens:
    """Words of letters and digits, with the signs between letters that may stand for one."""

    def __init__(self, texts: pa.Array):
        self.raw, self.off = text_bytes(texts)
        raw, off = self.raw, self.off
        word = _ALNUM[raw]
        if len(raw) > 2:
            inside = _INNER[raw]  # between two letters of one text
            edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(raw))]
            inside[edge] = inside[edge - 1] = False
            word[1:-1] |= inside[1:-1] & word[:-2] & word[2:]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(raw))]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.data = _FOLD[raw]

    def words(self) -> list[str]:
        raw = self.data.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(self.start.tolist(), self.end.tolist())]


class Matcher(NamedTuple):
    """states x classes -> state (0: dead, 1: start); the weight of a word that ends in a state, and of any word that passes it."""
    classes: np.ndarray
    step: np.ndarray
    ends: np.ndarray
    passes: np.ndarray


def matcher(words: dict[str, float], stems: dict[str, float], error: float = ERROR) -> Matcher:
    """The trie of words and stems, intersected with Levenshtein automata by subset construction."""
    entries = [(w.encode(), x, 0 if len(w) < 5 else 1 if len(w) < 9 else 2) for w, x in words.items()] + [(w.encode(), x, -1) for w, x in stems.items()]
    used = sorted({b for e, _, _ in entries for b in e})
    classes = np.zeros(256, np.int64)
    for i, b in enumerate(used):
        classes[b] = i + 1
    # trie nodes; each knows the most errors any word below allows
    child: list[dict[int, int]] = [{}]
    most, end, stem = [-1], [0.0], [0.0]
    for e, x, k in entries:
        node = 0
        most[0] = max(most[0], k)
        for b in e:
            nxt = child[node].get(int(classes[b]))
            if nxt is None:
                nxt = child[node][int(classes[b])] = len(child)
                child.append({}), most.append(-1), end.append(0.0), stem.append(0.0)
            node = nxt
            most[node] = max(most[node], k)
        if k < 0:
            stem[node] = max(stem[node], x)
        else:
            end[node] = max(end[node], x)
    allowed = {}
    for e, x, k in entries:
        node = 0
        for b in e:
            node = child[node][int(classes[b])]
        if k >= 0:
            allowed[node] = max(allowed.get(node, 0), k)

    def close(s: set[tuple[int, int]]) -> frozenset:
        """With letters of the trie left out, an error each."""
        todo, out = list(s), set(s)
        while todo:
            node, k = todo.pop()
            for nxt in child[node].values():
                if k + 1 <= most[nxt] and (nxt, k + 1) not in out:
                    out.add((nxt, k + 1))
                    todo.append((nxt, k + 1))
        least: dict[int, int] = {}
        for node, k in out:
            if k < least.get(node, 9):
                least[node] = k
        return frozenset(least.items())

    n_classes = len(used) + 1
    start = close({(0, 0)})
    number, queue, table = {frozenset(): 0, start: 1}, [start], [[0] * n_classes, None]
    ends, passes = [0.0, 0.0], [0.0, 0.0]
    while queue:
        now = queue.pop()
        row = []
        for c in range(n_classes):
            nxt = set()
            for node, k in now:
                to = child[node].get(c) if c else None
                if to is not None:
                    nxt.add((to, k))  # the letter itself
                if k < most[node]:
                    nxt.add((node, k + 1))  # a letter too many
                    for other, to in child[node].items():
                        if other != c and k + 1 <= most[to]:
                            nxt.add((to, k + 1))  # another letter
            s = close(nxt) if nxt else frozenset()
            if s not in number:
                number[s] = len(table)
                table.append(None)
                queue.append(s)
                ends.append(max((end[n] * error ** k for n, k in s if k <= allowed.get(n, -1)), default=0.0))
                passes.append(max((stem[n] for n, k in s if not k), default=0.0))
            row.append(number[s])
        table[number[now]] = row
    return Matcher(classes, np.array(table, np.int32), np.array(ends), np.array(passes))


def matches(m: Matcher, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that hit, and the weights of the hits."""
    n = len(t.start)
    weight = np.zeros(n)
    live, state, at = np.arange(n), np.ones(n, np.int32), 0
    code = m.classes[t.data]
    size = t.end - t.start
    while len(live):
        over = size[live] == at
        if over.any():
            weight[live[over]] = np.maximum(weight[live[over]], m.ends[state[over]])
            live, state = live[~over], state[~over]
        state = m.step[state, code[t.start[live] + at]]
        go = state > 0
        live, state = live[go], state[go]
        if len(live):
            weight[live] = np.maximum(weight[live], m.passes[state])
        at += 1
    hit = np.flatnonzero(weight)
    return hit, weight[hit]


_SPEECH_WORDS = frozenset(SPEECH.split())


def _quoted(t: Tokens, hit: np.ndarray) -> np.ndarray:
    """Whether a hit is quoted: between quotation marks, or near a word that reports speech."""
    out = np.zeros(len(hit), bool)
    raw = t.raw.tobytes()
    folded = t.data.tobytes()
    for i, h in enumerate(hit.tolist()):
        a, b = int(t.start[h]), int(t.end[h])
        lo, hi = max(int(t.off[t.doc[h]]), a - 80), min(int(t.off[t.doc[h] + 1]), b + 80)
        before, after = raw[lo:a].rpartition(b"\n")[2], raw[b:hi].partition(b"\n")[0]
        marks = before.count(b'"') % 2 == 1 and b'"' in after
        pairs = any(before.rfind(o) > before.rfind(c) and c in after for o, c in ((b"\xc2\xab", b"\xc2\xbb"), (b"\xe2\x80\x9c", b"\xe2\x80\x9d"), (b"\xe2\x80\x9e", b"\xe2\x80\x9c")))
        near = range(max(h - CONTEXT, int(t.first[t.doc[h]])), min(h + CONTEXT + 1, int(t.first[t.doc[h] + 1])))
        out[i] = marks or pairs or any(folded[t.start[j]:t.end[j]].decode("utf-8", "replace") in _SPEECH_WORDS for j in near if j != h)
    return out


def features(m: Matcher, texts: pa.Array) -> np.ndarray:
    """(texts, 4): 1, log of the hits' weight in all, weight for the length, largest weight."""
    t = Tokens(texts)
    n = len(t.off) - 1
    hit, w = matches(m, t)
    w = np.where(_quoted(t, hit), QUOTED * w, w)
    doc = t.doc[hit]
    total = np.bincount(doc, w, n)
    largest = np.zeros(n)
    np.maximum.at(largest, doc, w)
    return np.stack([np.ones(n), np.log1p(total), total / np.sqrt(np.diff(t.first) + 10.0), largest], 1)


def _terms(word: str) -> list[str]:
    """The word itself, and its stems with a caret before."""
    return [word, *("^" + word[:k] for k in STEM if len(word) > k)] if len(word) >= 4 else [word]


def _passages(rows: DataFrame) -> DataFrame:
    """text, toxic and the least hash of the text's five-word passages (of all its words, if there are fewer)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                w = Words(col(part, "text"))
                key = np.zeros(part.num_rows, U)
                for i, (a, b) in enumerate(zip(w.first.tolist(), w.first[1:].tolist())):
                    if b > a:
                        key[i] = mix(window_hash(w.hash[a:b], min(5, b - a))).min()
                yield pa.RecordBatch.from_arrays([col(part, "text"), col(part, "toxic"), pa.array(key.view(np.int64))], ["text", "toxic", "key"])

    return mapped(rows.select("text", "toxic"), run, "text string, toxic int, key long")


def _counted(texts: DataFrame, wanted: frozenset | None) -> DataFrame:
    """term, docs, n: how many texts of a task hold a term, and how often."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, n = Counter(), Counter()
        for batch in batches:
            for part in pieces(batch):
                t = Tokens(col(part, "text"))
                words, cut = t.words(), t.first.tolist()
                for a, b in zip(cut, cut[1:]):
                    own: dict[str, int] = defaultdict(int)
                    for w, k in Counter(words[a:b]).items():
                        for x in _terms(w):
                            if wanted is None or x in wanted:
                                own[x] += k
                    docs.update(own.keys())
                    n.update(own)
        yield pa.RecordBatch.from_arrays([pa.array(list(docs), pa.string()), pa.array(list(docs.values()), pa.int64()), pa.array([n[x] for x in docs], pa.int64())], ["term", "docs", "n"])

    counts = mapped(texts.select("text"), run, "term string, docs long, n long")
    return counts.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """The chance of k or more of n at p each."""
    i = np.arange(k, n + 1)
    logs = np.array([lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) for j in i.tolist()]) + i * np.log(p) + (n - i) * np.log1p(-p)
    return float(min(1.0, np.exp(logs).sum()))


class Model(NamedTuple):
    matcher: Matcher
    beta: np.ndarray


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge."""
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-3, *[0.3] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - y) + ridge @ beta
        beta = beta - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(beta)), grad)
    return beta


def _telling(rows: DataFrame) -> list[tuple[float, str, float]]:
    """(score, term, log ratio of its rates) of all terms that are significantly oftener in toxic texts."""
    sizes = {int(r["toxic"]): (r["docs"], r["words"] or 0) for r in rows.groupBy("toxic").agg(F.count("*").alias("docs"), F.sum(F.regexp_count("text", F.lit(r"[^\s]+"))).alias("words")).collect()}
    share = sizes[1][0] / (sizes[1][0] + sizes[0][0])
    seen = _counted(rows.filter("toxic = 1"), None)
    n_terms = seen.count()
    # what couldn't be significant even if no other text had it needn't be counted there
    bad = seen.filter(F.col("docs") * float(np.log(share)) <= float(np.log(FALSE))).toPandas()
    good = {t: (d, n) for t, d, n in _counted(rows.filter("toxic = 0"), frozenset(bad["term"])).toPandas().itertuples(index=False)}
    chance = {t: binomial_tail(d, d + good.get(t, (0, 0))[0], share) for t, d in zip(bad["term"], bad["docs"])}
    limit = max((p for i, p in enumerate(sorted(chance.values()), 1) if p <= FALSE * i / n_terms), default=-1.0)
    found = []
    for term, in_docs, k in bad.itertuples(index=False):
        ratio = np.log(((k + 0.5) / max(sizes[1][1], 1)) / ((good.get(term, (0, 0))[1] + 0.5) / max(sizes[0][1], 1)))
        if ratio > 1.5 and chance[term] <= limit:
            found.append((in_docs * ratio, term, float(ratio)))
    return found


def fit(docs: DataFrame, labels: DataFrame, held_out: int | None = 0, sample: int = SAMPLE) -> Model:
    given = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if held_out is not None:
        given = given.filter(crc_mod("doc_id", 5) != held_out)
    n = given.count()
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 40))
    # about `sample` rows of two numbers: small by its bound, whatever the labels' number
    given = given.filter(draw < int(min(1.0, sample / max(n, 1)) * (1 << 40))).toPandas()
    spark = docs.sparkSession
    given = spark.createDataFrame([(int(a), int(b)) for a, b in given.itertuples(index=False)], "id long, toxic int")
    rows = materialise(docs.select("doc_id", "text").join(F.broadcast(given), F.col("doc_id") == F.col("id")), "toxicity-sample")
    if {int(r["toxic"]) for r in rows.select("toxic").distinct().collect()} != {0, 1}:
        return Model(matcher({}, {}), np.array([30.0 if rows.filter("toxic = 1").limit(1).count() else -30.0, 0, 0, 0]))
    # copies and near copies are no further evidence: of texts with the same least passage one counts, unless that leaves no evidence
    found = _telling(_passages(rows).groupBy("toxic", "key").agg(F.min("text").alias("text"))) or _telling(rows)
    # the most telling first; a term within a kept stem, or a stem of kept stems or words, adds nothing
    words, stems = {}, {}
    for _, term, ratio in sorted(found, key=lambda f: (-f[0], f[1].startswith("^"), len(f[1]), f[1])):
        plain = term.lstrip("^")
        if any(plain.startswith(s) for s in stems) or (term != plain and any(x.startswith(plain) for x in (*words, *stems))):
            continue
        (stems if term.startswith("^") else words)[plain] = ratio
    m = matcher(words, stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                x = features(m, col(part, "text"))
                yield pa.RecordBatch.from_arrays([col(part, "doc_id"), *(pa.array(x[:, k]) for k in range(1, 4)), col(part, "toxic")], ["doc_id", "a", "b", "c", "y"])

    got = mapped(rows.select("doc_id", "text", "toxic"), run, "doc_id long, a double, b double, c double, y int").toPandas().sort_values(["doc_id", "a", "b", "c"])
    x = np.concatenate([np.ones((len(got), 1)), got[["a", "b", "c"]].to_numpy(float)], 1)
    return Model(m, _logistic(x, got["y"].to_numpy(float)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                p = 1 / (1 + np.exp(-np.clip(features(model.matcher, col(part, "text")) @ model.beta, -30, 30)))
                yield pa.RecordBatch.from_arrays([col(part, "doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return mapped(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of op9."""
    rows = scored(docs, fit(docs, labels))
    return rows.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
