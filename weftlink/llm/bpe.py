"""BPE encoding and decoding with a contiguous rank array.

For tokenizer files of the `tokenizers` library whose model is a BPE with an end-of-word suffix
over byte-level characters, normalised by NFC and lower-casing (word_bpe_49k.json is one).  Each
word holds its part boundaries, and the merge rank of each part with the next, in short contiguous
lists: the least rank is looked for again and again (the leftmost of equals), the boundary after
its part is deleted and the two ranks beside it are refreshed.  Words of over LONG parts use a heap
over the same ranks, with the same result in n log n.

What stands between white space recurs, so each Python worker keeps the ids of chunks seen before,
whatever task they came from; when these take CACHE bytes, it starts anew.  The work is one pass over
the rows without a shuffle.

Edge cases: a null text is empty; an empty one has no ids and decodes to ''; special tokens in a
text are special tokens, as in the library; a very long text is encoded whole, alone; of equal ranks
the leftmost is merged, as in the library; repeated rows and extra columns don't matter; an empty
table gives an empty one.
"""
from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Words, col, exact_groups, mapped, pieces

#: Where a vocabulary is read from; a parameter of every function here.
VOCABULARY = "word_bpe_49k.json"
CACHE, LONG = 32 << 20, 100
#: Bytes that an entry of the cache takes besides its chunk and ids, about.
_ENTRY = 180
#: Rows of one rank array.
_ROWS = 4096
_NONE, _FAR = 1 << 60, np.iinfo(np.int32).max

#: Capitals that Unicode 16 and 17 gave a lower case, which Python's tables may not have yet.
_NEWER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_NEWER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_NEWER = regex.compile("[" + "".join(map(chr, _NEWER_LOWER)) + "]")

#: Letters and numbers of Unicode 16, the library's version, that 15.1, Python's, lacks.
_SIXTEEN = """1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D40-10D49 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3
116D0-116E3 11BC0-11BE0 11BF0-11BF9 13460-143FA 16100-1611D 16130-16139 16D40-16D6C 16D70-16D79 18CFF 1CCF0-1CCF9 1E5D0-1E5ED 1E5F0 1E5F1-1E5FA"""


def _newer() -> str:
    """Letters and numbers that the regex module knows from later versions, as ranges of a set."""
    known = {c for r in _SIXTEEN.split() for a, _, b in [r.partition("-")] for c in range(int(a, 16), int(b or a, 16) + 1)}
    match = regex.compile(r"[\p{L}\p{N}]").match
    late = [c for c in range(0x80, 0x40000) if unicodedata.category(chr(c)) == "Cn" and c not in known and match(chr(c))]
    return "".join(f"\\U{c:08X}" for c in late)


#: The file's own split pattern, with white space spelt as the Unicode property.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


def late_split(late: str) -> str:
    """The same where letters and numbers of later versions are neither."""
    letter, number = (rf"[\p{{{k}}}--[{late}]]" for k in "LN")
    return rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|(?:(?!{letter}|{number})[^\p{{White_Space}}])+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Ragged:
    """Rows of unequal length: all their values, and how many each has."""

    def __init__(self, flat=None, count=None):
        self.flat = np.zeros(0, np.int32) if flat is None else flat
        self.count = np.zeros(0, np.int64) if count is None else np.asarray(count, np.int64)
        self.start = np.cumsum(self.count) - self.count

    @classmethod
    def of(cls, rows: list) -> Ragged:
        return cls(np.array([x for r in rows for x in r], np.int32), [len(r) for r in rows])

    def __len__(self) -> int:
        return len(self.count)

    def row(self, k: int) -> list:
        return self.flat[self.start[k]:self.start[k] + self.count[k]].tolist()

    def take(self, rows: np.ndarray) -> Ragged:
        n = self.count[rows]
        end = np.cumsum(n)
        at = np.arange(int(end[-1]) if len(end) else 0) + np.repeat(self.start[rows] - (end - n), n)
        return Ragged(self.flat[at], n)

    def join(self, groups: np.ndarray) -> Ragged:
        """The next groups[i] rows become row i."""
        total = np.append(0, np.cumsum(self.count))
        return Ragged(self.flat, np.diff(total[np.append(0, np.cumsum(groups))]))

    def plus(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.flat, other.flat]), np.concatenate([self.count, other.count]))


class WordBPE:
    """One vocabulary, with the pieces of words seen so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.token = {i: t for t, i in self.vocab.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.made: list[int] = []
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            self.rank.setdefault(self.vocab[a] << 20 | self.vocab[b], r)
            self.made.append(self.vocab[a + b])
        keys = np.array(sorted(self.rank), np.int64)
        self._keys = np.append(keys, 1 << 62)
        self._ranks = np.append(np.array([self.rank[k] for k in keys.tolist()], np.int32), _FAR)
        self._made = np.array(self.made, np.int32)
        chars = byte_characters()
        self.inner = [self.vocab[c] for c in chars]
        self.last = [self.vocab[c + self.suffix] for c in chars]
        self.split = self.late_split = regex.compile(SPLIT).findall
        late = _newer()
        self.late = regex.compile(f"[{late}]" if late else "(?!)").search
        if late:
            self.late_split = regex.compile(late_split(late)).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._inner, self._last = np.array(self.inner, np.int32), np.array(self.last, np.int32)
        size = max(self.token) + 1
        raw = [self.token.get(i, "").encode() + b" " for i in range(size)]
        self._tokens = Ragged(np.frombuffer(b"".join(raw), np.uint8), [len(r) for r in raw])
        #: Chunks seen so far, their ids, and the bytes that both take.
        self.index: dict[bytes, int] = {}
        self.known = Ragged()
        self.held = 0

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        if len(ids) > LONG:
            return self._merge_long(ids)
        get, made = self.rank.get, self.made
        ranks = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            ids[i] = new = made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | new, _NONE)
            if i < len(ranks):
                ranks[i] = get(new << 20 | ids[i + 1], _NONE)
        return ids

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._ranks[at], _FAR)

    def merge_all(self, words: list[bytes]) -> Ragged:
        """The ids of each word; words of like length are rows of one rank array."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        short = int(np.searchsorted(size[order], LONG, "right"))
        places, counts, flat = [], [], []
        for k in order[short:].tolist():
            ids = self.merge(words[k])
            places.append(np.array([k])), counts.append(np.array([len(ids)])), flat.append(np.array(ids, np.int32))
        for lo in range(0, short, _ROWS):
            rows = order[lo:min(lo + _ROWS, short)]
            n, width = size[rows], int(size[rows[-1]])
            raw = np.frombuffer(b"".join([words[k].ljust(width, b"\0") for k in rows.tolist()]), np.uint8).reshape(len(rows), width)
            ids = self._inner[raw]
            every, column = np.arange(len(rows)), np.arange(width)
            ids[every, n - 1] = self._last[raw[every, n - 1]]
            ids[column >= n[:, None]] = -1
            ranks = np.full((len(rows), width), _FAR, np.int32)
            if width > 1:
                real = column[:-1] < (n - 1)[:, None]
                ranks[:, :-1][real] = self._rank_of(ids[:, :-1][real], ids[:, 1:][real])
            while len(rows):
                i = ranks.argmin(1)
                every = np.arange(len(rows))
                least = ranks[every, i]
                done = least == _FAR
                if done.any():
                    whole = ids[done]
                    places.append(rows[done]), counts.append((whole >= 0).sum(1)), flat.append(whole[whole >= 0])
                    go = ~done
                    rows, ids, ranks, i, least = rows[go], ids[go], ranks[go], i[go], least[go]
                    if not len(rows):
                        break
                    every = np.arange(len(rows))
                # delete the boundary after part i: what follows moves up by one
                ids[every, i] = self._made[least]
                ids[:, :-1] = np.where(column[:-1] > i[:, None], ids[:, 1:], ids[:, :-1])
                ids[:, -1] = -1
                ranks[:, :-1] = np.where(column[:-1] >= i[:, None], ranks[:, 1:], ranks[:, :-1])
                ranks[:, -1] = _FAR
                after = ids[every, np.minimum(i + 1, width - 1)]
                ranks[every, i] = np.where(after >= 0, self._rank_of(ids[every, i], np.maximum(after, 0)), _FAR)
                left = every[i > 0]
                ranks[left, i[left] - 1] = self._rank_of(ids[left, i[left] - 1], ids[left, i[left]])
        if not words:
            return Ragged()
        out = Ragged(np.concatenate(flat), np.concatenate(counts))
        return out.take(np.argsort(np.concatenate(places), kind="stable"))

    def pieces_of(self, chunks: list[str]) -> Ragged:
        """The ids of each chunk, a chunk being what stands between blanks."""
        split = list(map(self.words_of, chunks))
        index: dict[str, int] = {}
        flat = [index.setdefault(w, len(index)) for own in split for w in own]
        words = list(index)
        known = [self.special.get(w) for w in words] if any(w in index for w in self.special) else None
        ids = self.merge_all([w.encode() for w in words])
        ids = ids.take(np.array(flat, np.int64))
        if known:  # a special token is itself
            ids = Ragged.of([[known[w]] if known[w] is not None else ids.row(k) for k, w in enumerate(flat)])
        return ids.join(np.fromiter(map(len, split), np.int64, len(split)))

    def encode_arrow(self, texts: pa.Array) -> Ragged:
        """The ids of each text.  Chunks are told apart by their bytes: a hash only sorts them."""
        words = Words(texts)
        seen, first, place = np.unique(words.hash, return_index=True, return_inverse=True)
        first, place = exact_groups(words.data, words.start, words.end, first, place.reshape(-1))
        raw = words.data.tobytes()
        chunks = [raw[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist())]
        at = np.array([self.index.get(c, -1) for c in chunks], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            if self.held > CACHE:
                self.index, self.known, self.held = {}, Ragged(), 0
                new = np.arange(len(at))
            at[new] = np.arange(len(new)) + len(self.known)
            fresh = [chunks[k] for k in new.tolist()]
            ids = self.pieces_of([c.decode() for c in fresh])
            self.known = self.known.plus(ids)
            self.index.update(zip(fresh, at[new].tolist()))
            self.held += sum(map(len, fresh)) + _ENTRY * len(fresh) + 4 * len(ids.flat)
        return self.known.take(at[place]).join(np.diff(words.first))

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.rank.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[r], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (s := get(ids[x] << 20 | ids[y], _NONE)) != _NONE:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            # letter by letter: a capital sigma has one form wherever it stands
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if _NEWER.search(text):
                text = text.translate(_NEWER_LOWER)
        text = text.lower()
        if text.isalpha():
            return [text]
        # letters of later versions are all beyond the Latin ones
        return self.late_split(text) if max(text, default="") > "\u0300" and self.late(text) else self.split(text)

    def words_of(self, text: str) -> list[str]:
        """The words to merge; a special token stands as itself."""
        if "<" in text and self.specials and self.specials.search(text):
            return [w for k, part in enumerate(self.specials.split(text)) for w in ([part] if k % 2 else self._words(part))]
        return self._words(text)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_arrow(pa.array([text], pa.string())).flat.tolist()

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by blanks."""
        return " ".join([self.token[i] for i in ids])

    def decode_all(self, ids: Ragged) -> list[memoryview]:
        """UTF-8 of each decoded row."""
        text = self._tokens.take(ids.flat)  # each token with a blank after it
        size = text.join(ids.count).count
        end = np.cumsum(size).tolist()
        raw = memoryview(text.flat.tobytes())
        return [raw[e - n:max(e - 1, e - n)] for e, n in zip(end, size.tolist())]


_loaded: dict[str, WordBPE] = {}


def load(name: str = VOCABULARY) -> WordBPE:
    path = vocabulary_path(name)
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for part in pieces(batch):
                ids = bpe.encode_arrow(col(part, "text"))
                rows = pa.ListArray.from_arrays(np.append(0, np.cumsum(ids.count)).astype(np.int32), pa.array(ids.flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([col(part, "doc_id"), rows], ["doc_id", "ids"])

    return mapped(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def token_digest(docs: DataFrame, vocabulary: str = VOCABULARY, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, n_tokens, ids_sha256, decoded_sha256."""
    kept = ["doc_id", *carry]
    names = [*kept, "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        sha = hashlib.sha256
        for batch in batches:
            for part in pieces(batch):
                ids = bpe.encode_arrow(col(part, "text"))
                raw = memoryview(ids.flat.astype("<u4").tobytes())
                end = np.cumsum(ids.count) * 4
                id_sha = [sha(raw[e - 4 * n:e]).hexdigest() for e, n in zip(end.tolist(), ids.count.tolist())]
                text_sha = [sha(t).hexdigest() for t in bpe.decode_all(ids)]
                yield pa.RecordBatch.from_arrays([*(col(part, c) for c in kept), pa.array(ids.count, pa.int64()), pa.array(id_sha, pa.string()), pa.array(text_sha, pa.string())], names)

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return mapped(docs.select(*kept, "text"), run, f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string")
