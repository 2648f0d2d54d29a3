"""Byte-pair encoding and decoding with a contiguous rank array.

A word's parts and the ranks of its adjacent pairs lie in contiguous arrays. The minimum rank
is searched by scanning, its boundary is deleted by closing the gap, and the two neighbouring
ranks are refreshed, until no pair has a rank. Short words of a batch are handled side by
side as rows of one numpy array; words over ``SHORT`` bytes, where scanning is quadratic, use
a heap over linked parts with the same merge order. Each distinct word is encoded once per
worker while it stays in a bounded cache.

The tokenizer file is read on the driver from a path parameter and sent to tasks by broadcast
(its size is fixed by the vocabulary, about 2 MB).

Defined cases: null is the empty text, with no tokens; special tokens of the file found in a
text are single ids, as in the library; repeated rows are encoded alike; a table without rows
gives one without rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SHORT = 48
_NONE = np.int32((1 << 31) - 1)
#: Words in each of the two generations of the cache.
_CACHE_WORDS = 100_000
#: Fixed value: the split pattern of the public byte-level BPE tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + i)
    return letters


class Vocabulary:
    """Merges and token bytes of a byte-level BPE file (tokenizers JSON)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        byte_of = {c: b for b, c in _byte_letters().items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in byte_of.items():
            self.of_byte[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made.astype(np.int32)
        self.of_bytes = self.pair(self.of_byte[:, None], self.of_byte[None, :])
        self.names = list(map(str, range(size)))
        self.table = None

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, ``_NONE`` without a merge; ``made`` has the token a rank makes."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word; words of like length form the rows of one array."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(sizes > SHORT):
            out[i] = self._encode_long(words[i])
        for low, high in ((0, 6), (6, 9), (9, 12), (12, 18), (18, SHORT)):
            own = np.flatnonzero((sizes > low) & (sizes <= high))
            for at in range(0, len(own), 10_000):
                some = own[at : at + 10_000]
                raw = np.frombuffer(b"".join([words[i].ljust(high, b"\0") for i in some]), np.uint8).reshape(len(some), high)
                for i, ids in zip(some, self._encode_rows(raw, sizes[some]), strict=True):
                    out[i] = ids
        return out

    def _encode_rows(self, raw: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
        """Token ids of the words in the rows of ``raw``, of which the first ``sizes`` bytes count."""
        n, width = raw.shape
        done, live = [None] * n, np.arange(n)
        parts = self.of_byte[raw].astype(np.int32)
        ranks = np.full((n, width), _NONE)
        ranks[:, :-1] = self.of_bytes[raw[:, :-1], raw[:, 1:]]
        ranks[np.arange(width)[None, :] >= sizes[:, None] - 1] = _NONE
        while len(live):
            at = ranks.argmin(1)
            least = ranks[np.arange(len(live)), at]
            more = least < _NONE
            over = np.flatnonzero(~more)
            for i, ids, size in zip(live[over].tolist(), parts[over].tolist(), sizes[over].tolist(), strict=True):
                done[i] = ids[:size]
            live, parts, ranks, at, sizes = live[more], parts[more], ranks[more], at[more], sizes[more] - 1
            row = np.arange(len(live))
            width -= 1
            behind = np.arange(width)[None, :] > at[:, None]  # close the gap behind the merged part
            parts = np.where(behind, parts[:, 1:], parts[:, :-1])
            ranks = np.where(behind, ranks[:, 1:], ranks[:, :-1])
            parts[row, at] = self.made[least[more]]
            ranks[row, at] = _NONE
            # refresh the ranks on both sides of the new part
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < sizes - 1)
            r, i = np.concatenate((left, right)), np.concatenate((at[left] - 1, at[right]))
            ranks[r, i] = self.pair(parts[r, i], parts[r, i + 1])
        return done

    def _encode_long(self, word: bytes) -> list[int]:
        if self.table is None:
            self.table = {k: (r, m) for k, r, m in zip(self.keys.tolist(), self.rank.tolist(), self.made[self.rank].tolist(), strict=True)}
        parts = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            if 0 <= i and after[i] < len(parts) and (x := self.table.get(parts[i] << 20 | parts[after[i]])):
                heapq.heappush(heap, (x[0], i, parts[i], parts[after[i]]))

        for i in range(len(parts) - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = self.table[a << 20 | b][1], None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            push(i)
            push(before[i])
        return [p for p in parts if p is not None]


class Encoder:
    """Whole texts to ids and back, with a cache of encoded words."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.v = vocabulary
        self.words = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")").split if vocabulary.special else None
        self.ids: dict[str, str] = {}
        self.back: dict[str, bytes] = {}
        self.old: tuple[dict[str, str], dict[str, bytes]] = {}, {}

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text; special tokens stand alone."""
        if self.split and any(s in text for s in self.v.special):
            return [w for i, part in enumerate(self.split(text)) for w in ([part] if i % 2 else self.words(part))]
        return self.words(text)

    def learn(self, words: set[str]) -> None:
        """Make ``ids`` and ``back`` hold all of ``words``.

        The cache has two generations: once the young one is full it becomes the old one, whose
        words return as they are met again, so frequent words stay and rare ones leave.
        """
        if len(self.ids) >= _CACHE_WORDS:
            self.old, self.ids, self.back = (self.ids, self.back), {}, {}
        new = words.difference(self.ids)
        ids_of, back_of = self.old
        for w in new.intersection(ids_of):
            self.ids[w], self.back[w] = ids_of[w], back_of[w]
        new = list(new.difference(ids_of))
        for w in filter(self.v.special.__contains__, new):
            self.ids[w], self.back[w] = str(self.v.special[w]), self.decode([self.v.special[w]])
        new = [w for w in new if w not in self.v.special]
        name = self.v.names.__getitem__
        for w, ids in zip(new, self.v.encode_words([w.encode() for w in new]), strict=True):
            self.ids[w], self.back[w] = ",".join(map(name, ids)), self.decode(ids)

    def forget(self) -> None:
        """Free the words at the end of a task: the worker process stays and serves other stages."""
        self.ids, self.back, self.old = {}, {}, ({}, {})
        pa.default_memory_pool().release_unused()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.v.bytes[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        words = self.pieces(text)
        self.learn(set(words))
        return [int(i) for w in words for i in self.ids[w].split(",")]


_workers: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    key = hash(shared.value)
    if key not in _workers:
        _workers[key] = Encoder(Vocabulary(shared.value))
    return _workers[key]


def _texts(column: pa.Array, limit: int = 1 << 20):
    """Slices of a string column of about ``limit`` characters, at least one text each."""
    texts, size = [], 0
    for x in column:
        texts.append(x.as_py() or "")
        size += len(texts[-1])
        if size >= limit:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def _broadcast(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids: the token ids of every whole text."""
    shared = _broadcast(docs, tokenizer_path)

    def run(batches):
        encoder = _encoder(shared)
        for batch in batches:
            at = 0
            for texts in _texts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(texts)], pa.array([encoder.encode(t) for t in texts], pa.list_(pa.int32()))], names=["doc_id", "ids"])
                at += len(texts)
        encoder.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text: ids back to texts; bytes that are no UTF-8 become U+FFFD."""
    shared = _broadcast(encoded, tokenizer_path)

    def run(batches):
        table = _encoder(shared).v.bytes
        for batch in batches:
            texts = [b"".join([table[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded word by word."""
    shared = _broadcast(docs, tokenizer_path)

    def run(batches):
        encoder = _encoder(shared)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            out = ([], [], [])
            for texts in _texts(batch.column(1)):
                split = [encoder.pieces(t) for t in texts]
                encoder.learn(set().union(*split))
                for words in split:
                    ids = ",".join(map(encoder.ids.__getitem__, words))
                    out[0].append(ids.count(",") + 1 if ids else 0)
                    out[1].append(sha(ids.encode()))
                    out[2].append(sha(b"".join(map(encoder.back.__getitem__, words)).decode("utf-8", "replace").encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        encoder.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
