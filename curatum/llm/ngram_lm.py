"""Language-model scoring with Elias-Fano n-gram tries.

The model is a trigram model over words plus an end token, each order mixed with the next
lower one:

    p(w | t u) = (1 - b3(c(t u))) * c(t u w) / c(t u) + b3(c(t u)) * p(w | u)
    p(w | u)   = (1 - b2(c(u))) * c(u w) / c(u) + b2(c(u)) * p(w)
    p(w)       = (1 - m) * c(w) / N for known words, m for the class of unknown ones

``m`` is the Good-Turing mass of words seen once. ``b(c) = discount * c ** (beta - 1)`` is what
absolute discounting takes, on average, from a context seen c times, if it has c ** beta
distinct successors; beta is chosen, for each order, so that all contexts of the training
texts together have as many successors as there are distinct n-grams. As b depends on the
context's count alone, every distribution sums to one (up to the rounding of counts above
2,048, half a percent at most), and as counts, counts of counts and numbers of n-grams are of
all training texts, a score depends on neither the layout of the files nor the chunks.

N-grams are spread over shards by hash, so that no frequent word or pair is one shard's burden.
Each shard holds, for pairs and for triples, a trie in compact memory-mapped levels: the contexts
(Elias-Fano), monotone pointers to their successors (Elias-Fano), the successors, named
relative to their context (Elias-Fano), and for each n-gram a code of its quantised log-frequency. A lookup
finds the context by successor search, then searches only that context's range. The division
by the context's count and the mixing happen at lookup: storing the mixed probabilities would need all
successors of a context in one shard. Words are 64-bit hashes. An n-gram is 28 bits of its context's hash
and 32 bits of a hash of word and context, so that two n-grams are taken for one another with
probability 2 ** -60, and 2 ** -32 if they share their context.
``Trie.dump`` and ``Trie.open`` write the levels to a file and map it.

Plan: texts are hashed once into chunks (word ids within the chunk, its distinct words);
chunks send their distinct words, pairs and triples to the shards, a shard merges all counts, builds
its tries, looks up each distinct n-gram once and answers with counts and codes; chunks join the
answers and sum scores by document. Nothing but a thousand totals passes the driver.

Messages grow in number with chunks times shards, so none is handled by itself: a chunk's keys
are coded in one go (Elias-Fano: whole low bytes, high parts in unary) and cut into messages by
offsets, and a shard decodes all its messages together. Shards are a power of two, so that each
holds as many high parts.

Defined cases: null and empty texts are the end token alone; a text's first word has the end
token as context and no triple; repeated rows are scored and
counted like any others; rows with a null doc_id are held out by no rule, so they are scored
but not learned; with no training text every probability is that of the unknown class.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .support import release_memory, store
from .tokens import mix, slices, text_bytes, word_hashes

_U = np.uint64
END = _U(0x7D0CBA5E9F3B1A65)
_BINS = 256
_LOW = _U(0xFFFFFFFF)

#: Counts of the codes 1, 2, ...: exact up to 2,048, then in steps of 1.1 %, up to 10 ** 13. Code 0 stands for none.
BOOK = np.append(np.arange(2049.0), np.round(2048 * 1.011 ** np.arange(1, 2040)))


def _squeeze(data: bytes) -> bytes:
    return struct.pack("<q", len(data)) + pa.compress(data, codec="zstd", asbytes=True)


def _expand(data: bytes) -> bytes:
    size = struct.unpack_from("<q", data)[0]
    return pa.decompress(memoryview(data)[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def pack(values: np.ndarray) -> bytes:
    """Unsigned values as compressed byte planes: high planes of small values cost nothing."""
    v = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    return bytes([width]) + _squeeze(v.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    width, planes = data[0], np.frombuffer(_expand(data[1:]), np.uint8)
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = planes.reshape(width, -1).T
    return out.reshape(-1).view("<u8")


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=_U(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=_U)


class EliasFano:
    """A monotone sequence in about 2 + log2(universe / n) bits a value, over one flat buffer."""

    def __init__(self, buffer):
        self.buffer = buffer
        self.n, self.low_bits, n_low, n_high = struct.unpack_from("<qqqq", buffer)
        self.low = np.frombuffer(buffer, np.uint8, n_low, 32)
        self._words = np.ndarray(n_low - 7, "<u8", buffer, 32, (1,))  # the eight bytes from each byte on
        high = np.frombuffer(buffer, np.uint8, n_high, 32 + n_low)
        zeros = np.flatnonzero(np.unpackbits(high, bitorder="little") == 0)
        ones_before = zeros - np.arange(len(zeros))
        self.bucket = np.concatenate(([0], np.minimum(ones_before, self.n)))  # first value whose high part is h
        self._mask = _U((1 << self.low_bits) - 1)

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> bytes:
        v, n = np.asarray(values, dtype=_U), len(values)
        bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        high = np.zeros(n + (max(universe, 1) >> bits) + 2, np.uint8)
        high[(v >> _U(bits)).astype(np.int64) + np.arange(n)] = 1
        low = np.unpackbits(v.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits]
        low_bytes = np.packbits(low.reshape(-1), bitorder="little").tobytes() + b"\0" * 9
        high_bytes = np.packbits(high, bitorder="little").tobytes()
        return struct.pack("<qqqq", n, bits, len(low_bytes), len(high_bytes)) + low_bytes + high_bytes

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), _U)
        at = i * self.low_bits
        byte, shift = at >> 3, (at & 7).astype(_U)
        word = self._words[byte] >> shift
        if self.low_bits > 56:
            word |= np.where(shift > 0, self.low[byte + 8].astype(_U) << ((_U(64) - shift) & _U(63)), _U(0))
        return word & self._mask

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions ``i``."""
        high = np.searchsorted(self.bucket, i, side="right") - 1
        return (high.astype(_U) << _U(self.low_bits)) | self._low_at(i)

    def successor(self, x: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position in [start, stop) of the first value >= x with x's high part, and whether it equals x."""
        high = np.minimum((x >> _U(self.low_bits)).astype(np.int64), len(self.bucket) - 2)
        lo, hi = np.maximum(self.bucket[high], start), np.minimum(self.bucket[high + 1], stop)
        end, want = hi.copy(), x & self._mask
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            mid = (lo[live] + hi[live]) >> 1
            less = self._low_at(mid) < want[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
        found = np.zeros(len(x), bool)
        inside = np.flatnonzero(lo < end)
        found[inside] = self._low_at(lo[inside]) == want[inside]
        return lo, found


class Trie:
    """Two trie levels: contexts, pointers, context-relative successors and codes, over one buffer."""

    def __init__(self, buffer):
        self.buffer = buffer
        sizes = struct.unpack_from("<qqqq", buffer)
        at, parts = 32, []
        for size in sizes:
            parts.append(memoryview(buffer)[at : at + size])
            at += size
        self.contexts, self.pointers, self.successors = (EliasFano(p) for p in parts[:3])
        self.codes = np.frombuffer(parts[3], "<u2")

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray) -> Trie:
        """``keys``: sorted distinct (context << 32 | word), 60 bits; ``counts``: their positive training counts."""
        context, word = keys >> _U(32), keys & _LOW
        names, first = np.unique(context, return_index=True)
        rank = np.repeat(np.arange(len(names), dtype=_U), np.diff(np.append(first, len(keys))))
        edges = np.sqrt(BOOK[1:-1] * BOOK[2:])
        codes = (np.searchsorted(edges, counts) + 1).astype("<u2")
        parts = [
            EliasFano.encode(names, 1 << 28), EliasFano.encode(np.append(first, len(keys)).astype(_U), len(keys) + 1),
            EliasFano.encode((rank << _U(32)) | word, max(1, len(names)) << 32), codes.tobytes(),
        ]
        mapped = mmap.mmap(-1, 32 + sum(map(len, parts)))
        mapped.write(struct.pack("<qqqq", *map(len, parts)))
        for part in parts:
            mapped.write(part)
        return cls(mapped)

    def dump(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.buffer)

    @classmethod
    def open(cls, path: str) -> Trie:
        return cls(np.memmap(path, np.uint8, "r"))

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Code of each key, 0 where the trie has none."""
        n, zero = len(keys), np.zeros(len(keys), np.int64)
        if not len(self.codes) or not n:
            return np.zeros(n, "<u2")
        at, known = self.contexts.successor(keys >> _U(32), zero, np.full(n, self.contexts.n))
        at = np.where(known, at, 0)
        start, stop = self.pointers.get(at).astype(np.int64), self.pointers.get(at + 1).astype(np.int64)
        place, found = self.successors.successor((at.astype(_U) << _U(32)) | (keys & _LOW), start, stop)
        hit = known & found
        return np.where(hit, self.codes[np.where(hit, place, 0)], 0).astype("<u2")


def _before(stream: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token before each token, the end token before a text's first."""
    out = np.empty_like(stream)
    out[1:] = stream[:-1]
    out[first] = END
    return out


def n_grams(stream: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pair and of the triple that end at each token; a text's first token has no triple (0).

    A key is (relative successor << 28 | context): in this order shards are ranges of keys, so that
    sorted keys of a shard lie close together, and a context's successors still go to all shards.
    """
    u = _before(stream, first)
    with np.errstate(over="ignore"):
        pairs = _key(mix(u), mix(u * _U(0xA24BAED4963EE407) + stream))
        context = mix(_before(u, first) * _U(0x9FB21C651E98DF25) + mix(u))
        triples = _key(context, mix(context * _U(0xD6E8FEB86659FD93) + stream))
    triples[first] = 0
    return pairs, triples


def _key(context: np.ndarray, successor: np.ndarray) -> np.ndarray:
    return (successor >> _U(32) << _U(28)) | (context >> _U(36))


def _by_context(keys: np.ndarray) -> np.ndarray:
    """(context << 32 | relative successor), as the tries hold them."""
    return ((keys & _U((1 << 28) - 1)) << _U(32)) | (keys >> _U(28))


def _firsts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _bounds(keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Where the shards, equal ranges of the ``bits``-bit key space, begin and end in sorted ``keys``."""
    edges = np.arange(1, shards, dtype=_U) << _U(bits - shards.bit_length() + 1)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def _run(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of ``sizes``, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - _firsts(sizes), sizes)


def code_groups(values: np.ndarray, sizes: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned ``values``, those of each message from a new byte on, in groups of ``unit`` bits (2 or 4): the
    highest bit says that the value goes on, the others hold it, lowest first. Also the bytes of each message."""
    values, bits, a_byte = np.asarray(values, dtype=np.int64), unit - 1, 8 // unit
    groups, long, j = np.ones(len(values), np.int8), np.flatnonzero(values >> bits), 1
    while len(long):
        groups[long] += 1
        j += 1
        long = long[values[long] >> (j * bits) > 0]
    ends = np.append(0, np.cumsum(groups, dtype=np.int64))
    edges = np.append(0, np.cumsum(sizes))
    n_bytes = -(-np.diff(ends[edges]) // a_byte)
    start = ends[:-1] + np.repeat(_firsts(n_bytes) * a_byte - ends[edges[:-1]], sizes)
    out = np.zeros(int(n_bytes.sum()) * a_byte, np.uint8)
    out[start] = values.astype(np.uint8) & ((1 << bits) - 1) | (groups > 1).view(np.uint8) << bits
    live, j = np.flatnonzero(groups > 1), 1
    while len(live):
        more = groups[live] > j + 1
        out[start[live] + j] = (values[live] >> (j * bits)) & ((1 << bits) - 1) | (more << bits)
        live, j = live[more], j + 1
    data = out[0::a_byte].copy()
    for i in range(1, a_byte):
        data |= out[i::a_byte] << (i * unit)
    return data, n_bytes


def decode_groups(data: np.ndarray, n_bytes: np.ndarray, sizes: np.ndarray, unit: int) -> np.ndarray:
    """The values of ``code_groups``."""
    bits, a_byte = unit - 1, 8 // unit
    groups = np.empty(len(data) * a_byte, np.uint8)
    for i in range(a_byte):
        groups[i::a_byte] = (data >> (i * unit)) & ((1 << unit) - 1)
    last = np.flatnonzero(groups < 1 << bits)
    first = np.append(0, last + 1)[:-1]
    own = _run(np.searchsorted(last, _firsts(n_bytes) * a_byte), sizes)  # not what fills up a message's last byte
    first, last = first[own], last[own]
    groups &= (1 << bits) - 1
    out, live, j = groups[first].astype(np.int64), np.flatnonzero(first < last), 1
    while len(live):
        out[live] |= groups[first[live] + j].astype(np.int64) << (j * bits)
        live, j = live[first[live] + j < last[live]], j + 1
    return out


#: Bits of the keys of words, pairs and triples.
_BITS = (64, 60, 60)


def low_bytes(bits: int, n: float, shards: int) -> int:
    """Whole low bytes that make n keys of ``bits`` bits shortest, with as many high parts as shards at least."""
    return min((x for x in range(1, 8) if bits - 8 * x >= shards.bit_length() - 1), key=lambda x: 8 * x * n + (1 << bits - 8 * x))


def code_keys(kinds: list[np.ndarray], lows: tuple[int, ...], shards: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Sorted distinct keys of each kind as messages to ``shards``: keys by shard and kind, low bytes of each
    kind, high parts of all kinds in unary, and the bytes of each shard's high parts."""
    at = [_bounds(keys, shards, bits) for keys, bits in zip(kinds, _BITS, strict=True)]
    sizes = np.stack([np.diff(a) for a in at], axis=1)
    buckets = np.array([(1 << bits - 8 * x) // shards for bits, x in zip(_BITS, lows, strict=True)])
    n_bytes = -(-(sizes + buckets).sum(axis=1) // 8)
    high, low, start = np.zeros(8 * int(n_bytes.sum()), np.uint8), [], 8 * _firsts(n_bytes)
    for i, (keys, x) in enumerate(zip(kinds, lows, strict=True)):
        bucket = (keys >> _U(8 * x)).astype(np.int64)
        high[bucket + np.arange(len(keys)) + np.repeat(start - np.arange(shards) * buckets[i] - at[i][:-1], sizes[:, i])] = 1
        start = start + sizes[:, i] + buckets[i]
        low.append(np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :x]).reshape(-1))
    return sizes, low, np.packbits(high, bitorder="little"), n_bytes


def decode_keys(shard: int, sizes: np.ndarray, low: list[np.ndarray], high: np.ndarray, n_bytes: np.ndarray, lows: tuple[int, ...], shards: int) -> list[np.ndarray]:
    """The keys of each kind in a shard's messages, one message after the other."""
    buckets = np.array([(1 << bits - 8 * x) // shards for bits, x in zip(_BITS, lows, strict=True)])
    within = sizes + buckets
    start = (8 * _firsts(n_bytes))[:, None] + np.cumsum(within, axis=1) - within
    ones = np.flatnonzero(np.unpackbits(high, bitorder="little"))
    bucket = ones - _run(start.reshape(-1), sizes.reshape(-1))
    kind, out = by_kind(sizes), []
    for i, x in enumerate(lows):
        keys = np.zeros((int(sizes[:, i].sum()), 8), np.uint8)
        keys[:, :x] = low[i].reshape(-1, x)
        out.append(keys.reshape(-1).view("<u8") | ((bucket[kind == i] + shard * int(buckets[i])).astype(_U) << _U(8 * x)))
    return out


def by_kind(sizes: np.ndarray) -> np.ndarray:
    """The kind of each key in messages of ``sizes``."""
    return np.repeat(np.tile(np.arange(sizes.shape[1], dtype=np.int8), len(sizes)), sizes.reshape(-1))


def _cut(data: np.ndarray, n_bytes: np.ndarray) -> pa.Array:
    """A binary value of each of ``n_bytes``."""
    return pa.Array.from_buffers(pa.binary(), len(n_bytes), [None, pa.py_buffer(np.append(0, np.cumsum(n_bytes)).astype("<i4")), pa.py_buffer(data)])


def _joined(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and how many each of its values has."""
    data, edges = [], []
    for part in column.chunks:
        offsets = np.frombuffer(part.buffers()[1], "<i4", len(part) + 1, 4 * part.offset)
        data.append(np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]])
        edges.append(np.diff(offsets).astype(np.int64))
    return (np.concatenate(data), np.concatenate(edges)) if data else (np.zeros(0, np.uint8), np.zeros(0, np.int64))


_CHUNK = "chunk long, ids array<long>, train binary, lengths binary, words binary, stream binary, n_tokens long, n_words long"


def _chunker(chunk_words: int):
    def cut(batches):
        from pyspark import TaskContext

        task, serial, size = TaskContext.get().partitionId(), 0, 0
        held: list = []

        def flush():
            nonlocal held, size, serial
            ids = [i for h in held for i in h[0]]
            train = np.concatenate([h[1] for h in held])
            words, lengths = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]) + 1
            last = np.cumsum(lengths) - 1
            stream = np.empty(int(lengths.sum()), _U)
            body = np.ones(len(stream), bool)
            body[last] = False
            stream[body], stream[last] = words, END
            names, index = np.unique(stream, return_inverse=True)
            out = pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | serial]), pa.array([ids], pa.list_(pa.int64())), pa.array([np.packbits(train).tobytes()]), pa.array([pack(lengths)]), pa.array([pack_sorted(names)]), pa.array([pack(index)]), pa.array([len(stream)]), pa.array([len(names)])],
                names=["chunk", "ids", "train", "lengths", "words", "stream", "n_tokens", "n_words"],
            )
            serial, held, size = serial + 1, [], 0
            release_memory()
            return out

        for batch in (part for whole in batches for part in slices(whole, 2)):
            words, counts = word_hashes(text_bytes(batch.column(2)))
            held.append((batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), bool), words, counts))
            size += len(words) + len(counts)
            if size >= chunk_words:
                yield flush()
        if held:
            yield flush()

    return cut


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct words, their places in its stream, and the lengths of its texts."""
    return unpack_sorted(row["words"]), unpack(row["stream"]).astype(np.int64), unpack(row["lengths"]).astype(np.int64)


_SENT = ("words", "pairs", "triples", "high", "counts")


def _sender(shards: int, lows: tuple[int, ...]):
    """Each chunk's distinct words, pairs and triples with training counts, one row per shard."""

    def message(row: dict) -> pa.RecordBatch:
        names, index, lengths = _opened(row)
        learned = np.repeat(np.unpackbits(np.frombuffer(row["train"], np.uint8))[: len(lengths)], lengths)
        kinds, times = [names], [np.bincount(index[learned > 0], minlength=len(names))]
        for keys in n_grams(names[index], _firsts(lengths)):
            both = np.sort(keys << _U(1) | learned)
            keys = both >> _U(1)
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            kinds.append(keys[first])
            times.append(np.add.reduceat((both & _U(1)).astype(np.int64), first))
        sizes, low, high, n_bytes = code_keys(kinds, lows, shards)
        kind, counts = by_kind(sizes), np.zeros(int(sizes.sum()), np.int64)
        for i, x in enumerate(times):
            counts[kind == i] = x
        columns = [*(_cut(x, sizes[:, i] * lows[i]) for i, x in enumerate(low)), _cut(high, n_bytes), _cut(*code_groups(counts, sizes.sum(axis=1), 2))]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(shards, dtype=np.int32)), pa.array(np.full(shards, row["chunk"], np.int64)), *columns], names=["shard", "chunk", *_SENT])

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield message(batch.slice(i, 1).to_pylist()[0])
                release_memory()

    return send


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sums of their counts, and which of them each key is."""
    distinct, which = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.int64), which


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    """By class of count (exact up to 64, then eight to a doubling): how many have it, and their sum."""
    kind = np.where(counts <= 64, counts, 64 + np.floor(8 * np.log2(np.maximum(counts, 1) / 64))).astype(int)
    return [*np.bincount(kind, minlength=_BINS)[:_BINS].tolist(), *np.bincount(kind, weights=counts, minlength=_BINS)[:_BINS].astype(int).tolist()]


def _answerer(shards: int, lows: tuple[int, ...]):
    """One shard: merge the counts, build the tries, answer each chunk's words, pairs and triples."""

    def answer(sent: pa.Table) -> pa.Table:
        shard = sent.column("shard")[0].as_py()
        (*low, high, counts), n_bytes = zip(*(_joined(sent.column(x)) for x in _SENT), strict=True)
        sizes = np.stack([n // x for n, x in zip(n_bytes, lows, strict=False)], axis=1)
        keys = decode_keys(shard, sizes, low, high, n_bytes[3], lows, shards)
        kind, times = by_kind(sizes), decode_groups(counts, n_bytes[4], sizes.sum(axis=1), 2)
        out, stats, classes = np.zeros(len(kind), np.int64), [], []
        for i in range(3):
            distinct, total, which = _merged(keys[i], times[kind == i])
            keys[i] = None
            count = total[(total > 0) & (distinct != 0) if i else total > 0]
            if i:
                names = _by_context(distinct)
                order = np.argsort(names)  # contexts in order are found faster
                names, found = names[order], total[order]
                seen = (found > 0) & (names != 0)
                found[order] = Trie.build(names[seen], found[seen]).lookup(names)
                stats.append(len(count))
            else:
                found = total
                stats += [int(count.sum()), len(count), int((count == 1).sum())]
            if i < 2:
                classes += _counts_of_counts(count)
            out[kind == i] = found[which]
        stats = [*stats[:4], *classes, stats[4]]
        data = _cut(*code_groups(out, sizes.sum(axis=1), 4))
        release_memory()
        first = [stats] + [None] * (len(sizes) - 1)
        return pa.table({"chunk": sent.column("chunk"), "shard": sent.column("shard"), "codes": data, "stats": pa.array(first, pa.list_(pa.int64()))})

    return answer


def successor_power(numbers: list[int], sums: list[int], distinct: int) -> float:
    """beta in [0, 1] for which contexts with these counts of counts have ``distinct`` successors, c ** beta each."""
    low, high = 0.0, 1.0
    for _ in range(60):
        beta = (low + high) / 2
        total = sum(n * (c / n) ** beta for n, c in zip(numbers, sums, strict=True) if n)
        low, high = (beta, high) if total < distinct else (low, beta)
    return (low + high) / 2


def _scorer(shards: int, n: int, v: int, once: int, beta2: float, beta3: float, discount: float):
    unknown = max(once, 1) / (max(n, 1) + 1)

    def mixed(seen: np.ndarray, context: np.ndarray, beta: float, lower: np.ndarray) -> np.ndarray:
        c = np.maximum(context, 1)
        back = np.where(context > 0, discount * c ** (beta - 1), 1.0)
        return (1 - back) * np.minimum(seen / c, 1.0) + back * lower

    def scored(row: dict, right: pa.Table) -> pa.Table:
        names, index, lengths = _opened(row)
        first = _firsts(lengths)
        pairs, triples = (np.unique(keys, return_inverse=True) for keys in n_grams(names[index], first))
        sizes = np.stack([np.diff(_bounds(keys, shards, bits)) for keys, bits in zip((names, pairs[0], triples[0]), _BITS, strict=True)], axis=1)
        kind, codes = by_kind(sizes), decode_groups(*_joined(right.take(np.argsort(right.column("shard"))).column("codes")), sizes.sum(axis=1), 4)
        count = codes[kind == 0]
        c_w, c_uw, c_tuw = count[index], BOOK[codes[kind == 1]][pairs[1]], BOOK[codes[kind == 2]][triples[1]]
        c_u, c_tu = np.append(0, c_w[:-1]), np.append(0, c_uw[:-1])
        c_u[first] = count[np.searchsorted(names, END)]
        p = np.where(c_w > 0, (1 - unknown) * c_w / max(n, 1), unknown)
        p = mixed(c_uw, c_u, beta2, p)
        c_tu[first] = 0
        p = mixed(c_tuw, c_tu, beta3, p)
        base = np.log10((c_w + 1) / (n + v + 1))
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_tokens": lengths, "n_known": np.add.reduceat((c_w > 0).astype(np.int64), first), "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(np.log10(p), first)})

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.concat_tables(scored(row, right) for row in left.to_pylist())
        release_memory()
        return out

    return score


def lm_score(docs: DataFrame, held_out, *, chunk_words: int = 1_000_000, shard_tokens: int = 1_000_000, discount: float = 0.8) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text) by the model of the rows where ``held_out`` is false.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and
    score (this model), both log10. ``chunk_words`` bounds what a task holds of the corpus at
    once, ``shard_tokens`` the corpus tokens per trie shard.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(~held_out, F.lit(False)).alias("train"), F.col("text").cast("string").alias("text"))
    chunks = store(slim.mapInArrow(_chunker(chunk_words), _CHUNK))
    total, a_chunk, names = chunks.agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum("n_tokens"), F.avg("n_tokens"), F.avg("n_words")))).first()
    shards = 1 << (max(4, -(-total // shard_tokens)) - 1).bit_length()
    lows = tuple(low_bytes(bits, x, shards) for bits, x in zip(_BITS, (names, a_chunk, a_chunk), strict=True))
    sent = chunks.select("chunk", "train", "lengths", "words", "stream").mapInArrow(_sender(shards, lows), f"shard int, chunk long, {', '.join(f'{x} binary' for x in _SENT)}")
    answers = store(sent.groupBy("shard").applyInArrow(_answerer(shards, lows), "chunk long, shard int, codes binary, stats array<long>"))
    totals = {r.pos: r.x for r in answers.select(F.posexplode("stats").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x")).collect()}
    n, v, once, n_pairs, *rest = (totals.get(i, 0) for i in range(5 + 4 * _BINS))
    *classes, n_triples = rest
    one, one_sum, two, two_sum = (classes[i * _BINS : (i + 1) * _BINS] for i in range(4))
    score = _scorer(shards, n, v, once, successor_power(one, one_sum, n_pairs), successor_power(two, two_sum, n_triples), discount)
    scored = chunks.select("chunk", "ids", "lengths", "words", "stream").groupBy("chunk").cogroup(answers.drop("stats").groupBy("chunk")).applyInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
