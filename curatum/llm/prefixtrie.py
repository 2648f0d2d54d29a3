"""Prefix trie of conversations by range-partition splitters.

A conversation's path is the concatenation of the 16-byte digests of its turns (role, text), so
that a node of the trie is a prefix of paths and its members are neighbours in path order. A
bounded sample of (path, conv_id) keys gives the splitters of a range partitioning; equal paths
are split by conv_id, so no group of copies burdens one shard. The trie of the splitters' paths
is the skeleton and goes to all tasks: a node whose members lie in two shards is a prefix of
the splitter between them. Each sorted shard finishes all its other nodes alone, in
one pass with a stack; of skeleton nodes it hands on what it holds of them, which is reduced by
node. The reduced skeleton has at most one row a splitter turn, whatever the input.

The hash over the ids of a skeleton node's own members is taken over blocks of joined ids in
shard order, streamed; of other nodes inside their shard. Splitters decide who works, never what comes out.

Bounds: a conversation is one record: its digests (24 bytes a turn) are held by one task, while
a shard of about ``SHARD_TURNS`` turns (more beyond ``MOST_SHARDS`` shards) is streamed: its task holds one path,
and of a node that is not in the skeleton those children that are finished before it. Splitter keys together take at most ``KEY_BYTES``.

Defined cases: a null role or text is empty; turns of one number come in the order of their
digests; a null conv_id is no conversation; ``conv_id % 100`` has the sign of conv_id, as in SQL;
repeated rows are repeated turns; an empty table has no conversation and no node.
"""

from __future__ import annotations

import bisect
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .support import store

DIGEST = 16
SHARD_TURNS, MOST_SHARDS = 1 << 19, 1 << 16
KEY_BYTES = 1 << 26
_OVERSAMPLING = 16
_BLOCK_IDS = 1 << 15
_BATCH = 1 << 13

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: Finished nodes (``node`` null; ``parent`` is set where the parent is in the skeleton), a shard's
#: parts of skeleton nodes (``block`` null), and blocks of the ids of their own members.
_PART = f"{NODE}, parent binary, node binary, shard int, chars long, block int, ends string"


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs (turn, digest, chars)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary")))
    turn = F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.length(text).alias("chars"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame, group: int = 100, kinds: int = 6) -> DataFrame:
    """(conv_id, turns): the first h turns of the group's first conversation, then the own ones after the first h."""
    own = own_turns(conversations)
    heads = own.where(f"conv_id % {group} = 0").select(F.col("conv_id").alias("_head"), F.slice("turns", 1, kinds - 1).alias("_turns"))
    rows = own.withColumn("_h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % kinds).cast("int"))
    rows = rows.join(heads, F.col("conv_id") - F.col("conv_id") % group == F.col("_head"), "left")
    first = F.coalesce(F.slice("_turns", F.lit(1), F.col("_h")), F.array().cast(own.schema["turns"].dataType))
    return rows.select("conv_id", F.concat(first, F.slice("turns", F.col("_h") + 1, F.size("turns"))).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, chars) from (conv_id, turns)."""
    path = F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["digest"])), ""))
    return conversations.select("conv_id", path.alias("path"), F.transform("turns", lambda x: x["chars"]).alias("chars"))


def splitters(rows: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """At most ``shards`` keys (path, conv_id) that cut ``rows`` in parts of about as many rows.

    They are evenly spaced in the rows with the smallest hash of conv_id, a fixed number a shard. Paths are
    cut to the bytes that the bound leaves each key, which moves the splitter and nothing else.
    """
    longest = max(KEY_BYTES // shards // DIGEST, 1) * DIGEST
    sample = rows.orderBy(F.xxhash64("conv_id"), "conv_id").limit(shards * _OVERSAMPLING).select(F.substring("path", 1, longest).alias("path"), "conv_id")
    ranked = sample.withColumn("place", F.row_number().over(W.orderBy("path", "conv_id"))).where(F.col("place") % _OVERSAMPLING == 0)
    return sorted((bytes(r["path"]), r["conv_id"]) for r in ranked.select("path", "conv_id").collect())


def _below(node: bytes, digest: bytes) -> bytes:
    """Id of the node that ``digest`` leads to."""
    return hashlib.blake2b(node + digest, digest_size=DIGEST).digest()


def skeleton(cuts: list[tuple[bytes, int]]) -> set[bytes]:
    """Ids of all nodes on the paths of the splitters, the root included."""
    ids = {b""}
    for path, _ in cuts:
        node = b""
        for i in range(0, len(path), DIGEST):
            node = _below(node, path[i : i + DIGEST])
            ids.add(node)
    return ids


def _dealt(shared):
    def run(batches):
        cuts, _ = shared.value
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)
            shard = pa.array([bisect.bisect_right(cuts, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, shard], [*batch.schema.names, "shard"])

    return run


class _Node:
    """A node on the current path: its counts so far, and finished children that wait for its smallest member."""

    __slots__ = ("block", "chars", "children", "conv", "hash", "id", "leaves", "n", "pending", "saved", "waiting")

    def __init__(self, id: bytes | None, chars: int):
        self.id, self.chars, self.conv = id, chars, None  # id: of a skeleton node
        self.n = self.children = self.leaves = self.saved = self.block = 0
        self.hash, self.pending, self.waiting = None, [], []


class _Shard:
    """The trie of one sorted shard, whose finished rows are in ``rows``."""

    def __init__(self, number: int, ids: set[bytes]):
        self.number, self.ids, self.rows = number, ids, []
        self.path, self.stack = b"", [_Node(b"", 0)]

    def add(self, conv: int, path: bytes, chars: list[int]) -> None:
        same, most = 0, min(len(path), len(self.path))
        if path == self.path:
            same = most
        else:
            while same < most and path[same : same + DIGEST] == self.path[same : same + DIGEST]:
                same += DIGEST
        self._close(same // DIGEST + 1)
        for i in range(same // DIGEST, len(path) // DIGEST):
            above = self.stack[-1].id
            id = None if above is None else _below(above, path[i * DIGEST : (i + 1) * DIGEST])
            self.stack.append(_Node(id if id in self.ids else None, chars[i]))
        self.path, node = path, self.stack[-1]
        node.n += 1
        node.conv = conv if node.conv is None else min(node.conv, conv)
        node.pending.append(conv)
        if len(node.pending) == _BLOCK_IDS:
            self._hash(node)

    def end(self) -> list[tuple]:
        self._close(0)
        return self.rows

    def _hash(self, node: _Node) -> None:
        """The pending ids go into the node's hash, or on as a block where others have ids of the node too."""
        if node.pending:
            text = ",".join(map(str, node.pending))
            if node.id is not None:
                self.rows.append((None,) * 9 + (node.id, self.number, None, node.block, text))
                node.block += 1
            elif node.hash is None:
                node.hash = hashlib.sha256(text.encode())
            else:
                node.hash.update(f",{text}".encode())
            node.pending = []

    def _close(self, depth: int) -> None:
        """Finish the nodes at ``depth`` or deeper, the deepest first."""
        while len(self.stack) > depth:
            at, node = len(self.stack) - 1, self.stack.pop()
            above = self.stack[-1] if self.stack else None
            self._hash(node)
            if node.id is not None:
                self.rows.append((node.conv, at, None, node.n, node.children, node.leaves, node.saved, None, above and above.id, node.id, self.number, node.chars, None, None))
            else:
                leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.chars
                above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved
                row = (node.n, node.children, leaves, saved, (node.hash or hashlib.sha256()).hexdigest())
                if above.id is None:
                    above.waiting.append((node.conv, at, *row))
                else:
                    self.rows.append((node.conv, at, None, *row, above.id, None, self.number, None, None, None))
                self.rows += ((*x[:2], node.conv, *x[2:], None, None, self.number, None, None, None) for x in node.waiting)
            if above is not None:
                above.n += node.n
                above.conv = node.conv if above.conv is None else min(above.conv, node.conv)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def _batches(rows: list[tuple], schema: pa.Schema):
    for i in range(0, len(rows), _BATCH):
        columns = zip(*rows[i : i + _BATCH], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _built(shared):
    def run(batches):
        schema, ids, shard = _arrow(_PART), shared.value[1], None
        for batch in batches:
            for number, conv, path, chars in zip(*(batch.column(c).to_pylist() for c in ("shard", "conv_id", "path", "chars")), strict=True):
                if shard is None or shard.number != number:
                    if shard:
                        yield from _batches(shard.end(), schema)
                    shard = _Shard(number, ids)
                shard.add(conv, path, chars)
                if len(shard.rows) >= _BATCH:
                    yield from _batches(shard.rows, schema)
                    shard.rows = []
        if shard:
            yield from _batches(shard.end(), schema)

    return run


def _hashed(batches):
    """(node, ends_sha256) from blocks sorted by node, shard and block: one running hash, whatever the number of ids."""
    node = running = None
    for batch in batches:
        out = []
        for n, text in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if n == node:
                running.update(f",{text}".encode())
            else:
                if running:
                    out.append((node, running.hexdigest()))
                node, running = n, hashlib.sha256(text.encode())
        yield from _batches(out, _arrow("node binary, ends_sha256 string"))
    if running:
        yield from _batches([(node, running.hexdigest())], _arrow("node binary, ends_sha256 string"))


def _finished(batches):
    """The skeleton's nodes from their reduced parts: counts go from the deepest nodes upwards."""
    rows = {r["node"]: r for batch in batches for r in batch.to_pylist()}
    for r in sorted(rows.values(), key=lambda r: -r["depth"]):
        r["n_leaves"] = r["n_leaves"] or 1
        r["saved_tokens"] += (r["n_convs"] - 1) * r["chars"]
        r["ends_sha256"] = r["ends_sha256"] or hashlib.sha256().hexdigest()
        if above := rows.get(r["parent"]):
            r["parent_conv_id"] = above["conv_id"]
            above["n_children"] += 1
            above["n_leaves"] += r["n_leaves"]
            above["saved_tokens"] += r["saved_tokens"]
    schema = _arrow(f"{NODE}, node binary")
    yield from _batches([tuple(r.get(f) for f in schema.names) for r in rows.values()], schema)


def trie(rows: DataFrame) -> DataFrame:
    """All nodes of the prefix trie of ``rows`` (conv_id, path, chars), one row each."""
    spark = rows.sparkSession
    rows = store(rows)
    turns = rows.agg(F.sum(F.size("chars"))).first()[0] or 0
    shards = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS)), MOST_SHARDS)
    cuts = splitters(rows, shards)
    shared = spark.sparkContext.broadcast((cuts, skeleton(cuts)))
    dealt = rows.mapInArrow(_dealt(shared), "conv_id long, path binary, chars array<int>, shard int")
    dealt = dealt.repartitionById(shards + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
    parts = store(dealt.mapInArrow(_built(shared), _PART))
    blocks = parts.where("block is not null").select("node", "shard", "block", "ends")
    ends = blocks.repartition("node").sortWithinPartitions("node", "shard", "block").select("node", "ends").mapInArrow(_hashed, "node binary, ends_sha256 string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    reduced = parts.where("node is not null and block is null").groupBy("node").agg(F.first("parent").alias("parent"), F.max("depth").alias("depth"), F.max("chars").alias("chars"), F.min("conv_id").alias("conv_id"), *sums)
    bones = store(reduced.join(ends, "node", "left").repartition(1).mapInArrow(_finished, f"{NODE}, node binary"))
    names = [f.split()[0] for f in NODE.split(", ")]
    above = bones.select(F.col("node").alias("_node"), F.col("conv_id").alias("_conv"))
    local = parts.where("node is null").join(F.broadcast(above), F.col("parent") == F.col("_node"), "left")
    return local.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_conv")).select(names).unionByName(bones.select(names))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations."""
    return trie(paths(rebuilt(conversations)))


ORACLE = """
WITH rows AS (SELECT conv_id, turn, length(x) AS n, md5(length(r) || ':' || r || ':' || x) AS d FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
own AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos FROM rows),
ids AS MATERIALIZED (SELECT conv_id, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
    lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM own)),
rebuilt AS (SELECT i.conv_id, 0 AS part, o.pos, o.n, o.d FROM ids i JOIN own o ON o.conv_id = i.conv_id - i.conv_id % 100 AND o.pos <= i.h
  UNION ALL SELECT i.conv_id, 1, o.pos, o.n, o.d FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.pos > i.h),
prefix AS MATERIALIZED (SELECT conv_id, row_number() OVER w AS depth, n, md5(string_agg(d, '') OVER w) AS key FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
lengths AS (SELECT conv_id, max(depth) AS length FROM prefix GROUP BY conv_id),
nodes AS MATERIALIZED (SELECT p.depth, p.key, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(p.n) AS n, coalesce(string_agg(p.conv_id, ',' ORDER BY p.conv_id) FILTER (l.length = p.depth), '') AS ends
  FROM prefix p JOIN lengths l ON p.conv_id = l.conv_id GROUP BY p.depth, p.key),
parents AS (SELECT m.depth, m.key, p.key AS parent, q.conv_id AS parent_conv_id FROM nodes m JOIN prefix p ON p.conv_id = m.conv_id AND p.depth = m.depth - 1 JOIN nodes q ON q.depth = p.depth AND q.key = p.key),
kids AS (SELECT depth - 1 AS depth, parent AS key, count(*) AS n_children FROM parents GROUP BY 1, 2),
below AS (SELECT p.depth, p.key, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((m.n_convs - 1) * m.n) AS saved_tokens
  FROM nodes m LEFT JOIN kids k ON m.depth = k.depth AND m.key = k.key JOIN prefix p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY p.depth, p.key)
SELECT m.conv_id, m.depth, p.parent_conv_id, m.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM nodes m JOIN below b ON m.depth = b.depth AND m.key = b.key LEFT JOIN parents p ON m.depth = p.depth AND m.key = p.key LEFT JOIN kids k ON m.depth = k.depth AND m.key = k.key
"""
