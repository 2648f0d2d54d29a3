"""The conversation trie against a plain one, with few and many shards."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from curatum.llm import prefixtrie
from curatum.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node long"


def brute(rows, turn_key):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), turn_key(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(base, [])[:h]) + tuple(turns[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(below[k][1] for k in kids[p])
        below[p] = (sum(below[k][0] for k in kids[p]) or 1, saved)
    ends = lambda p: ",".join(str(c) for c in sorted(members[p]) if paths[c] == p)
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *below[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items()), key=repr)


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}:{text}".encode()).digest()


@pytest.fixture(scope="module")
def rows():
    """Nulls, ties, repeated rows, negative and absent ids, hundreds of copies, one long conversation, no own turns left."""
    rng = random.Random(2)
    out = []
    for c in rng.sample(range(-500, 3000), 900):
        lines = ["a", "b", "ab", "é𝄞", "", None]
        for t in range(rng.choice([1, 2, 2, 3, 7])):
            out.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(lines)))
    for c in range(5000, 5600):
        out += [(c, 0, "user", "hot"), (c, 1, "assistant", "copy"), (c, 2, "user", "x"), (c, 3, "user", "x"), (c, 4, "user", "y"), (c, 5, "user", "z")]
    out += [(7001, t, "user", f"turn {t % 9}") for t in range(700)] + [(7002, t, "user", f"turn {t % 9}") for t in range(690)]
    out += [(8001, None, "user", "first"), (8001, 1, "b", "tie"), (8001, 1, "a", "tie"), (8001, 1, "a", "tie"), (None, 0, "user", "lost"), (8002, 5, None, None)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_nodes_equal_brute_force(spark, rows, partitions, monkeypatch):
    monkeypatch.setattr(prefixtrie, "_BLOCK_IDS", 50)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
        got = prefixtrie.prefix_trie(table).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got), key=repr) == brute(rows, digest)


def test_short_splitters_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(prefixtrie, "KEY_BYTES", 1)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows[:1500]], SCHEMA)
    assert sorted(map(tuple, prefixtrie.prefix_trie(table).collect()), key=repr) == brute(rows[:1500], digest)


def test_copies_are_split_over_shards(spark, rows):
    table = prefixtrie.paths(prefixtrie.rebuilt(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))).cache()
    cuts = prefixtrie.splitters(table, 20)
    keys = sorted((bytes(r["path"]), r["conv_id"]) for r in table.collect())
    sizes = [sum(a <= k < b for k in keys) for a, b in zip([(b"", -(2**63)), *cuts], [*cuts, (b"\xff" * 32, 0)], strict=True)]
    assert sum(sizes) == len(keys) and max(sizes) < 3 * len(keys) / 20


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefixtrie.prefix_trie(empty).collect() == []
    only_null = spark.createDataFrame([(None, 0, "user", "x", "", 0)], SCHEMA)
    assert prefixtrie.prefix_trie(only_null).collect() == []


def test_oracle(spark, rows):
    import duckdb

    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows[:1200])
    assert sorted(con.execute(ORACLES["op11_conversation_trie"]).fetchall(), key=repr) == brute(rows[:1200], digest)


def test_registered(spark, sf):
    conversations = spark.read.parquet(f"{sf}/conversations.parquet")
    got = QUERIES["op11_conversation_trie"](spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == brute([tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()], digest)
