"""Corpus operators against brute force, round trips and the installed tokenizer; edge cases of each."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curatum.llm import ann, bpe, linededup, matroska, minhash, mixing, ngram_lm, quality, quotes, wrapper
from curatum.llm.queries import ORACLES, QUERIES, tokenizer_path
from curatum.llm.tokens import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, _n long"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empties, ties, repeats, a long text, and columns with clashing names."""
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, long = text(120), text(30_000)
    near = base.split()
    near[50] = "changed"
    rows = [(0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, "two words"), (6, "Two  WORDS"), (7, long), (8, text(80)), (9, text(80) + "\n" + base), (None, base), (None, None), (10, " \n\t "), (8, text(10)), (11, "x"), (11, "x")]
    return spark.createDataFrame([(i, t, None, [None, "b", "a"][n % 3], None, "r", 1) for n, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(rows, k=5, percent=85):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    ids = sorted(i for i in sets if i is not None)
    group = {i: i for i in ids}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in ids:
        for b in ids:
            if b < a:
                for x in sets[a]:
                    for y in sets[b]:
                        if x and y and 100 * len(x & y) >= percent * len(x | y):
                            u, v = root(a), root(b)
                            group[max(u, v)] = min(u, v)
    return {i: root(i) for i in ids}


def test_word_hashes_follow_words():
    texts = ["A bc\tBC  é\x1cx", "", "  ", "bc"]
    flat, counts = word_hashes([t.encode() for t in texts], block_bytes=4)
    assert counts.tolist() == [len(words(t)) for t in texts]
    seen = [w for t in texts for w in words(t)]
    assert len(set(flat.tolist())) == len(set(seen)) and flat[1] == flat[2] == flat[-1]


def test_minhash_edge_cases(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = minhash.node_table(docs).collect()
    assert len(got) == len(rows)
    want = brute_components(rows)
    assert all(r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id == r.component_id) for r in got)
    clash = minhash.near_duplicates(docs.withColumn("kept", F.lit(1)).withColumn("node", F.lit(1)))
    assert clash.columns.count("kept") == 1 and clash.count() == len(rows)
    wide = minhash.near_duplicates(docs)
    assert wide.columns[: len(docs.columns)] == docs.columns and wide.count() == len(rows)
    assert minhash.node_table(empty).count() == 0


def test_minhash_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {r.doc_id: r.component_id for r in minhash.node_table(docs).collect()} == want


def test_minhash_links_left_open_by_stars(spark):
    """A chain of texts, each linked to its neighbours only, is one component."""
    base = ["w%d" % i for i in range(400)]
    rows = [(i, " ".join(["x%d" % j for j in range(20 * i)] + base[20 * i :])) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.node_table(df).collect()} == brute_components(rows)


def test_quality_accuracy_and_edges(spark, docs, empty):
    d, y = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality_scores(d, y).join(y, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    labels = spark.createDataFrame([(0, 1), (5, 0), (8, None), (9, 1)], "doc_id long, quality int")
    out = quality.quality_scores(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.score == 0.5 for r in quality.quality_scores(docs, labels.where("false")).collect())
    assert quality.quality_scores(empty, labels).count() == 0


def test_mixing_equals_oracle(spark, docs, empty):
    import duckdb

    con = duckdb.connect()
    for frame, name in ((spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "sf"), (docs, "edge"), (empty, "empty")):
        con.register("documents", frame.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
        got = sorted(map(repr, (tuple(r) for r in mixing.mix(frame).select("size", "source_size", "target", "taken").collect())))
        want = sorted(map(repr, (tuple(r) for r in con.execute(f"SELECT size, source_size, target, taken FROM ({ORACLES['op2_source_mixing']})").fetchall())))
        assert got == want, name
    rows = mixing.mix(docs).collect()
    assert sum(r.taken for r in rows) == sum(math.floor(t) for t in {r.source: r.target for r in rows}.values())
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert mixing.mixed_documents(docs).columns == docs.columns
    nameless = spark.createDataFrame([(None, f"w{i} " * (1 + i % 7), f"s{i % 3}", 1, 2) for i in range(900)], "doc_id long, text string, source string, copies int, cut int")
    targets = {r.source: r.target for r in mixing.mix(nameless).collect()}
    out = mixing.mixed_documents(nameless)
    assert out.columns == nameless.columns
    for r in out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect():
        assert targets[r.source] - 1 <= r.n <= targets[r.source] + 7


def brute_lm(rows, held, discount=0.8):
    """n_tokens, n_known, base and model score of each text, counted with plain dictionaries."""
    streams = [[*words(t), "</s>"] for _, t in rows]
    one, two, three = Counter(), Counter(), Counter()
    for (i, _), s in zip(rows, streams, strict=True):
        if not held(i):
            one.update(s)
            two.update(zip(["</s>", *s], s))
            three.update(zip(["</s>", *s], s, s[1:]))
    n, v, m = sum(one.values()), len(one), max(sum(c == 1 for c in one.values()), 1) / (max(sum(one.values()), 1) + 1)

    def beta(counts, distinct):
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(c**mid for c in counts) < distinct else (low, mid)
        return (low + high) / 2

    b2, b3 = beta(one.values(), len(two)), beta(two.values(), len(three))
    out = []
    for s in streams:
        score = 0.0
        for j, w in enumerate(s):
            u = s[j - 1] if j else "</s>"
            p = (1 - m) * one[w] / max(n, 1) if one[w] else m
            for seen, context, power in ((two[u, w], one[u], b2), *([(three[s[j - 2] if j > 1 else "</s>", u, w], two[s[j - 2] if j > 1 else "</s>", u], b3)] if j else [])):
                if context:
                    back = discount * context ** (power - 1)
                    p = (1 - back) * seen / context + back * p
            score += math.log10(p)
        out.append((len(s), sum(one[w] > 0 for w in s), sum(math.log10((one[w] + 1) / (n + v + 1)) for w in s), score))
    return n, out


def test_lm_equals_brute_force(spark, docs, empty):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300").select("doc_id", "text").unionByName(docs.select("doc_id", "text").where("doc_id is null"))
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    held_col = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    n, want = brute_lm(rows, held)
    want = sorted((i is not None, i or 0, *w) for (i, _), w in zip(rows, want, strict=True))
    for parts, parameters in ((3, {}), (7, {"chunk_words": 20_000}), (1, {"chunk_words": 5_000, "shard_tokens": 9_000})):
        got = ngram_lm.lm_score(frame.repartition(parts), held_col, **parameters).collect()
        assert len(got) == len(rows) and all(r.train_tokens == n for r in got)
        for r, w in zip(sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), want, strict=True):
            assert r[:4] == w[:4] and math.isclose(r[4], w[4], rel_tol=1e-9) and math.isclose(r[5], w[5], rel_tol=5e-3)
    assert ngram_lm.lm_score(docs, F.lit(False)).count() == docs.count()
    assert ngram_lm.lm_score(empty, F.lit(False)).count() == 0


def test_lm_does_not_depend_on_layout(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.col("doc_id") % 7 == 2
    runs = [{r.doc_id: (r.base_score, r.score, r.held_out) for r in ngram_lm.lm_score(f, held, chunk_words=c).collect()} for f, c in ((frame, 2_000_000), (frame.repartition(16), 30_000))]
    assert all(math.isclose(x[k], y[k], rel_tol=1e-9) for i, x in runs[0].items() for y in [runs[1][i]] for k in (0, 1))
    tested = [x for x in runs[0].values() if x[2]]
    assert sum(x[1] for x in tested) > sum(x[0] for x in tested)


def test_lm_work_does_not_grow_with_messages(monkeypatch):
    """op3: each of chunks times shards messages used to be coded, looked up and answered by itself."""
    rng, text = np.random.default_rng(5), pa.array([" ".join(f"w{x}" for x in range(i, i + 500)) for i in range(0, 4000, 50)])
    docs = pa.RecordBatch.from_arrays([pa.array(rng.permutation(len(text))), pa.array([i % 7 != 2 for i in range(len(text))]), text], names=["doc_id", "train", "text"])
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 3))
    chunks = [c for part in range(0, len(text), 8) for c in ngram_lm._chunker(10**6)([docs.slice(part, 8)])]
    chunks = [c.set_column(0, "chunk", pa.array([i])) for i, c in enumerate(chunks)]

    def calls(work):
        seen = Counter()
        sys.setprofile(lambda frame, event, arg: seen.update([event]))
        try:
            out = work()
        finally:
            sys.setprofile(None)
        return out, seen["call"] + seen["c_call"]

    sent, of_shards = zip(*(calls(lambda n=n: next(iter(ngram_lm._sender(n, (6, 5, 5))(chunks[:1])))) for n in (4, 4096)), strict=True)
    assert [x.num_rows for x in sent] == [4, 4096] and of_shards[1] < 1.1 * of_shards[0]
    answer = ngram_lm._answerer(4, (6, 5, 5))
    messages = pa.Table.from_batches(ngram_lm._sender(4, (6, 5, 5))(chunks))
    messages = messages.take(np.flatnonzero(np.asarray(messages.column("shard")) == 2))
    assert len(messages) == len(chunks) == 10
    (few, of_few), (many, of_many) = calls(lambda: answer(messages.slice(0, 1))), calls(lambda: answer(messages))
    assert (len(few), len(many)) == (1, 10) and of_many < 1.5 * of_few


def test_lm_messages_are_lossless():
    rng = np.random.default_rng(6)
    for unit in (2, 4):
        sizes = np.array([0, 3, 0, 4000, 1, 0, 77, 0])
        values = rng.integers(0, 1 << rng.integers(0, 45, sizes.sum()))
        data, n_bytes = ngram_lm.code_groups(values, sizes, unit)
        assert len(data) == n_bytes.sum() and (ngram_lm.decode_groups(data, n_bytes, sizes, unit) == values).all()
    for shards, n in ((4, 0), (4, 9), (64, 3000), (4096, 30_000)):
        kinds = [np.unique(np.append(rng.integers(0, 1 << 62, n).astype(np.uint64) << np.uint64(2) >> np.uint64(64 - bits), np.array([0, (1 << bits) - 1], np.uint64)[: 2 * bool(n)])) for bits in (64, 60, 60)]
        lows = tuple(ngram_lm.low_bytes(bits, n, shards) for bits in (64, 60, 60))
        sizes, low, high, n_bytes = ngram_lm.code_keys(kinds, lows, shards)
        ends = np.vstack([np.zeros(3, int), np.cumsum(sizes, axis=0)]) * np.array(lows)
        edges = np.append(0, np.cumsum(n_bytes))
        got = [ngram_lm.decode_keys(s, sizes[s : s + 1], [x[ends[s, i] : ends[s + 1, i]] for i, x in enumerate(low)], high[edges[s] : edges[s + 1]], n_bytes[s : s + 1], lows, shards) for s in range(shards)]
        assert all((np.concatenate([g[i] for g in got]) == kinds[i]).all() for i in range(3))


def test_trie_finds_all_and_nothing_else(tmp_path):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 50, 4000).astype(np.uint64) << np.uint64(32) | rng.integers(0, 1 << 32, 4000).astype(np.uint64))
    counts = rng.integers(1, 9000, len(keys))
    trie = ngram_lm.Trie.build(keys, counts)
    found = ngram_lm.BOOK[trie.lookup(keys)]
    assert (found[counts <= 2048] == counts[counts <= 2048]).all() and np.allclose(found, counts, rtol=0.006)
    assert (trie.lookup(keys ^ np.uint64(1))[~np.isin(keys ^ np.uint64(1), keys)] == 0).all()
    trie.dump(str(tmp_path / "t"))
    assert (ngram_lm.Trie.open(str(tmp_path / "t")).lookup(keys) == trie.lookup(keys)).all()
    values = np.sort(rng.integers(0, 1 << 60, 999).astype(np.uint64))
    ef = ngram_lm.EliasFano(ngram_lm.EliasFano.encode(values, 1 << 60))
    assert (ef.get(np.arange(999)) == values).all()
    assert len(ngram_lm.Trie.build(keys[:0], counts[:0]).lookup(keys)) == len(keys)


def test_quotes_equal_oracle(spark):
    import duckdb

    rows = [(1, 0, "u", "Hello there friend.\nHow are you?"), (1, 1, "a", "> How are you?\nFine  thanks.\n"), (1, 2, "u", ">> How are you?\n> fine thanks.\n\nGood."), (2, 0, "u", "> hello there   friend.\r\n> How are you?\nhi"), (2, 1, "x", None), (2, 2, "y", "> unknown\nz"), (3, 0, "q", "> Good.\n> > fine thanks.\nk\n\n> hi"), (None, 0, "q", "> Good.\na"), (4, 0, None, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(1)).withColumn("hash", F.lit("x"))
    got = {tuple(r) for r in quotes.reply_ordered(df).where("conv_id is not null").collect()}
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64"}))
    assert got == set(con.execute(f"SELECT * FROM ({ORACLES['op4_quotation_linking']}) WHERE conv_id IS NOT NULL").fetchall())
    assert {r.depth for r in quotes.reply_ordered(df).where("conv_id = 3").collect()} == {3}
    assert quotes.reply_ordered(df.limit(0)).count() == 0


def test_quotes_planted_in_many_conversations_equal_oracle(spark):
    """Chains of replies with nested quotes, forwarded messages, partly quoted passages, repeated rows and one line that all quote."""
    import random

    import duckdb

    rng, rows = random.Random(7), []
    words = [f"Word{i}" for i in range(300)]
    line = lambda: "  ".join(rng.choice(words) for _ in range(rng.randint(1, 8)))
    quote = lambda text: "\n".join(("> " if rng.random() < 0.8 else ">") + x for x in text.split("\n"))
    for conv in range(300):
        said = []
        for turn in range(rng.randint(1, 7)):
            own = "\n".join([line() for _ in range(rng.randint(1, 4))] + ["Thanks."] * (rng.random() < 0.3))
            kind, old = rng.random(), said or [x[3] for x in rows[-200:]]
            if kind < 0.6 and old:
                source = rng.choice(old) if kind < 0.5 or not rows else rng.choice(rows)[3]
                part = source.split("\n")
                cut = rng.randint(0, len(part) - 1)
                own = quote("\n".join(part[cut : cut + rng.randint(1, 6)]).upper()) + "\n" + "\n" * rng.randint(0, 2) + own
            elif kind < 0.8:
                own = "> thanks.\n" + own
            said.append(own)
            rows.append((conv, turn, "u", own))
    rows += rng.sample(rows, 20)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(repr, map(tuple, quotes.reply_ordered(df).collect())))
    con = duckdb.connect()
    con.register("conversations", df.dropDuplicates().toPandas())
    want = {repr(r) for r in con.execute(ORACLES["op4_quotation_linking"]).fetchall()}
    assert len(got) == len(rows) and set(got) == want
    assert sum("None" not in r for r in want) > 500


def test_quotes_of_long_messages_take_linear_work(spark):
    """One message of 40,000 lines whose level changes now and then, quoted in full."""
    text = "\n".join(f"line {i}" for i in range(40_000))
    reply = "\n".join(f"> line {i}" for i in range(40_000)) + "\nyes"
    df = spark.createDataFrame([(1, 0, "u", text), (1, 1, "a", reply), (1, 2, "u", "> yes\n>> line 7\nno")], "conv_id long, turn long, role string, text string")
    assert {(r.turn, r.reply_turn, r.n_quoted, r.depth) for r in quotes.reply_ordered(df).collect()} == {(0, None, 0, 0), (1, 0, 40_000, 1), (2, 1, 2, 2)}


def test_quotes_of_all_levels(spark):
    """Deeper quotations link where level 1 finds nothing, and a passage wrapped anew is found."""
    rows = [
        (1, 0, "The first message is here.\nIt has two lines."), (1, 1, "> The first message\n> is here. It has two lines.\nA reply."),
        (1, 2, "> words of nobody\n>> The first message is here.\nStill linked."), (1, 3, ">>> A reply.\nOnly deep."), (1, 4, "> Still linked.\n>> The first message is here.\n>> It has two lines.\nLowest wins."), (2, 0, ">> never said"),
    ]
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_turn, r.root_turn, r.depth) for r in quotes.reply_ordered(df, whole=True).collect()}
    assert got == {(1, 0): (None, 0, 0), (1, 1): (0, 0, 1), (1, 2): (0, 0, 1), (1, 3): (1, 0, 2), (1, 4): (2, 0, 2), (2, 0): (None, 0, 0)}


def brute_lines(rows, min_words):
    """Lines left when every run of at least min_words words that an earlier place holds whole is deleted."""
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is not None, rows[n][0] or 0))
    seqs = {n: [x.strip(" \t\r\x0b\x0c") for x in (rows[n][1] or "").split("\n") if x.strip(" \t\r\x0b\x0c")] for n in order}
    gone, seen = {n: set() for n in order}, set()
    for n in order:
        s = seqs[n]
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                run = tuple(s[i:j])
                if run in seen and sum(len(WORD.findall(x)) for x in run) >= min_words:
                    gone[n] |= set(range(i, j))
                seen.add(run)
    return {n: [x for i, x in enumerate(seqs[n]) if i not in gone[n]] for n in order}


def left_lines(text):
    return None if text is None else [x.strip() for x in text.split("\n") if x.strip()]


def test_line_dedup_equals_brute_force(spark, docs, empty):
    rng = random.Random(2)
    lines = [" ".join(rng.choice("abcdefgh") + str(i) for _ in range(rng.randint(1, 6))) for i in range(30)]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.6 else f"own {i} {j}" for j in range(rng.randint(1, 25)))) for i in range(40)]
    rows += [(60 + i, "\n".join(rows[i][1].split("\n")[2:-1] + ["tail"] + rows[i + 1][1].split("\n")[1:])) for i in range(8)]
    rows += [(50, rows[3][1]), (51, "\n\n"), (None, rows[5][1]), (52, None), (53, ""), (80, "a\n" * 40), (81, "a\n" * 30)]
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "doc_id long, text string, d string, h long, _marks long")
    for least in (1, 10):
        got = {r.doc_id: r.text for r in linededup.dedup_lines(df, min_words=least).collect()}
        want = brute_lines(rows, least)
        for n, (i, text) in enumerate(rows):
            assert left_lines(got[i]) == (None if text is None else want[n]), (least, i)
    assert linededup.dedup_lines(df).columns == [*df.columns, "n_lines", "n_deleted"]
    assert linededup.dedup_lines(df.withColumn("n_deleted", F.lit("x"))).columns == [*df.columns, "n_lines", "n_deleted"]
    assert linededup.dedup_lines(docs).count() == docs.count()
    assert linededup.dedup_lines(empty).count() == 0


def test_line_dedup_asks_for_one_earlier_place(spark):
    """A run whose pieces come from different places is no copy; a run that one place holds is."""
    a, b, c = "one two three", "four five six", "seven eight nine"
    join = "\n".join
    rows = [(0, join([a, b])), (1, join([b, c])), (2, join([a, b, c])), (3, join([a, b, c]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_deleted for r in linededup.dedup_lines(df, min_words=9).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


def test_line_dedup_of_frequent_lines(spark, monkeypatch):
    """With room for one frequent name only, the rest is joined by shuffle, with equal results."""
    monkeypatch.setattr(linededup, "HOT", 1)
    rows = [(i, "\n".join(["shared line of a whole dozen words that is put in every text here", f"own {i % 3} line"])) for i in range(50)]
    got = {r.doc_id: left_lines(r.text) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(50)] == list(brute_lines(rows, 10).values())


def test_ann_recall_and_edges(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    p = df.toPandas()
    x = np.stack(p.embedding.to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, hit, n = p.vec_id.to_numpy(), 0, 0
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -2
        best = ids[np.lexsort((ids, -s))[:5]]
        hit, n = hit + len(set(best) & {v for v, _ in found[ids[q]].values()}), n + 5
    assert hit / n >= 0.95
    odd = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 1.0]), (50, [2.0, 0.0]), (None, [1.0, 1.0]), (100, []), (150, [float("inf"), 1.0])]
    tiny = ann.nearest(spark.createDataFrame(odd, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in tiny] == [(0, 1), (0, 2), (0, 50), (0, 7), (50, 0), (50, 1), (50, 2), (50, 7)]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    same = {tuple(r) for r in got}
    assert {tuple(r) for r in ann.nearest(df.union(df.where("vec_id % 3 = 0")).repartition(5), F.col("vec_id") % 50 == 0).collect()} == same
    mixed = [(0, [1.0, 0.0]), (1, [1.0]), (2, [3.0]), (3, [0.0, 1.0]), (50, [2.0]), (4, [1.0, 1.0, 1.0])]
    tiny = ann.nearest(spark.createDataFrame(mixed, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in tiny] == [(0, 3), (50, 1), (50, 2)]


def test_matroska_round_trip_and_lacing(spark, docs, empty):
    for n in (64, 1024, 1088, 8192, 140_032):
        payload = random.Random(n).randbytes(n)
        file = matroska.mux(payload)
        rows = matroska.packets(file)
        assert b"".join(file[a:b] for _, _, a, b, _ in rows) == payload
        assert [t for _, t, *_ in rows] == sorted(t for _, t, *_ in rows) and len(matroska.cue_points(file)) == -(-n // 131072)
        for cut in (10, 60, n // 2):
            matroska.packets(file[:cut])
    frames = [b"a" * 300, b"b" * 20, b"c" * 7]
    xiph = b"\x81\x00\x05\x02\x02" + bytes([255, 45, 20]) + b"".join(frames)
    fixed = b"\x81\x00\x00\x04\x01" + b"xxyy"
    body = matroska.element(matroska.TIMESTAMP, b"\x0a") + matroska.element(matroska.SIMPLE_BLOCK, xiph) + matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, fixed))
    live = matroska._id(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + matroska._id(matroska.CLUSTER) + b"\xff" + body
    assert [(t, live[a:b]) for _, t, a, b, _ in matroska.packets(live)] == [(15, f) for f in frames] + [(10, b"xx"), (10, b"yy")]
    times = [t for _, t, *_ in matroska.packets(matroska.mux(bytes(20_000)))]
    assert times == [i * 128 for i in range(20)]
    grouped = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, b"\x81\x00\x00\x00a")) + matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, b"\x81\x00\x02\x00b") + matroska.element(matroska.REFERENCE_BLOCK, b"\xff"))
    scaled = matroska.element(matroska.SEGMENT, matroska.element(matroska.INFO, matroska.element(matroska.TIMESTAMP_SCALE, b"\x1e\x84\x80")) + matroska.element(matroska.CLUSTER, matroska.element(matroska.TIMESTAMP, b"\x05") + grouped))
    assert [(t, k) for _, t, _, _, k in matroska.packets(scaled)] == [(10, True), (14, False)]
    for r in matroska.read_back(matroska.media(docs)).join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]).where("doc_id not in (8, 11)"), "doc_id").collect():
        raw = (r.text or "").encode()
        raw += b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    assert matroska.packet_table(matroska.media(docs)).count() > docs.count()
    assert matroska.read_back(matroska.media(empty)).count() == 0


PAGE = "<html><head><title>t</title><script>var a='</p>';</script></head><body><header class=site-header>Site</header><nav><a href=/>Home</a></nav>{ad}<article><h1>{h}</h1><p><b>One &amp; {h}<br><p>Two&nbsp;words</p></article><div class='comments'><p>Nice!</p></div><aside>More</aside><form>q</form><footer>f</footer>"


def test_wrapper(spark):
    plain = "<div id=x><div class=brand>Acme Times</div><div class=body><p>{t} is unique</p><p>more {t}</p></div><p class=tail>All rights reserved</p></div>"
    rows = [(1, "http://a.example/1", PAGE.format(ad="<div class=ad>Buy</div>", h="First")), (2, None, None), (3, "x", ""), (4, "y", "just text"), (1, "http://a.example/1", PAGE.format(ad="", h="First"))]
    rows += [(10 + i, f"http://b.example/{i}", plain.format(t=f"T{i}")) for i in range(8)] + [(30, "http://c.example/", "<div>" * 3000 + "deep")]
    got = [(r.page_id, r.text, r.n_chars) for r in wrapper.main_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")).collect()]
    texts = dict((a, b) for a, b, _ in got)
    assert texts[1] == "First One & First Two words" and texts[2] == texts[3] == "" and texts[4] == "just text" and texts[30] == "deep"
    assert texts[10] == "T0 is unique more T0" and all(n == len(t) for _, t, n in got) and len(got) == len(rows)
    assert wrapper.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def extracted(spark, rows, **parameters):
    found = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), **parameters)
    return {r.page_id: r.text for r in found.collect()}


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_wrapper_decides_without_names(spark):
    """Class names that say nothing: constant parts are template, the varying bulk is content."""
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(12):
        h, a, b = sentence(rng, 4), sentence(rng, 60), sentence(rng, 50)
        html = f"<div class=k1>Home Archive About us</div><div class=k2>{sentence(rng, 5)}</div><div class=k3><h1>{h}</h1><div class=k4>Posted by the editors of this site</div><p>{a}</p><p>{b}</p></div><div class=k5>{sentence(rng, 6)}</div>"
        rows.append((i, f"http://h.example/{i}", f"<html><body>{html}</body></html>"))
        want[i] = f"{h} {a} {b}"
    assert extracted(spark, rows, names=False) == want
    assert wrapper.Page(rows[0][2], names=False).text() != want[0]
    assert extracted(spark, rows[:2]) == {i: want[i] for i in (0, 1)}  # two pages are enough


def test_wrapper_takes_the_varying_bulk_before_teaser_articles(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for i in range(10):
        body = [sentence(rng, 40) for _ in range(3)]
        cards = "".join(f"<article class=card><h3>{sentence(rng, 4)}</h3></article>" for _ in range(4))
        share = "<div class=related-work><p>%s</p></div>" % sentence(rng, 12)
        rows.append((i, f"http://t.example/{i}", "<body><div class=text>" + "".join(f"<p>{x}</p>" for x in body) + share + "</div>" + cards + "</body>"))
        want[i] = " ".join(body) + " " + share[share.index("<p>") + 3 : share.index("</p>")]
    assert extracted(spark, rows) == want


def test_wrapper_leaves_copies_of_one_article(spark):
    """Pages that differ in the advert only do not make their article a template."""
    rng = random.Random(10)
    text = sentence(rng, 200)
    rows = [(i, f"http://c.example/{i}", f"<div class=x>{sentence(rng, 5)}</div><div class=y><p>{text}</p></div>") for i in range(9)]
    assert all(text in x for x in extracted(spark, rows).values())


def test_tree_matching_equals_dynamic_programming():
    rng = random.Random(4)

    def tree(path, depth):
        kids = rng.sample(range(6), rng.randint(0, 5)) if depth < 4 else []
        return path, [tree(path + (k,), depth + 1) for k in kids]

    def flat(root):
        paths, above, stack = [], [], [(root, -1)]
        while stack:
            (path, kids), up = stack.pop(0)
            paths.append(hash(path))
            above.append(up)
            stack += [(k, len(paths) - 1) for k in kids]
        return paths, above

    def best(a, b):
        grid = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
        for i, x in enumerate(a[1], 1):
            for j, y in enumerate(b[1], 1):
                grid[i][j] = max(grid[i - 1][j], grid[i][j - 1], grid[i - 1][j - 1] + best(x, y) if x[0] == y[0] else 0)
        return 1 + grid[-1][-1]

    for _ in range(200):
        a, b = tree((), 0), tree((), 0)
        assert len(wrapper.aligned(flat(a), flat(b))) == best(a, b)


def test_wrapper_reads_wide_and_deep_pages_in_seconds():
    import time

    began = time.time()
    wide = wrapper.Page("<body>" + "".join(f"<x{i}>a</x{i}>" for i in range(20_000)))
    turned = wrapper.Page("<body>" + "".join(f"<x{i}>b</x{i}>" for i in reversed(range(20_000))))
    assert len(wrapper.aligned((wide.sig, wide.above), (turned.sig, turned.above))) == 3
    assert wrapper.Page("<div>" * 50_000 + "deep").text({wrapper.Page("").sig[0]: (None, 1.0)}) == "deep"
    assert wrapper.Page("<p data-id=ad title='id=menu class=nav'>kept</p>").text() == "kept"
    assert time.time() - began < 20


def test_bpe_equals_library(spark, docs, empty):
    from tokenizers import Tokenizer

    library, path = Tokenizer.from_file(tokenizer_path()), tokenizer_path()
    encoder = bpe.Encoder(bpe.Vocabulary(open(path, encoding="utf-8").read()))
    rng = random.Random(1)
    bits = ["a", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "ß", "12", "'s", "!", "<|endoftext|>", "日本", "👍", "Z" * 60, "\r\n", "½"]
    for _ in range(1500):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert encoder.encode(s) == library.encode(s, add_special_tokens=False).ids
    long = "".join(rng.choice("abcdefgh") for _ in range(5000))
    assert encoder.encode(long) == library.encode(long, add_special_tokens=False).ids
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = bpe.digests(docs, path).collect()
    want = Counter()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in got) == want
    back = bpe.decode(bpe.encode(docs, path), path).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t in texts)
    assert bpe.digests(empty, path).count() == 0


def test_pipeline_stages(spark, docs, empty):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, frame = frame, stage(spark, frame, sf)
        assert frame.columns == before.columns, name
        frame = spark.createDataFrame(frame.collect(), before.schema)
        if name == "quality classifier":
            assert frame.join(labels.where("quality = 1"), "doc_id").count() >= 0.97 * before.join(labels.where("quality = 1"), "doc_id").count()
        if name == "MinHash near-dedup":
            want = brute_components([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in frame.collect()) == sorted(i for i, c in want.items() if i == c)
    assert {"doc_id", "n_tokens"} <= set(corpus_pipeline.STAGES[4][1](spark, frame, sf).columns)
    edge = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (edge, edge.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            start = stage(spark, start, sf)
        start.collect()


def test_pipeline_near_dedup_links_from_80(spark):
    """Copies at similarities between 0.78 and 0.87: the stage keeps what brute force at 80 keeps."""
    import corpus_pipeline

    rows = []
    for g in range(60):
        base = [f"g{g}w{j}" for j in range(200)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[: 175 + g // 3] + [f"x{g}y{j}" for j in range(25 - g // 3)]))]
    want = brute_components(rows, percent=80)
    assert want != brute_components(rows)
    kept = corpus_pipeline.dedup_near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, c in want.items() if i == c)


def test_pipeline_rejects_rows_not_ids(spark):
    """Junk goes and clean text stays where they share a doc_id or have none."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    d, y = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.quality_scores(d, y).join(d, "doc_id").orderBy("score", "doc_id").collect()
    junk, clean = [r.text for r in scored[:2]], [r.text for r in scored[-2:]]
    rows = [(None, junk[0]), (None, clean[0]), (7, junk[1]), (7, clean[1])]
    docs = d.select("doc_id", "text").unionByName(spark.createDataFrame([(i if i is None else -i, t) for i, t in rows], "doc_id long, text string"))
    kept = corpus_pipeline.keep_quality(spark, docs, sf).where("doc_id is null or doc_id < 0").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, clean[0]), (-7, clean[1])])


def test_pipeline_near_dedup_judges_rows(spark):
    """Unrelated texts that share an id do not join their groups; of equal rows one stays."""
    import corpus_pipeline

    rng = random.Random(6)
    text = lambda: [f"w{rng.randrange(5000)}" for _ in range(150)]
    a, z, t = text(), text(), text()
    near = lambda words: " ".join([*words[:-2], "other", "end"])
    a, z, t, a2, z2 = " ".join(a), " ".join(z), " ".join(t), near(a), near(z)
    rows = [(1, a), (5, a2), (5, z), (7, z2), (8, t), (8, t), (None, a), (None, "only here"), (None, "only here"), (None, None), (9, None), (9, "")]
    for shift in (0, (1 << 62) + 5, -(1 << 62) - 5):
        moved = [(i if i is None else i + shift, x, n) for n, (i, x) in enumerate(rows)]
        docs = spark.createDataFrame(moved, "doc_id long, text string, node long").repartition(3)
        kept = corpus_pipeline.dedup_near(spark, docs, "")
        assert kept.columns == docs.columns
        kept = sorted(((r.doc_id or shift) - shift, r.text or "") for r in kept.collect())
        of = {a2: a, z2: z}
        assert sorted(of.get(x, x) for _, x in kept) == sorted([a, z, t, "only here", "", "", ""]), shift
        if shift <= 0:
            assert kept == sorted([(1, a), (7, z2), (8, t), (0, "only here"), (0, ""), (9, ""), (9, "")])
    both = [(-(2**63), a), (2**63 - 1, a2), (3, z), (3, z2), (4, t), (None, t)]
    kept = corpus_pipeline.dedup_near(spark, spark.createDataFrame(both, "doc_id long, text string"), "").collect()
    assert len(kept) == 3 and {r.text for r in kept} & {a, a2} and {r.text for r in kept} & {z, z2} and t in {r.text for r in kept}


def test_all_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
