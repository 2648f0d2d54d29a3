"""MinHash near-duplicate detection with tensored banding.

Instead of drawing fresh hash functions for each of L tables, two small collections A and B
of ``bands`` half-keys each are computed, and table (i, j) is keyed by the pair
(A_i, B_j): ``bands ** 2`` tables from ``2 * bands`` half-keys, so that the number of hash
evaluations grows with the square root of the number of tables.

Plan: one scan computes half-keys (Arrow batches, numpy). Texts with the same word sequence
form one class, represented by its smallest doc_id. A pair can meet in a table only if it
shares a half-key of A and one of B, so only representatives that share both kinds with
somebody are expanded into pair keys. Buckets are not expanded into all pairs: each is first
compared with pivots, and what then lies in one bucket but in different components is paired
by exact prefix filtering. Links are confirmed by exact Jaccard similarity on full sets of 64-bit
shingle hashes: in a corpus of n distinct shingles one of them is taken for another with
probability n / 2 ** 64, and a link is wrong only where that moves a pair over the threshold.

Defined cases: a null or wordless text has an empty set and is linked with nothing; a text of
fewer than ``k`` words is one shingle; rows sharing a doc_id are one node (all of them get its
component); a null doc_id stands alone in component null and is kept; an empty table gives an
empty result; other columns pass through ``near_duplicates`` untouched, but for columns that have
the names of its results, which are replaced; of rows sharing a doc_id it shows the largest n_shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .support import fresh, store
from .tokens import mix, shingles, slices, text_bytes, word_hashes

#: Tasks over which the copies of one text are dealt.
_SALTS = 16
_SIGNATURE = "doc_id long, n_shingles long, seq_hi long, seq_lo long, a array<long>, b array<long>"


def _signer(k: int, bands: int, rows: int):
    """Per Arrow batch: set size, sequence fingerprint and the half-keys of both collections."""
    n_hash = 2 * bands * rows

    def sign(batches):
        mult = mix(np.arange(1, n_hash + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            words, counts = word_hashes(text_bytes(batch.column(1)))
            flat, sizes = shingles(words, counts, k)
            has = np.flatnonzero(sizes)
            starts = np.concatenate(([0], np.cumsum(sizes[has])[:-1])).astype(np.int64)
            halves = np.zeros((2 * bands, len(sizes)), np.uint64)
            seq = np.zeros((2, len(sizes)), np.uint64)
            if len(has):
                with np.errstate(over="ignore"):
                    mins = np.empty((n_hash, len(has)), np.uint64)
                    for i in range(n_hash):
                        x = flat * mult[i]
                        x ^= x >> np.uint64(32)
                        x *= mult[n_hash - 1 - i]
                        mins[i] = np.minimum.reduceat(x, starts)
                    for i in range(2 * bands):
                        key = np.full(len(has), i + 1, np.uint64)
                        for m in mins[i * rows : (i + 1) * rows]:
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + m)
                        halves[i, has] = key
                    # the word sequence itself, twice with different multipliers
                    full = np.flatnonzero(counts)
                    first = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
                    place = np.arange(len(words), dtype=np.uint64) - np.repeat(first, counts).astype(np.uint64)
                    for j, m in enumerate((0x2545F4914F6CDD1D, 0xDA942042E4DD58B5)):
                        seq[j, full] = np.add.reduceat(mix(words + mix(place * np.uint64(m))), first[full])
            as_lists = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(m.T).view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes), pa.array(seq[0].view(np.int64)), pa.array(seq[1].view(np.int64)), as_lists(halves[:bands]), as_lists(halves[bands:])],
                names=["doc_id", "n_shingles", "seq_hi", "seq_lo", "a", "b"],
            )

    return sign


def _set_maker(k: int):
    def sets(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            words, counts = word_hashes(text_bytes(batch.column(1)))
            flat, sizes = shingles(words, counts, k)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))], names=["node", "items"])

    return sets


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of ``links(a, b)``; the component is its smallest node.

    Alternating large-star and small-star steps, one stored table per round; no node's
    neighbours are gathered in one place. Rounds grow with the logarithm of the diameter.
    """
    edges = store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = store(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 85, bands: int = 10, rows: int = 3, star_rounds: int = 2) -> DataFrame:
    """Add ``n_shingles``, ``component_id`` and ``kept`` to ``docs`` (columns doc_id, text and any others).

    Two texts are linked when 100 * intersection >= percent * union of their distinct k-word
    shingles. ``bands ** 2`` tables of ``2 * rows`` hash values each: at a similarity of 0.85 and
    the defaults a pair is missed with probability 2 * (1 - 0.85 ** 3) ** 10 = 0.00015.
    """
    result = node_table(docs, k=k, percent=percent, bands=bands, rows=rows, star_rounds=star_rounds)
    docs = docs.drop("n_shingles", "component_id", "kept")
    (node,) = fresh(docs, "node")
    sizes = result.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"), F.max("kept").alias("kept"))
    return docs.join(sizes.withColumnRenamed("doc_id", node), F.col("doc_id").cast("long").eqNullSafe(F.col(node)), "left").drop(node)


def node_table(docs: DataFrame, *, k: int = 5, percent: int = 85, bands: int = 10, rows: int = 3, star_rounds: int = 2) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = store(slim.mapInArrow(_signer(k, bands, rows), _SIGNATURE))
    known = signed.where("n_shingles > 0 and doc_id is not null")
    sequence = ["seq_hi", "seq_lo", "n_shingles"]
    same = known.groupBy(sequence).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).where("copies > 1")
    # Copies of one text are dealt over _SALTS tasks; texts that occur once need no partner.
    same = same.select(*sequence, "least", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    salted = known.withColumn("salt", F.expr(f"cast(pmod(xxhash64(doc_id), {_SALTS}) as int)"))
    nodes = store(salted.join(same, [*sequence, "salt"], "left").select("doc_id", F.coalesce("least", "doc_id").alias("rep"), "n_shingles", "a", "b"))
    reps = nodes.where("doc_id = rep").dropDuplicates(["rep", "n_shingles", "a", "b"])

    halves = reps.select("rep", F.posexplode(F.concat("a", "b")).alias("i", "key"))
    shared = halves.groupBy("i", "key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("i", "key")
    meets = halves.join(shared, ["i", "key"]).groupBy("rep").agg(F.collect_set("i").alias("held"))
    live = meets.join(reps, "rep").select(
        "rep", F.col("n_shingles").alias("n"),
        F.expr(f"transform(filter(held, x -> x < {bands}), x -> struct(x as i, a[x] as key))").alias("a"),
        F.expr(f"transform(filter(held, x -> x >= {bands}), x -> struct(x as i, b[x - {bands}] as key))").alias("b"),
    ).where("size(a) > 0 and size(b) > 0")
    tables = live.select("rep", "n", "b", F.explode("a").alias("x")).select("rep", "n", "x", F.explode("b").alias("y")).select("rep", "n", F.xxhash64("x.i", "x.key", "y.i", "y.key").alias("bucket"), F.expr("pmod(hash(x.i, y.i), 4)").alias("part"))
    tables = store(tables)
    crowded = tables.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("bucket")
    tables = store(tables.join(crowded, "bucket"))
    members = tables.select(F.col("rep").alias("node")).distinct()
    items = store(slim.join(members, slim.doc_id == members.node, "left_semi").mapInArrow(_set_maker(k), "node long, items array<long>").where("size(items) > 0"))

    compare = lambda pairs: _verify(pairs, items, percent)
    fits = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def star(rows_, order):
        """Pairs of each bucket's pivot (least in ``order``) with the bucket's members of other components."""
        pivot = rows_.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), F.col("rep"), F.col("n"), F.col("component"))).alias("p"))
        joined = rows_.join(pivot, "bucket").where("component <> p.component")
        return joined.select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b"), F.expr("p.n").alias("n_a"), F.col("n").alias("n_b")).where(fits).select("a", "b").distinct()

    open_rows = tables.withColumn("component", F.col("rep"))
    checked = links = None
    for step in range(star_rounds + 1):
        if step < star_rounds:
            order = F.lit(0) if step == 0 else F.xxhash64("rep", "part", F.lit(step))
            pairs = star(open_rows, order)
        else:
            pairs = _prefix_pairs(open_rows.select("rep", "n", "component").distinct(), items, percent).where(fits).select("a", "b").distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        found = store(compare(pairs))
        checked = found.select("a", "b") if checked is None else checked.union(found.select("a", "b"))
        good = found.where("linked").select("a", "b")
        links = good if links is None else links.union(good)
        groups = store(components(links))
        open_rows = _still_open(tables, groups)
        if step < star_rounds and open_rows.isEmpty():
            break
    found = nodes.select("doc_id", "rep").distinct().join(groups, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("component_id")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return signed.select("doc_id", "n_shingles").join(found.withColumnRenamed("doc_id", "_d"), F.col("doc_id") == F.col("_d"), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _prefix_pairs(open_nodes: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that can reach the threshold, by exact prefix filtering.

    With shingles in any common order, two linked sets share one of the first
    n - ceil(percent * n / 100) + 1 of each. The order is rarest first, so the many variants of a
    text, whose changes are their own, are no candidates of each other; shingles that only one
    open node has are counted, not joined. At the first shared shingle, what is left of both sets
    must still suffice for the overlap that their sizes ask for.
    """
    held = open_nodes.join(items, F.col("rep") == F.col("node")).select("rep", "n", "component", F.explode("items").alias("item"))
    common = held.groupBy("item").agg(F.count("*").alias("f")).where("f > 1")
    own = W.partitionBy("rep")
    ranked = held.join(common, "item").withColumn("at", F.row_number().over(own.orderBy("f", "item"))).withColumn("shared", F.count("*").over(own))
    prefix = ranked.withColumn("left", F.expr("shared - at")).where(F.expr(f"left + 1 >= ({percent} * n + 99) div 100"))
    x = prefix.select("item", F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c"), F.col("left").alias("left_a"))
    y = prefix.select("item", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("d"), F.col("left").alias("left_b"))
    enough = F.expr(f"(100 + {percent}) * (least(left_a, left_b) + 1) >= {percent} * (n_a + n_b)")
    return x.join(y, "item").where("a < b and c <> d").where(enough)


def _still_open(tables: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of buckets whose members still lie in different components."""
    placed = store(tables.join(groups, F.col("rep") == F.col("node"), "left").select("rep", "n", "bucket", "part", F.coalesce("component", "rep").alias("component")))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    return store(placed.join(mixed, "bucket"))


def _verify(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Exact decision for each pair on full sets."""
    right = pairs.join(items, F.col("b") == F.col("node")).select("a", "b", F.col("items").alias("s_b"))
    both = right.join(items, F.col("a") == F.col("node")).select("a", "b", F.size(F.array_intersect("s_b", "items")).alias("common"), (F.size("s_b") + F.size("items")).alias("total"))
    return both.select("a", "b", F.expr(f"100 * common >= {percent} * (total - common)").alias("linked"))
