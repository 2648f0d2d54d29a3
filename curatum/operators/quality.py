"""Heuristic quality of preference pairs, and structural and reward filters over pair tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import blocks
from .ingest import stored
from .selection import column_percentiles, percentiles

#: Word lists of the pair metrics.
STOPWORDS = "a an and are as at be because but by for from has have i in into is it its of on or that the their this to was were with you your".split()
UNCERTAIN = ("i don't know", "i do not know", "not sure", "unsure", "unknown", "cannot answer", "can't answer", "no information", "maybe", "probably")
INDICATORS = ("because", "therefore", "for example", "for instance", "defined as", "depends on", "caused by", "results in", "step", "first", "second", "however", "whereas")
DIFFICULT = ("analyze", "compare", "contrast", "derive", "evaluate", "explain", "justify", "prove", "synthesize", "tradeoff", "tradeoffs", "failure mode", "regulatory", "mechanism", "complexity", "assumption")
QUESTION_WORDS = ("why", "how", "compare", "explain", "analyze")
METRICS = ("semantic_similarity", "length_ratio", "answer_diversity", "preference_margin", "difficulty_score", "overall_quality")

_clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
_upto1 = lambda x: F.least(F.lit(1.0), x)


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?"), 0)


def _hits(text: Column, phrases) -> Column:
    total = F.lit(0)
    for p in phrases:
        total = total + text.contains(p).cast("int")
    return total


def _content(tokens: Column) -> Column:
    kept = F.filter(tokens, lambda t: ~t.isin(STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def _count(text: Column, mark: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)


def _let(value: Column, use) -> Column:
    """``use(value)`` with value computed once: filters on the result are pushed down without copying it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def with_pair_quality(pairs: DataFrame) -> DataFrame:
    """The six metrics of each pair as columns, by native expressions over the row's own words.

    The cosine comes from word counts of the row (higher-order functions); ``similarity_by_terms``
    gives the same values by a join on terms for document-length texts.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    words = F.struct(*(_tokens(text(c)).alias(c) for c in ("prompt", "chosen", "rejected")))
    content = lambda t: F.struct(t.alias("t"), *(_content(t[c]).alias(c) for c in ("prompt", "chosen", "rejected")))
    basic = lambda k: F.struct(k.alias("k"), _similarity(k["chosen"], k["rejected"]).alias("sim"), _ratio(k["t"]).alias("ratio"), _difficulty(F.lower(text("prompt")), k["t"]["prompt"], k["prompt"]).alias("hard"))

    def total(m: Column) -> Column:
        k, t = m["k"], m["k"]["t"]
        better = _answer_score(text("chosen"), t["chosen"], k["chosen"], m["hard"]) - _answer_score(text("rejected"), t["rejected"], k["rejected"], m["hard"])
        variety = F.when(F.size(t["chosen"]) == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(k["chosen"])) / F.size(k["chosen"]))
        present = F.when((F.size(t["chosen"]) > 0) & (F.size(t["rejected"]) > 0) & (F.size(t["prompt"]) > 0), 1.0).otherwise(0.0)
        return F.struct(m.alias("m"), _clamp(0.05 + 1.8 * F.greatest(better, F.lit(0.0))).alias("margin"), variety.alias("variety"), present.alias("present"))

    def final(x: Column) -> Column:
        m = x["m"]
        balance = F.when(m["ratio"] <= 0, F.lit(0.0)).otherwise(_clamp(1 - F.abs(F.ln(m["ratio"])) / F.ln(F.lit(10.0))))
        whole = _clamp(0.35 * x["margin"] + 0.25 * (1 - m["sim"]) + 0.15 * balance + 0.10 * x["variety"] + 0.10 * m["hard"] + 0.05 * x["present"])
        alike = F.when(m["sim"] > 0.85, 1 - 0.55 * _upto1((m["sim"] - 0.85) / 0.15)).otherwise(1.0)
        values = (m["sim"], m["ratio"], x["variety"], x["margin"], m["hard"], whole * alike)
        return F.struct(*(F.round(v, 6).alias(name) for v, name in zip(values, METRICS, strict=True)))

    scores = _let(words, lambda t: _let(content(t), lambda k: _let(basic(k), lambda m: _let(total(m), final))))
    return pairs.withColumn("_q", scores).select(*pairs.columns, *(F.col(f"_q.{m}") for m in METRICS))


def _bag(tokens: Column) -> Column:
    return F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("t"), F.size(F.filter(tokens, lambda x: x == t)).cast("double").alias("n")))


def _similarity(c: Column, r: Column) -> Column:
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x["n"] * x["n"]))
    dot = lambda v: F.aggregate(v["c"], F.lit(0.0), lambda a, x: a + x["n"] * F.coalesce(F.try_element_at(F.map_from_entries(v["r"]), x["t"]), F.lit(0.0)))
    cosine = _let(F.struct(_bag(c).alias("c"), _bag(r).alias("r")), lambda v: dot(v) / (norm(v["c"]) * norm(v["r"])))
    jaccard = F.size(F.array_intersect(c, r)) / F.size(F.array_union(c, r))
    none_c, none_r = F.size(c) == 0, F.size(r) == 0
    return F.when(none_c & none_r, F.lit(1.0)).when(none_c | none_r, F.lit(0.0)).otherwise(_clamp(0.8 * cosine + 0.2 * jaccard))


def _ratio(t: Column) -> Column:
    c, r = F.size(t["chosen"]), F.size(t["rejected"])
    return F.when((c == 0) & (r == 0), F.lit(1.0)).when(r == 0, F.greatest(c.cast("double"), F.lit(1.0))).otherwise(c / r)


def _difficulty(low: Column, tokens: Column, content: Column) -> Column:
    asked = sum((F.array_contains(tokens, w).cast("int") for w in QUESTION_WORDS), F.lit(0))
    clauses = _count(low, ",") + _count(low, ";") + _count(low, " versus ")
    long = F.size(F.filter(content, lambda t: F.length(t) >= 9))
    hard = 0.30 * _upto1(F.size(tokens) / 35.0) + 0.25 * _upto1(asked / 3.0) + 0.20 * _upto1(_hits(low, DIFFICULT) / 4.0) + 0.15 * _upto1(clauses / 4.0) + 0.10 * _upto1(long / 5.0)
    return F.when(F.size(tokens) == 0, F.lit(0.0)).otherwise(_clamp(hard))


def _answer_score(text: Column, tokens: Column, content: Column, hard: Column) -> Column:
    low, n, want = F.lower(text), F.size(tokens), 5.0 + 24.0 * hard
    digits = F.size(F.filter(tokens, lambda x: x.rlike("[0-9]")))
    length = _upto1(n / want) * F.when(n > want * 8, F.greatest(F.lit(0.2), want * 8 / n)).otherwise(1.0)
    specific = _upto1((F.size(F.array_distinct(content)) + 2.0 * digits) / F.greatest(want, F.lit(6.0)))
    marks = _upto1((_hits(low, INDICATORS) + digits) / 4.0)
    sentences = F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")))
    shape = _upto1(sentences / F.greatest(1.0 + 2.0 * hard, F.lit(1.0)))
    variety = F.size(F.array_distinct(content)) / F.size(content)
    doubt, terse = F.when(_hits(low, UNCERTAIN) > 0, 0.35).otherwise(0.0), F.when((n <= 3) & (hard > 0.15), 0.20).otherwise(0.0)
    score = 0.30 * length + 0.30 * specific + 0.20 * marks + 0.15 * shape + 0.05 * variety - doubt - terse
    return F.when(n == 0, F.lit(0.0)).otherwise(_clamp(score))


def similarity_by_terms(pairs: DataFrame) -> DataFrame:
    """(id, semantic_similarity) by counting terms and joining the two sides: for long texts."""
    side = lambda c: pairs.select("id", F.explode(_content(_tokens(F.col(c)))).alias("t")).groupBy("id", "t").agg(F.count("*").cast("double").alias(f"n_{c}"))
    both = side("chosen").join(side("rejected"), ["id", "t"], "full")
    c, r = F.coalesce("n_chosen", F.lit(0.0)), F.coalesce("n_rejected", F.lit(0.0))
    g = both.groupBy("id").agg(F.sum(c * r).alias("dot"), F.sqrt(F.sum(c * c)).alias("x"), F.sqrt(F.sum(r * r)).alias("y"), F.count_if((c > 0) & (r > 0)).alias("common"), F.count("*").alias("either"))
    s = F.when(F.col("x").isNull(), 1.0).when((F.col("x") == 0) | (F.col("y") == 0), 0.0).otherwise(_clamp(0.8 * F.col("dot") / (F.col("x") * F.col("y")) + 0.2 * F.col("common") / F.col("either")))
    return pairs.select("id").join(g, "id", "left").select("id", F.round(s, 6).alias("semantic_similarity"))


def quality_report(scored: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(metric, mean, median, min, max, stdev, total, kept) over all pairs."""
    long = stored(scored.select(F.col("overall_quality").alias("q"), F.expr(f"stack({len(METRICS)}, {', '.join(f'{m!r}, {m}' for m in METRICS)}) as (name, value)")))
    medians = percentiles(long.select("name", "value"), {m: [0.5] for m in METRICS})
    median = F.element_at(F.create_map(*(F.lit(x) for m, (v,) in medians.items() for x in (m, v))), F.col("metric"))
    whole = long.groupBy(F.col("name").alias("metric")).agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.stddev_pop("value"), 6).alias("stdev"), F.count("*").alias("total"), F.count_if(F.col("q") >= threshold).alias("kept"))
    return whole.select("metric", "mean", F.round(median, 6).alias("median"), "min", "max", "stdev", "total", "kept")


def pair_duplicates(pairs: DataFrame) -> DataFrame:
    """All but the first pair of equal trimmed lower-case texts."""
    key = [F.lower(F.trim(c)) for c in ("chosen", "rejected")]
    return pairs.withColumn("_n", F.row_number().over(W.partitionBy(*(F.xxhash64(k) for k in key), *key).orderBy("id"))).where("_n > 1").select("id", F.lit("high").alias("severity"))


def _words(c: str) -> Column:
    return F.regexp_count(F.col(c), F.lit(r"[^\x20\x09-\x0D]+"))


def length_ratio_flags(pairs: DataFrame) -> DataFrame:
    r = _words("chosen") / F.nullif(_words("rejected"), F.lit(0))
    return pairs.select("id", F.round(r, 6).alias("ratio")).where("ratio > 3.0 or ratio < 0.33")


def length_bias(pairs: DataFrame) -> DataFrame:
    g = pairs.agg(F.avg(_words("chosen")).alias("c"), F.avg(_words("rejected")).alias("r"))
    ratio = F.col("c") / F.col("r")
    return g.select(F.round("c", 6).alias("mean_chosen"), F.round("r", 6).alias("mean_rejected"), F.round(ratio, 6).alias("ratio"), ((ratio > 1.5) | (ratio < 0.67)).alias("biased"))


def short_responses(pairs: DataFrame) -> DataFrame:
    short = lambda c, s: pairs.where(F.length(F.trim(c)) < 10).select("id", F.lit(c).alias("side"), F.lit(s).alias("severity"))
    return short("chosen", "high").unionByName(short("rejected", "medium"))


def label_consistency(scored: DataFrame) -> DataFrame:
    """(id, level): critical where the margin contradicts the label, weak below 0.1."""
    return scored.select("id", F.when(F.col("margin") < 0, "critical").when(F.col("margin") < 0.1, "weak").otherwise("sound").alias("level"))


def filter_by_margin(scored: DataFrame, least: float = 0.0) -> DataFrame:
    return scored.where(F.col("margin") >= least)


def hardest_pairs(scored: DataFrame, keep: float = 0.1) -> DataFrame:
    """Pairs whose implicit gap is at most its ``keep`` percentile."""
    (cut,) = column_percentiles(scored, {"implicit": [keep]})["implicit"]
    return scored.where(F.col("implicit") <= F.lit(cut))


def reward_disagreement(scored: DataFrame, margins: tuple[str, ...] = ("margin", "implicit")) -> DataFrame:
    """(id, agreement, level): mean sign of the models' margins, 0 counting as against; critical below 0.5, partial below 1."""
    sign = sum((F.when(F.col(m) > 0, 1).otherwise(-1) for m in margins), F.lit(0))
    level = F.when(F.col("agreement") < 0.5, "critical").when(F.col("agreement") < 1.0, "partial").otherwise("full")
    return scored.select("id", (sign / float(len(margins))).alias("agreement")).withColumn("level", level)


def filter_by_strength(scored: DataFrame, keep: float = 0.6) -> DataFrame:
    """Pairs whose absolute margin reaches the exact (1 - keep) percentile."""
    (cut,) = column_percentiles(scored, {"abs(margin)": [1 - keep]})["abs(margin)"]
    return scored.where(F.abs("margin") >= F.lit(cut))


def bayes_rank(scored: DataFrame, low: float = -2.0) -> DataFrame:
    """Two margins clipped to [low, 90th percentile of their size], scaled and combined as evidence."""
    cut = column_percentiles(scored, {"abs(margin)": [0.9], "abs(implicit)": [0.9]})
    scale = lambda m, u: (F.least(F.greatest(F.col(m), F.lit(low)), F.lit(u)) - low) / (F.lit(u) - low)
    x = scored.select("id", scale("margin", *cut["abs(margin)"]).alias("a"), scale("implicit", *cut["abs(implicit)"]).alias("b"))
    both, none = F.col("a") * F.col("b"), (1 - F.col("a")) * (1 - F.col("b"))
    return x.select("id", F.round(both / F.nullif(both + none, F.lit(0.0)), 6).alias("p"))


def response_overlap(pairs: DataFrame, high: float = 0.9, moderate: float = 0.75) -> DataFrame:
    """(id, ratio, level) of pairs whose two responses, in lower case, share matching blocks beyond ``moderate``.

    Lengths bound the ratio from above, natively; Arrow batches hold what this leaves open against
    counts of characters and of their pairs, and only then search blocks (:mod:`..functions.blocks`).
    A pair in that search takes some 500 bytes a character of the rejected text. Null texts are empty.
    """
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([blocks.ratio(x, y, moderate) for x, y in zip(a, b, strict=True)], dtype="float64")

    c, r = (F.lower(F.coalesce(x, F.lit(""))) for x in ("chosen", "rejected"))
    bound = F.when(F.length(c) + F.length(r) == 0, 1.0).otherwise(2.0 * F.least(F.length(c), F.length(r)) / F.greatest(F.length(c) + F.length(r), F.lit(1)))
    found = pairs.where(bound > moderate).select("id", ratio(c, r).alias("r")).where("r is not null")
    return found.select("id", F.round("r", 6).alias("ratio"), F.when(F.col("r") > high, "high").otherwise("moderate").alias("level"))


def overlap_report(pairs: DataFrame, high: float = 0.9, suspect: float = 0.2) -> DataFrame:
    """(n, n_high, n_moderate, suspect): the data set is suspect if more than ``suspect`` of its pairs overlap highly."""
    flags = response_overlap(pairs, high).groupBy().agg(F.count_if(F.col("level") == "high").alias("n_high"), F.count_if(F.col("level") == "moderate").alias("n_moderate"))
    whole = pairs.groupBy().agg(F.count("*").alias("n"))
    return whole.join(flags, how="cross").select("n", "n_high", "n_moderate", (F.col("n_high") > suspect * F.col("n")).alias("suspect"))  # one row each


def best_and_worst(scored: DataFrame, share: float = 0.5) -> DataFrame:
    """The best and the worst ``share / 2`` of the rows by margin, cut at exact percentiles."""
    low, high = column_percentiles(scored, {"margin": [share / 2, 1 - share / 2]})["margin"]
    end = F.when(F.col("margin") >= F.lit(high), "best").when(F.col("margin") <= F.lit(low), "worst")
    return scored.withColumn("end", end).where("end is not null")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays in double precision; null where either is null, empty or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def semantic_weight(pairs: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(id, weight) of vector pairs (id, x, y): exp(-alpha * cosine distance)."""
    return pairs.select("id", F.round(F.exp(-alpha * (1 - cosine(F.col("x"), F.col("y")))), 6).alias("weight"))


def _most_bits(threshold: float, sketch: int, missed: float) -> int:
    """The smallest number of differing signs that a pair at cosine ``threshold`` exceeds with probability ``missed`` at most."""
    p, left = float(np.arccos(threshold) / np.pi), 1.0
    for d in range(sketch):
        left -= math.comb(sketch, d) * p**d * (1 - p) ** (sketch - d)
        if left <= missed:
            return d
    return sketch


def _signs(x: np.ndarray, seed: tuple[int, ...], n: int) -> np.ndarray:
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], n), dtype=np.float32)
    return x @ planes > 0


def cache_hits(vectors: DataFrame, threshold: float = 0.9, *, bits: int = 10, tables: int = 24, sketch: int = 256, first: int = 16, seed: int = 11, bucket_rows: int = 512, block: int = 4096) -> DataFrame:
    """(id, cached_id, similarity): the first earlier row whose answer a semantic cache could have given again.

    Signs of random projections key buckets. Only ids and ``sketch`` more signs are posted there: a pair
    whose sketches differ in more bits than a match does (but for one in a thousand) is cut in its bucket,
    and vectors are fetched, once each, for the pairs left. Of a row's earlier partners in a bucket the
    ``first`` are checked; where none of these matches, and others came after them, the row is held
    against its whole buckets, vector by vector, so groups of near-equal rows make no square of pairs and lose no match.

    Equal vectors are one class first, met by its smallest id. Bits grow with the number of classes so
    that buckets stay near ``bucket_rows`` rows where vectors are spread, and tables with the bits so that a match
    at ``threshold`` shares no bucket no more often than by the given numbers (0.0033 at 0.9). A crowded
    bucket is dealt into blocks and each two blocks are one cell, so no task holds it whole; small buckets share a cell.
    Rows with a null id, and vectors that are null, empty, zero or not finite, meet nothing.
    """
    rows = vectors.select("id", "x").where("id is not null").withColumn("_c", cosine(F.col("x"), F.col("x"))).where("_c is not null and not isnan(_c)")
    rows = rows.select("id", "x", F.xxhash64("x").alias("h"), F.xxhash64(F.lit(1), "x").alias("g"))
    classes = stored(rows.groupBy("h", "g").agg(F.min("id").alias("rep"), F.min_by("x", "id").alias("x")))
    n = classes.count()
    meet = 1 - np.arccos(threshold) / np.pi
    wide = max(bits, int(np.ceil(np.log2(max(n / bucket_rows, 1)))))
    many = tables if wide == bits else int(np.ceil(tables * np.log1p(-(meet**bits)) / np.log1p(-(meet**wide))))
    limit, words = _most_bits(threshold, sketch, 0.001), sketch // 64

    @F.pandas_udf("struct<keys:array<long>,signs:binary>")
    def signed(batch: pd.Series) -> pd.DataFrame:
        keys, signs, sizes = np.empty(len(batch), object), np.empty(len(batch), object), batch.map(len).to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            for part in np.array_split(at, -(-len(at) // 1024)):
                x = np.stack(batch.iloc[part].to_numpy()).astype(np.float32)
                own = _signs(x, (seed, int(size)), many * wide).reshape(len(part), many, wide)
                keys[part] = list(own @ (1 << np.arange(wide)))
                signs[part] = [s.tobytes() for s in np.packbits(_signs(x, (seed, int(size), 1), sketch), axis=1)]
        return pd.DataFrame({"keys": keys, "signs": signs})

    found = classes.select("rep", F.size("x").alias("d"), signed("x").alias("s")).select("rep", "d", "s.signs", F.posexplode("s.keys").alias("t", "key"))
    posted = found.select("rep", "signs", F.xxhash64("d", "t", "key").alias("bucket"))
    crowded = stored(posted.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > block).select("bucket", F.ceil(F.col("m") / block).cast("int").alias("s")))
    packs = max(1, n * many // (2 * block))

    def celled(posts: DataFrame) -> DataFrame:
        """``posts`` in cells (cell, i, j): whole small buckets, or two blocks of a crowded one."""
        dealt = posts.join(crowded, "bucket", "left").withColumn("s", F.coalesce("s", F.lit(1))).withColumn("b", F.expr("cast(pmod(xxhash64(rep), s) as int)"))
        dealt = dealt.withColumn("o", F.explode(F.expr("sequence(0, s - 1)"))).withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).drop("o")
        return dealt.withColumn("cell", F.when(F.col("s") == 1, F.pmod("bucket", F.lit(packs))).otherwise(F.col("bucket"))).drop("s")

    def buckets(cell: pa.Table):
        """Ranks of the ids in each bucket of a cell, ascending, with their places; whether the cell is of two blocks."""
        names, rank = np.unique(cell["rep"].to_numpy(), return_inverse=True)
        bucket, across = cell["bucket"].to_numpy(), cell["i"][0].as_py() != cell["j"][0].as_py()
        order = np.lexsort((rank, bucket))
        return names, rank, across, [at for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(at) > 1]

    def near(cell: pa.Table) -> pa.Table:
        names, rank, across, groups = buckets(cell)
        signs = np.frombuffer(b"".join(cell["signs"].to_pylist()), np.uint64).reshape(-1, words)
        b, who, with_, last = cell["b"].to_numpy(), [], [], []
        for at in groups:
            for part in np.array_split(np.arange(len(at)), -(-len(at) // 64)):
                good = np.bitwise_count(signs[at[part]][:, None, :] ^ signs[at][None, :, :]).sum(2, dtype=np.int16) <= limit
                good &= np.arange(len(at))[None, :] < part[:, None]
                if across:
                    good &= b[at][None, :] != b[at[part]][:, None]
                count = good.cumsum(1, dtype=np.int32)
                good &= count <= first
                x, y = np.nonzero(good)
                who.append(rank[at[part[x]]])
                with_.append(rank[at[y]])
                # of a row with more partners than were taken, the last one taken is marked
                last.append((count[x, -1] > first) & (count[x, y] == first))
        join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        return pa.table({"rep": pa.array(names[join(who).astype(np.int64)], cell["rep"].type), "other": pa.array(names[join(with_).astype(np.int64)], cell["rep"].type), "last": pa.array(join(last).astype(bool))})

    def whole(cell: pa.Table) -> pa.Table:
        names, rank, across, groups = buckets(cell)
        b, open_, who, other, sim = cell["b"].to_numpy(), cell["open"].to_numpy(), [], [], []
        for at in groups:
            x = np.stack(cell["x"].take(pa.array(at)).to_pandas().to_numpy()).astype(float)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            mine = np.flatnonzero(open_[at])
            for part in np.array_split(mine, -(-max(len(mine), 1) // 256)):
                s = np.floor(x[part] @ x.T * 1e6 + 0.5) / 1e6
                good = (s >= threshold) & (np.arange(len(at))[None, :] < part[:, None])
                if across:
                    good &= b[at][None, :] != b[at[part]][:, None]
                hit = np.flatnonzero(good.any(1))
                best = good[hit].argmax(1)  # in order of rank, so the smallest id
                who.append(rank[at[part[hit]]])
                other.append(rank[at[best]])
                sim.append(s[hit, best])
        join = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.zeros(0, kind)
        kind = cell["rep"].type
        return pa.table({"rep": pa.array(names[join(who, np.int64)], kind), "other": pa.array(names[join(other, np.int64)], kind), "similarity": join(sim, float)})

    kind = vectors.schema["id"].dataType.simpleString()
    pairs = celled(posted).groupBy("cell", "i", "j").applyInArrow(near, f"rep {kind}, other {kind}, last boolean")
    pairs = stored(pairs.groupBy("rep", "other").agg(F.max("last").alias("last")))
    left = pairs.join(classes.select("rep", "x"), "rep").select("rep", "x", "other", "last")
    right = classes.select(F.col("rep").alias("other"), F.col("x").alias("y"))
    checked = stored(left.join(right, "other").where("size(x) = size(y)").select("rep", "other", "last", F.round(cosine(F.col("x"), F.col("y")), 6).alias("similarity")))
    good = checked.where(F.col("similarity") >= threshold).select("rep", "other", "similarity")
    best = checked.groupBy("rep").agg(F.min(F.when(F.col("similarity") >= threshold, F.col("other"))).alias("best"), F.min(F.when(F.col("last"), F.col("other"))).alias("upto"))
    open_ = stored(best.where("upto < best or (best is null and upto is not null)").select("rep"))
    asked = posted.join(open_, "rep").select("rep", "bucket", F.lit(True).alias("open"))
    others = posted.join(asked.select("bucket").distinct(), "bucket", "left_semi").join(open_.withColumn("open", F.lit(True)), "rep", "left")
    again = celled(others.join(classes.select("rep", "x"), "rep").select("rep", "x", "bucket", F.coalesce("open", F.lit(False)).alias("open")))
    again = again.groupBy("cell", "i", "j").applyInArrow(whole, f"rep {kind}, other {kind}, similarity double")
    met = good.unionByName(again).groupBy("rep").agg(F.min("other").alias("cached_id"), F.min_by("similarity", "other").alias("similarity"))
    joined = classes.select("h", "g", "rep").join(met, "rep", "left")
    # a copy of a class meets what the class meets, or else the class itself
    out = rows.select("id", "h", "g").join(joined, ["h", "g"]).where("cached_id is not null or rep < id")
    return out.select("id", F.coalesce("cached_id", "rep").alias("cached_id"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
