"""Statistics over scored answers and calibration of predicted probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ingest import stored


def accuracy_by_domain(responses: DataFrame) -> DataFrame:
    """Mean of the subjects' mean accuracies by domain, the subject's part before the first underscore."""
    by_subject = responses.groupBy("subject").agg(F.avg(F.col("right").cast("double")).alias("a"))
    domain = F.when(F.coalesce("subject", F.lit("")) == "", "unknown").otherwise(F.split_part("subject", F.lit("_"), F.lit(1)))
    return by_subject.groupBy(domain.alias("domain")).agg(F.round(F.avg("a") * 100, 6).alias("accuracy"))


def overview(responses: DataFrame, entries: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts of responses, entries, subjects (null is none) and runs, in one row."""
    counted = lambda df, name: df.agg(F.count("*").alias(name))
    asked = responses.agg(F.count("*").alias("total_questions"), F.count_distinct("subject").alias("subjects"))
    return asked.crossJoin(counted(entries, "training_pairs")).crossJoin(counted(runs, "training_runs"))


def latest_responses(responses: DataFrame, last: int = 100) -> DataFrame:
    return responses.orderBy(F.col("created_at").desc(), "id").limit(last)


def eval_accuracy(responses: DataFrame, *by: str) -> DataFrame:
    """Share of right answers by model and ``by``; an answer that is missing or failed counts as wrong."""
    return responses.groupBy("model", *by).agg(F.round(F.avg(F.coalesce("right", F.lit(False)).cast("double")), 6).alias("score"))


def calibration_split(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add ``part``: six tenths train, two calibrate, two test, by the key."""
    at = F.pmod(F.col(key), F.lit(10))
    return rows.withColumn("part", F.when(at < 6, "train").when(at < 8, "calibrate").otherwise("test"))


def subject_bars(responses: DataFrame, top: int = 12) -> DataFrame:
    g = responses.groupBy(F.regexp_replace("subject", "_", " ").alias("name")).agg(F.count_if("right").alias("n_right"), F.count_if(~F.col("right")).alias("n_wrong"), F.count("*").alias("total"))
    return g.orderBy(F.col("total").desc(), "name").limit(top)


def error_distribution(responses: DataFrame) -> DataFrame:
    far = F.abs(F.ascii("letter") - F.ascii("key_letter"))
    kind = F.when(F.col("letter").isNull(), "other").when(far == 1, "close").when(F.col("confidence") < 0.3, "factual").otherwise("reasoning")
    return responses.where(~F.col("right")).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def timeline(responses: DataFrame, last: int = 15) -> DataFrame:
    """Accuracy per model and day: the latest ``last`` points, by a top-k sort."""
    g = responses.groupBy(F.substring("model", 1, 15).alias("model"), F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg(F.col("right").cast("double")) * 100, 6).alias("accuracy"))
    return g.orderBy(F.col("day").desc(), "model").limit(last)


def compare(responses: DataFrame, base: str, tuned: str) -> DataFrame:
    """Accuracy of two models by subject, and what the second gains."""
    acc = lambda m: F.avg(F.when(F.col("model") == m, F.col("right").cast("double")))
    g = responses.where(F.col("model").isin(base, tuned)).groupBy("subject").agg(acc(base).alias("b"), acc(tuned).alias("t"))
    return g.select("subject", F.round("b", 6).alias("base"), F.round("t", 6).alias("tuned"), F.round(F.col("t") - F.col("b"), 6).alias("gain"), F.round(F.when(F.col("b") > 0, (F.col("t") - F.col("b")) / F.col("b") * 100).otherwise(0.0), 6).alias("gain_pct"))


def _domain() -> Column:
    return F.when(F.coalesce("subject", F.lit("")) == "", "unknown").otherwise(F.split_part("subject", F.lit("_"), F.lit(1)))


def domain_matrix(responses: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """Accuracy by domain with a column for each of ``models``."""
    g = responses.groupBy(_domain().alias("domain")).pivot("model", list(models)).agg(F.round(F.avg(F.col("right").cast("double")), 6))
    return g.select("domain", *(F.col(f"`{m}`").alias(m) for m in models))


def _subtotals(grouped) -> DataFrame:
    return grouped.agg(F.grouping_id().cast("int").alias("level"), F.round(F.avg(F.col("right").cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))


def domain_rollup(responses: DataFrame) -> DataFrame:
    """(domain, subject, level, accuracy, n): subjects (level 0), domains (1) and all (3)."""
    return _subtotals(responses.withColumn("domain", _domain()).rollup("domain", "subject"))


def domain_cube(responses: DataFrame) -> DataFrame:
    """(domain, model, level, accuracy, n): all subtotals of domain and model; level names the columns summed over."""
    return _subtotals(responses.withColumn("domain", _domain()).cube("domain", "model"))


def reliability_bins(rows: DataFrame, bins: int = 10, *by: str) -> DataFrame:
    """Equal-width bins of p: n, mean confidence, accuracy."""
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return rows.groupBy(*by, at).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("confidence"), F.round(F.avg("y"), 6).alias("accuracy"))


def calibration_metrics(rows: DataFrame, bins: int = 10) -> DataFrame:
    """ECE, MCE, Brier and negative log-likelihood; rows are aggregated to bins before anything global."""
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")
    q = F.least(F.lit(1 - 1e-15), F.greatest(F.lit(1e-15), F.col("p")))
    nll = -(F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q))
    g = rows.groupBy(at).agg(F.count("*").alias("n"), F.avg("p").alias("c"), F.avg("y").alias("a"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("b"), F.sum(nll).alias("l"))
    gap, n = F.abs(F.col("c") - F.col("a")), F.sum("n")
    return g.agg(F.round(F.sum(gap * F.col("n")) / n, 6).alias("ece"), F.round(F.max(gap), 6).alias("mce"), F.round(F.sum("b") / n, 6).alias("brier"), F.round(F.sum("l") / n, 6).alias("nll"))


def group_calibration(rows: DataFrame, group: str, *, bins: int = 10, least: int = 50, key: str = "doc_id") -> DataFrame:
    """(group, bin, n, confidence, accuracy): bins of equal mass of each group with ``least`` rows or more,
    in order of (p, key), as ntile deals them.

    Rows are counted by score first, so ties are weights; prefix sums over score ranges place each score.
    A score whose ties lie in several bins (fewer than ``bins`` a group) is cut in order of ``key``: its
    rows, and only these, are placed by prefix sums over ranges of the key, so that neither a group nor
    a tie is sorted in one task. Rows without p take no part; a null group is a group.
    """
    named = rows.where(F.col("p").isNotNull()).select(F.col(group).alias("_g"), "p", "y", F.col(key).alias("_k"))
    scores = stored(named.groupBy("_g", "p").agg(F.count("*").alias("_n"), F.sum("y").alias("_y"), F.min("_k").alias("_low"), F.max("_k").alias("_high")))
    cells = scores.groupBy("_g", _cell().alias("_c")).agg(F.sum("_n").alias("_m"))
    ahead, whole = W.partitionBy("_g").orderBy("_c").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("_g")
    cells = cells.select(F.col("_g").alias("_h"), "_c", F.coalesce(F.sum("_m").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_m").over(whole).alias("_total")).where(F.col("_total") >= least)
    within = W.partitionBy("_g", _cell()).orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    placed = scores.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(cells, F.col("_g").eqNullSafe(F.col("_h")) & (_cell() == F.col("_c")))
    # the first total % bins bins hold one row more, as ntile has it
    small, more = F.floor(F.col("_total") / bins), F.col("_total") % bins
    first = more * (small + 1)
    at = lambda rank: F.when(rank < first, F.floor(rank / (small + 1))).otherwise(more + F.floor((rank - first) / F.greatest(small, F.lit(1)))).cast("int")
    rank = F.col("_ahead") + F.col("_before")
    placed = stored(placed.select("_g", "p", "_n", "_y", "_low", "_high", "_total", rank.alias("_rank"), at(rank).alias("_from"), at(rank + F.col("_n") - 1).alias("_to")))
    kept = placed.where("_from = _to").select("_g", F.col("_from").alias("bin"), "_n", (F.col("p") * F.col("_n")).alias("_p"), "_y")

    cut = placed.where("_from < _to").select(F.col("_g").alias("_h"), F.col("p").alias("_q"), "_total", F.col("_rank").alias("_start"), "_low", "_high")
    tied = named.join(cut, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("p") == F.col("_q")))
    span = F.greatest(F.col("_high").cast("double") - F.col("_low").cast("double"), F.lit(1.0))
    tied = tied.withColumn("_c", F.coalesce(F.floor((F.col("_k").cast("double") - F.col("_low").cast("double")) / span * CELLS), F.lit(-1)))
    ranges = tied.groupBy("_g", "p", "_c").agg(F.count("*").alias("_m"))
    ahead = W.partitionBy("_g", "p").orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(F.col("_g").alias("_i"), F.col("p").alias("_r"), F.col("_c").alias("_d"), F.coalesce(F.sum("_m").over(ahead), F.lit(0)).alias("_ahead"))
    tied = tied.join(ranges, F.col("_g").eqNullSafe(F.col("_i")) & (F.col("p") == F.col("_r")) & (F.col("_c") == F.col("_d")))
    place = F.col("_start") + F.col("_ahead") + F.row_number().over(W.partitionBy("_g", "p", "_c").orderBy("_k")) - 1
    dealt = tied.withColumn("_rank", place).groupBy("_g", at(F.col("_rank")).alias("bin"), "p").agg(F.count("*").alias("_n"), F.sum("y").alias("_y"))
    both = kept.unionByName(dealt.select("_g", "bin", "_n", (F.col("p") * F.col("_n")).alias("_p"), "_y"))
    n = F.sum("_n")
    return both.groupBy(F.col("_g").alias(group), "bin").agg(n.alias("n"), F.round(F.sum("_p") / n, 6).alias("confidence"), F.round(F.sum("_y") / n, 6).alias("accuracy"))


#: Score ranges in [0, 1] over which prefix sums are taken.
CELLS = 4096


def _cell(p: str = "p") -> Column:
    return F.floor(F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0)) * CELLS).cast("int")


def _running(scores: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    """``scores``, one row per distinct ``p`` in [0, 1], with ``below_x`` for each sum x: the total of x
    over smaller scores, and ``all_x``. Ranges of scores are summed first, scores within their range."""
    placed = scores.withColumn("_cell", _cell())
    cells = placed.groupBy("_cell").agg(*(F.sum(x).alias(x) for x in sums))
    ahead, whole = W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    cells = cells.select(F.col("_cell").alias("_c"), *(F.coalesce(F.sum(x).over(ahead), F.lit(0)).alias(f"_b_{x}") for x in sums), *(F.sum(x).over(whole).alias(f"all_{x}") for x in sums))
    within = W.partitionBy("_cell").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    joined = placed.join(cells, F.col("_cell") == F.col("_c"))
    return joined.select(*scores.columns, *((F.col(f"_b_{x}") + F.coalesce(F.sum(x).over(within), F.lit(0))).alias(f"below_{x}") for x in sums), *(f"all_{x}" for x in sums))


def auroc(rows: DataFrame) -> DataFrame:
    """Rank statistic with ties at half."""
    g = rows.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    g = _running(g, ("neg",)).withColumn("wins", F.col("pos") * (F.col("below_neg") + F.col("neg") / 2.0))
    return g.agg(F.round(F.sum("wins") / (F.sum("pos") * F.sum("neg")), 6).alias("auroc"))


def threshold_sweep(rows: DataFrame) -> DataFrame:
    """For each score c: accuracy and coverage of the rows with p >= c."""
    g = _running(rows.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("pos")), ("n", "pos"))
    kept, good = F.col("all_n") - F.col("below_n"), F.col("all_pos") - F.col("below_pos")
    return g.select("p", F.round(good / kept, 6).alias("accuracy"), F.round(kept / F.col("all_n"), 6).alias("coverage"))


def threshold_choice(rows: DataFrame, target: float = 0.95, reject_below: float = 0.3) -> DataFrame:
    """(accept_from, edit_from): the smallest score from which on accuracy meets ``target``, and the largest
    score below which it stays under ``reject_below``; null where there is none."""
    g = _running(rows.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("pos")), ("n", "pos"))
    above = (F.col("all_pos") - F.col("below_pos")) / (F.col("all_n") - F.col("below_n"))
    below = F.col("below_pos") / F.nullif(F.col("below_n"), F.lit(0))
    return g.agg(F.min(F.when(above >= target, F.col("p"))).alias("accept_from"), F.max(F.when(below < reject_below, F.col("p"))).alias("edit_from"))


def three_way(rows: DataFrame, choice: DataFrame) -> DataFrame:
    """``rows`` with ``route``: accept, edit or reject by the thresholds of ``choice`` (one row); edit is what lies between."""
    route = F.when(F.col("p") >= F.col("accept_from"), "accept").when(F.col("p") < F.col("edit_from"), "reject").otherwise("edit")
    return rows.crossJoin(F.broadcast(choice)).withColumn("route", route).select(*rows.columns, "route")


def conformal_threshold(rows: DataFrame, alpha: float = 0.1) -> DataFrame:
    """The finite-sample (1 - alpha) quantile of 1 - p over positive rows, from counts by score."""
    g = _running(rows.where("y = 1").groupBy((1 - F.col("p")).alias("p")).agg(F.count("*").alias("n")), ("n",))
    reached = F.col("below_n") + F.col("n") >= F.least(F.ceil((F.col("all_n") + 1) * (1 - alpha)), F.col("all_n"))
    return g.where(reached).agg(F.round(F.min("p"), 6).alias("threshold"))


def platt_fit(rows: DataFrame, iterations: int = 100) -> DataFrame:
    """One row (a, b) of sigma(a p + b), fitted without regularisation; rows are counted by (p, y) first."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    counts = rows.where("p is not null and y is not null").groupBy("p", F.col("y").cast("double").alias("y")).agg(F.count("*").cast("double").alias("w"))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=iterations, regParam=0.0).fit(VectorAssembler(inputCols=["p"], outputCol="x").transform(counts))
    return rows.sparkSession.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "a double, b double")


def cost_threshold(rows: DataFrame, *, false_accept: float = 100.0, review: float = 5.0, edit: float = 3.0, bins: int = 10) -> DataFrame:
    """The cheapest (accept_from, edit_from): accept from the one, edit from the other, review below.

    Rows are binned first; only the bins and the grid of threshold pairs, both of fixed size, are crossed.
    """
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    g = rows.groupBy(at).agg(F.count("*").alias("n"), F.sum(1 - F.col("y")).alias("wrong"))
    grid = rows.sparkSession.range(bins + 1).select(F.col("id").cast("int").alias("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("a"))).alias("e"))
    cost = F.when(F.col("bin") >= F.col("a"), F.col("wrong") * false_accept).when(F.col("bin") >= F.col("e"), F.col("n") * edit).otherwise(F.col("n") * review)
    total = g.crossJoin(F.broadcast(grid)).groupBy("a", "e").agg(F.sum(cost).alias("cost"))
    return total.orderBy("cost", "a", "e").limit(1).select((F.col("a") / bins).alias("accept_from"), (F.col("e") / bins).alias("edit_from"), F.round("cost", 6).alias("cost"))


def run_history(runs: DataFrame, last: int = 100) -> DataFrame:
    """The newest training runs."""
    return runs.orderBy(F.col("started_at").desc(), "id").limit(last)


def eval_history(results: DataFrame, last: int = 100) -> DataFrame:
    """The newest evaluation results."""
    return results.orderBy(F.col("created_at").desc(), "id").limit(last)
