"""Judge verdicts: consensus, cascades, panels, agreement, actions and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def consensus(verdicts: DataFrame) -> DataFrame:
    """Majority of each entry's verdicts; a tie goes to the first of the most confident. One aggregation."""
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.5))))
    rows = verdicts.select("entry_id", "judge_no", "correct", sure.alias("s"))
    g = rows.groupBy("entry_id").agg(
        F.count("*").alias("n"), F.count_if("correct").alias("yes"), F.max_by("correct", F.struct("s", -F.col("judge_no"))).alias("top"),
        F.avg(F.when(F.col("correct"), F.col("s"))).alias("sure_yes"), F.avg(F.when(~F.col("correct"), F.col("s"))).alias("sure_no"),
    )
    no = F.col("n") - F.col("yes")
    verdict = F.when(F.col("yes") > no, True).when(F.col("yes") < no, False).otherwise(F.col("top"))
    g = g.withColumn("correct", verdict)
    agree = F.when(F.col("correct"), F.col("yes")).otherwise(no)
    return g.select("entry_id", "correct", F.round(F.when(F.col("correct"), F.col("sure_yes")).otherwise(F.col("sure_no")), 6).alias("confidence"), F.round(agree / F.col("n"), 6).alias("agreement"), F.when(F.col("correct"), "accept").otherwise("reject").alias("action"))


def cascade(verdicts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Judge 2 counts only where judge 1 is unsure, judge 3 only where 1 and 2 disagree; then consensus."""
    wide = verdicts.groupBy("entry_id").agg(*(F.max(F.when(F.col("judge_no") == j, F.col(c))).alias(f"{c}{j}") for j in (1, 2, 3) for c in ("correct", "confidence")))
    escalated = (F.col("confidence1") < threshold) & F.col("correct2").isNotNull()
    tie = escalated & (F.col("correct1") != F.col("correct2")) & F.col("correct3").isNotNull()
    flags = wide.select("entry_id", escalated.alias("escalated"), tie.alias("tiebreaker_used"))
    asked = verdicts.join(flags, "entry_id").where((F.col("judge_no") == 1) | ((F.col("judge_no") == 2) & F.col("escalated")) | ((F.col("judge_no") == 3) & F.col("tiebreaker_used")))
    return consensus(asked).join(flags, "entry_id")


def cross_verify(verdicts: DataFrame) -> DataFrame:
    """Judge 1 on the chosen text and judge 2 on the rejected one side by side, with ``should_edit``."""
    w = verdicts.groupBy("entry_id").agg(*(F.max(F.when(F.col("judge_no") == j, F.col(c))).alias(f"{c}{j}") for j in (1, 2) for c in ("correct", "confidence")))
    return w.withColumn("should_edit", F.coalesce(~F.col("correct1") & F.col("correct2"), F.lit(False)))


def actions(entries: DataFrame, verdicts: DataFrame, evidence: DataFrame | None = None, *, threshold: float = 0.7) -> DataFrame:
    """(entry_id, should_edit, from_evidence, action, confidence) of each of ``entries`` (entry_id).

    A swap is an edit with the greater confidence; an unsure entry with ``evidence`` (entry_id,
    rejudged: confidence in the corrected text or null) is an edit too, whose confidence is the
    greater of its own and the second judgement (0.7 if there is none); otherwise a sure and
    right one is accepted, one below 0.3 rejected, the rest accepted. An entry no judge has seen
    is neutral: right with confidence 0.5.
    """
    found = evidence.select("entry_id", "rejudged", F.lit(True).alias("found")) if evidence is not None else entries.select("entry_id", F.lit(None).cast("double").alias("rejudged"), F.lit(False).alias("found")).limit(0)
    rows = entries.select("entry_id").join(cross_verify(verdicts), "entry_id", "left").join(found, "entry_id", "left")
    swap, right, sure = F.coalesce("should_edit", F.lit(False)), F.coalesce("correct1", F.lit(True)), F.coalesce("confidence1", F.lit(0.5))
    edited = ~swap & F.coalesce("found", F.lit(False)) & (sure < threshold)
    last = F.when(swap, F.greatest(sure, F.coalesce("confidence2", F.lit(0.5)))).when(edited, F.greatest(sure, F.coalesce("rejudged", F.lit(0.7)))).otherwise(sure)
    action = F.when(swap | edited, "edit").when((sure >= 0.7) & right, "accept").when(sure < 0.3, "reject").otherwise("accept")
    return rows.select("entry_id", swap.alias("should_edit"), edited.alias("from_evidence"), action.alias("action"), last.alias("confidence"))


def _latest(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("entry_id").agg(F.max_by(F.struct("action", "edited_chosen", "edited_rejected", "at"), F.struct("at", "action")).alias("d")).select("entry_id", "d.*")


def apply_decisions(entries: DataFrame, decisions: DataFrame, skip_status: str = "skipped") -> DataFrame:
    """Entries (id, chosen, rejected, status) after the latest decision (entry_id, action, edited_chosen,
    edited_rejected, at) of each, with ``reviewed_at``, null where there is none. Of decisions at one
    time the last in order of the action counts."""
    status = F.when(F.col("action") == "accept", "accepted").when(F.col("action") == "reject", "rejected").when(F.col("action") == "edit", "edited").when(F.col("action") == "skip", skip_status).otherwise(F.col("status"))
    text = lambda new, old: F.coalesce(F.when(F.col("action") == "edit", F.nullif(F.col(new), F.lit(""))), F.col(old)).alias(old)
    return entries.join(_latest(decisions), F.col("id") == F.col("entry_id"), "left").select("id", text("edited_chosen", "chosen"), text("edited_rejected", "rejected"), status.alias("status"), F.col("at").alias("reviewed_at"))


def review_sessions(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """One session row per decision on a known entry: training_entry_id, action, edited texts, reviewed_at."""
    known = decisions.join(entries.select(F.col("id").alias("entry_id")), "entry_id", "left_semi")
    return known.select(F.col("entry_id").alias("training_entry_id"), "action", "edited_chosen", "edited_rejected", F.col("at").alias("reviewed_at"))


def unknown_decisions(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions whose entry does not exist."""
    return decisions.join(entries.select(F.col("id").alias("entry_id")), "entry_id", "left_anti")


def panel(verdicts: DataFrame) -> DataFrame:
    """Majority, weighted majority, unanimity, two-thirds rule and normalised vote entropy of each entry."""
    g = verdicts.groupBy("entry_id").agg(F.count("*").alias("n"), F.count_if("correct").alias("yes"), F.sum(F.when(F.col("correct"), F.col("confidence")).otherwise(-F.col("confidence"))).alias("w"), F.sum(F.when(F.col("correct"), F.sqrt("confidence")).otherwise(-F.sqrt("confidence"))).alias("r"))
    share = F.col("yes") / F.col("n")
    h = lambda p: F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p)) - (1 - p) * F.log2(1 - p))
    return g.select("entry_id", (F.col("yes") * 2 > F.col("n")).alias("majority"), (F.round("w", 6) > 0).alias("weighted"), (F.round("r", 6) > 0).alias("root_weighted"), F.col("yes").isin(0).__or__(F.col("yes") == F.col("n")).alias("unanimous"), F.when(share * 3 >= 2, "accept").when(share * 3 <= 1, "reject").otherwise("escalate").alias("two_thirds"), F.round(1 - h(share), 6).alias("certainty"))


def cohen_kappa(verdicts: DataFrame) -> DataFrame:
    """Kappa of each pair of judges: a self join on the entry and one contingency aggregate."""
    a, b = verdicts.select("entry_id", F.col("judge_no").alias("judge_a"), F.col("correct").cast("int").alias("x")), verdicts.select("entry_id", F.col("judge_no").alias("judge_b"), F.col("correct").cast("int").alias("y"))
    g = a.join(b, "entry_id").where("judge_a < judge_b").groupBy("judge_a", "judge_b").agg(F.avg((F.col("x") == F.col("y")).cast("double")).alias("po"), F.avg("x").alias("px"), F.avg("y").alias("py"))
    pe = F.col("px") * F.col("py") + (1 - F.col("px")) * (1 - F.col("py"))
    return g.select("judge_a", "judge_b", F.round("po", 6).alias("agreement"), F.round((F.col("po") - pe) / F.nullif(1 - pe, F.lit(0.0)), 6).alias("kappa"))


def fleiss_kappa(verdicts: DataFrame) -> DataFrame:
    g = verdicts.groupBy("entry_id").agg(F.count("*").alias("n"), F.count_if("correct").alias("yes")).where("n > 1")
    y, n = F.col("yes"), F.col("n")
    g = g.select(((y * y + (n - y) * (n - y) - n) / (n * (n - 1))).alias("p"), y, n)
    t = g.agg(F.avg("p").alias("p"), (F.sum("yes") / F.sum("n")).alias("share"))
    pe = F.col("share") * F.col("share") + (1 - F.col("share")) * (1 - F.col("share"))
    return t.select(F.round("p", 6).alias("observed"), F.round((F.col("p") - pe) / (1 - pe), 6).alias("kappa"))
