"""Composite jobs: curation waterfall of preference pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import quality


def curation_waterfall(scored: DataFrame, keep: float = 0.6) -> DataFrame:
    """Counts after each step: no duplicates and no short texts, margin >= 0, the strongest ``keep``,
    no critical disagreement of the reward models.

    ``scored``: id, chosen, rejected, margin, implicit. Scores stay columns, so they stay aligned with pairs.
    """
    bad = quality.pair_duplicates(scored).select("id").union(quality.short_responses(scored).where("severity = 'high'").select("id")).distinct()
    sound = scored.join(bad, "id", "left_anti")
    positive = quality.filter_by_margin(sound)
    strong = quality.filter_by_strength(positive, keep)
    agreed = strong.join(quality.reward_disagreement(strong).where("level = 'critical'").select("id"), "id", "left_anti")
    step = lambda df, i, name: df.agg(F.lit(i).alias("step"), F.lit(name).alias("name"), F.count("*").alias("n"))
    return step(scored, 0, "all").unionByName(step(sound, 1, "sound")).unionByName(step(positive, 2, "positive")).unionByName(step(strong, 3, "strong")).unionByName(step(agreed, 4, "agreed"))
