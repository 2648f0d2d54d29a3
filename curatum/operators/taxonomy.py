"""Subjects and their domains: search, listing, coverage and custom subjects.

The taxonomy is a parameter: a table (domain, subject) of a few hundred rows, which Spark
broadcasts by its measured size. Nothing here depends on its content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def search(subjects: DataFrame, query: str) -> DataFrame:
    """(domain, subject, n): subjects that hold ``query``, whatever its case, and how many there are; a blank query is an error."""
    wanted = query.strip().lower()
    if not wanted:
        raise ValueError("the query is blank")
    found = subjects.where(F.contains(F.lower("subject"), F.lit(wanted)))
    return found.crossJoin(F.broadcast(found.agg(F.count("*").alias("n")))).select("domain", "subject", "n")


def domain(subjects: DataFrame, name: str) -> DataFrame:
    """(domain, subject, n): the subjects of the domain ``name``, whatever its case, and their number."""
    found = subjects.where(F.lower("domain") == name.strip().lower())
    return found.crossJoin(F.broadcast(found.agg(F.count("*").alias("n")))).select("domain", "subject", "n")


def coverage(subjects: DataFrame, responses: DataFrame) -> DataFrame:
    """(domain, probed, total): how many subjects of each domain have responses."""
    hit = responses.select("subject").distinct().withColumn("hit", F.lit(1))
    return subjects.join(hit, "subject", "left").groupBy("domain").agg(F.count("hit").alias("probed"), F.count("*").alias("total"))


def never_probed(subjects: DataFrame, responses: DataFrame) -> DataFrame:
    """(domain, subject) without a response; a subject's responses are one row before the join."""
    return subjects.join(responses.select("subject").distinct(), "subject", "left_anti").select("domain", "subject")


def custom_subjects(subjects: DataFrame, original: tuple[str, ...]) -> DataFrame:
    """Subjects outside the ``original`` domains; a subject that is also in one of them is none."""
    return subjects.select("subject").distinct().join(subjects.where(F.col("domain").isin(*original)), "subject", "left_anti")
