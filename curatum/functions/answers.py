"""Column expressions over model answers: letters, confidence, routing, error classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LETTERS = ("A", "B", "C", "D")
#: The answer patterns, tried in this order.
ANSWER_PATTERNS = (
    r"(?i)(?:answer\s+is\s*)([ABCD])",
    r"(?i)(?:answer\s*:\s*)([ABCD])",
    r"\b([ABCD])\b",
    r"\(([ABCD])\)",
    r"(?m)^([ABCD])\)",
)
#: Phrases that mark hedging and confident answers.
HEDGING = r"\b(?:i think|i believe|maybe|perhaps|not sure|uncertain|could be|might be|probably|likely)\b"
CONFIDENT = r"\b(?:definitely|certainly|absolutely|clearly|obviously|the answer is)\b"
#: Marks of the error classes, in order of precedence.
MATH_WORDS = r"calculate|compute|solve|equation|sum|product|derivative|integral|evaluate"
CALCULATION = r"\d+\s*[+\-*/]\s*\d+|\b(?:calculation|compute|equals|sum|product|difference)\b"
REASONING = r"\b(?:therefore|thus|hence|so|because|since|implies)\b"
INCOMPLETE = r"\b(?:not sure|partial|maybe|possibly|might be|could be|i think)\b"


def letter_at(index: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, LETTERS)), index + 1)


def index_of(letter: Column) -> Column:
    """0 to 3 for A to D, null for anything else."""
    return F.nullif(F.array_position(F.array(*map(F.lit, LETTERS)), letter), F.lit(0)).cast("int") - 1


def answer_letter(response: Column) -> Column:
    """The letter a response answers with, by the first pattern that matches; null if none does.

    The last two patterns are not tried: their letters stand alone, so the third has matched. White space
    around a response changes no match. The first letter found, in the order of the patterns, is taken at
    once, so that each is searched once.
    """
    found = F.concat(*(F.regexp_extract(response, p, 1) for p in ANSWER_PATTERNS[:3]))
    return F.nullif(F.upper(F.substring(found, 1, 1)), F.lit(""))


def is_right(letter: Column, key: Column) -> Column:
    return F.coalesce(F.upper(letter) == F.upper(key), F.lit(False))


def heuristic_confidence(letter: Column, right: Column, response: Column) -> Column:
    low = F.lower(response)
    hedges, sure = low.rlike(HEDGING), low.rlike(CONFIDENT)
    bonus = lambda test, x: F.when(test, F.lit(x)).otherwise(F.lit(0.0))
    raw = F.when(right, F.lit(0.8) + bonus(hedges, 0.15) + bonus(sure, 0.05)).otherwise(F.lit(0.2) + bonus(sure, 0.3) - bonus(hedges, 0.1))
    return F.when(letter.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def layered_confidence(key_right: Column, judge_right: Column, has_evidence: Column) -> Column:
    """An answer key decides; else a judge, with more weight if it had evidence; else 0.5."""
    return (
        F.when(key_right, 1.0).when(~key_right, 0.0)
        .when(judge_right, F.when(has_evidence, 0.9).otherwise(0.7))
        .when(~judge_right, F.when(has_evidence, 0.3).otherwise(0.2)).otherwise(0.5)
    )


def route(confidence: Column, threshold: float = 0.7) -> Column:
    return F.when(confidence >= threshold, "auto_approved").when(confidence <= 0, "rejected").otherwise("needs_review")


def error_type(letter: Column, key_index: Column, question: Column, response: Column) -> Column:
    """Why an answer is wrong; ``none`` for right ones."""
    chosen, low = index_of(letter), F.lower(response)
    by_text = (
        F.when(F.lower(question).rlike(MATH_WORDS) & low.rlike(CALCULATION), "calculation_error")
        .when(low.rlike(REASONING), "reasoning_error").when(low.rlike(INCOMPLETE), "incomplete_answer").otherwise("factual_error")
    )
    by_place = F.when(F.abs(chosen - key_index) == 1, "close_confusion").otherwise("distant_confusion")
    return F.when(chosen.isNull(), "no_answer").when(chosen == key_index, "none").when(F.coalesce(response, F.lit("")) != "", by_text).otherwise(by_place)


def answer_text(letter: Column, choice: Column) -> Column:
    return F.concat(F.lit("The answer is "), letter, F.lit(") "), choice)
