"""Probe prompts, scores, corrections and preference pairs over a table of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import answers as A
from .ingest import stored


def mcq_prompts(responses: DataFrame) -> DataFrame:
    """The multiple-choice prompt of each question."""
    title = F.initcap(F.regexp_replace("subject", "_", " "))
    head = F.when(F.coalesce("subject", F.lit("")) != "", F.concat(F.lit("Subject: "), title, F.lit("\n\n"))).otherwise("")
    lines = F.array_join(F.transform("choices", lambda c, i: F.concat(A.letter_at(i), F.lit(") "), c)), "\n")
    return responses.withColumn("prompt", F.concat(head, "question", F.lit("\n\n"), lines, F.lit("\n\nAnswer with a single letter (A, B, C, or D).")))


#: Ranges of ids, in each run and question, over which right answers are counted.
RANGES = 1024


def dpo_pairs(responses: DataFrame, *, weak_share: float = 0.3, least_pairs: int = 20) -> DataFrame:
    """Preference pairs per (model, subject) run: wrong answers, weak pairs from the first right
    answers, in order of (question_idx, id), up to ``weak_share`` of the wrong ones, and more right answers
    while a run has fewer than ``least_pairs``.

    The source is read once. Right answers are counted by run, question and range of ids; prefix sums
    show which ranges reach into a run's quotas, and only rows of a range that a quota cuts are ranked, within
    their range. So no run is sorted in one task, and rows that no quota takes are dropped at the first join.
    """
    run = ["model", "subject"]
    said = F.col("letter").isNotNull() & ~F.col("right")
    rows = stored(responses.where(F.col("right") | said))
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    at = F.floor((F.col("id") - F.lit(low or 0)) / F.lit(max((high or 0) - (low or 0), 1)) * RANGES)
    counts = rows.groupBy(*run, "question_idx", F.when(F.col("right"), at).alias("_at")).agg(F.count_if("right").alias("_n"), F.count_if(~F.col("right")).alias("_wrong"))
    by_run = W.partitionBy(*run)
    before = F.sum("_n").over(by_run.orderBy(F.col("question_idx").asc_nulls_first(), "_at")) - F.col("_n")
    counts = counts.select(*run, "question_idx", "_at", "_n", before.alias("_before"), F.sum("_wrong").over(by_run).alias("_wrong"), F.sum("_n").over(by_run).alias("_right"))
    counts = counts.withColumn("weak", F.least(F.floor(F.lit(weak_share) * F.col("_wrong")), "_right")).withColumn("extra", F.greatest(F.lit(0), F.lit(least_pairs) - F.col("_wrong") - F.col("weak")))
    quotas = stored(counts.where("_at is not null and _before < greatest(weak, extra)").select(*(F.col(c).alias(f"_{c}") for c in [*run, "question_idx"]), F.col("_at").alias("_range"), "_n", "_before", "weak", "extra"))
    same = F.col("right") & (at == F.col("_range"))
    for c in [*run, "question_idx"]:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    # an end of the sort key that differs for whole ranges: only where a quota ends inside is a place within the range needed
    inside = (F.col("weak") > F.col("_before")) & (F.col("weak") < F.col("_before") + F.col("_n")) | (F.col("extra") > F.col("_before")) & (F.col("extra") < F.col("_before") + F.col("_n"))
    right = rows.join(quotas, same).withColumn("_cut", inside)
    own = W.partitionBy(*run, "question_idx", "_range").orderBy("id")
    ranked = right.where("_cut").withColumn("place", F.col("_before") + F.row_number().over(own)).unionByName(right.where("not _cut").withColumn("place", F.col("_before") + 1))
    wrong = rows.where(said).withColumns({"weak": F.lit(0).cast("long"), "extra": F.lit(0).cast("long"), "place": F.lit(None).cast("long")})
    both = mcq_prompts(ranked.select(*rows.columns, "weak", "extra", "place").unionByName(wrong))

    key = A.answer_text(F.col("key_letter"), F.element_at("choices", F.col("key_idx") + 1))
    other = F.when(F.col("key_idx") == 0, 1).otherwise(0)
    model_choice = F.try_element_at("choices", A.index_of(F.col("letter")) + 1)
    kind = lambda name, when, rejected: F.when(when, F.struct(F.lit(name).alias("kind"), rejected.alias("rejected")))
    kinds = F.array_compact(F.array(
        kind("wrong", said, A.answer_text(F.col("letter"), model_choice)), kind("weak", F.col("place") <= F.col("weak"), F.lit("I'm not sure about this question.")),
        kind("extra", F.col("place") <= F.col("extra"), A.answer_text(A.letter_at(other), F.element_at("choices", other + 1))),
    ))
    return both.select("id", *run, "prompt", key.alias("chosen"), F.explode(kinds).alias("_k")).select("id", *run, "_k.kind", "prompt", "chosen", "_k.rejected")


#: The sentence that describes each error class in a correction.
ERROR_SENTENCES = {
    "factual_error": "The original response contained a factual inaccuracy.",
    "reasoning_error": "The original response had flawed reasoning.",
    "calculation_error": "The original response contained a calculation error.",
    "incomplete_answer": "The original response was incomplete.",
    "no_answer": "The original response did not provide a clear answer.",
    "close_confusion": "The original response confused a closely related option.",
    "distant_confusion": "The original response was significantly different from the correct answer.",
}


def corrections(responses: DataFrame) -> DataFrame:
    """id, error_type, full (corrected answer with explanation) and rejected text."""
    kind = A.error_type(F.col("letter"), F.col("key_idx"), F.col("question"), F.col("response"))
    choice = F.element_at("choices", F.col("key_idx") + 1)
    rows = responses.withColumn("error_type", kind)
    sentence = F.create_map(*(F.lit(x) for pair in ERROR_SENTENCES.items() for x in pair))[F.col("error_type")]
    error = F.when(F.col("error_type") != "none", F.concat(F.lit("  Error type: "), "error_type", F.lit(". "), sentence)).otherwise("")
    quote = F.when(F.coalesce("response", F.lit("")) != "", F.concat(F.lit('  The model\'s original response was: "'), F.substring("response", 1, 200), F.lit('"'))).otherwise("")
    full = F.concat(F.lit("The correct answer is "), "key_letter", F.lit(") "), choice, F.lit(".  Explanation: "), choice, F.lit(" is the correct answer to this question."), error, quote)
    rejected = F.coalesce(F.concat(A.answer_text(F.col("letter"), F.try_element_at("choices", A.index_of(F.col("letter")) + 1)), F.lit(".")), F.lit("I'm not sure about the answer to this question."))
    return rows.select("id", "error_type", full.alias("full_text"), rejected.alias("rejected"))


def followups(responses: DataFrame) -> DataFrame:
    """Five follow-up questions on each answer."""
    title, said = F.initcap(F.regexp_replace("subject", "_", " ")), F.substring("response", 1, 200)
    texts = F.array(
        F.concat(F.lit("Regarding your answer to the previous question about "), title, F.lit(", can you explain the reasoning behind your answer? Walk through your thought process step by step.")),
        F.concat(F.lit('You answered: "'), said, F.lit('". Why is that the correct answer? What principles or concepts support this?')),
        F.lit("If someone disagreed with your answer, what counterargument might they make? How would you defend your answer against that objection?"),
        F.concat(F.lit("What are the key assumptions underlying your answer to the question about "), title, F.lit("? Are there cases where those assumptions might not hold?")),
        F.lit("Can you provide a specific example or illustration that demonstrates why your answer is correct?"),
    )
    return responses.select("id", F.posexplode(texts).alias("n", "followup"))


def run_summary(responses: DataFrame) -> DataFrame:
    return responses.groupBy("model", "subject").agg(F.count("*").alias("total"), F.count_if("right").alias("n_right"), F.round(F.avg(F.col("right").cast("double")), 6).alias("accuracy"))


def topped_up_questions(questions: DataFrame, limit: int = 25) -> DataFrame:
    """``limit`` questions (subject, split, pos) of each subject: those of split ``dev``, then of ``test``, in order."""
    place = F.row_number().over(W.partitionBy("subject").orderBy(F.when(F.col("split") == "dev", 0).otherwise(1), "pos"))
    return questions.where(F.col("split").isin("dev", "test")).withColumn("place", place).where(F.col("place") <= limit)


#: Words that mark a feature and a technical sentence of a description.
FEATURE_WORDS = ("features", "uses", "supports", "includes", "key", "designed")
TECHNICAL_WORDS = ("type", "memory", "compile", "runtime", "syntax", "concurr", "blockchain", "smart contract", "contract", "container", "encrypt", "protocol", "framework", "library", "agent", "statically", "dynamically", "object", "functional", "oriented", "service")
#: Question and wrong choices by what is asked of a described subject.
DESCRIBED = {
    "definition": ("Which of the following best describes {}?", "A web framework for building REST APIs", "A database management system", "A graphics rendering engine"),
    "feature": ("What is a key characteristic of {}?", "It only works on Windows operating systems", "It requires a paid license for commercial use", "It was deprecated in 2020"),
    "domain": ("Which domain does {} belong to?", "It is a biological science", "It is a form of classical music", "It is a type of medieval architecture"),
    "technical": ("Which statement about {} is correct?", "It has no support for any data structures", "It cannot run on modern hardware", "It uses punch cards for input"),
}


def described_questions(subjects: DataFrame, limit: int = 25) -> DataFrame:
    """Up to four questions (subject, n, question, choices, answer) on each subject (subject, domain, description).

    The right choice is always the first. A missing domain reads ``technology``; a blank
    description gives no question.
    """
    strip = lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    parts = F.transform(F.split("description", r"\.", -1), strip)
    rows = subjects.where(strip(F.coalesce("description", F.lit(""))) != "").withColumn("_first", F.element_at(parts, 1)).withColumn("_all", F.filter(parts, lambda s: s != ""))
    later = F.slice("_all", 2, F.greatest(F.size("_all"), F.lit(1)))
    naming = lambda words: F.try_element_at(F.filter(later, lambda s: F.lower(s).rlike("|".join(words))), F.lit(1))
    title = F.initcap(F.regexp_replace("subject", "_", " "))
    domain = F.concat(F.lit("It belongs to the "), F.lower(F.regexp_replace(F.coalesce("domain", F.lit("technology")), "_", " ")), F.lit(" domain"))
    right = {"definition": F.col("_first"), "feature": F.coalesce(naming(FEATURE_WORDS), F.try_element_at("_all", F.lit(2))), "domain": domain, "technical": naming(TECHNICAL_WORDS)}
    asked = F.array(*(F.struct(F.concat(F.lit(ask.partition("{}")[0]), title, F.lit(ask.partition("{}")[2])).alias("question"), F.array(right[k], *map(F.lit, wrong)).alias("choices")) for k, (ask, *wrong) in DESCRIBED.items()))
    some = F.slice(F.filter(asked, lambda q: q["choices"][0].isNotNull()), 1, limit)
    return rows.select("subject", F.posexplode(some).alias("n", "q")).select("subject", "n", "q.question", "q.choices", F.lit(0).alias("answer"))


#: Questions on common misconceptions by subject, and those that suit any subject.
MISCONCEPTIONS = {
    "high_school_mathematics": (
        "A common misconception is that (a+b)^2 = a^2 + b^2. Explain why this is incorrect and provide the correct expansion.",
        "Some students believe that the derivative of a product is the product of derivatives. Is this correct? Explain why or why not.",
        "Is 0.999... equal to 1? Many people believe they are different. Explain the correct mathematical reasoning.",
    ),
    "high_school_physics": (
        "A common misconception is that heavier objects fall faster than lighter ones in a vacuum. Explain why this is incorrect.",
        "Some people believe that a force is always needed to keep an object moving. Is this true? Explain using Newton's laws.",
        "Is it true that energy is always conserved in every process? What about in inelastic collisions?",
    ),
    "high_school_chemistry": (
        "A common misconception is that atoms are the smallest particles that exist. Is this accurate? Explain.",
        "Some students believe that chemical bonds store energy. Explain why this is incorrect and what actually happens.",
        "Is it true that all reactions release energy? Distinguish between exothermic and endothermic reactions.",
    ),
    "high_school_biology": (
        "A common misconception is that evolution is a random process. Explain the role of natural selection.",
        "Some people believe that DNA directly produces proteins. What step is missing? Explain.",
        "Is it true that all bacteria are harmful? Explain the role of beneficial bacteria.",
    ),
    "high_school_us_history": (
        "A common misconception is that the Civil War was primarily about states' rights. Explain the central role of slavery.",
        "Some believe the American Revolution was universally popular. Explain the role of loyalists.",
        "Is it true that the Great Depression was caused solely by the stock market crash? Explain other contributing factors.",
    ),
    "high_school_world_history": (
        "A common misconception is that the Dark Ages were a period of no progress. Explain what was actually happening.",
        "Some believe the fall of Rome was sudden. Explain the gradual nature of the collapse.",
        "Is it accurate to say the Renaissance was a complete break from medieval thinking? Explain the continuity.",
    ),
}
EDGE_CASES = (
    "What is a common misconception about this topic that many people hold? Explain why it is wrong.",
    "What is an edge case or exception to the general rule you just described? When does the typical answer not apply?",
    "If the question conditions were slightly different (e.g., changed assumptions), how would the answer change?",
    "What would happen in the extreme case or boundary condition of this problem?",
    "What is a tricky or deceptive version of this question that might fool a student?",
)


def edge_cases(subjects: DataFrame) -> DataFrame:
    """(subject, n, question): the subject's misconceptions, if it has any, then the general questions; no shuffle."""
    known = F.create_map(*(x for k, qs in MISCONCEPTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, qs)))))
    asked = F.concat(F.coalesce(F.try_element_at(known, F.col("subject")), F.array().cast("array<string>")), F.array(*map(F.lit, EDGE_CASES)))
    return subjects.select("subject", F.posexplode(asked).alias("n", "question"))


def resolve_subjects(inputs: DataFrame, subjects: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add ``canonical`` to ``inputs(name)``: a subject, an alias of one, or either after lower-casing with underscores; else null."""
    valid = subjects.select("subject").distinct()
    alias = aliases.join(valid, "subject", "left_semi").groupBy("alias").agg(F.min("subject").alias("subject"))
    known = valid.select(F.col("subject").alias("key"), F.lit(0).alias("rank"), "subject").unionByName(alias.select(F.col("alias").alias("key"), F.lit(1).alias("rank"), "subject"))
    best = known.groupBy("key").agg(F.min_by("subject", "rank").alias("canonical"))
    plain = F.lower(F.regexp_replace("name", " ", "_"))
    first, second = best.select(F.col("key").alias("k1"), F.col("canonical").alias("c1")), best.select(F.col("key").alias("k2"), F.col("canonical").alias("c2"))
    return inputs.join(first, F.col("name") == F.col("k1"), "left").join(second, plain == F.col("k2"), "left").select(*inputs.columns, F.coalesce("c1", "c2").alias("canonical"))
