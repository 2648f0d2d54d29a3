"""Oracle SQL of the pair metrics, for queries over ``pairs(id, prompt, chosen, rejected)``."""

from __future__ import annotations

from .operators.quality import DIFFICULT, INDICATORS, METRICS, QUESTION_WORDS, STOPWORDS, UNCERTAIN


def _quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def _hits(low: str, phrases) -> str:
    return "(" + " + ".join(f"CAST(contains({low}, {_quoted(p)}) AS INTEGER)" for p in phrases) + ")"


def _clamp(x: str) -> str:
    return f"least(1e0, greatest(0e0, {x}))"


def _tokens(text: str) -> str:
    return f"regexp_extract_all({text}, '[a-z0-9]+(?:''[a-z0-9]+)?')"


def _squares(words: str) -> str:
    return f"sqrt(list_sum(list_transform(list_distinct({words}), lambda x: len(list_filter({words}, lambda y: y = x)) ** 2)))"


def _score(side: str) -> str:
    """Score of one answer, over columns low_, t_ and k_ of the side, ``hard`` and ``want``."""
    low, t, k = f"low_{side}", f"t_{side}", f"k_{side}"
    digits = f"len(list_filter({t}, lambda x: regexp_matches(x, '[0-9]')))"
    length = f"least(1e0, len({t}) / want) * CASE WHEN len({t}) > want * 8 THEN greatest(0.2e0, want * 8 / len({t})) ELSE 1e0 END"
    specific = f"least(1e0, (len(list_distinct({k})) + 2e0 * {digits}) / greatest(want, 6e0))"
    marks = f"least(1e0, ({_hits(low, INDICATORS)} + {digits}) / 4e0)"
    sentences = rf"greatest(1, len(list_filter(regexp_split_to_array({low}, '[.!?]+'), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]'))))"
    shape = f"least(1e0, {sentences} / greatest(1e0 + 2e0 * hard, 1e0))"
    doubt, terse = f"CASE WHEN {_hits(low, UNCERTAIN)} > 0 THEN 0.35e0 ELSE 0e0 END", f"CASE WHEN len({t}) <= 3 AND hard > 0.15e0 THEN 0.2e0 ELSE 0e0 END"
    whole = f"0.3e0 * {length} + 0.3e0 * {specific} + 0.2e0 * {marks} + 0.15e0 * {shape} + 0.05e0 * (len(list_distinct({k})) / len({k})) - {doubt} - {terse}"
    return f"CASE WHEN len({t}) = 0 THEN 0e0 ELSE {_clamp(whole)} END"


_SIDES = ("prompt", "chosen", "rejected")
_STOP = ", ".join(map(_quoted, STOPWORDS))
_CLAUSES = " + ".join(f"(length(low_prompt) - length(replace(low_prompt, '{m}', ''))) // {len(m)}" for m in (",", ";", " versus "))
_HARD = (
    f"0.3e0 * least(1e0, len(t_prompt) / 35e0) + 0.25e0 * least(1e0, ({' + '.join(f'CAST(list_contains(t_prompt, {_quoted(w)}) AS INTEGER)' for w in QUESTION_WORDS)}) / 3e0)"
    f" + 0.2e0 * least(1e0, {_hits('low_prompt', DIFFICULT)} / 4e0) + 0.15e0 * least(1e0, ({_CLAUSES}) / 4e0) + 0.1e0 * least(1e0, len(list_filter(k_prompt, lambda x: length(x) >= 9)) / 5e0)"
)
_DOT = "list_sum(list_transform(list_distinct(k_chosen), lambda x: len(list_filter(k_chosen, lambda y: y = x)) * len(list_filter(k_rejected, lambda y: y = x))))"
_COSINE = f"{_DOT} / ({_squares('k_chosen')} * {_squares('k_rejected')})"
_JACCARD = "len(list_filter(list_distinct(k_chosen), lambda x: list_contains(k_rejected, x))) / len(list_distinct(list_concat(k_chosen, k_rejected)))"

#: Common table expressions that end in scored(id, the six metrics), to follow one that defines pairs.
SCORED = f"""
low AS (SELECT id, {", ".join(f"lower(coalesce({s}, '')) AS low_{s}" for s in _SIDES)} FROM pairs),
words AS (SELECT *, {", ".join(f"{_tokens(f'low_{s}')} AS t_{s}" for s in _SIDES)} FROM low),
told AS (SELECT *, {", ".join(f"list_filter(t_{s}, lambda x: x NOT IN ({_STOP})) AS f_{s}" for s in _SIDES)} FROM words),
content AS (SELECT *, {", ".join(f"CASE WHEN len(f_{s}) > 0 THEN f_{s} ELSE t_{s} END AS k_{s}" for s in _SIDES)} FROM told),
basic AS (SELECT *, CASE WHEN len(k_chosen) = 0 AND len(k_rejected) = 0 THEN 1e0 WHEN len(k_chosen) = 0 OR len(k_rejected) = 0 THEN 0e0 ELSE {_clamp(f"0.8e0 * ({_COSINE}) + 0.2e0 * ({_JACCARD})")} END AS sim,
 CASE WHEN len(t_chosen) = 0 AND len(t_rejected) = 0 THEN 1e0 WHEN len(t_rejected) = 0 THEN greatest(len(t_chosen), 1)::DOUBLE ELSE len(t_chosen) / len(t_rejected) END AS ratio,
 CASE WHEN len(t_prompt) = 0 THEN 0e0 ELSE {_clamp(_HARD)} END AS hard FROM content),
wanted AS (SELECT *, 5e0 + 24e0 * hard AS want FROM basic),
total AS (SELECT id, sim, ratio, hard, {_clamp(f"0.05e0 + 1.8e0 * greatest(({_score('chosen')}) - ({_score('rejected')}), 0e0)")} AS margin,
 CASE WHEN len(t_chosen) = 0 THEN 0e0 ELSE len(list_distinct(k_chosen)) / len(k_chosen) END AS variety,
 CASE WHEN len(t_chosen) > 0 AND len(t_rejected) > 0 AND len(t_prompt) > 0 THEN 1e0 ELSE 0e0 END AS present,
 CASE WHEN ratio <= 0 THEN 0e0 ELSE {_clamp("1 - abs(ln(ratio)) / ln(10e0)")} END AS balance,
 CASE WHEN sim > 0.85e0 THEN 1 - 0.55e0 * least(1e0, (sim - 0.85e0) / 0.15e0) ELSE 1e0 END AS alike FROM wanted),
scored AS (SELECT id, round(sim, 6) AS semantic_similarity, round(ratio, 6) AS length_ratio, round(variety, 6) AS answer_diversity, round(margin, 6) AS preference_margin, round(hard, 6) AS difficulty_score,
 round({_clamp("0.35e0 * margin + 0.25e0 * (1 - sim) + 0.15e0 * balance + 0.1e0 * variety + 0.1e0 * hard + 0.05e0 * present")} * alike, 6) AS overall_quality FROM total)"""

_LONG = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS v, overall_quality AS q FROM scored" for m in METRICS)
#: Report over ``scored``.
REPORT = f"""SELECT metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, min(v) AS min, max(v) AS max, round(stddev_pop(v), 6) AS stdev, count(*) AS total, count(*) FILTER (q >= 0.3) AS kept
FROM ({_LONG}) GROUP BY metric"""
