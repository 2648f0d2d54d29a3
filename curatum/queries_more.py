"""Registered queries of tables, described subjects, judging, knowledge and the model surface, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import formats, ingest, isotonic, judging, knowledge, probing, quality, review, stats
from .queries import _PROMPT, _QA, _WIDE, C, M, ORACLES, P, QUERIES, R, V, _add, _decisions, _ev, _margins, _of, _qa
from .sources import fixtures as X, tables, versioned
from .streaming import monitors

__all__ = ["ORACLES", "QUERIES"]

c = F.col
_sql = lambda x: "'" + x.replace("'", "''") + "'"

# --- tables ------------------------------------------------------------------------------


def _exported(spark: SparkSession, d: str) -> DataFrame:
    path = tables.scratch_dir(spark)
    tables.export_training(X.pairs(spark, d), "dpo", path)
    return tables.read_entries(spark, path)


def _exported_as(target: str):
    """Entries written in a format by the exporter, read back as JSON Lines and by the format's reader."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        path, pairs = tables.scratch_dir(spark), X.pairs(spark, d)
        tables.export_training(pairs, target, path)
        return formats.read(spark.read.schema(formats.write(pairs, target).schema).json(path), target)

    return run


def _routed(spark: SparkSession, d: str) -> DataFrame:
    path = tables.scratch_dir(spark)
    scored = X.responses(spark, d).withColumn("confidence", F.when(c("right"), 0.9).when(c("letter").isNull(), 0.0).otherwise(0.4))
    tables.write_routed(scored.select("id", "subject", "confidence"), path)
    return spark.read.parquet(path).groupBy("route", "domain").agg(F.count("*").alias("n"))


def _appended(spark: SparkSession, d: str) -> DataFrame:
    path = tables.scratch_dir(spark)
    rows = X.table(spark, d, "events").select("event_id", "event_type", c("ts").alias("created_at"))
    tables.append_rows(rows.where("event_id % 2 = 0"), path)
    tables.append_rows(rows.where("event_id % 2 <> 0"), path)
    return spark.read.parquet(path).groupBy(c("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


for _f in formats.FORMATS:
    _clean = (lambda x: f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))") if _f == "chatml" else (lambda x: x)
    _rest = {"dpo": "rejected", "template_free": "nullif(rejected, '')"}.get(_f, "CAST(NULL AS VARCHAR)")
    _add(f"export_{_f}", _exported_as(_f), f"{P} SELECT id, {_clean('prompt')} AS prompt, {_clean('chosen')} AS chosen, {_rest} AS rejected FROM pairs")
_add("read_entries", _exported, f"{P} SELECT id, prompt, chosen, rejected FROM pairs")
_add("vault_routed", _routed, f"{R} SELECT CASE WHEN is_right THEN 'auto_approved' WHEN letter IS NULL THEN 'rejected' ELSE 'needs_review' END AS route, split_part(subject, '_', 1) AS domain, count(*) AS n FROM responses GROUP BY 1, 2")
_add("vault_append", _appended, "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
_versions = lambda s, d, first: X.table(s, d, "documents").select(c("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")) if first else F.concat(F.coalesce("text", F.lit("")), F.lit("!")), 256).alias("content_hash"), F.lit(1 if first else 2).alias("version"))


def _upserted(spark: SparkSession, d: str) -> DataFrame:
    """Two commits on a versioned table, read back; a second version of every third and each other row, then a third of some."""
    path, docs = tables.scratch_dir(spark), X.table(spark, d, "documents")
    versioned.create_table(_versions(spark, d, True).where("id % 4 <> 1"), path)
    versioned.upsert_table(_versions(spark, d, False).where("id % 3 = 0 or id % 4 = 1"), path)
    late = docs.where("doc_id % 10 = 0").select(c("doc_id").alias("id"), F.sha2(F.lit("late"), 256).alias("content_hash"), (F.when(c("doc_id") % 20 == 0, 3).otherwise(0)).alias("version"))
    return versioned.read_table(spark, path, versioned.upsert_table(late, path))


_add("vault_upsert", _upserted, """SELECT doc_id AS id, CASE WHEN doc_id % 20 = 0 THEN sha256('late') WHEN doc_id % 3 = 0 OR doc_id % 4 = 1 THEN sha256(coalesce(text, '') || '!') ELSE sha256(coalesce(text, '')) END AS content_hash,
 CASE WHEN doc_id % 20 = 0 THEN 3 WHEN doc_id % 3 = 0 OR doc_id % 4 = 1 THEN 2 ELSE 1 END AS version FROM documents""")
_add(
    "pdf_text_documents", lambda s, d: tables.page_text_documents(X.table(s, d, "documents").select(F.floor(c("doc_id") / 8).alias("doc"), (c("doc_id") % 8).alias("page_no"), "text")).drop("text"),
    r"SELECT doc, page_count, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS INTEGER) AS word_count, sha256(t) AS content_hash FROM (SELECT doc_id // 8 AS doc, count(*) AS page_count, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id % 8, text) AS t FROM documents GROUP BY 1)",
)

# --- questions ---------------------------------------------------------------------------
_add(
    "questions_topup", _of(X.responses, lambda r: probing.topped_up_questions(r.select("id", "subject", F.when(c("id") % 7 == 0, "dev").otherwise("test").alias("split"), c("id").alias("pos"))).select("id", "subject", "place")),
    f"{R} SELECT * FROM (SELECT id, subject, CAST(row_number() OVER (PARTITION BY subject ORDER BY CASE WHEN id % 7 = 0 THEN 0 ELSE 1 END, id) AS INTEGER) AS place FROM responses) WHERE place <= 25",
)
_any = lambda words: "|".join(words)
_STRIP = r"regexp_replace({}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
_asked = " UNION ALL ".join(
    f"SELECT subject, {n} AS k, {_sql(ask.partition('{}')[0])} || title || {_sql(ask.partition('{}')[2])} AS question, {right} AS answer_text, [{right}, {', '.join(map(_sql, wrong))}] AS choices FROM t"
    for n, ((ask, *wrong), right) in enumerate(zip(probing.DESCRIBED.values(), ("first", "coalesce(feature, parts[2])", "'It belongs to the ' || lower(domain) || ' domain'", "technical"), strict=True))
)
_add(
    "custom_mcq", lambda s, d: probing.described_questions(X.table(s, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("subject"), c("lang").alias("domain"), c("text").alias("description"))).withColumn("choices", F.array_join("choices", " | ")),
    f"""WITH p AS (SELECT 'doc_' || doc_id AS subject, 'Doc ' || doc_id AS title, coalesce(lang, 'technology') AS domain, list_transform(string_split(text, '.'), lambda x: {_STRIP.format('x')}) AS raw FROM documents WHERE {_STRIP.format('text')} <> ''),
t AS (SELECT *, raw[1] AS first, list_filter(raw, lambda x: x <> '') AS parts, list_filter(list_filter(raw, lambda x: x <> '')[2:], lambda x: regexp_matches(lower(x), '{_any(probing.FEATURE_WORDS)}'))[1] AS feature, list_filter(list_filter(raw, lambda x: x <> '')[2:], lambda x: regexp_matches(lower(x), '{_any(probing.TECHNICAL_WORDS)}'))[1] AS technical FROM p),
q AS ({_asked})
SELECT subject, CAST(row_number() OVER (PARTITION BY subject ORDER BY k) - 1 AS INTEGER) AS n, question, array_to_string(choices, ' | ') AS choices, 0 AS answer FROM q WHERE answer_text IS NOT NULL""",
)
_EDGES = ", ".join(f"({_sql(k)}, {n}, {_sql(q)})" for k, qs in probing.MISCONCEPTIONS.items() for n, q in enumerate(qs))
_GENERAL = ", ".join(f"({n}, {_sql(q)})" for n, q in enumerate(probing.EDGE_CASES))
_add(
    "tier3_edge_cases", _of(X.responses, lambda r: probing.edge_cases(r.select("subject").distinct())),
    f"""{R}, s AS (SELECT DISTINCT subject FROM responses), own(subject, n, question) AS (VALUES {_EDGES}), general(n, question) AS (VALUES {_GENERAL}), k AS (SELECT s.subject, count(own.n) AS n FROM s LEFT JOIN own ON s.subject = own.subject GROUP BY 1)
SELECT subject, CAST(n AS INTEGER) AS n, question FROM own WHERE subject IN (SELECT subject FROM s) UNION ALL SELECT k.subject, CAST(k.n + general.n AS INTEGER), question FROM k, general""",
)


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    r = X.responses(spark, d)
    name = F.when(c("id") % 4 == 0, c("subject")).when(c("id") % 4 == 1, F.initcap(F.regexp_replace("subject", "_", " "))).when(c("id") % 4 == 2, F.concat(F.lit("about_"), "subject")).otherwise("unheard of")
    subjects = r.select("subject").distinct()
    aliases = subjects.select(F.concat(F.lit("about_"), "subject").alias("alias"), F.when(c("subject") == "docker", "gone").otherwise(c("subject")).alias("subject"))
    return probing.resolve_subjects(r.select("id", name.alias("name")), subjects, aliases)


_add("subject_resolve", _resolved, f"""{R} SELECT id, CASE id % 4 WHEN 0 THEN subject WHEN 1 THEN array_to_string(list_transform(string_split(subject, '_'), lambda w: upper(w[1]) || w[2:]), ' ') WHEN 2 THEN 'about_' || subject ELSE 'unheard of' END AS name,
 CASE WHEN id % 4 IN (0, 1) OR (id % 4 = 2 AND subject <> 'docker') THEN subject END AS canonical FROM responses""")

# --- judging -----------------------------------------------------------------------------


def _replies(spark: SparkSession, d: str) -> DataFrame:
    k = (F.floor(c("entry_id") / 10) + c("judge_no")) % 10
    said = F.concat(F.lit('{"correct": '), c("correct").cast("string"), F.lit(', "confidence": '), c("confidence").cast("string"), F.lit(', "explanation": "by {judge} '), "judge_no", F.when(c("entry_id") % 2 == 0, F.concat(F.lit('", "reasoning": "because '), "judge_no", F.lit('"}'))).otherwise('"}'))
    text = F.when(k <= 5, said).when(k == 6, F.concat(F.lit("My view {as asked}: "), said, F.lit(" so it is."))).when(k == 7, "This is incorrect.").when(k == 8, "The answer is correct.").otherwise("no verdict {broken")
    return X.verdicts(spark, d).select("entry_id", "judge_no", text.alias("reply"))


_K = "((entry_id // 10 + judge_no) % 10)"
_add("verdict_parse", _of(_replies, lambda v: judging.parse_verdicts(v).drop("reply")), f"""{V} SELECT entry_id, judge_no, CASE WHEN {_K} <= 5 THEN 'json' WHEN {_K} = 6 THEN 'embedded_json' ELSE 'text' END AS parse_mode, CASE WHEN {_K} <= 6 THEN correct ELSE {_K} = 8 END AS correct,
 CASE WHEN {_K} <= 6 THEN confidence WHEN {_K} = 7 THEN 0.3::DOUBLE WHEN {_K} = 8 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE WHEN {_K} <= 6 THEN 'by {{judge}} ' || judge_no WHEN {_K} = 7 THEN 'This is incorrect.' WHEN {_K} = 8 THEN 'The answer is correct.' ELSE 'no verdict {{broken' END AS explanation, CASE WHEN {_K} <= 6 AND entry_id % 2 = 0 THEN 'because ' || judge_no WHEN {_K} <= 6 THEN 'by {{judge}} ' || judge_no WHEN {_K} = 7 THEN 'This is incorrect.' WHEN {_K} = 8 THEN 'The answer is correct.' ELSE 'no verdict {{broken' END AS reasoning FROM verdicts""")
_add("verdict_report", _of(_replies, lambda v: judging.parse_report(judging.parse_verdicts(v), "judge_no")), f"{V} SELECT judge_no, CASE WHEN {_K} <= 5 THEN 'json' WHEN {_K} = 6 THEN 'embedded_json' ELSE 'text' END AS parse_mode, count(*) AS n FROM verdicts GROUP BY 1, 2")
_add("judge_prompt", _of(X.pairs, lambda p: p.select("id", judging.judge_prompt(c("prompt"), c("chosen"), F.when(c("id") % 2 == 0, c("rejected"))).alias("judge_prompt"))), f"""{P} SELECT id, 'You are an expert reviewer evaluating a training data entry for correctness.' || chr(10) || 'Analyze whether the provided answer is correct.' || chr(10) || 'Explain your logic step-by-step in the reasoning field before giving the verdict fields.' || chr(10) || chr(10) || 'Question: ' || prompt || chr(10) || chr(10) || 'Answer to evaluate: ' || chosen || chr(10) || chr(10)
 || CASE WHEN id % 2 = 0 AND rejected <> '' THEN 'Claimed correct answer: ' || rejected || chr(10) || chr(10) ELSE '' END || 'Evaluate whether the answer is factually correct.' || chr(10) || 'Respond in the following JSON format only:' || chr(10) || '{{"reasoning": "step-by-step logic", "correct": true/false, "confidence": 0.0-1.0, "explanation": "brief verdict summary"}}' AS judge_prompt FROM pairs""")
_add("escalation_ladder", _of(X.verdicts, lambda v: judging.escalation(v).groupBy("tier").agg(F.count("*").alias("n"))), f"""{V}, g AS (SELECT entry_id, count(*) AS n, count(*) FILTER (correct) AS yes, avg(confidence) AS mean, max(confidence) AS top, max(confidence) FILTER (correct) AS top_yes, max(confidence) FILTER (NOT correct) AS top_no, last(correct ORDER BY judge_no) AS last_correct, last(confidence ORDER BY judge_no) AS last_sure FROM verdicts GROUP BY 1)
SELECT CASE WHEN round(greatest(yes, n - yes) / n::DOUBLE, 6) >= 0.666667 AND round(mean, 6) >= 0.7 AND coalesce(CASE WHEN yes * 2 > n THEN top_no ELSE top_yes END, 0) < 0.9 THEN 'panel' WHEN last_sure >= 0.75 AND last_correct = (yes * 2 > n) THEN 'senior' WHEN top >= 0.7 THEN 'premium' ELSE 'human' END AS tier, count(*) AS n FROM g GROUP BY 1""")
_add("vote_entropy", _of(X.verdicts, lambda v: review.panel(v).groupBy("certainty").agg(F.count("*").alias("n"))), f"{V} SELECT round(CASE WHEN s IN (0, 1) THEN 1 ELSE 1 + s * log2(s) + (1 - s) * log2(1 - s) END, 6) AS certainty, count(*) AS n FROM (SELECT count(*) FILTER (correct) / count(*)::DOUBLE AS s FROM verdicts GROUP BY entry_id) GROUP BY 1")
_add("flip_rate", _of(X.verdicts, lambda v: judging.flip_rate(v.where("judge_no < 3"), v.where("judge_no > 1").withColumn("judge_no", c("judge_no") - 1))), f"{V} SELECT a.judge_no, count(*) AS n, round(avg(CAST(a.correct <> b.correct AS DOUBLE)), 6) AS flip_rate FROM verdicts a JOIN verdicts b ON a.entry_id = b.entry_id AND b.judge_no = a.judge_no + 1 GROUP BY 1")
_PRICES = {"small": 0.002, "middle": 0.01, "large": 0.05}
_add("cost_report", _of(X.verdicts, lambda v: judging.cost_report(review.cascade(v), _PRICES)), f"""{V}{_WIDE}, f AS (SELECT count(*) AS a, count(*) FILTER (s1 < 0.7) AS b, count(*) FILTER (s1 < 0.7 AND c1 <> c2) AS c FROM wide)
SELECT 'small' AS tier, a AS calls, round(a * 0.002::DOUBLE, 6) AS cost FROM f UNION ALL SELECT 'middle', b, round(b * 0.01::DOUBLE, 6) FROM f UNION ALL SELECT 'large', c, round(c * 0.05::DOUBLE, 6) FROM f""")


def _rechecked(v: DataFrame) -> DataFrame:
    said = lambda j: F.max(F.when(c("judge_no") == j, c("correct")))
    return v.groupBy(c("entry_id").alias("id")).agg(said(1).alias("correct"), said(2).alias("recheck"))


_add("judge_spot_check", _of(X.verdicts, lambda v: judging.spot_check(_rechecked(v))))


def _letter_client():
    return lambda prompts: ["ABCD"[len(p) % 4] for p in prompts]


_add("batch_ask", _of(X.responses, lambda r: judging.batch_ask(probing.mcq_prompts(r), _letter_client).select("id", "reply", "error")), f"{R} SELECT id, ['A', 'B', 'C', 'D'][len({_PROMPT}) % 4 + 1] AS reply, CAST(NULL AS VARCHAR) AS error FROM responses")
_add("entry_status_counts", lambda s, d: review.apply_decisions(*_decisions(s, d)).agg(*(F.count_if(c("status") == x).alias(x) for x in ("accepted", "edited", "rejected", "pending"))), f"{P} SELECT count(*) FILTER (id % 3 <> 0 AND id % 4 = 0) AS accepted, count(*) FILTER (id % 3 <> 0 AND id % 4 = 2) AS edited, count(*) FILTER (id % 3 <> 0 AND id % 4 = 1) AS rejected, count(*) FILTER (id % 3 = 0) AS pending FROM pairs")

# --- pair quality ------------------------------------------------------------------------
# In these pairs a rejected text is a part of the chosen one, which is then the one block, or has too few of its characters.
_OVERLAP = f"""{P}, low AS (SELECT id, lower(chosen) AS a, lower(rejected) AS b, len(chosen) + len(rejected) AS n FROM pairs),
chars AS (SELECT id, sum(least(x, y)) AS m FROM (SELECT id, c, count(*) FILTER (side = 1) AS x, count(*) FILTER (side = 2) AS y FROM (SELECT id, 1 AS side, unnest(string_split(a, '')) AS c FROM low UNION ALL SELECT id, 2, unnest(string_split(b, '')) FROM low) GROUP BY id, c) GROUP BY id),
seen AS (SELECT id, CASE WHEN contains(a, b) OR contains(b, a) THEN 2.0::DOUBLE * least(len(a), len(b)) / n WHEN 2.0::DOUBLE * m / n > 0.75 THEN -1.0::DOUBLE END AS r FROM low JOIN chars USING (id)),
flags AS (SELECT id, round(r, 6) AS ratio, CASE WHEN r < 0 THEN 'open' WHEN r > 0.9 THEN 'high' ELSE 'moderate' END AS level FROM seen WHERE r > 0.75 OR r < 0)"""
_add("response_overlap", _of(X.pairs, quality.response_overlap), f"{_OVERLAP} SELECT * FROM flags")
_add("overlap_report", _of(X.pairs, quality.overlap_report), f"{_OVERLAP} SELECT (SELECT count(*) FROM pairs) AS n, count(*) FILTER (level = 'high') AS n_high, count(*) FILTER (level = 'moderate') AS n_moderate, count(*) FILTER (level = 'high') > 0.2 * (SELECT count(*) FROM pairs) AS suspect FROM flags")
_add("best_worst_select", _of(_margins, lambda m: quality.best_and_worst(m).select("id", "margin", "end")), f"""{M}, k AS (SELECT quantile_cont(margin, 0.25) AS lo, quantile_cont(margin, 0.75) AS hi FROM m) SELECT id, margin, CASE WHEN margin >= hi THEN 'best' ELSE 'worst' END AS "end" FROM m, k WHERE margin >= hi OR margin <= lo""")


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    v = X.table(spark, d, "embeddings")
    return v.select(c("vec_id").alias("id"), c("embedding").alias("x")).join(v.select((c("vec_id") - 1).alias("id"), c("embedding").alias("y")), "id")


_add("semantic_weight", _of(_neighbours, quality.semantic_weight), "SELECT a.vec_id AS id, round(exp(-(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS weight FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")


def _asked_again(spark: SparkSession, d: str) -> DataFrame:
    """The vectors, and after them a slightly moved one of each tenth."""
    v = X.table(spark, d, "embeddings").select(c("vec_id").alias("id"), c("embedding").cast("array<double>").alias("x"))
    moved = F.transform("x", lambda y, i: F.round(y + 0.02 * (F.pmod(i * 7 + c("id"), F.lit(5)) - 2), 6))
    return v.unionByName(v.where("id % 10 = 3").select((c("id") + 100000000).alias("id"), moved.alias("x")))


_add("semantic_cache_hits", lambda s, d: quality.cache_hits(_asked_again(s, d)), """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
w AS (SELECT * FROM v UNION ALL SELECT id + 100000000, list_transform(x, lambda y, i: round(y + 0.02::DOUBLE * (((i - 1) * 7 + id) % 5 - 2), 6)) FROM v WHERE id % 10 = 3)
SELECT id, arg_min(other, other) AS cached_id, arg_min(s, other) AS similarity FROM (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.x, b.x), 6) AS s FROM w a JOIN w b ON b.id < a.id) WHERE s >= 0.9 GROUP BY id""")

# --- statistics and calibration ----------------------------------------------------------
_add("platt_fit", _of(X.calibration, lambda r: stats.platt_fit(r).select(F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))))
_add("isotonic_fit", _of(X.calibration, isotonic.isotonic_fit), f"""{C}, g AS (SELECT p, count(*) AS w, sum(y) AS s FROM cal WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY p), t AS (SELECT p, w, s, sum(w) OVER o AS tw, sum(s) OVER o AS ts FROM g WINDOW o AS (ORDER BY p)),
slopes AS (SELECT a.p AS low, b.p, min(CAST(b.ts - a.ts + a.s AS DOUBLE) / CAST(b.tw - a.tw + a.w AS DOUBLE)) OVER (PARTITION BY a.p ORDER BY b.p DESC) AS v FROM t a JOIN t b ON b.p >= a.p), fit AS (SELECT p, max(v) AS v FROM slopes GROUP BY p)
SELECT DISTINCT p, calibrated FROM (SELECT unnest([min(p), max(p)]) AS p, v AS calibrated FROM fit GROUP BY v)""")
_add("cost_threshold", _of(X.calibration, stats.cost_threshold), f"""{C}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, sum(1 - y) AS wrong FROM cal GROUP BY 1), g AS (SELECT a.k AS a, e.k AS e FROM range(11) a(k), range(11) e(k) WHERE e.k <= a.k)
SELECT a / 10.0::DOUBLE AS accept_from, e / 10.0::DOUBLE AS edit_from, round(sum(CASE WHEN bin >= a THEN wrong * 100.0::DOUBLE WHEN bin >= e THEN n * 3.0::DOUBLE ELSE n * 5.0::DOUBLE END), 6) AS cost FROM b, g GROUP BY a, e ORDER BY cost, a, e LIMIT 1""")
_add("run_history", _of(X.training_runs, stats.run_history), f"WITH {X.RUNS} SELECT * FROM runs ORDER BY started_at DESC, id LIMIT 100")
_add("eval_history", _of(X.evaluation_results, stats.eval_history), f"WITH {X.RESULTS} SELECT * FROM results ORDER BY created_at DESC, id LIMIT 100")

# --- knowledge ---------------------------------------------------------------------------
_chunks = lambda s, d: ingest.chunks(ingest.planted(X.table(s, d, "documents").select("doc_id", "text")))
_add("qa_generate", _of(_chunks, knowledge.generate_qa))
_add("qa_chunk_refs", _of(_chunks, lambda k: knowledge.generate_qa(k).groupBy("doc_id", "chunk_ref").agg(F.count("*").alias("n"))))
_add("ingest_pages", lambda s, d: knowledge.ingest_pages(X.table(s, d, "pages"))["pairs"])
_add("hidden_text_strip", lambda s, d: ingest.extract_pages(X.table(s, d, "pages"), strip_hidden=True).select("page_id", "content"))
_add("evidence_units", lambda s, d: knowledge.evidence_units(X.table(s, d, "pages")))
_add("evidence_answer", lambda s, d: knowledge.evidence_answers(X.table(s, d, "pages")))


def _edits(spark: SparkSession, d: str) -> DataFrame:
    items, pages = X.table(spark, d, "benchmark"), X.table(spark, d, "pages")
    units = ingest.stored(knowledge.evidence_units(pages))
    entries = items.select(c("item_id").alias("id"), F.substring("text", 1, 60).alias("chosen"), F.lit("I don't know.").alias("rejected"), (c("item_id") % 2 == 0).alias("correct"), (c("item_id") % 10 / 10.0).alias("confidence"))
    return knowledge.evidence_edits(entries, ingest.evidence(items.select(c("item_id").alias("q_id"), c("text").alias("question")), units), units, pages)


_add("evidence_edit", _edits)
# Chunks in SQL: each step takes the window from a start, cuts it at the last mark in its last fifth, and goes back by the overlap.
_LAST = "CASE WHEN contains(tail, {0}) THEN cut + length(tail) - strpos(reverse(tail), reverse({0})) - length({0}) + 1 ELSE -1 END"
_STRIPPED = r"regexp_replace(part, '^[\s\x0B\x1C-\x1F\x85\xA0]+|[\s\x0B\x1C-\x1F\x85\xA0]+$', '', 'g')"


def _chunk_sql(docs: str, size: int = 4000, overlap: int = 200) -> str:
    """CTEs up to ``chunks(doc_id, index, start_char, end_char, text)`` of the query ``docs(doc_id, text)``."""
    stop = f"least(a + {size}, length(text))"
    ends = f"""SELECT *, CASE WHEN stop = length(text) THEN stop WHEN p2 > a THEN p2 WHEN p1 > a THEN p1 WHEN s > a THEN s + 1 ELSE stop END AS b FROM (
  SELECT doc_id, text, n, a, stop, {_LAST.format("chr(10) || chr(10)")} AS p2, {_LAST.format("chr(10)")} AS p1, greatest({_LAST.format("'. '")}, {_LAST.format("'! '")}, {_LAST.format("'? '")}) AS s FROM (
  SELECT doc_id, text, n, a, {stop} AS stop, a + {int(size * 0.8)} AS cut, substring(text, a + {int(size * 0.8)} + 1, {stop} - a - {int(size * 0.8)}) AS tail FROM w))"""
    step = lambda source: f"SELECT doc_id, text, n, a, b FROM ({ends.replace('FROM w', f'FROM {source}')})"
    return f"""WITH RECURSIVE source AS ({docs}), starts AS (SELECT doc_id, text, 0 AS n, 0 AS a FROM source WHERE length(text) > 0),
windows AS ({step("starts")} UNION ALL {step(f"(SELECT doc_id, text, n + 1 AS n, greatest(b - {overlap}, a + 1) AS a FROM windows WHERE b < length(text))")}),
chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS index, CAST(a AS INTEGER) AS start_char, CAST(b AS INTEGER) AS end_char, text FROM (SELECT doc_id, n, a, b, {_STRIPPED} AS text FROM (SELECT *, substring(text, a + 1, b - a) AS part FROM windows)) WHERE text <> '')"""


ORACLES["chunk"] = f"{_chunk_sql('SELECT doc_id, text FROM documents')} SELECT * FROM chunks"
_add("qa_prompt", lambda s, d: ingest.chunks(X.table(s, d, "documents")).select("doc_id", "index", F.sha2(knowledge.qa_prompt(c("text"), "history"), 256).alias("prompt_hash")), f"""{_chunk_sql("SELECT doc_id, text FROM documents")} SELECT doc_id, index, sha256('Read the following text and generate 3-5 question-answer pairs based on its content.' || chr(10) || 'The answers should be factual and grounded in the text in the domain of history.' || chr(10) || chr(10) || 'Text:' || chr(10) || '---' || chr(10) || text || chr(10) || '---' || chr(10) || chr(10)
 || 'Output the Q&A pairs as a JSON array where each element has "question" and "answer" keys.' || chr(10) || 'Only output the JSON array, no other text.' || chr(10) || chr(10) || 'Example format:' || chr(10) || '[{{"question": "...", "answer": "..."}}, {{"question": "...", "answer": "..."}}]' || chr(10)) AS prompt_hash FROM chunks""")
_add("qa_prompt_chunks", QUERIES["qa_prompt"], ORACLES["qa_prompt"])  # its name before qa_prompt took the chunks


def _qa_replies(spark: SparkSession, d: str) -> DataFrame:
    pair = F.struct("question", "answer")
    said = F.when(c("id") % 5 == 0, "no list here").otherwise(F.concat(F.lit("Here: "), F.to_json(F.array(pair)), F.lit(" done")))
    told = _qa(spark, d).select(c("id").alias("doc_id"), F.lit(0).alias("index"), said.alias("reply"))
    return knowledge.parse_qa_replies(told, _qa(spark, d).where("id % 5 <> 0").select(c("id").alias("doc_id"), F.lit(0).alias("index"), c("question").alias("text")))


_add("qa_reply_parse", _qa_replies, f"{_QA} SELECT id AS doc_id, 0 AS chunk_ref, 0 AS id, question, answer FROM qa WHERE id % 5 <> 0")

# --- streams -----------------------------------------------------------------------------
_add("stream_content_dedup", _of(_ev, lambda e: monitors.first_by_content(e, "user_id", "subject").select("event_id", "ts")), 'SELECT event_id, ts FROM (SELECT event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1')
