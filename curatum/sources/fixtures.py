"""Input tables of the registered queries, derived by Spark from the given tables.

Each has a DataFrame builder and, for the oracles, a SQL text of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import answers as A

SUBJECTS = ("high_school_mathematics", "high_school_physics", "abstract_algebra", "college_biology", "moral_disputes", "philosophy", "sociology", "econometrics", "professional_law", "business_ethics", "python", "docker")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of orders that one task groups.
LINES_A_TASK = 1 << 19

#: Most partitions that Spark writes a shuffle for without holding the rows of a task to sort them (its default).
UNSORTED = 200


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-choice answers: one row per (order, line).

    Lines are dealt by the id of their answer over as many tasks as their number asks for, so that
    a task's memory does not grow with the table, and groups by id that follow need no shuffle.
    Where that is more than :data:`UNSORTED` tasks, lines are dealt over so many first: a task that
    reads the table would hold all it reads, one that deals on holds its share only.
    """
    lines = table(spark, sf_dir, "lineitem")
    tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES_A_TASK))
    if tasks > UNSORTED:
        lines = lines.repartition(UNSORTED, "l_orderkey", "l_linenumber")
    lines = lines.withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    k = lines.repartition(tasks, "id").groupBy("id", "l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"), F.min("l_quantity").alias("q"), F.min("l_discount").alias("disc"), F.min("l_shipdate").alias("created_at"))
    at = lambda i: F.element_at("choices", i + 1)
    k = k.select(
        "id", "l_orderkey", F.col("l_linenumber").alias("question_idx"), "disc", "created_at",
        ((F.col("pk") + F.col("l_linenumber")) % 5).cast("int").alias("mi"), (F.col("l_orderkey") % 4).cast("int").alias("key_idx"), ((F.col("sk") + F.col("l_linenumber")) % 7).cast("int").alias("tpl"),
        F.concat(F.lit("model-"), (F.col("sk") % 3).cast("string")).alias("model"), F.element_at(F.array(*map(F.lit, SUBJECTS)), (F.col("pk") % 12 + 1).cast("int")).alias("subject"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat((F.col("q").cast("int") + i).cast("string"), F.lit(" units"))).alias("choices"),
        F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("Calculate the total of order "), F.col("l_orderkey"))).otherwise(F.concat(F.lit("Which quantity was shipped on line "), F.col("l_linenumber"), F.lit("?"))).alias("question"),
    )
    letter, choice = A.letter_at(F.col("mi")), F.when(F.col("mi") < 4, at(F.least("mi", F.lit(3))))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    text = (
        F.when(F.col("mi") == 4, "No idea at all.").when(F.col("tpl") == 0, say("The answer is ", letter, ") ", choice, ".")).when(F.col("tpl") == 1, say("Answer: ", letter))
        .when(F.col("tpl") == 2, say("I think maybe (", letter, ")")).when(F.col("tpl") == 3, say("Therefore ", letter, ") because of the total."))
        .when(F.col("tpl") == 4, say("I compute 2 + 3 so the answer is definitely ", letter, ".")).when(F.col("tpl") == 5, say(letter, ") ", choice)).otherwise(say("Not sure, ", letter, " might be right."))
    )
    k = k.withColumn("response", text).withColumn("key_letter", A.letter_at(F.col("key_idx")))
    k = k.withColumn("letter", A.answer_letter(F.col("response")))
    return k.withColumn("right", A.is_right(F.col("letter"), F.col("key_letter"))).drop("mi", "tpl")


RESPONSES = r"""
lines AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_suppkey) AS sk, min(l_quantity) AS q, min(l_discount) AS disc, min(l_shipdate) AS created_at FROM lineitem GROUP BY 1, 2),
shaped AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey, l_linenumber AS question_idx, disc, created_at, (pk + l_linenumber) % 5 AS mi, CAST(l_orderkey % 4 AS INTEGER) AS key_idx,
  (sk + l_linenumber) % 7 AS tpl, 'model-' || (sk % 3) AS model, [{subjects}][pk % 12 + 1] AS subject, list_transform([0, 1, 2, 3], lambda i: CAST(CAST(q AS INTEGER) + i AS VARCHAR) || ' units') AS choices,
  CASE WHEN l_orderkey % 2 = 0 THEN 'Calculate the total of order ' || l_orderkey ELSE 'Which quantity was shipped on line ' || l_linenumber || '?' END AS question FROM lines),
said AS (SELECT *, ['A', 'B', 'C', 'D'][mi + 1] AS l, choices[mi + 1] AS c FROM shaped),
worded AS (SELECT *, CASE WHEN mi = 4 THEN 'No idea at all.' WHEN tpl = 0 THEN 'The answer is ' || l || ') ' || c || '.' WHEN tpl = 1 THEN 'Answer: ' || l WHEN tpl = 2 THEN 'I think maybe (' || l || ')'
  WHEN tpl = 3 THEN 'Therefore ' || l || ') because of the total.' WHEN tpl = 4 THEN 'I compute 2 + 3 so the answer is definitely ' || l || '.' WHEN tpl = 5 THEN l || ') ' || c ELSE 'Not sure, ' || l || ' might be right.' END AS response,
  ['A', 'B', 'C', 'D'][key_idx + 1] AS key_letter FROM said),
lettered AS (SELECT *, coalesce(nullif(upper(regexp_extract(response, '(?i)(?:answer\s+is\s*)([ABCD])', 1)), ''), nullif(upper(regexp_extract(response, '(?i)(?:answer\s*:\s*)([ABCD])', 1)), ''), nullif(regexp_extract(response, '\b([ABCD])\b', 1), '')) AS letter FROM worded),
responses AS (SELECT *, coalesce(letter = key_letter, false) AS is_right FROM lettered)
""".replace("{subjects}", ", ".join(f"'{s}'" for s in SUBJECTS))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three judges' verdicts on each response: entry_id, judge_no, correct, confidence."""
    r = responses(spark, sf_dir).select(F.col("id").alias("entry_id"), "l_orderkey", "question_idx", "disc", "subject", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("judge_no"))
    sure = F.round(F.least(F.lit(1.0), 0.35 + 5.0 * F.col("disc") + 0.05 * F.col("judge_no")), 2)
    return r.select("entry_id", "subject", "judge_no", ((F.col("l_orderkey") + F.col("judge_no") * F.col("question_idx")) % 3 != 0).alias("correct"), sure.alias("confidence"))


VERDICTS = RESPONSES + r""",
verdicts AS (SELECT id AS entry_id, subject, judge_no, (l_orderkey + judge_no * question_idx) % 3 <> 0 AS correct, round(least(1.0::DOUBLE, 0.35::DOUBLE + 5.0::DOUBLE * disc + 0.05::DOUBLE * judge_no), 2) AS confidence
  FROM responses, (VALUES (1), (2), (3)) j(judge_no))
"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs from conversations: a user turn and the assistant turn that follows it."""
    from ..operators.formats import conversation_pairs

    p = conversation_pairs(table(spark, sf_dir, "conversations"))
    m, first = F.col("conv_id") % 7, F.substring_index("chosen", ".", 1)
    rejected = F.when(m == 0, F.col("chosen")).when(m.isin(1, 2), F.concat(first, F.lit("."))).when(m == 3, "I don't know.").otherwise("I don't have information about this topic.")
    p = p.withColumn("rejected", rejected)
    p = p.withColumn("chosen", F.when(F.col("turn") % 4 == 0, F.concat("chosen", F.lit(" because the first step depends on 42"))).otherwise(F.col("chosen")))
    return p.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Explain why and compare, "), "prompt")).otherwise(F.col("prompt")).alias("prompt"), "chosen", "rejected")


PAIRS = r"""
turns AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
raw_pairs AS (SELECT conv_id, turn, text AS prompt, next_text AS chosen FROM turns WHERE role = 'user' AND next_role = 'assistant'),
pairs AS (SELECT conv_id * 100 + turn AS id, CASE WHEN conv_id % 3 = 0 THEN 'Explain why and compare, ' || prompt ELSE prompt END AS prompt,
  CASE WHEN turn % 4 = 0 THEN chosen || ' because the first step depends on 42' ELSE chosen END AS chosen,
  CASE WHEN conv_id % 7 = 0 THEN chosen WHEN conv_id % 7 IN (1, 2) THEN split_part(chosen, '.', 1) || '.' WHEN conv_id % 7 = 3 THEN 'I don''t know.' ELSE 'I don''t have information about this topic.' END AS rejected FROM raw_pairs)
"""


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, p, y, lang): a predicted probability and the label it is held against."""
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(y, "doc_id").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("p"), F.col("quality").cast("int").alias("y"), "lang")


CALIBRATION = "cal AS (SELECT d.doc_id, least(1.0::DOUBLE, n_chars / 4000.0::DOUBLE) AS p, CAST(quality AS INTEGER) AS y, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def training_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training runs, one per order: id, model, mode, status, loss, started_at."""
    o = table(spark, sf_dir, "orders")
    mode = F.element_at(F.array(F.lit("dpo"), F.lit("sft")), (F.col("o_orderkey") % 2 + 1).cast("int"))
    return o.groupBy("o_orderkey").agg(F.min("o_custkey").alias("k"), F.min("o_orderstatus").alias("status"), F.min("o_totalprice").alias("price"), F.min("o_orderdate").alias("started_at")).select(F.col("o_orderkey").alias("id"), F.concat(F.lit("model-"), (F.col("k") % 3).cast("string")).alias("model"), mode.alias("mode"), "status", F.round(F.col("price") / 1e6, 6).alias("loss"), "started_at")


RUNS = "runs AS (SELECT o_orderkey AS id, 'model-' || (min(o_custkey) % 3) AS model, ['dpo', 'sft'][CAST(o_orderkey % 2 + 1 AS INTEGER)] AS mode, min(o_orderstatus) AS status, round(min(o_totalprice) / 1e6::DOUBLE, 6) AS loss, min(o_orderdate) AS started_at FROM orders GROUP BY o_orderkey)"


def evaluation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation results, one per model, subject and day of answers: id, model, task, score, metric, created_at."""
    g = responses(spark, sf_dir).groupBy("model", "subject", "created_at").agg(F.min("id").alias("id"), F.round(F.avg(F.col("right").cast("double")), 6).alias("score"))
    return g.select("id", "model", F.col("subject").alias("task"), "score", F.lit("accuracy").alias("metric"), "created_at")


RESULTS = RESPONSES + ", results AS (SELECT min(id) AS id, model, subject AS task, round(avg(CAST(is_right AS DOUBLE)), 6) AS score, 'accuracy' AS metric, created_at FROM responses GROUP BY model, subject, created_at)"


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, subject) of the answers, and one subject that no answer has."""
    found = responses(spark, sf_dir).select("subject").distinct()
    name = F.col("subject")
    domain = F.when(name.like("high_school%") | name.isin("abstract_algebra", "college_biology"), "STEM").when(name.isin("python", "docker"), "Code").otherwise("Humanities")
    return found.unionByName(found.agg(F.lit("world_religions").alias("subject"))).select(domain.alias("domain"), "subject")


TAXONOMY = RESPONSES + """, names AS (SELECT DISTINCT subject FROM responses UNION ALL SELECT 'world_religions'),
subj AS (SELECT subject, CASE WHEN subject LIKE 'high_school%' OR subject IN ('abstract_algebra', 'college_biology') THEN 'STEM' WHEN subject IN ('python', 'docker') THEN 'Code' ELSE 'Humanities' END AS domain FROM names)"""


def repeated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pairs``, each third one twice with other spaces, and each fifth with a short chosen text."""
    p = pairs(spark, sf_dir)
    again = p.where("id % 3 = 0").select((F.col("id") + 1_000_000_000).alias("id"), "prompt", F.concat("chosen", F.lit("  ")).alias("chosen"), F.concat(F.lit(" "), "rejected").alias("rejected"))
    return p.unionByName(again).withColumn("chosen", F.when(F.col("id") % 5 == 0, F.substring("chosen", 1, 8)).otherwise(F.col("chosen")))


REPEATED = PAIRS + """, twice AS (SELECT id, prompt, chosen, rejected FROM pairs UNION ALL SELECT id + 1000000000, prompt, chosen || '  ', ' ' || rejected FROM pairs WHERE id % 3 = 0),
repeated AS (SELECT id, prompt, CASE WHEN id % 5 = 0 THEN chosen[1:8] ELSE chosen END AS chosen, rejected FROM twice)"""
