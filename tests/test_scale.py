"""What a task holds: plans and partitions that keep it from growing with the tables."""

import contextlib
import io
import json
import random
import re
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from curatum.functions import answers as A
from curatum.operators import ingest, judging, knowledge, review, taxonomy
from curatum.sources import fixtures as X


def _plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_never_probed_joins_one_row_a_subject(spark):
    """every response used to be sorted for the join, those of a subject in one task."""
    subjects = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", None)], "domain string, subject string")
    responses = spark.createDataFrame([(i, s) for i, s in enumerate(["x", "x", "x", None])], "id long, subject string")
    got = taxonomy.never_probed(subjects, responses)
    assert sorted(map(tuple, got.collect()), key=str) == [("A", "y"), ("B", None)]
    assert "Aggregate(keys=[subject" in _plan(got)


def test_responses_are_dealt_by_their_number(spark, sf, monkeypatch):
    """F1, F8, F9, F10: the tasks that group lines grow with the table."""
    want = sorted(map(str, X.responses(spark, sf).collect()))
    lines = X.table(spark, sf, "lineitem").count()
    monkeypatch.setattr(X, "LINES_A_TASK", 250)
    many = X.responses(spark, sf)
    assert many.rdd.getNumPartitions() == -(-lines // 250) > 4
    assert sorted(map(str, many.collect())) == want


def test_many_tasks_are_dealt_for_in_two_steps(spark, sf, monkeypatch):
    """for more than 200 tasks, each task that read the table held all its lines to sort them by task, and spilled."""
    want = sorted(map(str, X.responses(spark, sf).collect()))
    monkeypatch.setattr(X, "LINES_A_TASK", 20)
    many = X.responses(spark, sf)
    assert many.rdd.getNumPartitions() > 200
    assert sorted(map(str, many.collect())) == want
    plan = _plan(review.consensus(_verdicts(spark, sf)))
    dealt = [int(x) for x in re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert plan.count("Exchange ") == len(dealt) == 2 and dealt[0] > dealt[1] == 200


def _verdicts(spark, sf):
    return X.verdicts(spark, sf).select("entry_id", "judge_no", "correct", "confidence")


def test_spot_check_needs_no_shuffle_by_entry(spark, sf):
    """F8: a pivot grouped and shuffled by entry and judge, then by entry."""
    rechecked = entry.queries()["judge_spot_check"](spark, sf)
    assert _plan(rechecked).count("Exchange hashpartitioning(") == 1
    wide = {}
    for r in _verdicts(spark, sf).where("judge_no < 3").collect():
        wide.setdefault(r.entry_id, {})[r.judge_no] = r.correct
    hashes = spark.createDataFrame([(i,) for i in wide], "id long").selectExpr("id", "xxhash64(id, 7) AS h").orderBy("h", "id").limit(100).collect()
    differ = sum(wide[r.id][1] != wide[r.id][2] for r in hashes)
    assert rechecked.first().asDict() == {"n": 100, "disagreement": differ / 100, "alarm": differ > 15}


def test_consensus_needs_no_second_shuffle(spark, sf):
    """verdicts, three times the answers, were shuffled by entry again."""
    assert _plan(review.consensus(_verdicts(spark, sf))).count("Exchange hashpartitioning(") == 1


def test_escalation_is_hashed(spark, sf):
    """verdicts were shuffled again and sorted by entry, since the last judge's verdict was kept as a struct."""
    plan = _plan(judging.escalation(_verdicts(spark, sf)))
    assert plan.count("Exchange hashpartitioning(") == 1 and "SortAggregate" not in plan and "Sort " not in plan
    rows = [(1, 1, True, 0.5), (1, 3, False, 0.8), (1, 2, True, None), (2, 2, True, 0.6), (2, 1, False, 0.95)]
    tiers = judging.escalation(spark.createDataFrame(rows, "entry_id long, judge_no int, correct boolean, confidence double"))
    assert {r.entry_id: r.tier for r in tiers.collect()} == {1: "premium", 2: "premium"}


class _Rows:
    """Takes the function that an operator gives to mapInArrow."""

    def select(self, *columns):
        return self

    where = select

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


def _held(operator, batch):
    """Most bytes of Python's objects while a batch goes through, and the rows that come back."""
    run, rows = operator(_Rows()).run, 0
    tracemalloc.start()
    for out in run(iter([batch])):
        rows += out.num_rows
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most, rows


def _pages(n):
    html = "<html><body><main>" + "<p>" + "A passage of a page that says something. " * 500 + "</p>" + '<a href="/{0}">x</a><a href="/{0}#y">x</a><a href="#z">x</a><a href="mailto:a@b">x</a></main></body></html>'
    return pa.record_batch({"page_id": list(range(n)), "url": [f"https://h.x/{i}" for i in range(n)], "html": [html.format(i) for i in range(n)]})


def test_page_links_hold_a_slice(spark):
    """two Python workers a task held whole batches, one the pages and their texts, one the links."""
    most, rows = _held(ingest.page_links, _pages(1500))  # 30 MB
    assert rows == 1500 and most < 20_000_000
    pages = spark.createDataFrame([(1, "https://h.x/a", '<a href="b">1</a><a href="/b#c">2</a><a href="https://o.x/">3</a><a href="tel:1">4</a><a href="?q">5</a>'), (2, None, None)], "page_id long, url string, html string")
    got = ingest.page_links(pages)
    assert [tuple(r) for r in got.collect()] == [(1, "https://h.x/a", 0, "https://h.x/b"), (1, "https://h.x/a", 1, "https://h.x/a?q")]
    assert _plan(got).count("MapInArrow") == 1 and "EvalPython" not in _plan(got)


def test_evidence_holds_a_slice():
    """the passages of a whole batch of pages were one frame."""
    most, rows = _held(knowledge._blocks, _pages(1500).select(["page_id", "html"]))
    assert rows == 1500 and most < 20_000_000


def test_ingest_holds_a_slice():
    """pages and chunks of a whole batch were frames."""
    most, rows = _held(ingest.extract_pages, _pages(1500))
    assert rows == 1500 and most < 20_000_000
    most, rows = _held(ingest.chunks, _pages(1500).select(["page_id", "html"]))
    assert rows == 9000 and most < 20_000_000


def test_chunks_of_many_slices(spark):
    """the step of chunk, qa_prompt and qa_generate; no pandas, whole results."""
    texts = [(1, "One. " * 300_000), (2, None), (3, "Two! " * 700_000), (4, ""), (5, "\n\n é. " * 500_000)]
    got = ingest.chunks(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1))
    want = [(i, a, b, t[a:b].strip()) for i, t in texts for a, b in ingest.chunk_bounds(t or "", 4000, 200) if t[a:b].strip()]
    assert [(r.doc_id, r.start_char, r.end_char, r.text) for r in got.collect()] == want
    assert "MapInArrow" in _plan(got) and "Pandas" not in _plan(got)


def test_sanitize_by_slices(spark):
    """a whole batch became Python's objects and a frame; now an Arrow function (evaluation type 250) takes slices."""
    text = "Jailbreak  \u200bthis. " * 60_000
    got = ingest.sanitize(spark.createDataFrame([(i, text if i % 4 else None) for i in range(12)], "doc_id long, text string").coalesce(1))
    assert ", 250" in _plan(got)
    for r in got.collect():
        assert (r.clean_text, r.flags or []) == (ingest.clean_one(text) if r.doc_id % 4 else ("", []))


def _by_python(text):
    """What a reply is read as when Python's parser tries every piece of it."""
    for mode, piece in [("json", text.strip()), *(("embedded_json", x) for x in judging._braced(text))]:
        with contextlib.suppress(ValueError, TypeError, RecursionError):
            data = json.loads(piece)
            return (mode, *judging._fields(data)) if isinstance(data, dict) else ("neutral", True, 0.5, "", "")
    low, short = text.lower(), text.strip()[:500]
    right, wrong = "correct" in low and "incorrect" not in low, "incorrect" in low or "wrong" in low
    return "text", right, 0.7 if right else 0.3 if wrong else 0.5, short, short


def _replies():
    rng = random.Random(7)
    words = ["{", "}", '"', ":", ",", " ", "[", "]", '{"correct": true', '"correct"', '"confidence"', '"explanation"', '"reasoning"', "true", "false", "null", "0.5", "1", "-1e3", "01", "NaN", "x", '\\"', "\\n", "\n", "wrong", "\u2003"]
    texts = ["".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(3000)]
    values = {"correct": ["true", "false", '"no"', "1", "null"], "confidence": ["0.85", "1", "-0", "1e400", "12345678901234567890.5", '"0.4"', "01", "1-2", "[1]"], "explanation": ['"by {judge} 2"', '"}{"', '""', "5", "null", '"a \\\\ \\" b"', '"\\u00e9"', '"a\tb"', '"é"'], "more": ["[1, true]", '["{", "]"]', "{}", "null", "x", "1.0", '"correct"']}
    values["reasoning"] = values["explanation"]
    for _ in range(3000):
        fields = [f'"{k}"{rng.choice([": ", ":", " :\n"])}{rng.choice(values[k][: rng.choice([1, 2, 99])])}' for k in rng.choices(list(values), k=rng.randint(1, 5))]
        texts.append(rng.choice(["", "", " ", "\n", "So {as asked}: ", "\xa0"]) + "{" + rng.choice([",", ", ", ",\n "]).join(fields) + "}" + rng.choice(["", "", "\n", " so.", "}", "\x0b"]))
    long = '\\" {' * 100_000
    return [*texts, f'{{"correct": true, "explanation": "{long}"}}', "{" * 200_000, "no verdict {broken", "\u3000 5 \u3000x"]


def test_replies_are_read_as_python_reads_them(spark):
    """natively or not, by the same rules; failures told early are failures."""
    texts = _replies()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, reply string")
    got = {r.id: (r.parse_mode, r.correct, r.confidence, r.explanation, r.reasoning) for r in judging.parse_verdicts(df).collect()}
    differ = [(t[:200], got[i], _by_python(t)) for i, t in enumerate(texts) if repr(got[i]) != repr(_by_python(t))]
    assert not differ, (len(differ), differ[:3])
    modes = [g[0] for g in got.values()]
    assert all(modes.count(m) > 50 for m in ("json", "embedded_json", "text"))


def test_braces_in_strings_are_read_natively(spark, monkeypatch):
    """any brace within a string, and any open brace in a text, sent a reply to Python through pandas."""
    real = judging.F.arrow_udf

    def refuse(texts: pa.Array) -> pa.Array:
        if texts.null_count < len(texts):
            raise ValueError("a reply reached Python")
        return pa.nulls(len(texts), pa.struct([("mode", pa.string()), ("correct", pa.bool_()), ("confidence", pa.float64()), ("explanation", pa.string()), ("reasoning", pa.string())]))

    monkeypatch.setattr(judging.F, "arrow_udf", lambda kind: lambda f: real(refuse, kind))
    texts = ['{"correct": true, "confidence": 0.8, "explanation": "by {judge} 1", "reasoning": "}{"}', '{\n  "more": ["{"],\n  "correct": false,\n  "explanation": ""\n}', "no verdict {broken", None]
    got = judging.parse_verdicts(spark.createDataFrame([(t,) for t in texts], "reply string"))
    assert ", 250" in _plan(got) and "andas" not in _plan(got)
    assert [(r.parse_mode, r.correct, r.explanation) for r in got.collect()] == [("json", True, "by {judge} 1"), ("json", False, judging.NO_EXPLANATION), ("text", False, "no verdict {broken"), ("neutral", True, "")]


def test_answer_letter_searches_each_pattern_once(spark):
    """five patterns on a trimmed copy, each searched twice; the letters are the same."""
    texts = ["", None, " A)", "\n (B) ", "x\n C) y", "the answer is d", "Answer : c then B", "Answer: b, the answer is A", "no", " A ", "aA) Bb", "B\tanswer is", "D_", "(A)(B)", "éA) C"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    trimmed = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    old = F.coalesce(*(F.nullif(F.upper(F.regexp_extract(trimmed, p, 1)), F.lit("")) for p in A.ANSWER_PATTERNS))
    new = df.select(old.alias("old"), A.answer_letter(F.col("t")).alias("new"))
    assert all(r.old == r.new for r in new.collect())
    assert "(?U)" not in _plan(df.select(A.answer_letter(F.col("t"))))
