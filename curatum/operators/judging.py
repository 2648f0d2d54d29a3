"""Judge replies to verdicts, panels that escalate, repeated runs, prices, and asking a model in batches."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from functools import partial

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


def judge_prompt(question: Column, answer: Column, claimed: Column | None = None) -> Column:
    """What a judge is asked about one answer, with the claimed key where there is one."""
    head = F.concat(
        F.lit("You are an expert reviewer evaluating a training data entry for correctness.\nAnalyze whether the provided answer is correct.\nExplain your logic step-by-step in the reasoning field before giving the verdict fields.\n\nQuestion: "),
        question, F.lit("\n\nAnswer to evaluate: "), answer, F.lit("\n\n"),
    )
    key = F.lit("") if claimed is None else F.when(F.coalesce(claimed, F.lit("")) != "", F.concat(F.lit("Claimed correct answer: "), claimed, F.lit("\n\n"))).otherwise("")
    tail = 'Evaluate whether the answer is factually correct.\nRespond in the following JSON format only:\n{"reasoning": "step-by-step logic", "correct": true/false, "confidence": 0.0-1.0, "explanation": "brief verdict summary"}'
    return F.concat(head, key, F.lit(tail))


def _truth(value: object) -> bool:
    if isinstance(value, str):
        word = value.strip().lower()
        return word in ("true", "yes", "correct") or (word not in ("false", "no", "incorrect", "wrong") and bool(value))
    return bool(value)


#: Fixed value: stands for an explanation that is missing or empty.
NO_EXPLANATION = "No explanation provided."


def _fields(data: dict) -> tuple[bool, float, str, str]:
    explanation = str(data.get("explanation") or NO_EXPLANATION)
    return _truth(data.get("correct", False)), float(data.get("confidence", 0.5)), explanation, str(data.get("reasoning") or explanation)


def _braced(text: str):
    """The balanced ``{...}`` pieces of a text, by where they start; braces in strings count too. One pass."""
    opened, closed = [], {}
    for brace in re.finditer(r"[{}]", text):
        if brace.group() == "{":
            opened.append(brace.start())
        elif opened:
            closed[opened.pop()] = brace.end()
    for start in sorted(closed):
        yield text[start : closed[start]]


#: Starts of texts and of braced pieces without which the parser fails, told without its costly error.
_VALUE = re.compile(r'[{\["\-0-9]|true|false|null|NaN|Infinity')
_OBJECT = re.compile(r'\{[ \t\r\n]*["}]')


def json_verdict(text: str) -> tuple[str | None, bool | None, float | None, str | None, str | None]:
    """(mode, correct, confidence, explanation, reasoning) of a reply with JSON; all None where none can be read."""
    whole = text.strip()
    if _VALUE.match(whole):
        try:
            data = json.loads(whole)
            return ("json", *_fields(data)) if isinstance(data, dict) else ("neutral", True, 0.5, "", "")
        except (ValueError, TypeError, RecursionError):
            pass
    for piece in _braced(text):
        if _OBJECT.match(piece):
            try:
                return ("embedded_json", *_fields(json.loads(piece)))
            except (ValueError, TypeError, RecursionError):
                continue
    return (None,) * 5


_VERDICT = pa.struct([("mode", pa.string()), ("correct", pa.bool_()), ("confidence", pa.float64()), ("explanation", pa.string()), ("reasoning", pa.string())])


def _json_verdicts(texts: pa.Array) -> pa.Array:
    """:func:`json_verdict` of each text; null for null, which costs no step of a loop."""
    rows = [json_verdict(x) for x in texts.drop_null().to_pylist()]
    read = pa.StructArray.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_VERDICT)], fields=list(_VERDICT))
    valid = texts.is_valid()
    place = pc.subtract(pc.cumulative_sum(valid.cast(pa.int64())), 1)
    return read.take(pc.if_else(valid, place, None))


def _flat_verdict() -> str:
    """Pattern of one flat JSON object whose verdict fields have the asked types, braces in strings or not.

    Every loop is possessive: a reply is passed once, in constant stack. Escapes of code units are left to Python's parser.
    """
    space, text = r"[ \t\r\n]*+", r'"[^"\\\x00-\x1F]*+(?:\\["\\/bfnrt][^"\\\x00-\x1F]*+)*+"'
    colon, asked = f"{space}:{space}", '"(?:correct|confidence|explanation|reasoning)"'
    field = "|".join([
        f'"correct"{colon}(?:true|false)', rf'"confidence"{colon}-?[0-9][-+.0-9eE]*+', f'"(?:explanation|reasoning)"{colon}{text}',
        rf'(?!{asked}){text}{colon}(?:{text}|[^"{{}}\[\],\s]++|\[(?:[^"{{}}\[\]]++|{text})*+\])',
    ])
    return rf"\A{space}\{{{space}(?:{field}){space}(?:,{space}(?:{field}){space})*+\}}{space}\z"


#: Texts that Python's parser may find JSON in: a brace that is closed later, or the start of another value.
_MAYBE_JSON = r'\A(?:[^{]*+\{[^}]*+\}|[\s\x1C-\x1F\x85\p{Z}]*+(?:[\["\-0-9]|true|false|null|NaN|Infinity))'


def _plain_verdict(v: Column) -> Column:
    """The fields of variant ``v``, a reply of the form :func:`_flat_verdict`, got at once."""
    return F.try_variant_get(v, "$", "struct<correct: boolean, confidence: double, explanation: string, reasoning: string>")


#: White space of Unicode, as regular expressions take it.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def parse_verdicts(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Add parse_mode, correct, confidence, explanation, reasoning to raw judge replies.

    A reply that is one flat JSON object of the asked types is read as a variant, natively, as the text
    rules are; only other replies that could hold JSON go through the Arrow function.
    A null reply and JSON that is no object are neutral: (true, 0.5).
    """

    @F.arrow_udf("mode string, correct boolean, confidence double, explanation string, reasoning string")
    def from_json(texts: pa.Array) -> pa.Array:
        return _json_verdicts(texts)

    text, low = F.col(column), F.lower(column)
    n, p, short = F.col("_n"), F.col("_p"), F.col("_short")
    tried = replies.withColumn("_v", F.when(text.rlike(_flat_verdict()), F.try_parse_json(text))).withColumn("_n", _plain_verdict(F.col("_v"))).drop("_v")
    tried = tried.withColumn("_p", from_json(F.when(n.isNull() & text.rlike(_MAYBE_JSON), text)))
    tried = tried.withColumn("_short", F.when(n.isNull() & p.mode.isNull(), F.substring(F.btrim(text, F.lit(_SPACES)), 1, 500)))
    right, wrong = low.contains("correct") & ~low.contains("incorrect"), low.contains("incorrect") | low.contains("wrong")
    pick = lambda of_null, native, python, of_text: F.when(text.isNull(), of_null).when(n.isNotNull(), native).when(p.mode.isNotNull(), python).otherwise(of_text)
    filled = lambda value, empty: F.when(value != "", value).otherwise(empty)
    why = filled(n.explanation, F.lit(NO_EXPLANATION))
    return tried.select(
        *replies.columns, pick(F.lit("neutral"), F.lit("json"), p.mode, F.lit("text")).alias("parse_mode"), pick(F.lit(True), F.coalesce(n.correct, F.lit(False)), p.correct, right).alias("correct"),
        pick(F.lit(0.5), F.coalesce(n.confidence, F.lit(0.5)), p.confidence, F.when(right, 0.7).when(wrong, 0.3).otherwise(0.5)).alias("confidence"),
        pick(F.lit(""), why, p.explanation, short).alias("explanation"), pick(F.lit(""), filled(n.reasoning, why), p.reasoning, short).alias("reasoning"),
    )


def parse_report(parsed: DataFrame, *by: str) -> DataFrame:
    """How many replies were read in which mode, by ``by`` (the judge)."""
    return parsed.groupBy(*by, "parse_mode").agg(F.count("*").alias("n"))


def escalation(verdicts: DataFrame, *, quorum: float = 2 / 3, panel_mean: float = 0.7, dissent: float = 0.9, senior: float = 0.75, premium: float = 0.7) -> DataFrame:
    """(entry_id, tier): who settles each entry.

    The panel does where it has a quorum, is sure on average and nobody dissents with high
    confidence; else its last judge, if sure and of the majority's mind; else a premium judge, by
    the highest confidence; else a human.
    """
    g = verdicts.groupBy("entry_id").agg(
        F.count("*").alias("n"), F.count_if("correct").alias("yes"), F.avg("confidence").alias("mean"), F.max("confidence").alias("top"),
        F.max(F.when(F.col("correct"), F.col("confidence"))).alias("top_yes"), F.max(F.when(~F.col("correct"), F.col("confidence"))).alias("top_no"), F.max_by("correct", "judge_no").alias("last_correct"), F.max_by("confidence", "judge_no").alias("last_sure"),
    )
    major = F.col("yes") * 2 > F.col("n")
    agree = F.greatest(F.col("yes"), F.col("n") - F.col("yes")) / F.col("n")
    against = F.coalesce(F.when(major, F.col("top_no")).otherwise(F.col("top_yes")), F.lit(0.0))
    settled = (F.round(agree, 6) >= round(quorum, 6)) & (F.round("mean", 6) >= panel_mean) & (against < dissent)
    tier = F.when(settled, "panel").when((F.col("last_sure") >= senior) & (F.col("last_correct") == major), "senior").when(F.col("top") >= premium, "premium").otherwise("human")
    return g.select("entry_id", tier.alias("tier"))


def flip_rate(first: DataFrame, second: DataFrame) -> DataFrame:
    """Share of verdicts by judge that change when the same question is judged again."""
    a, b = first.select("entry_id", "judge_no", F.col("correct").alias("x")), second.select("entry_id", "judge_no", F.col("correct").alias("y"))
    return a.join(b, ["entry_id", "judge_no"]).groupBy("judge_no").agg(F.count("*").alias("n"), F.round(F.avg((F.col("x") != F.col("y")).cast("double")), 6).alias("flip_rate"))


def cost_report(cascaded: DataFrame, prices: dict[str, float]) -> DataFrame:
    """Calls and cost by tier of a cascade (flags escalated, tiebreaker_used); ``prices`` per call in tier order."""
    g = cascaded.agg(F.count("*").alias("a"), F.count_if("escalated").alias("b"), F.count_if("tiebreaker_used").alias("c"))
    rows = F.array(*(F.struct(F.lit(tier).alias("tier"), F.col(c).alias("calls"), F.round(F.col(c) * price, 6).alias("cost")) for c, (tier, price) in zip("abc", prices.items(), strict=True)))
    return g.select(F.inline(rows))


def spot_check(judged: DataFrame, n: int = 100, seed: int = 7, alarm: float = 0.15) -> DataFrame:
    """Disagreement of ``correct`` and ``recheck`` on the ``n`` rows with the smallest hash of their id: a top-n, no global sort."""
    sample = judged.select("correct", "recheck", F.xxhash64("id", F.lit(seed)).alias("h"), "id").orderBy("h", "id").limit(n)
    rate = F.avg((F.col("correct") != F.col("recheck")).cast("double"))
    return sample.agg(F.count("*").alias("n"), F.round(rate, 6).alias("disagreement"), (rate > alarm).alias("alarm"))


class Pace:
    """A bucket that fills at ``rate`` a second and begins empty; what it gains while nothing is due is lost, so there are no bursts."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic):
        self.rate, self.clock, self.at = rate, clock, clock()

    def due(self, cost: float) -> float:
        """When ``cost`` may be spent."""
        return self.at + cost / self.rate

    def spend(self, cost: float) -> None:
        self.at = max(self.due(cost), self.clock())


def packed(costs: list[int], count: int, most: int | None) -> list[list[int]]:
    """Places of ``costs`` in batches of at most ``count`` whose number times largest cost, as padded, is at
    most ``most``. A cost beyond ``most`` has a batch of its own. Similar costs lie together."""
    if most is None:
        return [list(range(i, min(i + count, len(costs)))) for i in range(0, len(costs), count)]
    batches: list[list[int]] = []
    for i in sorted(range(len(costs)), key=lambda i: (costs[i], i)):  # ascending, so the new cost is the largest
        if batches and len(batches[-1]) < count and (len(batches[-1]) + 1) * costs[i] <= most:
            batches[-1].append(i)
        else:
            batches.append([i])
    return batches


def asking(make_client, *, batch: int = 64, max_tokens: int | None = None, batch_tokens: int | None = None, calls_per_second: float | None = None, tokens_per_second: float | None = None, tokens: Callable[[str], int] = lambda text: len(text) // 4 + 1, clock=time.monotonic, sleep=time.sleep):
    """The function that asks the prompts of one partition, at that partition's rates."""

    def run(frames):
        ask = make_client()
        if max_tokens is not None:
            ask = partial(ask, max_tokens=max_tokens)
        calls = Pace(calls_per_second, clock) if calls_per_second else None
        spent = Pace(tokens_per_second, clock) if tokens_per_second else None

        def call(prompts: list[str], cost: int) -> list[str]:
            wait = max([0.0, *(p.due(c) - clock() for p, c in ((calls, 1), (spent, cost)) if p)])
            if wait:
                sleep(wait)
            for p, c in ((calls, 1), (spent, cost)):
                if p:
                    p.spend(c)
            replies = ask(prompts)
            if len(replies) != len(prompts):
                raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
            return replies

        for pdf in frames:
            texts = pdf.prompt.fillna("").tolist()
            costs = [tokens(t) + (max_tokens or 0) for t in texts]
            replies, errors = [None] * len(texts), [None] * len(texts)
            for at in packed(costs, batch, batch_tokens):
                try:
                    for i, reply in zip(at, call([texts[i] for i in at], sum(costs[i] for i in at)), strict=True):
                        replies[i] = reply
                except Exception as whole:  # noqa: BLE001 - the client is the user's; its error is the row's result
                    for i in at:
                        try:
                            if len(at) == 1:
                                raise whole
                            replies[i] = call([texts[i]], costs[i])[0]
                        except Exception as e:  # noqa: BLE001
                            errors[i] = f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"id": pdf.id, "prompt_hash": pdf.prompt_hash, "reply": replies, "error": errors})

    return run


def batch_ask(prompts: DataFrame, make_client: Callable[[], Callable[..., list[str]]], *, answered: DataFrame | None = None, calls_per_second: float | None = None, tokens_per_second: float | None = None, tasks: int | None = None, **limits) -> DataFrame:
    """(id, prompt_hash, reply, error) of ``prompts(id, prompt)``, asked in batches within each partition.

    ``make_client`` is called once a partition. A batch that fails is asked again row by row, so
    that an error stays with its row. Prompts whose hash is in ``answered(prompt_hash)`` are skipped.

    ``calls_per_second`` and ``tokens_per_second`` hold for the whole job: prompts then lie in at most
    ``tasks`` partitions (the session's default parallelism), each of which has an equal share. Spark runs a
    lost task again with the share it had; with speculative execution two copies would share one, so leave that
    off. ``batch_tokens`` bounds a batch as padded to its longest prompt, ``max_tokens`` goes to the
    client and counts as spent for each prompt; see :func:`asking` for the others.
    """
    rows = prompts.select("id", "prompt", F.sha2(F.coalesce("prompt", F.lit("")), 256).alias("prompt_hash"))
    if answered is not None:
        rows = rows.join(answered.select("prompt_hash").distinct(), "prompt_hash", "left_anti").select("id", "prompt", "prompt_hash")
    if calls_per_second or tokens_per_second:
        tasks = tasks or prompts.sparkSession.sparkContext.defaultParallelism
        rows = rows.repartition(tasks)
    share = lambda rate: rate and rate / tasks
    run = asking(make_client, calls_per_second=share(calls_per_second), tokens_per_second=share(tokens_per_second), **limits)
    return rows.mapInPandas(run, "id long, prompt_hash string, reply string, error string")
