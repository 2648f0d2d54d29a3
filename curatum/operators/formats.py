"""Training formats: readers to (prompt, chosen, rejected), writers from it, and pairs of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

FORMATS = ("dpo", "alpaca", "chatml", "completion", "openai_messages", "template_free")


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """Neighbouring user and assistant turns as (conv_id, turn, prompt, chosen)."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("chosen", F.lead("text").over(w))
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "chosen")


def _last(items: Column, field: str, name: str, value: str) -> Column:
    return F.try_element_at(F.filter(items, lambda x: x[field] == name), F.lit(-1))[value]


def _strip(text: Column) -> Column:
    """``text`` without the white space at its ends, of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _tagged(text: Column, role: str) -> Column:
    """Text between the first tag of ``role`` and the end tag behind it, stripped; unterminated: the whole text."""
    tag, end = f"<|im_start|>{role}\n", "<|im_end|>"
    behind = F.substring(text, F.instr(text, tag) + F.lit(len(tag)), F.length(text))
    found = F.when(F.contains(behind, F.lit(end)), _strip(F.substring_index(behind, end, 1))).otherwise(text)
    if role == "user":
        return F.when(F.contains(text, F.lit(tag)) & F.contains(text, F.lit(end)), found).otherwise(text)
    marked = F.contains(text, F.lit("<|im_start|>user\n")) & F.contains(text, F.lit(end))
    return F.when(~marked, text).when(F.contains(text, F.lit(tag)), found).otherwise("")


def write(df: DataFrame, target: str) -> DataFrame:
    """Columns of format ``target`` from id, prompt, chosen, rejected."""
    prompt, chosen, rejected = F.coalesce("prompt", F.lit("")), F.coalesce("chosen", F.lit("")), F.coalesce("rejected", F.lit(""))
    part = lambda text, label: F.struct(text.alias("text"), F.lit(label).alias("label"))
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    columns = {
        "dpo": [prompt.alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected")],
        "alpaca": [prompt.alias("instruction"), F.lit("").alias("input"), chosen.alias("output")],
        "chatml": [F.concat(F.lit("<|im_start|>user\n"), prompt, F.lit("<|im_end|>\n<|im_start|>assistant\n"), chosen, F.lit("<|im_end|>")).alias("text")],
        "completion": [prompt.alias("prompt"), chosen.alias("completion")],
        "openai_messages": [F.array(turn("user", prompt), turn("assistant", chosen)).alias("messages")],
        "template_free": [F.filter(F.array(part(prompt, "instruction"), part(chosen, "response"), part(rejected, "rejected")), lambda x: (x["label"] != "rejected") | (x["text"] != "")).alias("segments")],
    }
    if target not in columns:
        raise ValueError(f"unknown format {target!r}; one of {', '.join(FORMATS)}")
    return df.select("id", *columns[target])


def read(df: DataFrame, source: str) -> DataFrame:
    """id, prompt, chosen, rejected from a table in format ``source``."""
    none, c = F.lit(None).cast("string"), F.col
    readers = {
        "dpo": lambda: (c("prompt"), c("chosen"), c("rejected")),
        "alpaca": lambda: (c("instruction"), c("output"), none),
        "chatml": lambda: (_tagged(c("text"), "user"), _tagged(c("text"), "assistant"), none),
        "completion": lambda: (c("prompt"), c("completion"), none),
        "openai_messages": lambda: (_last(c("messages"), "role", "user", "content"), _last(c("messages"), "role", "assistant", "content"), none),
        "template_free": lambda: (_last(c("segments"), "label", "instruction", "text"), _last(c("segments"), "label", "response", "text"), _last(c("segments"), "label", "rejected", "text")),
    }
    if source not in readers:
        raise ValueError(f"unknown format {source!r}; one of {', '.join(FORMATS)}")
    prompt, chosen, rejected = readers[source]()
    return df.select("id", F.coalesce(prompt, F.lit("")).alias("prompt"), F.coalesce(chosen, F.lit("")).alias("chosen"), rejected.alias("rejected"))


def convert(df: DataFrame, source: str, target: str) -> DataFrame:
    if source not in FORMATS or target not in FORMATS:
        raise ValueError(f"unknown format; one of {', '.join(FORMATS)}")
    return df if source == target else write(read(df, source), target)
