"""Question-answer pairs from chunks of text, and evidence passages of stored pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import ingest

#: How a sentence says what something is, in the order tried.
DEFINITIONS = (r"^([A-Z][^.]{2,60}?)\s+(?:is|are|refers to|means|is defined as)\s+(.+?[.!?])", r"^([A-Z][^:]{2,60}?):\s*(.+?[.!?])")
#: Sentence shapes and the question each gives; the first may carry the subject.
SHAPES = (
    (r"^([A-Z][^.]{2,60}?)\s+(?:is|are)\s+", 0, "what is {}?"),
    (r"^([A-Z][^.]{2,60}?)\s+can be used to\s+", re.IGNORECASE, "How can {} be used?"),
    (r"^([A-Z][^.]{2,60}?)\s+(?:allows|enables)\s+", re.IGNORECASE, "What does {} allow or enable?"),
)
#: White space as a class of Java's patterns, with all that Unicode has.
_WS = r"[\t-\r\x1C- \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

_SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _java(pattern: str, flags: int = 0) -> str:
    """The pattern for Java: all white space counts, only line feeds end lines, and without case dotted and dotless i are letters."""
    free = bool(flags & re.IGNORECASE)
    return ("(?diu)" + pattern.replace("[A-Z]", "[A-Z\u0130\u0131]") if free else "(?d)" + pattern).replace(r"\s", _WS)


def _strip(x: Column) -> Column:
    return F.trim(x, F.lit(_SPACES))


def _filled(question: str, term: Column) -> Column:
    before, after = question.split("{}")
    return F.concat(F.lit(before), term, F.lit(after))


def _heading(lines: str, within: str):
    """For ``lines``, what a line asks as a heading and the lines after it as the answer; null if it is none."""

    def pair(line: Column, at: Column) -> Column:
        body = F.array_join(F.slice(F.filter(F.slice(lines, at + 2, 5), lambda x: x != ""), 1, 3), " ")
        title = F.regexp_replace(F.regexp_replace(line, _java(r"^[\p{Nd}.]+\s*"), ""), _java(r"^#+\s*"), "")
        named = title.rlike(r"^\p{IsUppercase}") & (F.size(F.split(title, f"{_WS}+")) <= 6)
        question = F.when(named, _filled("what is {}?", title)).otherwise(_filled('what does the following describe: "{}"?', title))
        fits = F.length(line).between(3, 99) & ~line.rlike("[.,;:?!]\\z") & (F.length(body) > 20) & (F.length(title) >= 3)
        return F.when(fits, F.struct(F.concat(F.lit(within), question).alias("question"), F.substring(body, 1, 500).alias("answer")))

    return pair


def _definition(within: str):
    """What a sentence defines, by the first pattern that it has; null if by none."""

    def pair(sentence: Column) -> Column:
        found = F.lit(None)
        for pattern in map(_java, reversed(DEFINITIONS)):
            term, rest = (_strip(F.regexp_extract(sentence, pattern, i)) for i in (1, 2))
            made = F.struct(_filled(f"{within}what is {{}}?" if within else "What is {}?", term).alias("question"), F.concat_ws(" ", term, rest).alias("answer"))
            found = F.when(sentence.rlike(pattern), made).otherwise(found)
        return F.when(F.substring(sentence, 1, 1).between("A", "Z"), found)  # as all of them begin

    return pair


def _ask(sentence: Column, within: str) -> Column:
    """The question of a sentence's first shape, else of its first three words; null if it has fewer."""
    asked = []
    for n, (shape, flags, question) in enumerate(SHAPES):
        term = F.nullif(_strip(F.regexp_extract(sentence, _java(shape, flags), 1)), F.lit(""))
        asked.append(_filled(question if n else within + question, term))  # null without a term
    words = F.slice(F.split(sentence, f"{_WS}+", 4), 1, 3)
    return F.coalesce(*asked, F.when(F.size(words) == 3, _filled('What can you tell me about: "{}..."?', F.array_join(words, " "))))


def proposals(chunks: DataFrame, subject: str | None = None) -> DataFrame:
    """``chunks`` with ``pairs``, an array of (question, answer) of its ``text``: from headings, from definitions,
    then from those of its first ten sentences that no answer before holds. Null text is empty. No Python.

    Lines and sentences are columns of their own, so that Spark splits a text once.
    """
    within = f"In {subject}, " if subject else ""
    text = F.coalesce("text", F.lit(""))
    lines = F.transform(F.split(_strip(text), "\n"), _strip)
    sentences = F.filter(F.split(_strip(text), f"(?<=[.!?]){_WS}+"), lambda x: x != "")
    split = chunks.withColumns({"_lines": lines, "_sentences": sentences})
    stated = F.concat(F.transform("_lines", _heading("_lines", within)), F.transform("_sentences", _definition(within)))
    split = split.withColumn("_stated", F.filter(stated, lambda x: x.isNotNull()))

    asked = lambda x: F.struct(F.when(F.length(x).between(30, 300), _ask(x, within)).alias("question"), x.alias("answer"))
    split = split.withColumn("_asked", F.filter(F.transform(F.slice("_sentences", 1, 10), asked), lambda x: x["question"].isNotNull()))

    def more(pairs: Column, new: Column) -> Column:
        held = F.exists(pairs, lambda x: F.contains(x["answer"], F.substring(new["answer"], 1, 50)))
        return F.when(held, pairs).otherwise(F.array_append(pairs, new))

    return split.withColumn("pairs", F.aggregate("_asked", F.col("_stated"), more)).drop("_lines", "_sentences", "_stated", "_asked")


def generate_qa(chunks: DataFrame, subject: str | None = None, scope: tuple[str, ...] = ("doc_id", "chunk_ref")) -> DataFrame:
    """(doc_id, chunk_ref, id, question, answer): first answer of each question of a chunk, or of ``scope``."""
    made = proposals(chunks.select("doc_id", "index", "text"), subject)
    flat = made.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("index").cast("int").alias("chunk_ref"), F.posexplode("pairs").alias("id", "qa"))
    return ingest.qa_dedup(flat.select("doc_id", "chunk_ref", "id", "qa.question", "qa.answer"), *scope)


def ingest_pages(pages: DataFrame) -> dict[str, DataFrame]:
    """The whole lane: ``pairs`` with page_id and chunk_ref, ``manifest`` of the pages kept, ``totals``.

    Pages under 50 clean characters are skipped. The sanitised pages feed all three, so they are stored once.
    """
    clean = ingest.sanitize(ingest.extract_pages(pages).select(F.col("page_id").alias("doc_id"), "url", "title", F.col("content").alias("text")))
    clean = ingest.stored(clean.where(F.length("clean_text") >= 50))
    parts = ingest.chunks(clean.select("doc_id", F.col("clean_text").alias("text")))
    qa = generate_qa(parts).select(F.col("doc_id").alias("page_id"), "chunk_ref", F.col("id").alias("place"), "question", "answer", F.concat_ws("-", "doc_id", "chunk_ref", "id").alias("id"))
    made = ingest.qa_pairs(qa).join(qa.select("id", "page_id", "chunk_ref"), "id")
    manifest = ingest.manifest(clean.select(F.col("doc_id").alias("id"), F.col("clean_text").alias("text"))).join(clean.select(F.col("doc_id").alias("id"), "url", "title", F.when(F.col("is_safe"), "clean").otherwise("flagged").alias("status"), F.to_json("flags").alias("flags")), "id")
    return {"pairs": made, "manifest": manifest, "totals": manifest.groupBy("status").agg(F.count("*").alias("pages"), F.sum("word_count").alias("words"))}


def qa_prompt(text: Column, subject: str | None = None) -> Column:
    """What a model is asked for pairs of a chunk; the prompt holds its first 4,000 characters."""
    where = f" in the domain of {subject}" if subject else ""
    head = f"Read the following text and generate 3-5 question-answer pairs based on its content.\nThe answers should be factual and grounded in the text{where}.\n\nText:\n---\n"
    tail = '\n---\n\nOutput the Q&A pairs as a JSON array where each element has "question" and "answer" keys.\nOnly output the JSON array, no other text.\n\nExample format:\n[{"question": "...", "answer": "..."}, {"question": "...", "answer": "..."}]\n'
    return F.concat(F.lit(head), F.substring(text, 1, 4000), F.lit(tail))


def parse_qa_replies(replies: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_ref, id, question, answer) of replies (doc_id, index, reply); chunks whose reply holds no pair fall back to ``generate_qa``."""
    items = F.from_json(F.regexp_extract("reply", r"(?s)\[.*\]", 0), "array<struct<question:string,answer:string>>")
    read = replies.select("doc_id", F.col("index").alias("chunk_ref"), F.posexplode(items).alias("id", "qa")).select("doc_id", "chunk_ref", "id", "qa.question", "qa.answer").where("question is not null and answer is not null")
    rest = chunks.join(read.select("doc_id", F.col("chunk_ref").alias("index")).distinct(), ["doc_id", "index"], "left_anti")
    return read.unionByName(generate_qa(rest))


class _Passages(ingest._Extractor):
    """Blocks of the main part of a page, if it has one, else of all of it."""

    SKIP = frozenset(("script", "style", "noscript", "svg", "header", "footer", "nav", "aside", "form"))
    BLOCKS = frozenset(("p", "li", "blockquote", "h1", "h2", "h3"))
    ROOTS = frozenset(("main", "article"))

    def __init__(self) -> None:
        super().__init__()
        self.inside, self.rooted = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag in self.ROOTS
        before = len(self.blocks)
        super().handle_starttag(tag, attrs)
        self.rooted += [self.inside > 0] * (len(self.blocks) - before)

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        self.inside = max(0, self.inside - (tag in self.ROOTS))

    def passages(self) -> list[str]:
        texts = [(" ".join(" ".join(parts).split()), rooted) for (_, parts), rooted in zip(self.blocks, self.rooted, strict=True)]
        return [t for t, rooted in texts if rooted] if any(self.rooted) else [t for t, _ in texts]


def _blocks(pages: DataFrame) -> DataFrame:
    def read(page, html):
        e = _Passages()
        e.feed(html or "")
        e.close()
        for n, text in enumerate(e.passages()):
            yield page, n, text

    return ingest._by_row(pages, ("page_id", "html"), read, "page_id long, n int, text string", "text").where(F.length("text") >= 20)


def evidence_units(pages: DataFrame) -> DataFrame:
    """(page_id, passage_id, text): blocks of 20 characters or more; those over 500 are cut at sentence ends."""
    cut = F.when(F.length("text") <= 500, F.array("text")).otherwise(F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\u001f"), "\u001f"))
    pieces = _blocks(pages).select("page_id", "n", F.posexplode(cut).alias("k", "text")).where(F.length("text") >= 20)
    return pieces.select("page_id", (F.col("n") * F.lit(100000).cast("long") + F.col("k")).alias("passage_id"), "text")


def evidence_answers(pages: DataFrame, most: int = 4, size: int = 1200) -> DataFrame:
    """(page_id, answer): the first distinct blocks of a page, up to ``most`` and ``size`` characters; the last is cut at a word."""
    first = _blocks(pages).groupBy("page_id", "text").agg(F.min("n").alias("n"))
    w = W.partitionBy("page_id").orderBy("n")
    rows = first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    rows = rows.withColumn("end", F.sum(F.length("text") + 1).over(w))
    left = size - (F.col("end") - F.length("text") - 1)
    text = F.when(F.col("end") <= size, F.col("text")).when(left > 80, F.regexp_replace(F.substring("text", F.lit(1), left), r"(?s) [^ ]*$", ""))
    kept = rows.select("page_id", "n", text.alias("text")).where("text is not null")
    return kept.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("answer"))


def evidence_edits(entries: DataFrame, top: DataFrame, passages: DataFrame, urls: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Edited texts of uncertain entries (id, chosen, rejected, correct, confidence) from their best passage (q_id, rank, page_id, passage_id)."""
    found = top.where("rank = 1").join(passages, ["page_id", "passage_id"]).join(urls.select("page_id", "url"), "page_id").select(F.col("q_id").alias("id"), F.substring("text", 1, 500).alias("evidence"), "url")
    rows = entries.where(F.col("confidence") < threshold).join(found, "id", "left")
    source = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("\n\nSource: "), "url")).otherwise("")
    edited = F.concat(F.lit("The answer is: "), "evidence", source)
    return rows.select("id", edited.alias("edited_chosen"), F.when(edited.isNotNull(), F.when(F.col("correct"), F.col("rejected")).otherwise(F.col("chosen"))).alias("edited_rejected"))
