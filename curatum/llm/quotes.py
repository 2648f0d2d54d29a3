"""Quotation linking in conversations, with DataFrame functions only.

A line's quote level is the number of ``>`` marks it begins with. Consecutive lines of one
level form a passage; a passage and each of its lines are normalised (lower case, white space
as one space) and hashed to 128 bits. A quoted passage is joined to its origin, the first message that
has it as text of its own: in the same conversation if there is one before the quoting
message, else the first of all. Only one origin per hash enters the join, so a frequent line
costs one row on that side. Line breaks inside a passage count as spaces, so one that was wrapped
anew is found. A message replies to the origin of its longest passage of the lowest level that
finds one. Threads follow from reply pointers by doubling; they only point to earlier messages.

Result: one row per message with its own text, without quotes, in reply order when sorted by
(root_conv, root_turn, depth, conv_id, turn).

Defined cases: a null text is an empty one; quotes without origin are removed all the same;
blank lines never link; rows repeated with the same conv_id and turn are one message for
links and keep a row each; rows with a null key are never an origin; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .support import store

_MARKS = r"^([ \t]*>)+"


def _parsed(messages: DataFrame) -> DataFrame:
    """Each message with ``lines``: its lines as structs (level, body)."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n", -1)
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), "[^>]", ""))
    body = lambda x: F.regexp_replace(x, _MARKS + "[ \t]?", "")
    return messages.withColumn("lines", F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.when(level(x) > 0, body(x)).otherwise(x).alias("body"))))


def _normal(x):
    return F.trim(F.lower(F.regexp_replace(x, r"[ \t\f\x0B]+", " ")))


def _passages(parsed: DataFrame, quoted: bool, wrapped: bool = False) -> DataFrame:
    """(conv_id, turn, level, hash, length) of passages and single lines; with ``wrapped``, line breaks count as spaces."""
    normal = F.filter(F.transform("lines", lambda x: F.struct(x["level"].alias("level"), _normal(x["body"]).alias("body"))), lambda x: x["body"] != "")
    keep = (lambda x: x["level"] > 0) if quoted else (lambda x: x["level"] == 0)
    rows = parsed.withColumn("n", normal).where(F.exists("n", keep))
    # Passages lie between the places where the level changes; slices of them keep the work linear in the lines.
    starts = F.expr("filter(sequence(1, size(n)), i -> i = 1 or n[i - 1].level <> n[i - 2].level)")
    rows = rows.withColumn("starts", starts).withColumn("ends", F.expr("concat(slice(starts, 2, size(starts)), array(size(n) + 1))"))
    spans = F.arrays_zip("starts", "ends")
    block = lambda s: F.struct(F.element_at("n", s["starts"])["level"].alias("level"), F.array_join(F.transform(F.slice("n", s["starts"], s["ends"] - s["starts"]), lambda x: x["body"]), "\n").alias("body"))
    blocks = F.filter(F.transform(spans, block), keep)
    rows = rows.select("conv_id", "turn", F.explode(F.concat(blocks, F.filter("n", keep))).alias("p"))
    body = F.translate("p.body", "\n", " ") if wrapped else F.col("p.body")
    return rows.select("conv_id", "turn", "p.level", F.unhex(F.md5(body)).alias("hash"), F.length("p.body").alias("length"))


def link(messages: DataFrame, whole: bool = True) -> DataFrame:
    """conv_id, turn, reply_conv, reply_turn of every message that quotes a known one.

    Without ``whole``, only passages of level 1 are asked for, and only as they are wrapped.
    """
    parsed = _parsed(messages.select("conv_id", "turn", "text"))
    asked = store(_passages(parsed, True, whole).where("level >= 1" if whole else "level = 1").distinct())
    own = _passages(parsed, False, whole).where("conv_id is not null and turn is not null").join(asked.select("hash").distinct(), "hash", "left_semi")
    near = own.groupBy("conv_id", "hash").agg(F.min("turn").alias("near_turn"))
    near = store(near)
    first = near.groupBy("hash").agg(F.min(F.struct("conv_id", F.col("near_turn").alias("turn"))).alias("first"))
    found = asked.join(near, ["conv_id", "hash"], "left").join(first, "hash", "left")
    same = F.col("near_turn") < F.col("turn")
    other = F.col("first") < F.struct("conv_id", "turn")
    origin = F.when(same, F.struct("conv_id", F.col("near_turn").alias("turn"))).when(other, F.col("first"))
    found = found.withColumn("origin", origin).where("origin is not null")
    best = F.max(F.struct((-F.col("level")).alias("l"), "length", (-F.col("origin.conv_id")).alias("c"), (-F.col("origin.turn")).alias("t"))).alias("best")
    return found.groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", (-F.col("best.c")).alias("reply_conv"), (-F.col("best.t")).alias("reply_turn"))


def _roots(replies: DataFrame) -> DataFrame:
    """conv_id, turn, root_conv, root_turn, depth by pointer doubling; rounds grow with the log of the depth."""
    state = store(replies.select("conv_id", "turn", F.col("reply_conv").alias("root_conv"), F.col("reply_turn").alias("root_turn"), F.lit(1).alias("depth")))
    while True:
        up = state.select(F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), F.col("root_conv").alias("c"), F.col("root_turn").alias("t"), F.col("depth").alias("d"))
        joined = store(state.join(up, ["root_conv", "root_turn"], "left"))
        if joined.where("c is not null").isEmpty():
            return state
        state = joined.select("conv_id", "turn", F.coalesce("c", "root_conv").alias("root_conv"), F.coalesce("t", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"))


def reply_ordered(messages: DataFrame, whole: bool = True) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quoted, max_level, reply_conv, reply_turn, root_conv, root_turn, depth."""
    replies = store(link(messages, whole))
    threads = replies.join(_roots(replies), ["conv_id", "turn"]).select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "reply_conv", "reply_turn", F.col("root_conv").alias("_rc"), F.col("root_turn").alias("_rt"), F.col("depth").alias("_d"))
    threads = store(threads)
    parsed = _parsed(messages.select("conv_id", "turn", "role", "text"))
    own = F.regexp_replace(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n"), r"^[ \t\n]+|[ \t\n]+$", "")
    rows = parsed.select("conv_id", "turn", "role", own.alias("text"), F.size(F.filter("lines", lambda x: x["level"] > 0)).alias("n_quoted"), F.array_max(F.transform("lines", lambda x: x["level"])).alias("max_level"))
    out = rows.join(threads, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    return out.select("conv_id", "turn", "role", "text", "n_quoted", "max_level", "reply_conv", "reply_turn", F.coalesce("_rc", "conv_id").alias("root_conv"), F.coalesce("_rt", "turn").alias("root_turn"), F.coalesce("_d", F.lit(0)).alias("depth"))


ORACLE = r"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, generate_subscripts(a, 1) AS i, unnest(a) AS line
  FROM (SELECT conv_id, turn, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS a FROM conversations)),
leveled AS (
  SELECT *, len(regexp_replace(regexp_extract(line, '^([ \t]*>)+'), '[^>]', '', 'g')) AS level,
    regexp_replace(line, '^([ \t]*>)+[ \t]?', '') AS rest FROM lines),
bodies AS (SELECT conv_id, turn, i, level, CASE WHEN level > 0 THEN rest ELSE line END AS body FROM leveled),
normal AS (SELECT *, trim(lower(regexp_replace(body, '[ \t\f\x0B]+', ' ', 'g')), ' ') AS n FROM bodies),
solid AS (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY i) AS island
  FROM normal WHERE n <> '' WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
passages AS (
  SELECT DISTINCT conv_id, turn, level, replace(p, chr(10), ' ') AS p FROM (
    SELECT conv_id, turn, level, string_agg(n, chr(10) ORDER BY i) AS p FROM solid GROUP BY conv_id, turn, level, island
    UNION ALL SELECT conv_id, turn, level, n FROM solid)),
near AS (SELECT conv_id, p, min(turn) AS near_turn FROM passages WHERE level = 0 AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, p),
first AS (SELECT p, min(ROW(conv_id, near_turn)) AS f FROM near GROUP BY p),
found AS (
  SELECT q.conv_id, q.turn, q.level, len(q.p) AS length,
    CASE WHEN n.near_turn < q.turn THEN ROW(q.conv_id, n.near_turn) WHEN f.f < ROW(q.conv_id, q.turn) THEN f.f END AS origin
  FROM passages q LEFT JOIN near n ON q.conv_id = n.conv_id AND q.p = n.p LEFT JOIN first f ON q.p = f.p WHERE q.level >= 1),
replies AS (SELECT conv_id, turn, origin[1] AS reply_conv, origin[2] AS reply_turn FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, length DESC, origin[1], origin[2]) AS r FROM found WHERE origin IS NOT NULL) WHERE r = 1),
chain AS (
  SELECT conv_id, turn, reply_conv AS c, reply_turn AS t, 1 AS depth FROM replies
  UNION ALL SELECT x.conv_id, x.turn, r.reply_conv, r.reply_turn, x.depth + 1 FROM chain x JOIN replies r ON x.c = r.conv_id AND x.t = r.turn),
threads AS (SELECT conv_id, turn, c, t, depth FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY depth DESC) AS r FROM chain) WHERE r = 1),
own AS (
  SELECT conv_id, turn, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0), ''), '^[ \t\n]+|[ \t\n]+$', '', 'g') AS own_text,
    count(*) FILTER (level > 0) AS n_quoted, max(level) AS max_level FROM bodies GROUP BY conv_id, turn)
SELECT m.conv_id, m.turn, m.role, o.own_text AS text, CAST(o.n_quoted AS INTEGER) AS n_quoted, CAST(o.max_level AS INTEGER) AS max_level,
  r.reply_conv, r.reply_turn, coalesce(h.c, m.conv_id) AS root_conv, coalesce(h.t, m.turn) AS root_turn, CAST(coalesce(h.depth, 0) AS INTEGER) AS depth
FROM conversations m LEFT JOIN own o ON m.conv_id = o.conv_id AND m.turn = o.turn
LEFT JOIN replies r ON m.conv_id = r.conv_id AND m.turn = r.turn LEFT JOIN threads h ON m.conv_id = h.conv_id AND m.turn = h.turn
"""
