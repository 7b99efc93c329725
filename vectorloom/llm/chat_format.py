"""Chat formatting in budgeted windows.

Prefix sums of turn tokens choose turn-aligned spans of a conversation; every window keeps
the leading system turn, repeats a limited history of the turns before its span, and its
loss mask covers the assistant turns of the span alone, so a repeated target is never
trained on twice. DataFrame functions only; what is aggregated is one window, which the budget bounds.

A conversation may have any share of the turns, so prefix sums are taken in two steps: within blocks of
BLOCK_TURNS turn numbers, and over one row of sums a block. A turn then meets the windows
near it by bins of `history` tokens. What is dealt by conversation alone has a small row a block or
window. Only `read_windows` puts a conversation into one row, as its digests are of the whole.

A turn is written `<|im_start|>ROLE\\nTEXT<|im_end|>\\n`. In roles and texts `&` is written
`&amp;`, and the first character of each control string (and a line feed in a role) as a
character entity, so no control string of CONTROLS survives inside a text, and the replacement
is undone exactly.

Defined cases: null text and null role are empty; turns are ordered by turn (nulls
first), equal turn numbers by role, text; repeated rows are repeated turns; null conv_id is a
conversation of its own; a turn that alone exceeds the budget gets a window of its own and
is kept whole, however long; turns of one conversation with one number stay in one task; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, materialise, read, words

BUDGET = 1024  # tokens of new turns in a window
HISTORY = 256  # tokens of earlier turns repeated before them
TURN_COST = 4  # tokens of a turn's marks
BLOCK_TURNS = 512
START, END = "<|im_start|>", "<|im_end|>"
# Control strings of public chat templates, escaped inside texts.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_FIRST = {"<": "&lt;", "[": "&#91;"}


def escape(text: Column) -> Column:
    """Undone by unescape(): every `&` becomes `&amp;` first, so entities in the result are all ours."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    for control in sorted(CONTROLS, key=len, reverse=True):
        out = F.replace(out, F.lit(control), F.lit(_FIRST[control[0]] + control[1:]))
    return out


def unescape(text: Column) -> Column:
    out = text
    for entity, char in (("&lt;", "<"), ("&#91;", "["), ("&#10;", "\n"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


_CONV = ["conv", "no_conv"]
_BLOCK = [*_CONV, "block"]


def _turns(turns: DataFrame, budget: int) -> DataFrame:
    """A row a turn with its tokens; conv and no_conv stand for conv_id, so that joins need no null-safe keys."""
    first = F.floor(F.col("turn") / BLOCK_TURNS).cast("long")
    return turns.select(
        F.coalesce("conv_id", F.lit(0).cast(turns.schema["conv_id"].dataType)).alias("conv"),
        F.col("conv_id").isNull().alias("no_conv"),
        F.coalesce(first, F.lit(-(1 << 62))).alias("block"),  # null turn numbers come first
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        (F.size(words(F.col("text"))) + TURN_COST).cast("long").alias("tokens"),
    ).withColumn("long", (F.col("tokens") > budget - budget // 2).cast("long"))


def _placed(turns: DataFrame, budget: int) -> DataFrame:
    """Turns with pos (1, 2, ...), before (tokens ahead of it) and span, the window that it is new in: short turns
    whose sum begins in the same half budget, between two long ones, or a long turn."""
    rows, quantum = _turns(turns, budget), budget // 2
    short = F.when(F.col("long") == 1, 0).otherwise(F.col("tokens"))
    sums = {"pos": F.lit(1), "before": F.col("tokens"), "n_long": F.col("long"), "n_short": short}
    earlier = Window.partitionBy(*_CONV).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*_BLOCK).agg(*(F.sum(c).alias(f"all_{n}") for n, c in sums.items()))
    blocks = blocks.select(*_BLOCK, *(F.coalesce(F.sum(f"all_{n}").over(earlier), F.lit(0)).alias(f"off_{n}") for n in sums))
    within = Window.partitionBy(*_BLOCK).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", *(F.sum(c).over(within).alias(n) for n, c in sums.items())).join(blocks, _BLOCK)
    rows = rows.withColumns({n: F.col(n) + F.col(f"off_{n}") for n in sums}).withColumn("before", F.col("before") - F.col("tokens"))
    part = F.when(F.col("long") == 1, 0).otherwise(F.floor((F.col("n_short") - F.col("tokens")) / quantum))
    return rows.select(*_CONV, "role", "text", "tokens", "pos", "before", F.struct("n_long", (1 - F.col("long")).alias("short"), part.alias("part")).alias("span"))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row a window: conv_id, window (0, 1, ...), text, n_repeated (leading turns that are
    repeated), n_new, tokens, and loss, an array of (start, chars) of the texts to learn."""
    reach = max(1, history)
    # read by several steps, so sorted and summed once
    rows = materialise(_placed(turns, budget), "chat-turns").withColumn("is_system", (F.col("pos") == 1) & (F.col("role") == "system"))
    rows = rows.withColumn("bin", F.floor(F.col("before") / reach))
    turn = lambda is_new: F.struct(
        "pos", F.lit(is_new).alias("is_new"), (F.col("role") == "assistant").alias("is_target"), "tokens",
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    # a small row a window; a window is looked up by its own turns and by those that it repeats, at most `history` ahead
    spans = rows.groupBy(*_CONV, "span").agg(F.min("before").alias("opens"), F.max("before").alias("last"), F.min("pos").alias("first"))
    spans = spans.withColumn("window", (F.row_number().over(Window.partitionBy(*_CONV).orderBy("span")) - 1).cast("int"))
    bins = F.sequence(F.greatest(F.floor(F.col("opens") / reach) - 1, F.lit(0)), F.floor(F.col("last") / reach))
    near = spans.select(*_CONV, F.explode(bins).alias("bin"), F.struct("span", "opens", "window").alias("w"))
    near = near.groupBy(*_CONV, "bin").agg(F.collect_list("w").alias("ws"))
    own = F.filter("ws", lambda w: w["span"] == F.col("span"))[0]["window"]
    later = F.filter("ws", lambda w: (w["opens"] > F.col("before")) & (w["opens"] <= F.col("before") + history) & ~F.col("is_system"))
    met = rows.join(near, [*_CONV, "bin"]).select(*_CONV, "pos", "role", "text", "tokens", F.concat(F.array(F.struct(own.alias("window"), F.lit(True).alias("new"))), F.transform(later, lambda w: F.struct(w["window"].alias("window"), F.lit(False).alias("new")))).alias("to"))
    placed = met.withColumn("to", F.explode("to")).select(*_CONV, F.col("to.window").alias("window"), turn(True).withField("is_new", F.col("to.new")).alias("t"))
    system = rows.where("is_system").select(*_CONV, turn(False).alias("t")).join(spans.where("first > 1").select(*_CONV, "window"), _CONV)
    windows = placed.unionByName(system.select(*placed.columns)).groupBy(*_CONV, "window").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    joined = windows.withColumn("conv_id", F.when(~F.col("no_conv"), F.col("conv")))
    piece = lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,chars:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        span = F.struct(
            (acc["at"] + F.length(t["head"])).cast("long").alias("start"), F.length(t["body"]).cast("long").alias("chars")
        )
        return F.struct(
            (acc["at"] + F.length(piece(t))).cast("long").alias("at"),
            F.when(t["is_new"] & t["is_target"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    return joined.select(
        "conv_id",
        "window",
        F.array_join(F.transform("turns", piece), "").alias("text"),
        F.size(F.filter("turns", lambda t: ~t["is_new"])).alias("n_repeated"),
        F.size(F.filter("turns", lambda t: t["is_new"])).alias("n_new"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda acc, t: acc + t["tokens"]).alias("tokens"),
        F.aggregate("turns", empty, step, lambda acc: acc["spans"]).alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Back from the written text alone: a row a conversation with its turns, and the text under the mask."""
    # Each piece after a start mark is ROLE\nTEXT<|im_end|>\n; a control string cannot stand inside.
    parts = F.slice(F.split("text", r"\Q" + START + r"\E", -1), F.col("n_repeated") + 2, F.col("n_new"))
    turn = lambda p: F.struct(
        unescape(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(p.substr(F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(END + "\n"))).alias("text"),
    )
    learnt = F.array_join(
        F.transform("loss", lambda s: unescape(F.col("text").substr((s["start"] + 1).cast("int"), s["chars"].cast("int")))), ""
    )
    per_window = windows.select(
        "conv_id",
        F.struct("window", F.transform(parts, turn).alias("turns"), learnt.alias("learnt"), F.length("text").cast("long").alias("chars")).alias("w"),
    )
    return per_window.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws")).select(
        "conv_id",
        F.flatten(F.transform("ws", lambda w: w["turns"])).alias("turns"),
        F.array_join(F.transform("ws", lambda w: w["learnt"]), "").alias("learnt"),
        F.aggregate("ws", F.lit(0).cast("long"), lambda acc, w: acc + w["chars"]).alias("formatted_chars"),
        F.size("ws").alias("n_windows"),
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(asked).alias("text"),
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    back = read_windows(materialise(format_windows(turns), "chat-windows"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
    )


# Spans, repeated turns and pieces' lengths of every turn; then sums and digests a conversation.
OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), k AS (
  SELECT *, len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) + 4 AS tokens,
    {length} AS chars FROM t
), o AS (
  SELECT *, tokens > 512 AS long, row_number() OVER w AS pos, sum(tokens) OVER w - tokens AS before, count(*) FILTER (WHERE tokens > 512) OVER w AS n_long,
    coalesce(sum(tokens) FILTER (WHERE tokens <= 512) OVER w, 0) AS n_short FROM k
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), s AS (
  SELECT *, pos = 1 AND role = 'system' AS is_system, CASE WHEN long THEN 0 ELSE (n_short - tokens) // 512 END AS part FROM o
), v AS (
  SELECT conv_id, min(before) AS opens, min(pos) AS first FROM s GROUP BY conv_id, n_long, long, part
), r AS (
  SELECT s.conv_id, sum(s.chars) AS repeated FROM s JOIN v ON s.conv_id = v.conv_id
    AND CASE WHEN is_system THEN v.first > 1 ELSE v.opens > s.before AND v.opens <= s.before + 256 END GROUP BY s.conv_id
), c AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS learnt, sum(chars) AS chars FROM s GROUP BY conv_id
)
SELECT c.conv_id, n_turns, turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, CAST(chars + coalesce(repeated, 0) AS BIGINT) AS formatted_chars
FROM c LEFT JOIN r ON c.conv_id = r.conv_id
"""


def _sql_length() -> str:
    """Characters of a written turn in SQL: marks, and three or four more for each escaped character."""
    more = lambda s, found, k: f"(length({s}) - length(replace({s}, {found!r}, ''))) // {len(found)} * {k}"
    escaped = lambda s: " + ".join([f"length({s})", more(s, "&", 4), *(more(s, c, len(_FIRST[c[0]]) - 1) for c in CONTROLS)])
    return f"{len(START) + 1 + len(END) + 1} + {escaped('role')} + {more('role', chr(10), 4)} + {escaped('text')}"


OP9_SQL = OP9_SQL.replace("{length}", _sql_length())
