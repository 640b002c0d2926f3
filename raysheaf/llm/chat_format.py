"""Chat formatting into budgeted windows, DataFrame functions only.

Method: the prefix sum of turn tokens puts each turn into a window without a sequential scan. The turns after the system turn
are cut into strides of equal length in tokens; turns that lie in one stride make a window, a turn that reaches over the end of its
stride makes one by itself. So windows are turn-aligned and own at most a stride, or one turn. Every window repeats the system
turn and, in what the budget leaves, up to ``history`` tokens of whole turns from the end of the window before; repeated turns
are masked, so each assistant text is a training target once. The stride is what the budget leaves beside history and the
conversation's system turn, so no window exceeds the budget but one whose only turn of its own does so with the system turn.

The prefix sum is taken in two levels (inside blocks of turn numbers, then over block totals), so that a conversation with a
third of all turns is spread over many tasks.

Template: ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts ``&`` and ``<`` are written ``&amp;`` and ``&lt;``; no
control string can then occur in them, and reading back restores every character.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

BUDGET = 512  # tokens of a window, at most
HISTORY = 128  # tokens of the window before that are repeated, at most
BLOCK = 64  # turn numbers in a block of the two-level prefix sum
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
WORD = r"[^\x09-\x0D\x20]+"
OVERHEAD = 4  # tokens of a turn's marks and role


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def word_tokens(text: Column) -> Column:
    """Words, an estimate of a text's tokens that needs no tokenizer."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _placed(conv: DataFrame, budget: int, history: int, block: int, tokens: Callable[[Column], Column]) -> DataFrame:
    """Turns with pos (1 for the first), start (tokens before it), head (whether it is the system turn), system (tokens of that of
    its conversation) and window (null for the system turn)."""
    turns = conv.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = turns.withColumn("tokens", tokens(F.col("text")) + OVERHEAD)
    turns = turns.withColumn("block", F.floor(F.col("turn") / block))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumns({"in_pos": F.row_number().over(inside), "in_start": F.coalesce(F.sum("tokens").over(before), F.lit(0))})
    first = F.min(F.struct("turn", "role", (-F.col("tokens")).alias("less")))  # of system rows that share the first turn the longest
    totals = turns.groupBy("conv_id", "block").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), first.alias("first"))
    order = Window.partitionBy("conv_id").orderBy("block")
    blocks = order.rowsBetween(Window.unboundedPreceding, -1)
    head = F.first("first").over(order.rowsBetween(Window.unboundedPreceding, 0))
    totals = totals.select(
        F.col("conv_id").alias("b_conv"),
        F.col("block").alias("b_block"),
        F.coalesce(F.sum("tokens").over(blocks), F.lit(0)).alias("b_start"),
        F.coalesce(F.sum("n").over(blocks), F.lit(0)).alias("b_pos"),
        F.when(head["role"] == "system", -head["less"]).otherwise(0).alias("system"),
    )
    same = placed["conv_id"].eqNullSafe(totals["b_conv"]) & placed["block"].eqNullSafe(totals["b_block"])
    placed = placed.join(totals, same).withColumns({"pos": F.col("b_pos") + F.col("in_pos"), "start": F.col("b_start") + F.col("in_start")})
    stride = F.greatest(budget - history - F.col("system"), F.lit(1))
    body = F.greatest(F.col("start") - F.col("system"), F.lit(0))
    own, last = F.floor(body / stride), F.floor((body + F.col("tokens") - 1) / stride)
    placed = placed.withColumn("head", (F.col("pos") == 1) & (F.col("role") == "system"))
    window = F.when(~F.col("head"), 2 * own + F.when(own == last, 0).otherwise(1))
    return placed.select("conv_id", "role", "text", "tokens", "pos", "start", "head", "system", window.alias("window"))


def chat_windows(
    conv: DataFrame, budget: int = BUDGET, history: int = HISTORY, block: int = BLOCK, tokens: Callable[[Column], Column] = word_tokens
) -> DataFrame:
    """One row per window: conv_id, window, formatted, loss_spans (begin, length in code points), n_repeated, n_turns, n_tokens.

    A window has at most ``budget`` tokens, repeated turns among them, unless it owns one turn only and that turn with the system
    turn is longer; no turn is cut. ``tokens`` counts those of a text, to which ``OVERHEAD`` is added for a turn's marks. Turns
    are ordered by turn, role, text. Null role or text counts as empty; a null conv_id is a conversation of its own, null turns
    come first. Rows that repeat a turn are turns of their own. The system turn is the first turn, if its role is ``system``.
    Columns other than the four are ignored.
    """
    if history >= budget:
        raise ValueError("history must be less than the budget")
    placed = materialise(_placed(conv, budget, history, block, tokens), "turns")  # read three times below, twice without the texts
    own = placed.where("not head").groupBy("conv_id", "window", "system").agg(F.min("start").alias("w_start"), F.sum("tokens").alias("own"))
    order = Window.partitionBy("conv_id").orderBy("window")
    room = F.least(F.lit(history), budget - F.col("system") - F.lead("own").over(order))
    first = own.withColumns({"next": F.lead("window").over(order), "next_start": F.lead("w_start").over(order), "room": room, "nth": F.row_number().over(order)})
    head = placed.where("head").select(F.col("conv_id").alias("s_conv"), "role", "text", "tokens", "pos")
    heads = head.join(first.select("conv_id", "window", "nth"), F.col("conv_id").eqNullSafe(F.col("s_conv")), "left").select(
        F.col("s_conv").alias("conv_id"), F.coalesce("window", F.lit(0)).alias("window"), F.coalesce(F.col("nth") > 1, F.lit(False)).alias("repeated"), "pos", "role", "text", "tokens"
    )
    follow = first.where("next is not null").select(F.col("conv_id").alias("n_conv"), F.col("window").alias("n_window"), "next", "next_start", "room")
    joined = placed.where("not head").join(follow, F.col("conv_id").eqNullSafe(F.col("n_conv")) & (F.col("window") == F.col("n_window")), "left")
    is_history = F.col("next").isNotNull() & (F.col("next_start") - F.col("start") <= F.col("room"))
    once = F.struct("window", F.lit(False).alias("repeated"))
    again = F.struct(F.col("next").alias("window"), F.lit(True).alias("repeated"))
    rows = joined.withColumn("to", F.explode(F.when(is_history, F.array(once, again)).otherwise(F.array(once))))
    rows = rows.select("conv_id", "to.window", "to.repeated", "pos", "role", "text", "tokens").unionByName(heads)
    packed = rows.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("pos", "repeated", "role", "text"))).alias("turns"),
        F.sum(F.col("repeated").cast("int")).cast("int").alias("n_repeated"),
        F.sum("tokens").alias("n_tokens"),
    )
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            (~t["repeated"] & (t["role"] == "assistant")).alias("target"),
            F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("mark"),
            escape(t["text"]).alias("body"),
        ),
    )
    packed = packed.withColumn("pieces", pieces)
    sized = F.transform("pieces", lambda p: F.struct(p["target"], F.char_length(p["mark"]).alias("skip"), F.char_length(p["body"]).alias("length")))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<begin:int,length:int>>)").alias("spans"))
    walked = F.aggregate(
        sized,
        zero,
        lambda acc, s: F.struct(
            (acc["at"] + s["skip"] + s["length"] + len(END)).alias("at"),
            F.when(s["target"], F.array_append(acc["spans"], F.struct((acc["at"] + s["skip"]).alias("begin"), s["length"].alias("length"))))
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["body"], F.lit(END))), "")
    return packed.select(
        "conv_id",
        "window",
        formatted.alias("formatted"),
        walked.alias("loss_spans"),
        "n_repeated",
        (F.size("turns") - F.col("n_repeated")).alias("n_turns"),
        "n_tokens",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """One row per window: its new turns (role, text) and its target text, both parsed out of ``formatted``."""
    parts = F.expr(rf"slice(split(formatted, '<\\|turn\\|>', -1), 2 + n_repeated, size(split(formatted, '<\\|turn\\|>', -1)))")
    turn = F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(p, TEXT, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text"),
        ),
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["begin"] + 1, s["length"])))
    return windows.select("conv_id", "window", "formatted", turn.alias("turns"), F.array_join(loss, "").alias("loss"), "n_turns")


def chat_digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, from the windows' text alone: counts and digests of its turns and of its targets.

    A digest is over all text of a conversation, which therefore has to fit into one row here (2 GB, Spark's limit).
    """
    back = read_back(windows).select(
        "conv_id",
        F.struct(
            "window",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            "loss",
        ).alias("part"),
        F.size("turns").alias("n_turns"),
        F.char_length("formatted").alias("chars"),
    )
    whole = back.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
        F.sort_array(F.collect_list("part")).alias("parts"),
    )
    turns, loss = F.array_join("parts.turns", ""), F.array_join("parts.loss", "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


def op2_chat_format(spark, sf_dir):
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -7L conv_id, t.turn, t.role, '{said}' text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat_digests(chat_windows(conv.unionByName(more)))


SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, len(regexp_extract_all(text, '[^\\x09-\\x0D\\x20]+')) + {OVERHEAD} AS tokens,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
         {len(TURN) + len(TEXT) + len(END)} + length(replace(replace(role, '&', '&amp;'), '<', '&lt;'))
           + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) AS chars
  FROM t
), s AS (
  SELECT *, pos = 1 AND role = 'system' AS head,
         coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         max(CASE WHEN pos = 1 AND role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS system
  FROM n
), a AS (SELECT *, greatest({BUDGET} - {HISTORY} - system, 1) AS stride, start - system AS body FROM s),
w AS (SELECT *, CASE WHEN NOT head THEN 2 * (body // stride) + CASE WHEN body // stride = (body + tokens - 1) // stride THEN 0 ELSE 1 END END AS k FROM a),
f AS (SELECT conv_id, k, min(start) AS w_start, sum(tokens) AS own FROM w WHERE NOT head GROUP BY conv_id, k),
g AS (SELECT *, lead(w_start) OVER (PARTITION BY conv_id ORDER BY k) AS next_start, lead(own) OVER (PARTITION BY conv_id ORDER BY k) AS next_own FROM f),
m AS (SELECT conv_id, count(*) AS n_windows FROM f GROUP BY conv_id),
c AS (
  SELECT w.*, coalesce(n_windows, 1) AS n_windows,
         CASE WHEN head THEN coalesce(n_windows, 1)
              WHEN next_start - start <= least({HISTORY}, {BUDGET} - system - next_own) THEN 2 ELSE 1 END AS times
  FROM w LEFT JOIN g USING (conv_id, k) LEFT JOIN m USING (conv_id)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars * times)::BIGINT AS formatted_chars,
       max(n_windows)::BIGINT AS n_windows
FROM c GROUP BY conv_id
"""
