"""Chat formatting: perspective rotation of multi-party dialogues, with native expressions only.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and all others as named users. Turns of a context
role (by default ``system``) belong to no participant; they stay as system
turns in every perspective.

One row stands for one turn in one perspective, so no conversation is ever
gathered into one value. A row has the rendered segment, its first and end
code point in the rendered dialogue, and the mask: 1 where the segment's body
is to be learned (the speaker's own turns), with the body's own first and end.

Scale: speakers are distinct (conversation, role) pairs, counted with partial
aggregation, joined back on the conversation; offsets are prefix sums in two
levels (within runs of ``run`` turns, and over the runs), so that a
conversation with a third of all turns is dealt to many tasks.

Defined cases: turns are ordered by turn (nulls last), then role, then text,
repeated rows all stay. A null role is a speaker named ``unknown``; a null text
renders as an empty body. A null conversation is one conversation. A
conversation with context turns alone has no perspective. Other columns aren't
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Turns whose offsets are summed in one window.
RUN = 512
CONTEXT_ROLES = ("system",)


def _header(role: Column, name: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.when(role == "user", F.concat(F.lit(" name="), name)).otherwise(F.lit("")), F.lit("|>\n"))


def rotate(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", context_roles: tuple[str, ...] = CONTEXT_ROLES, run: int = RUN
) -> DataFrame:
    """conv_id, perspective, position (0, 1, ...), turn, speaker, chat_role, name, segment, mask, seg_start, seg_end, body_start, body_end."""
    t = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    context = F.col("speaker").isin(*context_roles)
    people = t.filter(~context).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    x = t.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = F.col("speaker") == F.col("perspective")
    x = x.withColumn("chat_role", F.when(context, "system").when(own, "assistant").otherwise("user"))
    x = x.withColumn("name", F.when(F.col("chat_role") == "user", F.col("speaker")).otherwise(""))
    head = _header(F.col("chat_role"), F.col("name"))
    x = x.withColumn("segment", F.concat(head, "text", F.lit("\n"))).withColumn("head", F.length(head)).withColumn("mask", own.cast("int"))
    x = x.withColumn("n", F.length("segment").cast("long")).withColumn("run", F.coalesce(F.floor(F.col("turn") / run), F.lit(2**62)))
    cell = ["conv_id", "perspective", "run"]
    sums = x.groupBy(*cell).agg(F.sum("n").alias("chars"), F.count(F.lit(1)).alias("turns"))
    over = Window.partitionBy("conv_id", "perspective").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("conv_id").alias("c"),
        F.col("perspective").alias("p"),
        F.col("run").alias("r"),
        F.coalesce(F.sum("chars").over(over), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum("turns").over(over), F.lit(0)).alias("turns_before"),
    )
    order = Window.partitionBy(*cell).orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
    x = x.withColumn("place", F.row_number().over(order)).withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("run") == F.col("r")))
    end = F.col("chars_before") + F.col("upto")
    start = end - F.col("n")
    body = start + F.col("head")
    return x.select(
        "conv_id", "perspective", (F.col("turns_before") + F.col("place") - 1).alias("position"), "turn", "speaker", "chat_role", "name", "segment", "mask",
        start.alias("seg_start"), end.alias("seg_end"), body.alias("body_start"), (end - 1).alias("body_end"),
    )


def render(rotated: DataFrame) -> DataFrame:
    """One row per (conversation, perspective): the whole dialogue and the spans to learn. For dialogues that fit a value."""
    parts = F.sort_array(F.collect_list(F.struct("position", "segment", "mask", "body_start", "body_end")))
    g = rotated.groupBy("conv_id", "perspective").agg(parts.alias("parts"))
    learned = F.transform(F.filter("parts", lambda p: p["mask"] == 1), lambda p: F.array(p["body_start"], p["body_end"]))
    return g.select("conv_id", "perspective", F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("rendered"), learned.alias("learn_spans"))


#: DuckDB SQL for op7's rows.
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE speaker NOT IN ('system')
), x AS (
  SELECT conv_id, perspective, turn, speaker, text,
    CASE WHEN speaker IN ('system') THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role
  FROM t JOIN p ON conv_id IS NOT DISTINCT FROM c
), y AS (
  SELECT *, CASE WHEN chat_role = 'user' THEN speaker ELSE '' END AS name,
    '<|' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || speaker ELSE '' END || '|>' || chr(10) AS head
  FROM x
), z AS (
  SELECT *, head || text || chr(10) AS segment,
    row_number() OVER w - 1 AS position,
    CAST(sum(length(head || text || chr(10))) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg_end
  FROM y WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text)
)
SELECT conv_id, perspective, position, turn, speaker, chat_role, name, segment,
  CAST(speaker = perspective AS INTEGER) AS mask,
  seg_end - length(segment) AS seg_start, seg_end,
  seg_end - length(segment) + length(head) AS body_start, seg_end - 1 AS body_end
FROM z
"""
