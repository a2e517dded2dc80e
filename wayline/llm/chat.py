"""Dialogues rendered from every participant's side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Turns of a conversation whose lengths one window sums.
SPAN = 1024


def rotate_speakers(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", shared: str = "system") -> DataFrame:
    """One row for each turn and participant of its conversation:
    conv_id, perspective, turn, role, name, content, loss, start, end.

    The participant's own turns are the assistant's and bear loss; others' are a user's, named after them;
    turns of the shared speaker stay as they are in every perspective and have none of their own. content
    is the rendered message, start and end are its character range in the whole rendered dialogue. Turns
    are ordered by number, then speaker and text; null texts are empty, null speakers are named
    "unknown". Repeated turns are rendered as often as they come, ties in any order since they are equal; a
    conversation of shared turns alone has no perspective. A null conv_id is a conversation of its own, an
    empty one another. Texts may have any length; columns of other names aren't read. Participants are
    looked up by spans of turn numbers, and offsets are summed within spans and over them, so a conversation
    of any length is spread over tasks.
    """
    who = F.coalesce(F.col(speaker).cast("string"), F.lit("unknown"))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), who.alias("who"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("said"))
    sides = rows.where(F.col("who") != shared).select("conv_id", F.col("who").alias("perspective")).distinct()
    own = F.col("who") == F.col("perspective")
    role = F.when(F.col("who") == shared, F.lit(shared)).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when((F.col("who") != shared) & ~own, F.col("who"))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("k")
    rows = rows.select("*", key, F.floor(F.coalesce("turn", F.lit(0)) / SPAN).alias("span"))
    sides = rows.select("k", "span").distinct().join(sides.select(key, "perspective"), "k")
    seen = rows.join(sides, ["k", "span"]).withColumns({"role": role, "name": name, "loss": (F.col("who") != shared) & own})
    head = F.concat(F.lit("<|"), F.col("role"), F.coalesce(F.concat(F.lit(" "), F.col("name")), F.lit("")), F.lit("|>\n"))
    seen = seen.withColumn("content", F.concat(head, F.col("said"), F.lit("<|end|>\n"))).withColumn("size", F.length("content").cast("long"))
    within = Window.partitionBy("k", "perspective", "span").orderBy("turn", "who", "said").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("k", "perspective").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = seen.groupBy("k", "perspective", "span").agg(F.sum("size").alias("size")).withColumn("base", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    out = seen.withColumn("upto", F.sum("size").over(within)).join(spans.select("k", "perspective", "span", "base"), ["k", "perspective", "span"])
    end = F.col("base") + F.col("upto")
    return out.select("conv_id", "perspective", "turn", "role", "name", "content", "loss", (end - F.col("size")).alias("start"), end.alias("end"))


def assembled(rendered: DataFrame) -> DataFrame:
    """conv_id, perspective, dialogue, masks: whole strings with the loss-bearing character ranges, for
    conversations that fit in a task."""
    rows = F.array_sort(F.collect_list(F.struct("start", "end", "content", "loss")))
    grouped = rendered.groupBy("conv_id", "perspective").agg(rows.alias("rows"))
    masks = F.transform(F.filter("rows", lambda r: r["loss"]), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    return grouped.select("conv_id", "perspective", F.array_join(F.transform("rows", lambda r: r["content"]), "").alias("dialogue"), masks.alias("masks"))


CHAT_SQL = """
WITH r AS (SELECT conv_id, turn::BIGINT AS turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS said FROM conversations),
s AS (SELECT DISTINCT conv_id, who AS perspective FROM r WHERE who <> 'system'),
m AS (SELECT conv_id, perspective, turn, who, said, CASE WHEN who = 'system' THEN 'system' WHEN who = perspective THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN who <> 'system' AND who <> perspective THEN who END AS name, who <> 'system' AND who = perspective AS loss FROM r JOIN s USING (conv_id)),
c AS (SELECT *, '<|' || role || coalesce(' ' || name, '') || '|>' || chr(10) || said || '<|end|>' || chr(10) AS content FROM m),
e AS (SELECT *, (sum(length(content)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, who, said ROWS UNBOUNDED PRECEDING))::BIGINT AS "end" FROM c)
SELECT conv_id, perspective, turn, role, name, content, loss, "end" - length(content) AS start, "end" FROM e"""
