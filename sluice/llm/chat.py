"""Chat formatting by perspective rotation.

For every participant of a dialogue the dialogue is rendered once with that participant as the assistant: each turn
becomes a segment of chat markup, the participant's own turns speak as `assistant` and carry the training mask, turns of
other participants are users with their name, and the system turns stay system turns in every perspective. Participants
are the distinct roles of a dialogue except `system`.

The result has one row per dialogue, perspective and turn; a dialogue's text is its segments in order of `position`
(render_dialogues joins them). So a dialogue of any length spreads over rows, and the only thing gathered by key is the
set of a dialogue's participants, which partial aggregation keeps small.

Defined cases: a null text is an empty turn; a null role is the participant `unknown`; rows with a null conv_id form no
dialogue and are left out; equal turns are ordered by role and text, exact repeats stay as repeated turns; a dialogue
without participants (system turns only) has no perspective; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def rotate_perspectives(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, speaker, role_out, segment, is_target, n_target_chars."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    cast = turns.where(F.col("speaker") != "system").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    both = turns.join(cast, "conv_id")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == "system", "system").when(own, "assistant").otherwise("user")
    head = F.concat(F.lit(START), role, F.when(role == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(F.lit("")), F.lit("\n"))
    return both.select("conv_id", "perspective", "turn", "speaker", role.alias("role_out"), F.concat(head, F.col("text"), F.lit(END), F.lit("\n")).alias("segment"), own.alias("is_target"), F.when(own, F.length("text") + len(END)).otherwise(F.lit(0)).cast("long").alias("n_target_chars"))


def render_dialogues(segments: DataFrame) -> DataFrame:
    """One row per dialogue and perspective: its whole text and the masked spans (start, end) in characters.

    Gathers the turns of one dialogue, so it is for consumers that need a dialogue as one string.
    """
    rows = segments.groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "segment", "is_target", "n_target_chars"))).alias("t"))
    ends = F.transform("t", lambda x, i: F.aggregate(F.slice(F.col("t"), 1, i + 1), F.lit(0), lambda a, y: a + F.length(y["segment"])))
    spans = F.transform(F.filter(F.arrays_zip(F.col("t").alias("t"), ends.alias("e")), lambda z: z["t"]["is_target"]), lambda z: F.struct((z["e"] - 1 - z["t"]["n_target_chars"]).cast("long").alias("start"), (z["e"] - 1).cast("long").alias("end")))
    return rows.select("conv_id", "perspective", F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("text"), spans.alias("mask"), F.size("t").alias("n_turns"))


SQL = """
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
parts AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
named AS (
  SELECT *, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role_out
  FROM turns JOIN parts USING (conv_id))
SELECT conv_id, perspective, turn, speaker, role_out,
  '<|im_start|>' || role_out || CASE WHEN role_out = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) || text || '<|im_end|>' || chr(10) AS segment,
  speaker = perspective AS is_target,
  CAST(CASE WHEN speaker = perspective THEN length(text) + 10 ELSE 0 END AS BIGINT) AS n_target_chars
FROM named
"""
