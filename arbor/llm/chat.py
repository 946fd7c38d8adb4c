"""Chat formatting by perspective rotation: every participant's view of a dialogue, in segments.

For each participant of a conversation all turns are rendered with that speaker as the assistant and the others as users
by name; the loss mask covers what the assistant says. The result has one row for each turn and perspective, with the
segment's place in the rendered dialogue, rather than one row per conversation, so that a conversation of any length stays
distributed: places are running sums in blocks of turns plus the sums of the blocks before. Joined in order of seq, the
segments are the rendered dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbor.llm.common import each_copy, quoted

#: Turns of this many consecutive numbers form a block.
BLOCK = 256
ASSISTANT_HEAD, END = "<|assistant|>\n", "<|end|>\n"


def escaped(text: Column) -> Column:
    """``text`` without marks of the format: what stands between ``<`` and ``|`` of a mark, or of one so escaped, gets a backslash
    more. Taking one away gives the text back.
    """
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _named(speaker: Column) -> Column:
    name = F.regexp_replace(escaped(speaker), r"\|(\\*)>", r"|\\$1>")
    return F.when(speaker == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn and perspective: conv_id, perspective, seq, speaker, role, segment, seg_start, seg_end, mask_start,
    mask_end, masked.

    Participants are the speakers of a conversation other than ``system``; a conversation without any has no rows. Turns are
    ordered by (turn, speaker, text) with nulls first; equal rows are turns of their own. A null speaker is a participant
    with the name ``unknown``, texts and names are :func:`escaped`, so that none can forge a turn, a null text is empty, a null conversation id is a conversation. seg_start, seg_end: characters
    in the rendered dialogue, end exclusive; mask_start, mask_end: what a model is trained on, text and end mark of the
    assistant's turns, equal where nothing is (masked false).
    """
    speaker = F.coalesce(quoted(speaker_col).cast("string"), F.lit("unknown"))
    rows = turns.select(
        quoted(conv_col).alias("conv"), quoted(turn_col).cast("long").alias("turn"), speaker.alias("speaker"), escaped(F.coalesce(quoted(text_col).cast("string"), F.lit(""))).alias("text")
    )
    rows = rows.groupBy("conv", "turn", "speaker", "text").agg(F.count("*").alias("copies"))  # repeated rows travel once
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))))
    who = rows.where("speaker <> 'system'").select(F.col("conv").alias("c"), F.col("speaker").alias("perspective")).distinct()
    each = rows.join(who, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit(ASSISTANT_HEAD)).otherwise(_named(F.col("speaker")))
    each = each.withColumn("head", F.length(head)).withColumn("len", F.col("head") + F.length("text") + len(END))
    keys = ["conv", "perspective"]
    sums = each.groupBy(*keys, "block").agg(F.sum(F.col("len") * F.col("copies")).alias("chars"), F.sum("copies").alias("turns"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select(
        F.col("conv").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("char0"), F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turn0")
    )
    inside = Window.partitionBy(*keys, "block").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("char1", F.coalesce(F.sum(F.col("len") * F.col("copies")).over(inside), F.lit(0))).withColumn("turn1", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    placed = placed.join(offset, F.col("conv").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    nth = each_copy(placed, "copies", "i")
    start = F.col("char0") + F.col("char1") + F.col("i") * F.col("len")
    full = nth.withColumn("seg_start", start)
    return full.select(
        F.col("conv").alias(conv_col),
        "perspective",
        (F.col("turn0") + F.col("turn1") + F.col("i")).alias("seq"),
        "speaker",
        F.when(own, "assistant").when(F.col("speaker") == "system", "system").otherwise("user").alias("role"),
        F.concat(head, F.col("text"), F.lit(END)).alias("segment"),
        "seg_start",
        (F.col("seg_start") + F.col("len")).alias("seg_end"),
        (F.col("seg_start") + F.when(own, F.col("head")).otherwise(F.col("len"))).alias("mask_start"),
        (F.col("seg_start") + F.col("len")).alias("mask_end"),
        own.alias("masked"),
    )


SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, regexp_replace(coalesce(text, ''), '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS text FROM conversations),
who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE speaker <> 'system'),
e AS (SELECT r.conv_id, perspective, turn, speaker, text, speaker = perspective AS own,
  CASE WHEN speaker = perspective THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>' ELSE '<|user name=' || regexp_replace(regexp_replace(speaker, '<(\\\\*)\\|', '<\\\\\\1|', 'g'), '\\|(\\\\*)>', '|\\\\\\1>', 'g') || '|>' END || chr(10) AS head
  FROM r JOIN who ON r.conv_id IS NOT DISTINCT FROM who.conv_id),
l AS (SELECT *, length(head) + length(text) + {len(END)} AS len FROM e),
p AS (SELECT *, row_number() OVER w - 1 AS seq, coalesce(sum(len) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg_start
  FROM l WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text))
SELECT conv_id, perspective, seq, speaker, CASE WHEN own THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
  head || text || '<|end|>' || chr(10) AS segment, CAST(seg_start AS BIGINT) AS seg_start, CAST(seg_start + len AS BIGINT) AS seg_end,
  CAST(seg_start + CASE WHEN own THEN length(head) ELSE len END AS BIGINT) AS mask_start, CAST(seg_start + len AS BIGINT) AS mask_end, own AS masked
FROM p
"""
