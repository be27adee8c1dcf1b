"""Chat formatting with multi-party perspective rotation, in DataFrame operations only.

Every participant of a conversation (every role but ``system``) in turn is the assistant:
a dialogue is rendered once for each, their own turns as ``assistant``, those of the others as
``user name=<speaker>``, system turns as ``system``.  Only the assistant's text and its end
mark are to be learnt from; their range is the mask.

A segment is ``<|im_start|>HEAD\\nTEXT<|im_end|>\\n``.  Marks inside a text or a name are
broken up (``<|`` becomes ``<\\|``).  Names keep letters, digits, ``_``, ``-`` and ``.``; one that has others gets ``_`` for each of them and eight hex digits
of its MD5 after a ``-``, so speakers whose names differ in such characters only stay apart.

``rotate`` has one row per conversation, perspective and turn: its text and where it
starts and ends in that dialogue, by prefix sums over a range partition
(see ``sharding.placed``).  ``render`` puts segments together into dialogues, in chunks of about ``chunk`` characters, whose masks
are offsets in the whole dialogue: most dialogues are one chunk, and a conversation with a third of all turns is very many, in as many tasks.

Defined cases.  A null role is the speaker ``unknown``; a null text is empty.  Turns are in order of
turn (null first), role and text; wholly equal rows are segments of their own.  A very long text is one segment, and its chunk is as long.  A conversation with
system turns only has no participant and no rows.  A null conversation id is a conversation like
any other.  Empty tables give empty results.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.sharding import placed

START, END = "<|im_start|>", "<|im_end|>"


def rotate(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, turn, speaker, role, segment, start, end, mask_start and mask_end."""
    rows = df.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("gm_text"),
    )
    people = rows.filter("speaker <> 'system'").select(F.col("conv_id").alias("gm_conv"), F.col("speaker").alias("perspective")).distinct()
    rows = rows.join(people, F.col("conv_id").eqNullSafe(F.col("gm_conv"))).drop("gm_conv")
    own = F.col("speaker") == F.col("perspective")
    plain = F.regexp_replace("speaker", r"[^\p{L}\p{N}_.\-]", "_")
    name = F.when(plain == F.col("speaker"), plain).otherwise(F.concat(plain, F.lit("-"), F.substring(F.md5(F.col("speaker").cast("binary")), 1, 8)))
    role = F.when(own, "assistant").when(F.col("speaker") == "system", "system").otherwise("user")
    head = F.concat(F.lit(START), role, F.when(role == "user", F.concat(F.lit(" name="), name)).otherwise(""), F.lit("\n"))
    body = F.concat(F.replace("gm_text", F.lit("<|"), F.lit("<\\|")), F.lit(END))
    rows = rows.withColumn("role", role).withColumn("gm_head", F.length(head).cast("long")).withColumn("segment", F.concat(head, body, F.lit("\n")))
    rows = rows.drop("gm_text").withColumn("gm_size", F.length("segment").cast("long"))
    order = ["conv_id", "perspective", "turn", "speaker", "segment"]
    known, _ = placed(rows, order, ["gm_size"], ["conv_id", "perspective"])
    start = F.col("gm_size_before")
    mine = F.col("role") == "assistant"
    return known.select(
        "conv_id", "perspective", "turn", "speaker", "role", "segment", start.alias("start"), (start + F.col("gm_size")).alias("end"),
        F.when(mine, start + F.col("gm_head")).alias("mask_start"), F.when(mine, start + F.col("gm_size") - 1).alias("mask_end"),
    )


def render(segments: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """conv_id, perspective, chunk, start, text and masks (``start-end`` in the dialogue, comma-joined) of the segments that start in each ``chunk`` characters."""
    row = F.struct("start", "segment", "mask_start", "mask_end")
    groups = segments.groupBy("conv_id", "perspective", F.floor(F.col("start") / F.lit(chunk)).alias("chunk")).agg(F.array_sort(F.collect_list(row)).alias("gm_rows"))
    masks = F.transform(F.filter("gm_rows", lambda r: r["mask_start"].isNotNull()), lambda r: F.concat(r["mask_start"].cast("string"), F.lit("-"), r["mask_end"].cast("string")))
    text = F.array_join(F.transform("gm_rows", lambda r: r["segment"]), "")
    return groups.select("conv_id", "perspective", "chunk", F.get("gm_rows", F.lit(0))["start"].alias("start"), text.alias("text"), F.array_join(masks, ",").alias("masks"))


def op8_perspectives(spark, sf_dir: str) -> DataFrame:
    """Every conversation rendered from the perspective of each of its participants, with the ranges to learn from."""
    return render(rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP8_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '<\|') AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE speaker <> 'system'),
s AS (SELECT r.conv_id, perspective, turn, speaker, body, regexp_replace(speaker, '[^\p{L}\p{N}_.\-]', '_', 'g') AS plain,
  CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || plain || CASE WHEN plain = speaker THEN '' ELSE '-' || left(md5(speaker), 8) END ELSE '' END || chr(10) AS head FROM s),
g AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, segment
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM g)
SELECT conv_id, perspective, start // 65536 AS chunk, min(start) AS start, string_agg(segment, '' ORDER BY start) AS text,
  coalesce(string_agg((start + length(head)) || '-' || (start + length(segment) - 1), ',' ORDER BY start) FILTER (role = 'assistant'), '') AS masks
FROM o GROUP BY conv_id, perspective, start // 65536
"""
