"""Chat formatting: multi-party perspective rotation, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and the
others as named users; what the speaker says, with its end mark, is what is trained on. The system's turns
stay the system's in every rendering, and the system is no participant.

The result has a row for each turn of each rendering, with its place in the rendered text: a dialogue is its
segments in order of `seq`. A conversation is dealt out by ranges of turns, and offsets are prefix sums over
the ranges, so a conversation that holds a large share of all rows is nobody's single group. The texts are
shuffled once, before they are multiplied. `dialogues` gives a row for each rendering instead.

Defined cases: turns without a conv_id belong to no conversation and are left out. A null role is a user
named "unknown" and no participant; a null text is empty; null turns come last. Ties are ordered by role and
text, and repeated rows are turns of their own. A conversation without participants has no rendering. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

HEAD, END = "<|im_start|>", "<|im_end|>\n"
LAST = 9223372036854775807
TRAINED_END = len(END) - 1  # the mark, not the line feed


def segments(conversations: DataFrame, reach: int = 1024) -> DataFrame:
    """Rows (conv_id, speaker, seq, turn, shown_role, shown_name, segment, seg_start, mask_start, mask_end):
    seg_start is the segment's place in the rendered dialogue; what is trained on lies from mask_start to
    before mask_end there, both null for other segments. Characters are code points."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.col("role").isNotNull().alias("named"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id is not null")
    turns = turns.withColumn("part", F.coalesce(F.floor(F.col("turn") / reach), F.lit(LAST)))
    as_other = F.when(F.col("role") == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), "role"))
    fixed = len(HEAD) + len("\n") + len(END)
    size = F.length("text") + fixed

    # Of each range of turns: how long it is in each rendering.
    sums = turns.groupBy("conv_id", "part", "role", "named").agg(
        F.count("*").alias("n"), F.sum(size + F.length(as_other)).alias("chars"), F.sum(F.length(as_other) - len("assistant")).alias("saved")
    )
    speakers = sums.filter("named and role <> 'system'").select("conv_id", F.col("role").alias("speaker")).distinct()
    ranges = sums.join(speakers, "conv_id").groupBy("conv_id", "part", "speaker").agg(
        F.sum("n").alias("n"), F.sum(F.col("chars") - F.when(F.col("named") & (F.col("role") == F.col("speaker")), F.col("saved")).otherwise(0)).alias("chars")
    )
    before = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "conv_id", "part", "speaker", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("c0")
    )

    # The texts meet their speakers within a range of turns.
    both = turns.join(ranges, ["conv_id", "part"])
    own = F.col("named") & (F.col("role") == F.col("speaker"))
    shown = F.when(own, F.lit("assistant")).otherwise(as_other)
    place = Window.partitionBy("conv_id", "part", "speaker").orderBy(F.asc_nulls_last("turn"), "role", "named", "text")
    run = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns(
        {
            "own": own,
            "shown": shown,
            "seq": F.col("n0") + F.row_number().over(place) - 1,
            "stop": F.col("c0") + F.sum(size + F.length(shown)).over(run),
        }
    )
    return both.select(
        "conv_id",
        "speaker",
        "seq",
        "turn",
        F.when(F.col("own"), "assistant").when(F.col("role") == "system", "system").otherwise("user").alias("shown_role"),
        F.when(~F.col("own") & (F.col("role") != "system"), F.col("role")).alias("shown_name"),
        F.concat(F.lit(HEAD), "shown", F.lit("\n"), "text", F.lit(END)).alias("segment"),
        (F.col("stop") - size - F.length("shown")).alias("seg_start"),
        F.when(F.col("own"), F.col("stop") - F.length("text") - len(END)).alias("mask_start"),
        F.when(F.col("own"), F.col("stop") - len(END) + TRAINED_END).alias("mask_end"),
    )


def dialogues(conversations: DataFrame) -> DataFrame:
    """(conv_id, speaker, text, spans): each rendering as one row, with the spans that are trained on. One row
    must hold a dialogue here; segments() has no such limit."""
    part = F.struct("seq", "segment", "mask_start", "mask_end")
    rows = segments(conversations).groupBy("conv_id", "speaker").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    spans = F.transform(F.filter("parts", lambda p: p.mask_start.isNotNull()), lambda p: F.struct(p.mask_start.alias("start"), p.mask_end.alias("end")))
    return rows.select("conv_id", "speaker", F.concat_ws("", F.transform("parts", lambda p: p.segment)).alias("text"), spans.alias("spans"))


def op8_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(table(spark, sf_dir, "conversations"))


OP8_SQL = """
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS role,
         role IS NOT NULL AS named, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT DISTINCT conv_id, role AS speaker FROM t WHERE named AND role <> 'system'
), r AS (
  SELECT t.*, speaker, named AND role = speaker AS own,
         CASE WHEN named AND role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END AS shown
  FROM t JOIN p USING (conv_id)
), s AS (
  SELECT *, '<|im_start|>' || shown || chr(10) || text || '<|im_end|>' || chr(10) AS segment FROM r
), o AS (
  SELECT *, row_number() OVER w - 1 AS seq,
         CAST(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stop
  FROM s WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS LAST, role, named, text)
)
SELECT conv_id, speaker, seq, turn,
       CASE WHEN own THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user' END AS shown_role,
       CASE WHEN NOT own AND role <> 'system' THEN role END AS shown_name,
       segment, stop - length(segment) AS seg_start,
       CASE WHEN own THEN stop - length(text) - 11 END AS mask_start,
       CASE WHEN own THEN stop - 1 END AS mask_end
FROM o
"""
