"""Preference formatting: the turns that a chosen and a rejected conversation share at their start are rendered once as
the prompt; the remaining turns become a pair of completions, with the spans of text that count for the loss.

Only DataFrame functions are used. Turns are numbered within their conversation and the two sides are compared turn by
turn, as rows; a pair's rows meet only to be joined into its texts.

Defined cases: turns are ordered by turn (null last), role, text; null roles and texts equal one another and are rendered
as empty; repeated turns are turns of their own; a conversation without its partner keeps an empty prompt and an empty
other completion; if one conversation is the start of the other, its completion is empty; turns with a null conv_id
belong to no pair; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog_loom.llm.shared import table


def rendered(role: str, text: str) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def format_preferences(turns: DataFrame) -> DataFrame:
    """turns(pair_id, chosen boolean, turn, role, text) to one row for each pair: prompt, chosen, rejected, and the
    spans "start-end" (characters of the completion, end not included) of assistant text that the loss counts."""
    order = Window.partitionBy("pair_id", "chosen").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    numbered = turns.withColumn("at", F.row_number().over(order) - 1)
    this = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = numbered.groupBy("pair_id", "at").agg(F.max(F.when(F.col("chosen"), this)).alias("yes"), F.max(F.when(~F.col("chosen"), this)).alias("no"))
    differs = F.min(F.when(~F.col("yes").eqNullSafe(F.col("no")), F.col("at"))).over(Window.partitionBy("pair_id"))
    sides = sides.withColumn("common", F.coalesce(differs, F.lit(1 << 30)))
    line = lambda side: F.when(F.col(side).isNotNull(), rendered(f"{side}.role", f"{side}.text"))
    before = Window.partitionBy("pair_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("at") >= F.col("common")

    def span(side: str) -> Column:
        start = F.coalesce(F.sum(F.when(rest, F.length(line(side)))).over(before), F.lit(0)) + F.length(f"{side}.role") + 5
        return F.when(rest & (F.col(f"{side}.role") == "assistant"), F.concat(start.cast("string"), F.lit("-"), (start + F.length(f"{side}.text")).cast("string")))

    pieces = sides.select("pair_id", "at", rest.alias("rest"), line("yes").alias("yes_line"), line("no").alias("no_line"), span("yes").alias("yes_span"), span("no").alias("no_span"))
    row = F.struct("at", "rest", "yes_line", "no_line", "yes_span", "no_span")
    whole = pieces.groupBy("pair_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    text = lambda field, rest: F.array_join(F.transform(F.filter("rows", lambda r: r["rest"] == rest), lambda r: r[field]), "")
    spans = lambda field: F.array_join(F.transform("rows", lambda r: r[field]), ",")
    return whole.select(
        "pair_id", text("yes_line", False).alias("prompt"), text("yes_line", True).alias("chosen"), text("no_line", True).alias("rejected"),
        F.size(F.filter("rows", lambda r: ~r["rest"])).cast("long").alias("prompt_turns"), spans("yes_span").alias("chosen_loss"), spans("no_span").alias("rejected_loss"),
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 make pair k; the even one is the chosen one."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null")
    return format_preferences(turns.select(F.shiftright("conv_id", 1).cast("long").alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("chosen"), "turn", "role", "text"))


SQL = """
WITH t AS (SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 = 0 AS chosen, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT coalesce(y.pair_id, n.pair_id) AS pair_id, coalesce(y.pos, n.pos) AS pos, y.role AS yr, y.text AS yt, n.role AS nr, n.text AS nt
  FROM (SELECT * FROM t WHERE chosen) y FULL JOIN (SELECT * FROM t WHERE NOT chosen) n ON y.pair_id = n.pair_id AND y.pos = n.pos),
c AS (SELECT *, coalesce(min(CASE WHEN yr IS NOT DISTINCT FROM nr AND yt IS NOT DISTINCT FROM nt THEN NULL ELSE pos END) OVER (PARTITION BY pair_id), 1000000) AS common,
  '<|' || yr || '|>' || chr(10) || yt || '<|end|>' || chr(10) AS yl, '<|' || nr || '|>' || chr(10) || nt || '<|end|>' || chr(10) AS nl FROM b),
s AS (SELECT *, pos >= common AS rest,
  coalesce(sum(CASE WHEN pos >= common THEN length(yl) END) OVER w, 0) + length(yr) + 5 AS ys,
  coalesce(sum(CASE WHEN pos >= common THEN length(nl) END) OVER w, 0) + length(nr) + 5 AS ns
  FROM c WINDOW w AS (PARTITION BY pair_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT pair_id,
 coalesce(string_agg(CASE WHEN NOT rest THEN yl END, '' ORDER BY pos), '') AS prompt,
 coalesce(string_agg(CASE WHEN rest THEN yl END, '' ORDER BY pos), '') AS chosen,
 coalesce(string_agg(CASE WHEN rest THEN nl END, '' ORDER BY pos), '') AS rejected,
 CAST(count(CASE WHEN NOT rest THEN 1 END) AS BIGINT) AS prompt_turns,
 coalesce(string_agg(CASE WHEN rest AND yr = 'assistant' THEN CAST(ys AS VARCHAR) || '-' || CAST(ys + length(yt) AS VARCHAR) END, ',' ORDER BY pos), '') AS chosen_loss,
 coalesce(string_agg(CASE WHEN rest AND nr = 'assistant' THEN CAST(ns AS VARCHAR) || '-' || CAST(ns + length(nt) AS VARCHAR) END, ',' ORDER BY pos), '') AS rejected_loss
FROM s GROUP BY pair_id
"""
