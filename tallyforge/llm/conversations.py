"""Cumulative-snapshot collapse of logged conversations, and their rendering.

Logs hold a conversation again after each turn. Every prefix of a conversation's turns has a rolling hash (two 64-bit
hashes of position, role and text, combined over the turns so far); a conversation whose own hash is a strict prefix of
a longer one is dropped by an anti-join, of equal ones the smallest id stays. Prefixes and whole hashes are made distinct
with partial aggregation first, so a first turn or a conversation that a third of all rows share is one row in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import table


def _hash(seed: int):
    return F.xxhash64(F.lit(seed), "pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def prefixes(turns: DataFrame) -> DataFrame:
    """turns with pos (1, 2, ... by turn, ties by role and text), n (turns in all) and the hashes h1, h2 of the prefix."""
    own = Window.partitionBy("conv_id")
    order = own.orderBy("turn", "role", "text")
    upto = own.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").withColumn("pos", F.row_number().over(order)).withColumn("n", F.count("*").over(own).cast("int"))
    return rows.withColumn("h1", F.bit_xor(_hash(1)).over(upto)).withColumn("h2", F.bit_xor(_hash(2)).over(upto))


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the maximal conversations; n_copies counts the equal ones that conv_id stands for.

    Rows without conv_id belong to no conversation: `unnamed` has them. Null roles and texts differ from empty ones, repeated
    rows are turns of their own, very long texts are hashed whole, and an empty table gives no rows.
    """
    rows = prefixes(turns)
    whole = rows.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    part = rows.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return whole.join(part, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies")


def unnamed(turns: DataFrame) -> DataFrame:
    """The rows without conv_id, as they are."""
    return turns.where("conv_id is null")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """kept with `rendered`: for each turn its role in marks, its text and an end mark, a line each (null role: unknown)."""
    one = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>"))
    bodies = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("_id"), F.struct("turn", "role", "text", one.alias("line")).alias("t"))
    mine = bodies.join(kept.select(F.col("conv_id").alias("_kept")), F.col("_id") == F.col("_kept"), "left_semi")
    texts = mine.groupBy("_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["line"]), "\n").alias("rendered"))
    return kept.join(texts, F.col("conv_id") == F.col("_id")).drop("_id")


def op8_snapshot_collapse(spark, sf_dir: str) -> DataFrame:
    """All conversations that prefix no longer one, rendered; edge cases as in `collapse` and `render`."""
    turns = table(spark, sf_dir, "conversations")
    return render(turns, collapse(turns))


OP8_SQL = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, count(*) AS n, list(struct_pack(r := role, t := text) ORDER BY pos) AS body,
         string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>', chr(10) ORDER BY pos) AS rendered
  FROM t GROUP BY conv_id
), w AS (
  SELECT n, body, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(rendered) AS rendered FROM c GROUP BY n, body
)
SELECT w.conv_id, w.n AS n_turns, w.n_copies, w.rendered FROM w
WHERE NOT EXISTS (SELECT 1 FROM w AS b WHERE b.n > w.n AND b.body[1:w.n] = w.body)
"""
