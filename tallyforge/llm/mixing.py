"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The mix has a number of blocks of equal tokens. Sources get blocks by highest quotients of their targets; a source's
blocks go to its shards (documents by a hash of the id, about as many shards as documents in one) by highest quotients
of the shards' tokens. A shard's documents, in a seeded order, form a row of tokens that is cut into equal blocks; a
seeded permutation of block numbers says which blocks are taken, or taken once more. Documents get what their share of
the taken blocks holds: whole passes over a block come first, so no token is taken more than twice.

Only counts are shuffled for the apportionment; a hot source has many shards, each a task's worth. There is one row for
each source, and one for each shard of a source (half the root of its documents); joins with them are left to Spark.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.shared import table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
SEED = 20
#: Tokens in a block: at most MAX_BLOCK, fewer in small corpora so that there are about MIN_BLOCKS blocks.
MAX_BLOCK, MIN_BLOCKS = 64, 20_000
#: Any two of these steps give different walks through a shard's blocks; all are primes above the blocks of a shard.
STEPS = (1_000_000_007, 998_244_353, 1_000_000_009, 2_147_483_647, 1_073_741_789)


def apportion(weights: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients weight / (2 seats + 1), none above its `most`; ties go to the earlier one.

    The divisor form finds all but the last few seats at once; a heap deals those out.
    """
    w = np.asarray(weights, float)
    most = np.where(w > 0, most, 0).astype(np.int64)
    seats = min(int(seats), int(most.sum()))
    got = np.zeros(len(w), np.int64)
    if seats <= 0:
        return got
    at = lambda x: np.minimum(most, np.floor(np.minimum(w * x, 4e18) + 0.5 - 1e-9)).astype(np.int64)
    low, high = 0.0, 1.0
    while at(high).sum() < seats:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if at(mid).sum() <= seats else (low, mid)
    got = np.maximum(at(low), 0)
    left = seats - int(got.sum())
    queue = [(-w[i] / (2 * got[i] + 1), i) for i in np.flatnonzero(got < most)]
    heapq.heapify(queue)
    for _ in range(left):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(queue, (-w[i] / (2 * got[i] + 1), i))
    return got


@F.pandas_udf(T.ArrayType(T.LongType()))
def _apportioned(weights: pd.Series, seats: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([apportion(np.asarray(w, float), int(s), np.asarray(m, np.int64)) for w, s, m in zip(weights, seats, most, strict=True)])


def sized(docs: DataFrame, *others: str) -> DataFrame:
    """docs with `_size`, the words of its text (null: 0), `_tie`, a hash of the text, and `_last`, one of other columns.

    Rows of one id are told apart by these, so reruns agree; rows that are equal in all of that are alike in the mix.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumn("_size", size).withColumn("_tie", F.xxhash64("text")).withColumn("_last", F.xxhash64(*others) if others else F.lit(0).cast("long"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, s, source_size, n_docs, target), a row for each source; s numbers sources by code point, null last.

    A source's target is its weight's part of the whole share, at most twice its size; what is above goes to the others
    by weight until none is above. In closed form: with sources by rising cap per weight, the first one whose cap is not
    below the level that the capped ones leave.
    """
    by = sizes.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("n_docs"))
    by = by.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))  # one row for each source
    w = F.lit(WEIGHTS[-1])
    for k, x in enumerate(WEIGHTS[:-1]):
        w = F.when(F.pmod(F.col("s") - 1, F.lit(len(WEIGHTS))) == k, F.lit(x)).otherwise(w)
    rising = Window.orderBy("level", "s")
    by = by.withColumn("w", w).withColumn("cap", (MOST * F.col("source_size")).cast("double")).withColumn("level", F.col("cap") / F.col("w"))
    everything = Window.partitionBy(F.lit(0))
    by = by.withColumn("before", F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    by = by.withColumn("after", F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing))).withColumn("all", F.sum("source_size").over(everything))
    by = by.withColumn("try", (SHARE * F.col("all") - F.col("before")) / F.col("after"))
    by = by.withColumn("lambda", F.min(F.when(F.col("try") <= F.col("level"), F.struct("level", "try"))).over(everything)["try"])
    return by.select("source", "s", "source_size", "n_docs", F.least("cap", F.coalesce(F.col("lambda") * F.col("w"), "cap")).alias("target"), "all")


def planned(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows (doc_id, source, _size, _tie, _last, any others) with source_size, target, and `_blocks`: the row's part of each block
    as structs (begin, end, times), in words of the row. sizes: the same rows' source, doc_id, _size, _tie and _last, to count over."""
    by = targets(sizes).withColumn("block", F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK), F.floor(F.col("all") / MIN_BLOCKS))).cast("long")).withColumn("shards", F.ceil(F.sqrt("n_docs") / 2).cast("int"))
    seats = by.groupBy("block", "all").agg(F.sort_array(F.collect_list(F.struct("s", "target", "source_size"))).alias("a"))
    seats = seats.withColumn("q", _apportioned(F.col("a.target"), F.round(SHARE * F.col("all") / F.col("block")).cast("long"), F.transform("a.source_size", lambda x: MOST * F.greatest(F.lit(1).cast("long"), F.round(x / F.col("block")).cast("long")))))
    seats = seats.select(F.explode(F.arrays_zip(F.col("a.s").alias("s"), "q")).alias("z")).select(F.col("z.s").alias("s"), F.col("z.q").alias("seats"))
    by = written(by.join(seats, "s"), "sources")

    def sharded(df: DataFrame) -> DataFrame:
        return df.join(by.select(F.col("source").alias("_source"), "s", "shards", "source_size", "target"), F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "_tie"), F.col("shards")).cast("int"))

    held = sharded(sizes).groupBy("s", "shard").agg(F.sum("_size").alias("words")).join(by.select("s", "seats", "block"), "s")
    held = held.withColumn("n", F.greatest(F.lit(1).cast("long"), F.round(F.col("words") / F.col("block")).cast("long")))
    held = held.groupBy("s", "seats").agg(F.sort_array(F.collect_list(F.struct("shard", "words", "n"))).alias("a"))
    held = held.withColumn("q", _apportioned(F.col("a.words").cast("array<double>"), F.col("seats"), F.transform("a.n", lambda n: MOST * n)))
    held = held.select("s", F.explode(F.arrays_zip(F.col("a.shard").alias("shard"), F.col("a.words").alias("words"), F.col("a.n").alias("n"), "q")).alias("z")).select("s", "z.*")
    step = F.element_at(F.array(*[F.lit(p) for p in STEPS]), (F.pmod(F.xxhash64(F.lit(SEED + 1), "s", "shard"), F.lit(len(STEPS))) + 1).cast("int"))
    held = held.select("s", "shard", "words", "n", F.floor(F.col("q") / F.col("n")).alias("base"), (F.col("q") % F.col("n")).alias("more"), (step % F.col("n")).alias("step"), F.pmod(F.xxhash64(F.lit(SEED + 2), "s", "shard"), F.col("n")).alias("off"))
    order = Window.partitionBy("s", "shard").orderBy(F.xxhash64(F.lit(SEED + 3), "doc_id", "_tie"), "doc_id", "_tie", "_size", "_last").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = sharded(rows).withColumn("_end", F.sum("_size").over(order)).withColumn("_begin", F.col("_end") - F.col("_size")).join(held, ["s", "shard"])
    # block k of a shard holds words floor(k W / n) up to floor((k + 1) W / n)
    parts = F.expr("""
        CASE WHEN _size > 0 THEN transform(
            sequence(((_begin + 1) * n - 1) div words, (_end * n - 1) div words),
            k -> struct(greatest(_begin, (k * words) div n) - _begin AS begin, least(_end, ((k + 1) * words) div n) - _begin AS end,
                        base + IF(pmod(step * k + off, n) < more, 1, 0) AS times))
        ELSE cast(array() AS array<struct<begin: bigint, end: bigint, times: bigint>>) END""")
    return at.withColumn("_blocks", parts).drop("_source", "s", "shard", "shards", "words", "n", "base", "more", "step", "off", "_begin", "_end", "_tie", "_last")


def mix_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document; ids must be whole numbers or null.

    Null and empty texts have size 0 and give nothing; a null source is a source of its own, the last one; rows of one id
    count each by their own text; an empty table gives no rows. Reruns agree, however the rows are dealt.
    """
    sizes = written(sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")).select("doc_id", "source", "_size", "_tie", "_last"), "sizes")
    taken = F.aggregate("_blocks", F.lit(0).cast("long"), lambda t, b: t + (b["end"] - b["begin"]) * b["times"])
    return planned(sizes, sizes).select("doc_id", F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"))


def _passes(text: str | None, parts: list[dict], pattern: regex.Pattern) -> list[str | None]:
    """What each pass over a text takes: the text itself (null), or the parts that the pass takes, joined by new lines."""
    words, out = None, []
    for turn in range(1, 1 + max((p["times"] for p in parts), default=0)):
        spans: list[list[int]] = []
        for p in parts:
            if p["times"] >= turn and p["end"] > p["begin"]:
                if spans and spans[-1][1] == p["begin"]:
                    spans[-1][1] = p["end"]
                else:
                    spans.append([p["begin"], p["end"]])
        if len(spans) == 1 and spans[0] == [0, parts[-1]["end"]]:
            out.append(None)
        elif spans:
            words = words or [m.span() for m in pattern.finditer(text)]
            out.append("\n".join(text[words[a][0] : words[b - 1][1]] for a, b in spans))
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def _cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    pattern = regex.compile(WORD)
    for text, blocks in batches:
        for k in range(0, len(text), 500):
            yield pa.array([_passes(t, parts, pattern) for t, parts in zip(text.slice(k, 500).to_pylist(), blocks.slice(k, 500).to_pylist(), strict=True)], pa.list_(pa.string()))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself, with docs' columns: a row for each pass over a document (at most two), with what the pass takes.

    Edge cases as in `mix_counts`. n_chars, where docs has it, is that of the new text; all other columns stay as they are,
    whatever their names. Only texts and block numbers go through Python.
    """
    simple = [c for c, kind in ((f.name, f.dataType.simpleString()) for f in docs.schema.fields) if "map<" not in kind and "variant" not in kind]
    own = docs.select("doc_id", "source", "text", F.struct("*").alias("_row"))  # columns of any name stay apart
    own = sized(own, *[f"_row.`{c}`" for c in simple]).drop("text")
    rows = planned(own, own.drop("_row")).select("_row", F.explode(_cut("_row.text", "_blocks")).alias("_part"))
    text = F.coalesce("_part", "_row.text")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`") for c in docs.columns])


def op1_source_mixing(spark, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken; edge cases as in `mix_counts`."""
    return mix_counts(table(spark, sf_dir, "documents"))
