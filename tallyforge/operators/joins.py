"""Joins of models as rows: their equality keys, fan-outs, and unique keys that pass along lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import joins as jn
from tallyforge.functions import templates as tp
from tallyforge.functions import texts as tx
from tallyforge.operators.lineage import spread

#: Stands for a nested query that is joined.
QUERY = "(query)"


def join_keys(rows: DataFrame) -> DataFrame:
    """(model_id, path, start, left_relation, left_key, right_relation, right_key): a row for each equality of a join.

    rows: those of rules.features(). Relations are those that aliases stand for, a nested query is QUERY, null where an
    alias is unknown. Joins without an equality of columns give none.
    """
    # An expression is exploded, not the column: for a column Spark infers a filter, which reads all joins a second time, before rows are dealt.
    each = F.flatten(F.transform("joins", lambda j: F.transform(j["pairs"], lambda p: F.struct(j["start"].alias("start"), p.alias("p")))))
    pairs = rows.select("model_id", "path", F.explode(each).alias("j")).select("model_id", "path", "j.start", "j.p")
    named = lambda side: F.when(F.col(f"p.{side}.relation").rlike("^_+$"), QUERY).otherwise(F.col(f"p.{side}.relation")).alias(f"{side}_relation")
    return pairs.select("model_id", "path", "start", named("left"), F.col("p.left.key").alias("left_key"), named("right"), F.col("p.right.key").alias("right_key"))


def fan_out(rows: DataFrame, keyed: DataFrame, every_ref: bool = True) -> DataFrame:
    """(model_id, path, rule, severity, line, col, joined, missing): joins whose keys leave some of a model's unique key open.

    keyed: (name, unique_key array). Of a join, the relation itself is tried first, then with `every_ref` what the file
    refers to, in order; the first that is not covered is reported. Models without a known key are covered. Models join by
    name; a name that a third of all files refer to is one row on that side, which Spark splits or broadcasts.
    """
    equal = F.filter("joins", lambda j: j["kind"].isin("inner", "left", "right", "full") & j["equality"])
    refs = F.transform(F.filter(tx.references(F.col("text")), lambda r: r["kind"] == "ref"), lambda r: F.lower(r["name"]))
    own = rows.select("model_id", "path", "text", "shaped.breaks", refs.alias("refs"), F.explode(equal).alias("j"))
    tried = F.concat(F.array(F.substring_index("j.relation", ".", -1)), F.col("refs") if every_ref else F.array().cast("array<string>"))
    tried = own.select("model_id", "path", "text", "breaks", "j.start", "j.keys", F.posexplode(tried).alias("ord", "name"))
    known = keyed.where(F.size("unique_key") > 0).groupBy(F.lower("name").alias("name")).agg(F.min("unique_key").alias("unique_key"))
    open_ = tried.join(known, "name").where(~jn.is_covered(F.col("keys"), F.col("unique_key")))
    one = open_.groupBy("model_id", "path", "start").agg(F.min(F.struct("ord", "name", F.array_except("unique_key", "keys").alias("missing"), "text", "breaks")).alias("m"))
    place = tx.line_col(F.col("m.text"), tp.source_offset(F.col("m.breaks"), F.col("start")))
    return one.select("model_id", "path", F.lit("R038").alias("rule"), F.lit("high").alias("severity"), place["line"].alias("line"), place["col"].alias("col"), F.col("m.name").alias("joined"), "m.missing")


def propagated_keys(models: DataFrame, edges: DataFrame) -> DataFrame:
    """(model_id, unique_key) of models with a key of their own, and of those that pass on their only parent's.

    models: (model_id, unique_key array, passes); `passes` says that a model keeps its parent's rows as they are. Rounds
    along lineage until nothing is new; what has a key of its own keeps it, and cycles end.
    """
    single = edges.select("child", "parent").distinct().groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("parent")).where("n = 1")
    bare = models.where((F.col("unique_key").isNull() | (F.size("unique_key") == 0)) & F.col("passes")).select(F.col("model_id").alias("child"))
    step = single.join(bare, "child", "left_semi").select(F.col("parent").alias("_p"), F.col("child").alias("_c"))
    first = models.where(F.size("unique_key") > 0).select(F.col("model_id").alias("node"), "unique_key")
    return spread(first, step).select(F.col("node").alias("model_id"), "unique_key")
