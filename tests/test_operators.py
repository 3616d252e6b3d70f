"""Operators on hand-made rows."""

import math

from pyspark.sql import functions as F

from tallyforge.functions import lognormal as ln
from tallyforge.functions import sqltext as st
from tallyforge.operators import costs, governance, lineage, rules


def test_lognormal_moments(spark):
    e = ln.from_point(F.lit(100.0), 0.5)
    r = spark.range(1).select(ln.median(e).alias("m"), ln.mean(e).alias("a"), ln.variance(e).alias("v")).first()
    s2 = math.log1p(0.25)
    assert math.isclose(r.m, 100) and math.isclose(r.a, 100 * math.exp(s2 / 2)) and math.isclose(r.v, (math.exp(s2) - 1) * 1e4 * math.exp(s2))


def test_range_quantiles(spark):
    e = ln.from_range(F.lit(2.0), F.lit(8.0))
    r = spark.range(1).select(ln.quantile(e, 0.1).alias("a"), ln.quantile(e, 0.9).alias("b"), ln.median(e).alias("m")).first()
    assert math.isclose(r.a, 2) and math.isclose(r.b, 8) and math.isclose(r.m, 4)


def test_masking_keeps_literals_apart(spark):
    text = "select 'a -- b' x -- order by\nfrom t /* union */ where y = 'select *'"
    got = spark.createDataFrame([(text,)], "t string").select(st.masked(F.col("t")).alias("m")).first().m
    assert "order" not in got and "union" not in got and "select *" not in got and got.startswith("select '' x")


def test_closure_on_a_diamond_and_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 4)], "parent long, child long")
    got = {(r.seed, r.node) for r in lineage.downstream(edges).collect()}
    assert {n for s, n in got if s == 1} == {2, 3, 4, 5} and {n for s, n in got if s == 4} == {5}


def test_delta_statuses(spark):
    base = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0), ("c", 2, 1.0)], "finding_id string, severity int, savings double")
    head = spark.createDataFrame([("b", 1, 1.0), ("c", 3, 1.0), ("d", 1, 1.0)], "finding_id string, severity int, savings double")
    assert {r.finding_id: r.status for r in governance.delta(base, head).collect()} == {"a": "resolved", "b": "unchanged", "c": "regressed", "d": "introduced"}


def test_missing_field_makes_leaves_false(spark):
    rows = spark.createDataFrame([(None,), ("x",)], "f string")
    assert [r.f for r in rows.where(governance.predicate({"not": {"equals": ("f", "x")}})).collect()] == [None]


def test_suppressed_rule_is_not_found(spark):
    files = spark.createDataFrame([("m", "models/marts/a.sql", "-- costcheck: disable-file=R001\nselect * from t", "view", None, None, None), ("n", "models/marts/b.sql", "select * from t", "view", None, None, None)], "model_id string, path string, text string, materialized string, unique_key string, partition_by string, cluster_by string")
    got = {(r.model_id, r.rule) for r in rules.findings(rules.features(files)).collect()}
    assert ("n", "R001") in got and ("m", "R001") not in got


def test_first_present_alias_counts_even_if_null(spark):
    rows = spark.createDataFrame([(None, 5.0)], "bytes_processed double, bytes_billed double")
    assert costs.aliased(rows, {"bytes": ["bytes_processed", "bytes_billed"]}).first().bytes is None


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "parent long, child long")
    assert lineage.downstream(none).count() == 0
    obs = spark.createDataFrame([], "model_id string, window_start timestamp, window_end timestamp, executions long, bytes_processed double, credits double, cost_usd double")
    assert costs.observe_monthly(obs).count() == 0 and costs.violations(obs).count() == 0


def test_lines_are_found_in_the_whole_text(spark):
    row = spark.createDataFrame([("x" * 600 + "\n\na. b.\nc!",)], "text string").select(st.lines_of(F.col("text"), "[.!?]").alias("m")).first()
    assert [(m.line, m.n) for m in row.m] == [(3, 2), (4, 1)]


def test_long_chains_of_computed_edges(spark):
    nodes = spark.range(1, 4097).select(F.col("id").alias("child"), F.floor(F.col("id") / 2).cast("long").alias("parent"))
    got = {r.seed: r.n for r in lineage.downstream_counts(nodes).where("seed in (0, 1, 2, 1024)").collect()}
    assert got == {0: 4096, 1: 4095, 2: 2046 + 1, 1024: 2 + 1}
    most = {r.seed: r.n for r in lineage.downstream_counts(nodes, 15).where("seed in (0, 1, 1024)").collect()}
    assert most == {0: 15, 1: 15, 1024: 3}
    changed = spark.createDataFrame([(2048,), (1024,), (5,)], "id long")
    touched = {r.node for r in lineage.reached(nodes, changed).collect()}
    below = lambda n: {m for c in (2 * n, 2 * n + 1) if c <= 4096 for m in {c} | below(c)}
    assert touched == below(2048) | below(1024) | below(5)


def test_globs_of_predicates_take_marks_of_like_literally(spark):
    rows = spark.createDataFrame([("a_b.sql",), ("axb.sql",), ("a%b.sql",), ("x/a_b.sql",), (None,)], "path string")
    held = lambda pattern: {r.path for r in rows.where(governance.predicate({"glob": ("path", pattern)})).collect()}
    assert held("a_b*") == {"a_b.sql"} and held("a%b.sql") == {"a%b.sql"} and held("*a_b.sql") == {"a_b.sql", "x/a_b.sql"}
    assert held("a?b.sql") == {"a_b.sql", "axb.sql", "a%b.sql"}
    assert rows.where(governance.predicate({"not": {"glob": ("path", "*")}})).count() == 1
