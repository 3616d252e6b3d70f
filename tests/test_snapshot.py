"""Snapshot assembly, context warnings and deltas, on hand-made rows."""

from pyspark.sql import functions as F

from tallyforge.operators import rules, snapshot

FILE = "path string, text string, side string"
MODEL = "path string, side string, model_id string, compiled_code string, materialized string"


def test_targets_win_and_compiled_code_is_taken_by_side(spark):
    targets = spark.createDataFrame([("a.sql", "new", "head"), ("a.sql", "old", "base"), ("p.sql", None, "head")], FILE)
    context = spark.createDataFrame([("a.sql", "context", "head"), ("c.sql", "c", "head")], FILE)
    models = spark.createDataFrame([("a.sql", "head", "m2", "compiled 2", "view"), ("a.sql", "head", "m1", "compiled 1", "table"), ("c.sql", "head", "m3", "  ", "view")], MODEL)
    rows = {(r.path, r.side): (r.text, r.is_target, r.input, r.model_id, r.materialized) for r in snapshot.assembled(snapshot.united(targets, context), models).collect()}
    assert rows == {
        ("a.sql", "head"): ("compiled 1", True, "compiled", "m1", "table"), ("a.sql", "base"): ("old", True, "raw", "a.sql", None), ("p.sql", "head"): (None, True, "raw", "p.sql", None), ("c.sql", "head"): ("c", False, "raw", "m3", "view"),
    }


def test_context_becomes_warnings_and_exceptions_leave_the_delta(spark):
    star = "select * from t"
    targets = spark.createDataFrame([("models/marts/a.sql", star, "head"), ("models/marts/a.sql", "select 1", "base"), ("models/marts/b.sql", star, "base"), ("models/marts/b.sql", f"{star} order by x", "head")], FILE)
    context = spark.createDataFrame([("models/marts/c.sql", f"{star} union all {star}", "head"), ("models/marts/d.sql", star, "base")], FILE)
    found = snapshot.judged(snapshot.assembled(snapshot.united(targets, context), spark.createDataFrame([], MODEL)))
    assert {tuple(r) for r in snapshot.context_warnings(found).collect()} == {("models/marts/c.sql", "R001", 2)}
    status = lambda *a: sorted((r.rule, r.path[-5], r.status) for r in snapshot.delta(found, *a).join(found.select("finding_id", "rule", "path").distinct(), "finding_id").collect())
    assert status() == [("R001", "a", "introduced"), ("R001", "b", "unchanged"), ("R007", "b", "introduced")]
    assert status(F.col("rule") == "R007") == [("R001", "a", "introduced"), ("R001", "b", "unchanged")]
    assert snapshot.delta(found.limit(0)).count() == 0 and snapshot.context_warnings(found.limit(0)).count() == 0


def test_the_catalog_names_every_rule_once(spark):
    rows = rules.catalog(spark).collect()
    held = [r.rule for r in rows]
    assert held == sorted(set(held)) and set(rules.conditions()) <= set(held) and {r.rule for r in rows if r.raised} == {"R002", "R018", "R020"}
    assert len(held) == 46 and "R027" not in held and all(r.severity in rules.SEVERITIES and r.name for r in rows)
