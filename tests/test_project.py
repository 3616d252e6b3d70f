"""Functions and operators beside the registered queries, on hand-made rows."""

import re

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import globs
from tallyforge.functions import texts as tx
from tallyforge.operators import attribution, enforcement, evaluation, lineage, rules, validation

TEXT = "select 'a -- b' x -- join\nfrom t /* un\njoin */ a join u on a.x > u.y\nleft join v using (k) cross join w"


@pytest.mark.parametrize(
    "pattern,path,crossing,within",
    [
        ("models/**/a_?.sql", "models/x/y/a_1.sql", True, True), ("models/**/a.sql", "models/a.sql", True, True), ("*.sql", "a/b.sql", True, False), ("m[!a]x{1,2}", "mbx2", True, True),
        ("m[!a]x", "max", False, False), ("a.b", "axb", False, False), ("a_b", "axb", False, False), ("{x,y/*}.sql", "y/z.sql", True, True), ("a+(b)", "a+(b)", True, True),
    ],
)
def test_globs(pattern, path, crossing, within):
    assert bool(re.match(globs.glob_regex(pattern), path)) == crossing and bool(re.match(globs.glob_regex(pattern, False), path)) == within


def test_blanked_text_keeps_offsets_and_spans_are_those_of_a_scan(spark):
    row = spark.createDataFrame([(TEXT,)], "t string").select(tx.blanked(F.col("t")).alias("b"), tx.spans(tx.blanked(F.col("t")), r"\bjoin\b").alias("s"), tx.unbounded_joins(tx.blanked(F.col("t"))).alias("n")).first()
    assert len(row.b) == len(TEXT) and [i for i, c in enumerate(row.b) if c == "\n"] == [i for i, c in enumerate(TEXT) if c == "\n"]
    assert [x.start for x in row.s] == [m.start() for m in re.finditer(r"\bjoin\b", row.b)] and len(row.s) == 3 and row.n == 1


def test_text_functions_on_nothing(spark):
    rows = spark.createDataFrame([("",), (None,)], "t string").select(tx.spans(F.col("t"), "x").alias("s"), tx.suppressions(F.col("t")).alias("u"), tx.references(F.col("t")).alias("r"), tx.parsed_bytes(F.col("t")).alias("p")).collect()
    assert [(list(r.s or []), list(r.u or []), list(r.r or []), r.p) for r in rows] == [([], [], [], None)] * 2


def test_incremental_block(spark):
    text = "select 1 {% if is_incremental() %} where a > 1 {% endif %} limit 3"
    assert spark.range(1).select(tx.incremental_block(F.lit(text)).alias("b")).first().b.strip() == "where a > 1"


def _files(spark, *texts):
    return rules.features(spark.createDataFrame([(f"m{i}", "models/marts/a.sql", t) for i, t in enumerate(texts)], "model_id string, path string, text string"))


def test_identity_outlives_moved_lines_and_tells_equal_occurrences_apart(spark):
    a = rules.located(_files(spark, "select * from t union all\nselect * from u")).where("rule = 'R001'").collect()
    b = rules.located(_files(spark, "-- one more line\n\nselect *  from t union all\n\nselect * from u")).where("rule = 'R001'").collect()
    assert {r.finding_id for r in a} == {r.finding_id for r in b} and len({r.finding_id for r in a}) == 2
    assert {(r.line, r.col) for r in a} == {(1, 1), (2, 1)} and {(r.line, r.col) for r in b} == {(3, 1), (5, 1)}


def test_line_suppressions_hide_their_line_only(spark):
    found = rules.located(_files(spark, "select * from t -- q: disable=R001\nunion all\nselect * from u\nunion all -- q: disable-next-line=R001\nselect * from w")).where("rule = 'R001'")
    assert [r.line for r in rules.ordered(found).collect()] == [3]


def test_metadata_findings_without_a_manifest(spark):
    files = spark.createDataFrame([("a.sql", "x", 9 << 20, None), ("b.sql", "y", 1, None)], "path string, text string, size long, modified timestamp")
    assert sorted((r.path or "", r.rule) for r in rules.metadata_findings(files, None).collect()) == [("", "R023"), ("a.sql", "R026")]


def test_multiplier_precedence(spark):
    m = lambda r, w, o=None: spark.range(1).select(attribution.multiplier(F.lit(r), w, o).alias("m")).first().m
    assert m("R001", "bigquery").basis == "warehouse-prior:bigquery" and m("r001", "postgres").basis == "rule-prior:generic"
    assert m("R001", "bigquery", {"R001": 3.0}).basis == "config-override" and m("R045", "bigquery") is None and m("R999", "generic") is None


def test_findings_without_a_price_or_a_multiplier(spark):
    found = spark.createDataFrame([("a", "R001", "p", 1.0), ("b", "R001", "p", 1.0), ("a", "R999", "p", 1.0)], "model_id string, rule string, path string, structure double")
    price = spark.sql("SELECT 'a' AS model_id, named_struct('mu', 0D, 'sigma', 1D) AS cost, 1e9D AS scan_bytes")
    fan = spark.createDataFrame([], "model_id string, downstream long, exposures long")
    got = {(r.model_id, r.rule): r for r in attribution.attributed(found, price, fan).collect()}
    assert got["a", "R001"].savings_usd > 0 and got["b", "R001"].savings_usd is None and got["a", "R999"].unestimated and got["a", "R999"].gb_months is None
    assert [r.model_id for r in attribution.ranked(attribution.attributed(found, price, fan)).collect()][0] == "a"


def test_gate_without_findings_and_unknown_impact(spark):
    f = spark.createDataFrame([], "path string, tags array<string>, owners array<string>, rule string, severity int, confidence int, savings_usd double, gb_months double, excepted boolean, blocks boolean")
    m = spark.createDataFrame([], "path string, tags array<string>, owners array<string>, model_id string")
    reach = spark.createDataFrame([], "seed string, node string")
    got = enforcement.gates(f, m, reach, [{"name": "g", "mode": "fail", "pr_increase": 1.0}, {"name": "h", "mode": "fail", "paths": ["**"], "blast_radius": 1}]).collect()
    assert {(r.gate, r.status, tuple(r.reasons)) for r in got} == {("g", "fail", ("pr-cost-unknown",)), ("h", "pass", ())}


def test_policy_permissions_and_overrides():
    assert enforcement.forbidden({"waivers": True, "baselines": False}, {}) == ["waivers"]
    local, policy = {"R001": {"severity": "low", "enabled": False}}, {"R001": {"severity": "high", "enabled": None}}
    assert enforcement.effective_overrides(local, policy, True) == {"R001": {"severity": "high", "enabled": False}}
    assert enforcement.effective_overrides(local, policy, False) == {"R001": {"severity": "high"}} and enforcement.effective_overrides(local, None, False) == local


def test_settings_problems(spark):
    ok = {"id": "w", "path": "a", "owner": "o", "reason": "r", "ticket_url": "t", "approver": "x", "rule": "R001", "created_at": "2024-01-01T00:00:00Z", "expires_at": "2025-01-01T00:00:00Z"}
    assert validation.waiver_problems([ok]) == [] and len(validation.waiver_problems([ok, ok | {"finding_id": "f", "owner": " ", "expires_at": "2023-01-01T00:00:00Z"}])) == 4
    assert validation.gate_problems([{"name": "default"}, {"name": "a", "paths": ["x"]}]) == [] and len(validation.gate_problems([{"name": ""}, {"name": "a", "monthly_usd": -1.0}])) == 3
    policy = {"id": "p", "schema_version": 2, "issued_at": "2024-01-01", "expires_at": "2025-01-01", "scopes": [{"id": "s", "rules": {"R001": {"threshold": 0}, "R9": {}}, "exceptions": [{"id": "e"}], "custom_rules": [{"id": "C", "when": {"glob": ("n", "*")}, "fields": {"n": "number"}}]}]}
    assert len(validation.policy_problems(policy, ["R001"])) == 4
    deep = {"equals": ("f", 1)}
    for _ in range(12):
        deep = {"not": deep}
    assert validation.predicate_problems(deep) == ["nested too deeply"]
    assert len(validation.cost_problems({"interval": 2, "usd_per_tb": 5.0, "multipliers": {"R001": (3, 1)}})) == 3
    assert validation.problems(spark, validation.gate_problems([{"name": ""}])).count() == 1


def test_samples(spark):
    files, names, fired = spark.range(500).select(F.concat(F.lit("p"), "id").alias("path")), spark.createDataFrame([("R1",), ("R2",)], "rule string"), spark.createDataFrame([("p1", "R1")], "path string, rule string")
    one = evaluation.negative_sample(files, names, fired, 1.0, 7)
    assert one.count() == 999 and one.where("weight <> 1").count() == 0
    part = evaluation.negative_sample(files, names, fired, 0.2, 7)
    assert 120 < part.count() < 280 and part.exceptAll(evaluation.negative_sample(files.repartition(3), names, fired, 0.2, 7)).count() == 0
    rows = spark.range(100).select(F.col("id").cast("string").alias("finding_id"), F.when(F.col("id") < 3, 4).otherwise(1).alias("severity"))
    got = evaluation.high_first(rows, 10, 1, 4)
    assert got.count() == 10 and got.where("severity = 4").count() == 3


def test_lineage_on_empty_tables(spark):
    none = spark.createDataFrame([], "caller string, callee string")
    changed = spark.createDataFrame([("m",)], "macro string")
    assert [r.model_id for r in lineage.macro_impact(none, changed, spark.createDataFrame([("x", "m"), ("y", "n")], "model_id string, macro string")).collect()] == ["x"]
    assert lineage.changed_paths(none.selectExpr("caller AS path", "callee AS text"), none.selectExpr("caller AS path", "callee AS text")).count() == 0
