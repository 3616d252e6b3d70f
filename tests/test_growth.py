"""What follows lineage, reads observations or judges texts does no more of it than its result needs."""

import os
import random

import pytest

from tallyforge.functions import sqltext as st
from tallyforge.functions import texts as tx
from tallyforge.operators import enforcement, lineage, rules
from tallyforge.plans import catalog
from tallyforge.plans.derive import derive
from tallyforge.plans.project import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _graph(seed, nodes=24, edges=34):
    r = random.Random(seed)
    return [(r.randrange(nodes), r.randrange(nodes)) for _ in range(edges)] + [(None, 1), (1, None), (3, 3)]


def _below(edges):
    step = {}
    for p, c in edges:
        if p is not None and c is not None:
            step.setdefault(p, set()).add(c)
    out = {}
    for s in step:
        seen, todo = set(), [s]
        while todo:
            new = step.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        out[s] = seen - {s}
    return out


@pytest.mark.parametrize("name", ["finding_savings", "downstream_cost", "model_cost_index"])
def test_observations_are_aggregated_once(spark, name):
    assert sum("l_extendedprice" in line for line in _plan(QUERIES[name](spark, SF)).split("\n") if "Relation" in line) == 1


def test_findings_without_places_compute_no_breaks(spark):
    own = rules.findings(catalog._feature_rows(derive(spark, SF, "d_files"), derive(spark, SF, "d_models")), "bigquery")
    assert "last" not in _plan(own) and "split(" in _plan(own)


@pytest.mark.parametrize("text, bare, blank, quiet", [
    (None, None, None, None),
    ("", "", "", ""),
    ("a 'x''y' b", "a 'x''y' b", "a '    ' b", "a 'x''y' b"),
    ("a '-- no' -- yes", "a '-- no' ", "a '     '       ", "a '-- no'       "),
    ("a '/*' {# b #}c", "a '/*' c", "a '  '        c", "a '/*'        c"),
    ("a /* open 'x'", "a /* open 'x'", "a /* open ' '", "a /* open 'x'"),
    ("it's -- so", "it's ", "it's      ", "it's      "),
])
def test_texts_with_and_without_marks(spark, text, bare, blank, quiet):
    t = F.col("t")
    assert tuple(spark.createDataFrame([(text,)], "t string").select(st.without_comments(t), tx.blanked(t), tx.blanked(t, False)).first()) == (bare, blank, quiet)


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs_of_graphs_with_cycles(spark, seed):
    edges = _graph(seed)
    got = {}
    for r in lineage.downstream(spark.createDataFrame(edges, "parent long, child long")).collect():
        assert r.node not in got.setdefault(r.seed, set())  # each pair once
        got[r.seed].add(r.node)
    assert got == {s: n for s, n in _below(edges).items() if n}


def test_a_long_way_takes_few_rounds(spark, monkeypatch):
    kept, scratch = [], lineage.scratch
    monkeypatch.setattr(lineage, "scratch", lambda s, n: kept.append(scratch(s, n)) or kept[-1])
    assert lineage.downstream(spark.createDataFrame([(k, k + 1) for k in range(100)], "parent long, child long")).count() == 5050
    assert len(os.listdir(kept[-1])) <= 9


@pytest.mark.parametrize("seed", [4, 5])
def test_groups_are_followed_as_one_set(spark, monkeypatch, seed):
    edges, r = _graph(seed), random.Random(seed)
    starts = [(i, n) for i in range(3) for n in [*r.sample(range(24), (1, 2, 9)[i]), None]]
    kept, scratch = [], lineage.scratch
    monkeypatch.setattr(lineage, "scratch", lambda s, n: kept.append(scratch(s, n)) or kept[-1])
    got = sorted(map(tuple, lineage.reached_by(spark.createDataFrame(edges, "parent long, child long"), spark.createDataFrame(starts, "i int, node long")).collect()))
    below = _below(edges)
    assert got == sorted({(i, n) for i, s in starts for n in below.get(s, ())})
    assert spark.read.parquet(f"{kept[-1]}/*").count() <= 2 * len(got)


def test_gates_tell_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(lineage, "downstream", lambda *a, **k: pytest.fail("all pairs"))
    assert QUERIES["full_gates"](spark, SF).count() == 5


def test_gates_by_edges_and_by_pairs(spark):
    f = spark.createDataFrame([], "path string, tags array<string>, owners array<string>, rule string, severity int, confidence int, savings_usd double, gb_months double, excepted boolean, blocks boolean")
    m = spark.createDataFrame([("a/x", [], [], 1), ("a/y", [], [], 2), ("b/z", [], [], 3)], "path string, tags array<string>, owners array<string>, model_id long")
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 3)], "parent long, child long")
    asked = [{"name": f"{p}{n}", "mode": "fail", "paths": [f"{p}/*"], "blast_radius": n} for p, n in (("a", 2), ("a", 3), ("b", 1), ("b", 2))] + [{"name": "none", "mode": "fail"}]
    by = lambda *a: {r.gate: r.status for r in enforcement.gates(f, m, *a).collect()}
    assert by(None, asked, None, False, edges) == by(lineage.downstream(edges), asked) == {"a2": "fail", "a3": "pass", "b1": "fail", "b2": "pass", "none": "pass"}
