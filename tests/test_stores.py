"""Settings files, manifests, baselines as tables, running sums over large groups, and ratings."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import baselines, costs, evaluation, ordered
from tallyforge.sources import manifests, readers, settings

SCHEMA = """
models:
  - name: orders
    config: {materialized: incremental, unique_key: [id, day], full_refresh: true, partition_by: {field: day, data_type: date}}
    columns: [{name: id, tests: [unique]}, {name: day}, {descr: x}]
    meta: {owner: team-a}
  - name: 3
  - description: nameless
sources:
  - name: raw
    tables: [{name: t1}, {name: t2}, {}]
exposures:
  - name: board
    depends_on: ["ref('orders')"]
    owner: {name: Ann, email: a@x}
    meta: {owners: [b, c]}
"""
PROJECT = """
name: shop
models:
  shop:
    +materialized: view
    +tags: [x]
    staging:
      +materialized: table
      raw: {cluster_by: [a, b]}
    marts:
      on_schema_change: append
  other: {}
"""


@pytest.fixture
def folder(tmp_path):
    files = {
        "models/schema.yml": SCHEMA, "dbt_project.yml": PROJECT, "sub/dbt_project.yml": "name: x\nmodels: {a: {}, b: {}}", "bad/dbt_project.yml": "a: [", "models/broken.yaml": "models: [\n - {", "models/deep/er/list.yml": "- 1\n- 2", "ci/pipeline.yml": "jobs: {a: 1}",
        "models/empty.yml": "", "target/models/skipped.yml": "models: [", "models/long.yml": "models: []\n" + "# x\n" * 400, "models/a.sql": "select 1",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "models/latin.yml").write_bytes("models: [{name: é}]".encode("latin-1"))
    return tmp_path


def test_settings_files_are_read_in_partitions(spark, folder, monkeypatch):
    found = settings.project_settings(spark, str(folder), 1200)
    rows = found.collect()
    by = {(r.entity, r.name): r for r in rows}
    order = by["model", "orders"]
    assert order.settings == {"materialized": "incremental", "unique_key": "id,day", "full_refresh": "true", "partition_by": "day"} and order["items"] == ["id", "day"] and order.owners == ["team-a"]
    assert by["source", "raw"]["items"] == ["t1", "t2"] and by["exposure", "board"]["items"] == ["ref('orders')"] and by["exposure", "board"].owners == ["Ann", "b", "c"]
    assert {(r.path, r.problem) for r in rows if r.entity == "reject"} == {("bad/dbt_project.yml", "project"), ("sub/dbt_project.yml", "ambiguous"), ("models/broken.yaml", "yaml"), ("models/long.yml", "oversize"), ("models/latin.yml", "unreadable")}
    assert sum(r.entity == "model" for r in rows) == 1
    assert {(r.path, r.rule) for r in settings.settings_findings(found).collect()} == {("bad/dbt_project.yml", "R025"), ("sub/dbt_project.yml", "R025"), ("models/broken.yaml", "R024"), ("models/long.yml", "R026"), ("models/latin.yml", "R026")}


def test_folders_inherit_and_override(spark, folder):
    got = {r.folder: r.settings for r in settings.folder_settings(settings.project_settings(spark, str(folder))).where("project = ''").collect()}
    assert got == {"": {"materialized": "view"}, "staging": {"materialized": "table"}, "staging/raw": {"materialized": "table", "cluster_by": "a,b"}, "marts": {"materialized": "view", "on_schema_change": "append"}}


def test_both_ways_to_read_settings_agree(spark, folder):
    files, _ = readers.project_files(spark, str(folder))
    yaml = files.where("kind = 'dbt_yaml' and path not like '%latin%'")
    shown = lambda df: sorted((r.entity, r.name or "", str(sorted(r.settings.items())), str(r["items"]), r.problem or "") for r in df.collect())
    assert shown(settings.settings_of(yaml)) == shown(settings.project_settings(spark, str(folder)).where("problem is null or problem <> 'unreadable'"))
    assert settings.settings_of(yaml.limit(0)).count() == 0
    none = spark.createDataFrame([("models/x.yml", None)], "path string, text string")
    assert settings.settings_of(none).count() == 0


def test_an_empty_folder_has_no_settings(spark, tmp_path):
    assert settings.project_settings(spark, str(tmp_path)).count() == 0


MANIFEST = {
    "nodes": {
        "model.p.a": {"resource_type": "model", "name": "a", "package_name": "p", "fqn": ["p", "a"], "path": "a.sql", "config": {"materialized": "table", "unique_key": "id", "cluster_by": ["x", "y"], "full_refresh": False, "group": "g"}, "compiled_code": "  ", "compiled_sql": "select 2", "refs": [["p", "b"], ["c"], []], "sources": [["raw", "t"], ["raw"]], "columns": {"z": {}, "id": {"n": 1}}, "depends_on": {"nodes": ["model.p.b"], "macros": ["macro.p.m"]}, "tags": ["t"], "checksum": {"name": "sha256", "checksum": "ab"}},
        "model.p.b": {"resource_type": "model", "original_file_path": "models/b.sql", "path": "b.sql", "config": None},
        "test.p.t": {"resource_type": "test", "name": "t", "depends_on": {"nodes": ["model.p.a"]}},
    },
    "macros": {"macro.p.m": {"name": "m", "original_file_path": "macros/m.sql", "depends_on": {"macros": ["macro.p.n"]}}, "macro.p.n": {}},
    "exposures": {"e1": {"name": "board", "depends_on": {"nodes": ["model.p.a"]}, "owner": {"email": "o@x"}}, "e2": {"label": "nameless"}},
    "sources": {"s1": {"source_name": "raw", "name": "t"}, "s2": {"name": "only"}},
}


def test_a_manifest_gives_five_relations_and_rejects(spark, tmp_path):
    for name, text in {"m.json": json.dumps(MANIFEST), "big.json": json.dumps({"nodes": {}, "x": "y" * 9000}), "broken.json": "{\"nodes\": {", "list.json": "[1]", "bare.json": "{}"}.items():
        (tmp_path / name).write_text(text)
    texts, large = manifests.manifest_texts(spark, str(tmp_path), 8000)
    objects, broken = manifests.manifest_objects(texts)
    assert [r.path.rsplit("/", 1)[-1] for r in large.collect()] == ["big.json"] and sorted(r.path.rsplit("/", 1)[-1] for r in broken.collect()) == ["broken.json", "list.json"]
    a, b = manifests.models(objects).orderBy("model_id").collect()
    assert (a.name, a.package, a.file, a.materialized, a.unique_key, a.cluster_by, a.full_refresh, a.group, a.compiled_code, a.refs, a.source_refs, a["columns"], a.tags, a.checksum, a.fqn) == ("a", "p", "a.sql", "table", "id", "x,y", False, "g", None, ["b", "c"], ["raw.t"], ["id", "z"], ["t"], "ab", ["p", "a"])
    assert (b.name, b.file, b.materialized, b.refs, b.tags) == ("model.p.b", "models/b.sql", None, None, [])
    assert {tuple(r)[1:] for r in manifests.edges(objects).collect()} == {("model.p.a", "model.p.b", "node"), ("model.p.a", "macro.p.m", "macro"), ("macro.p.m", "macro.p.n", "macro")}
    assert {tuple(r)[1:] for r in manifests.macros(objects).collect()} == {("macro.p.m", "m", "macros/m.sql"), ("macro.p.n", "macro.p.n", None)}
    assert {tuple(r)[1:] for r in manifests.sources(objects).collect()} == {("raw", "t"), ("only", "only")}
    assert [tuple(r)[1:] for r in manifests.exposures(objects).collect()] == [("board", ["model.p.a"], "o@x")]


FINDING = "finding_id string, rule string, path string"


def test_a_merge_touches_its_buckets_only_and_repeats_without_effect(spark, tmp_path):
    at, some = str(tmp_path / "b"), lambda *ids: spark.createDataFrame([(i, "R1", f"p\\{i}") for i in ids], FINDING)
    baselines.write_baseline(some(*[f"f{k}" for k in range(300)]), at, "bigquery")
    stamp = lambda: {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "b").glob("bucket=*/*.parquet")}
    before = stamp()
    for _ in range(2):
        baselines.merge_baseline(spark.createDataFrame([("f7", "R0", "a"), ("g1", "R2", "q"), ("g1", "R3", "b"), ("", "R", "x"), (None, "R", "x")], FINDING), at, "bigquery")
        after = stamp()
        assert 1 <= sum(before.get(k) != v for k, v in after.items()) <= 2 and before.keys() <= after.keys()
    got = {r.finding_id: (r.rule, r.path) for r in baselines.read_baseline(spark, at, "bigquery").collect()}
    assert len(got) == 301 and got["f7"] == ("R0", "a") and got["g1"] == ("R3", "b") and got["f8"] == ("R1", "p/f8")
    baselines.write_baseline(some("only"), at, "bigquery")
    assert [r.finding_id for r in baselines.read_baseline(spark, at).collect()] == ["only"]
    with pytest.raises(Exception, match="platform"):
        baselines.read_baseline(spark, at, "trino").collect()


@pytest.mark.parametrize("ranges", [1, 7])
def test_running_sums_do_not_depend_on_ranges(spark, ranges):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice(["x", "y", None]) if k % 3 == 0 else f"p{k:04}", rng.choice([None, rng.randrange(50)])) for k in range(600)]
    df = spark.createDataFrame(rows, "folder string, path string, bytes long").withColumn("place", F.lit(1)).drop("place")
    got = ordered.running(df, "folder", ["path"], F.col("bytes"), ranges).collect()
    by = defaultdict(list)
    for r in got:
        by[r.folder].append(r)
    assert Counter((r.folder, r.path, r.bytes) for r in got) == Counter(rows)
    for folder, held in by.items():
        held.sort(key=lambda r: r.place)
        assert [r.place for r in held] == list(range(1, len(held) + 1)) and {r.size for r in held} == {len(held)}
        assert [r.path or "" for r in held] == sorted(p or "" for f, p, _ in rows if f == folder)
        total = 0
        for r in held:
            total += r.bytes or 0
            assert r.so_far == total
    assert ordered.running(df.limit(0), "folder", ["path"]).count() == 0


def test_upper_medians_match_a_sort(spark):
    rng = random.Random(7)
    rows = [(g, rng.choice([None, float(rng.randrange(9)), rng.random()])) for g in ["hot"] * 200 + ["a"] * 5 + ["b"] * 2 + ["none"] for _ in range(1)] + [("none", None)]
    want = {}
    for g in {g for g, _ in rows}:
        held = sorted(v for h, v in rows if h == g and v is not None)
        if held:
            want[g] = held[len(held) // 2]
    got = ordered.upper_medians(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()
    assert {r.g: r.v for r in got} == want and len(got) == len(want)


def test_ratings_with_abstentions_and_ties(spark):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, None), ("b", 2, None), ("c", 1, "x"), ("c", 2, "y"), ("d", 1, "x"), ("d", 2, None), ("e", 1, "p"), ("e", 2, "q")]
    items = evaluation.rated_items(spark.createDataFrame(rows, "item string, rater int, label string"))
    assert {r.item: (r.raters, r.abstained, r.labels, r.disagreement and round(r.disagreement, 4)) for r in items.collect()} == {"a": (3, 0, 2, 0.3333), "b": (2, 2, 0, None), "c": (2, 0, 2, 0.5), "d": (2, 1, 1, 0.0), "e": (2, 0, 2, 0.5)}
    assert [round(x, 4) for x in evaluation.rating_rates(items).first()] == [5, 0.2727, 0.2, 0.6]
    assert [r.item for r in evaluation.most_disputed(items, 2).collect()] == ["c", "e"]
    assert evaluation.most_disputed(items.limit(0), 2).count() == 0 and costs.sibling_runs.__doc__
