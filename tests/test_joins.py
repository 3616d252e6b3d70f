"""Templates, scopes, join keys, blocks and the rules over them, on hand-made texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import joins as jn
from tallyforge.functions import templates as tp
from tallyforge.functions import texts as tx
from tallyforge.operators import joins, rules


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


def test_every_offset_of_stripped_text_maps_into_its_source(spark):
    rng = random.Random(1)
    pieces = ["select a ", "{{ ref('orders') }}", "{% if x %}", "\n", "{{x}}", "from t", "{% endif %}", "{{ source('raw', 'ev') }}", "é漢 ", "{{ ref('p', \"q\") }}"]
    for named in (False, True):
        for _ in range(12):
            text = "".join(rng.choices(pieces, k=rng.randint(0, 12)))
            want, source = [], []
            for m in re.finditer(r"(?s)\{\{.*?\}\}|\{%.*?%\}|.", text):
                found = m.group()
                name = re.match(r"\{\{ (?:ref|source)\((.*)\) \}\}", found)
                parts = re.findall(r"['\"](\w+)['\"]", name[1]) if name else []
                put = found if len(found) == 1 else " " if found[1] == "%" else f" {parts[-1] if 'ref' in found else '.'.join(parts)} " if name and named else " __jinja__ "
                want.append(put)
                source += [m.start() if len(found) == 1 else min(m.start() + i, m.end() - 1) for i in range(len(put))]
            row = spark.createDataFrame([(text,)], "t string").select(tp.stripped(F.col("t"), named).alias("s")).select("s.text", F.transform(F.sequence(F.lit(0), F.greatest(F.length("s.text") - 1, F.lit(0))), lambda i: tp.source_offset(F.col("s.breaks"), i)).alias("o")).first()
            assert row.text == "".join(want) and (not source or row.o == source)


def test_unclosed_templates_and_nothing(spark):
    assert one(spark, "a {{ b", tp.stripped(F.col("t"))).text == "a {{ b"
    assert one(spark, "", tp.stripped(F.col("t"))).text == "" and one(spark, None, tp.stripped(F.col("t"))).text is None
    assert not one(spark, None, jn.joins(jn.scopes(jn.shape(F.col("t"))["text"])))


@pytest.mark.parametrize(
    "predicate,hidden",
    [
        ("lower(a.k) = b.code", True), ("a.code = upper(trim(b.k))", True), ("date(a.ts) = b.ref", True), ("coalesce(a.k, 0) = b.j", False), ("lower(a.k) = b.k", False), ("trim(a.k) = trim(b.j)", False), ("sha256(a.k) = sha256(b.j)", False),
        ("date_trunc('day', a.ts) = b.day", False), ("a.x::date = b.day", False), ("cast(a.k as int) = b.j", False), ("cast(lower(a.k) as text) = b.j", True), ("lower('x') = a.k", False), ("a.k = b.j", False), ("a.k >= lower(b.j)", False), ("a.i = b.i and (lower(a.k) = b.code)", True),
    ],
)
def test_functions_that_hide_a_key(spark, predicate, hidden):
    found = one(spark, f"select 1 from t a join u b on {predicate} where lower(a.z) = 1", jn.joins(jn.scopes(jn.shape(F.col("t"))["text"])))
    assert [j.hidden for j in found] == [hidden]


def test_joins_of_nested_scopes_resolve_their_own_aliases(spark):
    text = "with c as (select a.id from t a join u b on a.id = b.id) select * from (select * from c a left join (v) on 1 = 1) x right outer join w a using (id, k) cross join z"
    found = one(spark, text, jn.joins(jn.scopes(jn.shape(F.col("t"))["text"])))
    assert sorted((j.kind, j.relation, tuple(j.keys)) for j in found) == [("cross", "z", ()), ("inner", "u", ("id",)), ("left", "", ()), ("right", "w", ("id", "k"))]
    inner = next(j for j in found if j.relation == "u")
    assert [(p.left.relation, p.right.relation) for p in inner.pairs] == [("t", "u")] and text[inner.start :].startswith("join u b")


def test_scopes_of_long_and_deep_texts(spark):
    deep = "select 1 from t"
    for k in range(5):
        deep = f"select 1 from ({deep} where f(g(x)) = {k}) q{k} join u{k} on q{k}.id = u{k}.id"
    assert len(one(spark, deep, jn.joins(jn.scopes(jn.shape(F.col("t"))["text"])))) == 5
    long = "select " + ", ".join(f"coalesce(c{i}, 'x (select') as c{i}" for i in range(4000)) + " from t a join u b on a.id = b.id"
    assert [j.keys for j in one(spark, long, jn.joins(jn.scopes(jn.shape(F.col("t"))["text"])))] == [["id"]]


def test_incremental_blocks_count_levels(spark):
    text = "{% if x %} a {% endif %} {%- if is_incremental() -%} b {% if y %} c {% else %} d {% endif %} e {%- endif -%} f"
    assert one(spark, text, tx.incremental_block(F.col("t"))) == " b {% if y %} c {% else %} d {% endif %} e "
    for bare in ("{% if is_incremental() %} never closed", "{% if x %} a {% endif %}", ""):
        assert one(spark, bare, tx.incremental_block(F.col("t"))) == ""


def _rows(spark, *texts, path="models/core/a.sql"):
    return rules.features(spark.createDataFrame([(f"m{i}", path, t) for i, t in enumerate(texts)], "model_id string, path string, text string"))


@pytest.mark.parametrize(
    "rule,path,triggers,exempt",
    [
        ("R010", "a.py", ["d.iterrows()", "d . itertuples ()", "d.apply(lambda r: f(r, (1)), axis=1)", "d.apply(f, axis='columns')"], ["d.apply(f)", "d.apply(f, axis=0)", "# d.iterrows", "apply(axis=1)"]),
        ("R022", "a.py", ["d.collect()", "d.toPandas()", "c.fetchmany(5)", "d.to_dict('x')"], ["collect()", "d.collect_set()", "d.to_dictionary()", "'d.collect()'"]),
        ("R030", "m/a.sql", ["select 1 from t a where exists (select 1 from u b where b.i = a.i)", "select (select max(v) from u where u.k = a.k) from t a", "select 1 from t where id in (select x.id from u x where x.k = t.k)"], ["select 1 from t a where a.i in (select b.i from u b where b.j = b.k)", "select 1 from (select u.i from s.u) q", "select 1 from t a where exists (select 1 from u a where a.i = 1)", "select 1 from t a -- (select a.i)"]),
        ("R032", "m/a.sql", ["select 1 from t where event_date = 1 or block_date = 2", "select 1 from t where (a.updated_at > 1 or b.created_at > 2)", "select 1 from t where x = 1 and\nevent_date = 1 or event_date = 2"], ["select 1 from t where event_date = 1 and block_date = 2", "select 1 from t where event_date = 1 or x = 2", "select event_date or block_date from t", "select 1 from t where a = 1 group by event_date or block_date"]),
        ("R009", "m/a.sql", ["select lower(trim(a)), LOWER(trim(a)) from t"], ["select lower(trim(a)), upper(trim(a)) from t"]),
        ("R002", "m/a.sql", ["select json_value(a, '$.x'), parse_json( A ) from t"], ["select json_value(a, '$.x'), json_value(b, '$.x') from t"]),
    ],
)
def test_triggers_and_exemptions(spark, rule, path, triggers, exempt):
    hit = {r.model_id for r in rules.findings(_rows(spark, *triggers, *exempt, path=path)).where(F.col("rule") == rule).collect()}
    assert hit == {f"m{i}" for i in range(len(triggers))}


def test_places_are_those_of_the_source(spark):
    text = "{{ config(a='b') }}\n{% set x = 1 %} select 1 from {{ ref('very_long_name') }} a\n join {{ ref('y') }} b on lower(a.k) = b.code\n cross join {{z}} c"
    found = {r.rule: r for r in rules.located(_rows(spark, text)).collect()}
    lines = text.split("\n")
    assert lines[found["R017"].line - 1][found["R017"].col - 1 :].startswith("join {{ ref('y')") and lines[found["R012"].line - 1][found["R012"].col - 1 :].startswith("cross join") and found["R012"].message == "cross join" and found["R012"].span == 10


def test_fan_out_tries_the_relation_and_then_every_reference(spark):
    rows = _rows(spark, "select 1 from {{ ref('A') }} a join {{ ref('B') }} b on a.x = b.id", "select 1 from {{ ref('A') }} a cross join {{ ref('B') }} b", "select 1 from t join b using (id, day)", "select 1 from {{ ref('c') }} c join {{ ref('B') }} b on c.id = b.id")
    keyed = spark.createDataFrame([("a", ["aid"]), ("b", ["id"]), ("c", []), ("d", None)], "name string, unique_key array<string>")
    assert [(r.model_id, r.joined, r.missing, r.line, r.col) for r in joins.fan_out(rows, keyed).collect()] == [("m0", "a", ["aid"], 1, 32)]
    assert joins.fan_out(rows, keyed, every_ref=False).count() == 0 and joins.fan_out(rows.limit(0), keyed).count() == 0
    wide = spark.createDataFrame([("b", ["id", "day"]), ("b", ["id", "day"])], "name string, unique_key array<string>")
    assert sorted((r.model_id, tuple(r.missing)) for r in joins.fan_out(rows, wide).collect()) == [("m0", ("day",)), ("m3", ("day",))]


def test_keys_pass_along_single_parents_only(spark):
    models = spark.createDataFrame([(1, ["k"], True), (2, None, True), (3, [], True), (4, None, False), (5, None, True), (6, ["z"], True), (7, None, True), (8, None, True)], "model_id long, unique_key array<string>, passes boolean")
    edges = spark.createDataFrame([(2, 1), (2, 1), (3, 2), (4, 3), (5, 4), (6, 1), (7, 1), (7, 6), (8, 8)], "child long, parent long")
    got = {r.model_id: r.unique_key for r in joins.propagated_keys(models, edges).collect()}
    assert got == {1: ["k"], 2: ["k"], 3: ["k"], 6: ["z"]}


@pytest.mark.parametrize(
    "text,want",
    [
        ("{{ config(materialized='table', tags=['a', \"b\"], full_refresh=true) }}", {"materialized": "table", "tags": "a,b", "full_refresh": "true"}),
        ("{{ config( unique_key = \"id\",\n  x=1.5 ) }} {{ config(unique_key='later') }}", {"unique_key": "later", "x": "1.5"}),
        ("{{ config(a=var('x', 'y'), b='k, c=1', d={'e': 1}) }} -- config(z=1)", {"b": "k, c=1"}), ("select config from t", {}), ("", {}),
    ],
)
def test_inline_settings(spark, text, want):
    assert one(spark, text, tx.config_values(F.col("t"))) == want


def test_dollars_for_reading(spark):
    values = [0.0, 0.004, 7.4, 949.0, 1049.0, 1234.0, 9949.0, 12_345.0, 999_999.0, 1_499_999.0, 2_500_000.0, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(tx.shown_usd(F.col("v"))).collect()]
    assert got == ["$0", "$0", "$7", "$950", "$1.0k", "$1.2k", "$9.9k", "$12k", "$1M", "$2M", "$2M", None]
