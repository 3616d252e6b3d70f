"""Projects, lineage, observations and findings derived from the standard tables, in SQL that both engines accept.

`{name}` stands for a table or another derived relation. In Spark each becomes a DataFrame argument of spark.sql; for
DuckDB the same text becomes a chain of common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

#: SQL texts of one model each, by template number: a trigger or an exemption of a rule, with comment and literal decoys.
TEMPLATES = (
    "select * from {{ ref('up_@') }} where id > 1",
    "select id, name from {{ ref('up_@') }} -- select * from nowhere",
    "select json_extract(props, '$.a') a, json_extract(props, '$.b') b from {{ source('raw', 'ev_@') }}",
    "select parse_json(props) a from {{ ref('up_@') }}",
    "select regexp_extract(a, 'x') x, regexp_replace(b, 'y', 'z') y from {{ ref('up_@') }}",
    "select a, b from {{ ref('up_@') }} order by a",
    "select a, b from {{ ref('up_@') }} order by a limit 10",
    "select distinct a, b from {{ ref('up_@') }}",
    "select distinct a, count(*) n from {{ ref('up_@') }} group by a",
    "select lower(trim(email)) e, upper(trim(email)) f from {{ ref('up_@') }} where lower(trim(email)) is not null",
    "select a.id from {{ ref('up_@') }} a cross join {{ ref('other_@') }} b",
    "select a.id from {{ ref('up_@') }} a cross join date_spine d",
    "select id, row_number() over (order by ts) rn from {{ ref('up_@') }}",
    "select id, row_number() over (partition by k order by ts) rn from {{ ref('up_@') }}",
    "with c as (select 1 x) select a.x from c a join c b on a.x = b.x join c d on d.x = a.x",
    "select id from {{ ref('up_@') }} union select id from {{ ref('other_@') }}",
    "select id from {{ ref('up_@') }} union all select id from {{ ref('other_@') }}",
    "select count(distinct user_id) n from {{ ref('up_@') }}",
    "select count(distinct user_id) n, count(distinct k) m from {{ ref('up_@') }} group by k",
    "select id from {{ ref('up_@') }} where date(event_date) = '2024-01-01'",
    "select id from {{ ref('up_@') }} where event_date >= '2024-01-01'",
    "select id from {{ ref('up_@') }} where name like '%abc'",
    "select id from {{ ref('up_@') }} where name like 'abc%'",
    "select id from {{ ref('up_@') }} where id not in (select id from {{ ref('other_@') }})",
    "select a.id, (select max(b.v) from {{ ref('other_@') }} b) mx from {{ ref('up_@') }} a",
    "select distinct t.id from {{ ref('up_@') }} t cross join unnest(t.items) u",
    "with recursive r as (select 1 n union all select n + 1 from r) select n from r",
    "select sum(v) over (partition by k order by ts rows between unbounded preceding and unbounded following) s from {{ ref('up_@') }}",
    "{{ config(materialized='incremental') }} select id, ts from {{ source('raw', 'ev_@') }} {% if is_incremental() %} where id > 5 {% endif %}",
    "{{ config(materialized='incremental', unique_key='id') }} select id from {{ ref('up_@') }} {% if is_incremental() %} where updated_at > '2024-01-01' {% endif %}",
    "{{ config(materialized='incremental', unique_key='id', full_refresh=true) }} select id from {{ ref('up_@') }}",
    "select a.id from {{ ref('up_@') }} a join {{ ref('other_@') }} b on lower(a.k) = b.code",
    "select a.id from {{ ref('up_@') }} a join {{ ref('other_@') }} b on a.name like b.pattern",
    "select 'select * from x' as t, id from {{ ref('up_@') }} /* order by a */",
    "-- costcheck: disable-file=R001\nselect * from {{ ref('up_@') }}",
    "select id,\n  name\nfrom `proj.events_*`\nwhere 1 = 1",
    "SELECT  ID,\n  Name\nFROM {{ ref('up_@') }}\nORDER   BY Name",
    "select a.id from cat1.s.t a join cat2.s.u b on a.id = b.id",
)

#: More texts of one file each: (end of the path, text); the rules they meet are in plans.project.
MORE_TEMPLATES = (
    (".sql", "select a.id from t_@ a join u_@ b on a.ts > b.ts"),
    (".sql", "select a.id from t_@ a left join u_@ b on a.id = b.id"),
    (".sql", "select a.id from t_@ a join u_@ b using (id)"),
    (".sql", "select a.id from t_@ a, u_@ b where a.id > 1"),
    (".sql", "select a.id from t_@ a, date_spine d"),
    (".sql", "with c as (select 1 as x) select c.x from c union all select c.x from c union all select c.x from c"),
    (".sql", "with base as (select 1 as x) select x from base"),
    (".sql", "select a.id from t_@ a where exists (select 1 from u_@ b where b.id = a.id)"),
    (".sql", "select id from t_@ where event_date = 1 or block_date = 2"),
    (".sql", "select id from t_@ where event_date = 1 and block_date = 2"),
    (".sql", "select a.id from c1.s.t a join c2.s.u b on a.id = b.id"),
    (".sql", "select a.id from c1.s.t a join c1.s.u b on a.id = b.id"),
    (".sql", "{{ config(materialized='incremental', incremental_strategy='merge', unique_key='id') }} select id from {{ ref('p', 't_@') }}"),
    (".sql", "{{ config(materialized='incremental', incremental_strategy='merge', unique_key='id', incremental_predicates=['x']) }} select id from t_@"),
    (".sql", "{{ config(materialized='incremental', incremental_strategy='append') }} select id from {{ source('raw', 't_@') }} -- {{ ref('no') }}"),
    (".sql", "{{ config(materialized='incremental', unique_key='id', on_schema_change='sync_all_columns') }} select id from t_@"),
    (".py", "def model(dbt, s): return dbt.ref('a').apply(f, axis=1)"),
    (".py", "def model(dbt, s): return dbt.ref('a').to_pandas().head()"),
    (".py", "rows = 'select * from t'"),
    (".sql", "-- q: disable-next-line=R006, R012\nselect a.id from t_@ a, u_@ b\njoin v on a.x > v.x -- q: disable=R006"),
    (".sql", "{{ config(materialized='incremental', unique_key='id') }} with s as (select id from {{ source('raw', 't_@') }}), f as (select id from s) select id from f {% if is_incremental() %} where updated_at > 1 {% endif %}"),
    (".sql", "{{ config(materialized='incremental', unique_key='id') }} with s as (select id from {{ source('raw', 't_@') }} where updated_at > 1), f as (select id from s) select id from f {% if is_incremental() %} where updated_at > 1 {% endif %}"),
    (".sql", "{{ config(materialized='incremental', unique_key='id') }} select id from {{ source('raw', 't_@') }} where updated_at > 1"),
    (".sql", "{{ config(materialized='incremental', unique_key='id') }} select id, updated_at from t_@ {% if is_incremental() %} where id > 5 {% endif %}"),
    (".sql", "{{ config(materialized='incremental', unique_key='id') }} select id from t_@ {% if is_incremental() %} {% if var('x') %} where a > 1 {% endif %} and event_date > 1 {% endif %}"),
    (".py", "for i, row in df.iterrows(): use(row)"),
    (".py", "rows = [f(r) for r in df.itertuples()]"),
    (".py", "df.apply(lambda r: f(r), axis = 1)"),
    (".py", "df.apply(f).apply(g, axis=0)"),
    (".py", "iterrows = 1"),
    (".py", "rows = cursor.fetchall()"),
    (".py", "rows = df.collect()"),
    (".py", "df.select(collect_list('x'), to_dict)"),
    (".sql", "select a.id, (select max(b.v) from u_@ b where b.k = a.k) m from t_@ a"),
    (".sql", "select a.id from t_@ a where a.id in (select b.id from u_@ b)"),
    (".sql", "select q.id from (select b.id from u_@ b where b.v = b.w) q"),
    (".sql", "select a.id from t_@ a where not exists (select 1 from u_@ b join w c on c.id = b.id where b.id = a.id)"),
    (".sql", "select id from t_@ where updated_at > 1 and (created_at = 2 or event_date = 3)"),
    (".sql", "select id from t_@ where status = 1 or event_date = 2"),
    (".sql", "{{ config(x=1) }}\n{% set a = 1 %}\nselect a.id from {{ ref('t_@') }} a\n  cross join {{ ref('u_@') }} b"),
    (".sql", "{% if x %} select 1 {% else %}\nselect {{ col }}, a.id from t_@ a join u_@ b on lower(a.k) = b.code {% endif %}"),
)

#: Texts of one model with joins each.
KEY_TEMPLATES = tuple(
    (".sql", text)
    for text in (
        "select a.id from {{ ref('orders_@') }} a join {{ ref('lines_@') }} b on a.id = b.order_id",
        "select a.id from t a left join u b on a.id = b.id and a.day = b.day where a.x = b.y",
        "select a.id from t a join u b using (id, day)",
        "select a.id from t a join u b on lower(a.k) = b.code",
        "select a.id from t a join u b on lower(a.k) = lower(b.j)",
        "select a.id from t a join u b on cast(a.k as text) = cast(b.j as text)",
        "select a.id from t a join u b on date_trunc('day', a.ts) = b.day",
        "select a.id from t a join u b on coalesce(b.k, b.k) = a.k",
        "select a.id from t a join u b on a.k = coalesce(b.j, 'x')",
        "select a.id from t a join u b on trim(a.k) = b.k",
        "select a.id from t a join u b on md5(a.k) = md5(b.j)",
        "select a.id from t a join u b on a.k::date = b.day",
        "select a.id from t a join u b on to_char(a.ts) = b.code",
        "select a.id from t a join u b on a.id = b.id and upper(b.code) = a.k",
        "select a.id from t a join u b on a.id = b.id or a.k = b.k",
        "select a.id from t a join u b on a.ts > b.ts",
        "with c as (select x.id from t x join u y on (x.id = y.id)) select c.id from c full outer join v on v.id = c.id",
        "select a.id from t a join u b on date(a.ts) = b.code",
        "select a.id from t a join (select z.id from s z join u w on w.id = z.id and w.day = z.day) q on q.id = a.id",
    )
)


def _numbered(prefix: str, folder: str, templates: tuple[tuple[str, str], ...]) -> str:
    """A file for each part, its text one of the templates by number."""
    quoted = lambda t: t.replace("'", "''").replace("\n", "' || chr(10) || '").replace("{", "{{").replace("}", "}}")
    arms = " ".join(f"WHEN {k} THEN '{quoted(t)}'" for k, (_, t) in enumerate(templates))
    ends = " ".join(f"WHEN {k} THEN '{e}'" for k, (e, _) in enumerate(templates))
    own, k = f"p_partkey % {len(templates)}", "cast(p_partkey AS varchar(20))"
    return f"SELECT p_partkey AS k, concat('{prefix}', {k}) AS model_id, {own} AS template, concat('models/{folder}/{prefix}', {k}, CASE {own} {ends} END) AS path, replace(CASE {own} {arms} END, '@', {k}) AS text FROM {{part}}"


def _sql_files() -> str:
    arms = " ".join(f"WHEN {k} THEN '{t.replace(chr(39), chr(39) * 2)}'" for k, t in enumerate(TEMPLATES))
    return f"SELECT model_id, path, template, replace(CASE template {arms} END, '@', cast(k AS varchar(20))) AS text FROM {{d_models}}".replace("{{ ", "{{{{ ").replace(" }}", " }}}}").replace("{%", "{{%").replace("%}", "%}}")


DERIVED: dict[str, str] = {
    "d_models": f"""
SELECT p_partkey AS k, concat('m', cast(p_partkey AS varchar(20))) AS model_id, concat('model_', cast(p_partkey AS varchar(20))) AS name, p_partkey % {len(TEMPLATES)} AS template,
  CASE p_partkey % 4 WHEN 0 THEN concat('models/staging/stg_', cast(p_partkey AS varchar(20)), '.sql') WHEN 1 THEN concat('models/intermediate/int_', cast(p_partkey AS varchar(20)), '.sql')
    WHEN 2 THEN concat('models/marts/fct_', cast(p_partkey AS varchar(20)), '.sql') ELSE concat('models/core/dim_', cast(p_partkey AS varchar(20)), '.sql') END AS path,
  CASE p_size % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'table' WHEN 2 THEN 'incremental' ELSE 'ephemeral' END AS materialized,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'id' END AS unique_key, CASE WHEN p_partkey % 5 = 0 THEN 'event_date' END AS partition_by, CASE WHEN p_partkey % 7 = 0 THEN 'k' END AS cluster_by,
  CASE p_size % 5 WHEN 0 THEN 1e9 WHEN 1 THEN 5e11 WHEN 2 THEN 5e12 ELSE 5e10 END AS prior_bytes
FROM {{part}}""",
    "d_files": _sql_files(),
    "d_edges": """
SELECT p_partkey AS child, cast(floor(p_partkey / 2) AS bigint) AS parent FROM {part} WHERE p_partkey > 0
UNION SELECT p_partkey AS child, cast(floor(p_partkey / 3) AS bigint) AS parent FROM {part} WHERE p_partkey > 0 AND p_partkey % 5 = 0""",
    "d_obs": """
SELECT concat('m', cast(l_partkey AS varchar(20))) AS model_id, cast(l_shipdate AS timestamp) AS window_start, cast(l_shipdate AS timestamp) + INTERVAL '1' DAY AS window_end, cast(l_quantity AS bigint) AS executions,
  CASE WHEN l_partkey % 4 IN (0, 1, 2) THEN l_extendedprice * 1000000 END AS bytes_processed, CASE WHEN l_partkey % 4 IN (0, 1) THEN l_discount * 10 END AS credits, CASE WHEN l_partkey % 4 = 0 THEN l_tax * 100 END AS cost_usd
FROM {lineitem}""",
    "d_history": "SELECT model_id, k * 1000000.0 + 5000.0 AS bytes_per_run, cast(k % 60 + 1 AS double) AS runs_per_month FROM {d_models} WHERE k % 11 = 3",
    "d_catalog": "SELECT model_id, CASE WHEN k % 2 = 0 THEN k * 7000000.0 + 1000.0 END AS num_bytes, k * 31.0 + 10.0 AS row_count FROM {d_models} WHERE k % 6 = 1",
    "d_findings": """
SELECT side, concat('f', cast(id AS varchar(20))) AS finding_id, max(severity) AS severity, max(confidence) AS confidence, max(savings) AS savings, max(rule) AS rule, max(path) AS path, max(line) AS line
FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'base' ELSE 'head' END AS side, o_custkey AS id, cast(substr(o_orderpriority, 1, 1) AS int) AS severity, cast(o_orderkey % 3 AS int) AS confidence, floor(o_totalprice) / 100 AS savings,
        concat('R', lpad(cast(o_custkey % 44 + 1 AS varchar(20)), 3, '0')) AS rule,
        concat(CASE o_custkey % 3 WHEN 0 THEN 'models/staging/stg_' WHEN 1 THEN 'models/marts/fct_' ELSE 'models/core/dim_' END, cast(o_custkey AS varchar(20)), '.sql') AS path, cast(o_custkey % 90 + 1 AS int) AS line
      FROM {orders}) x GROUP BY side, id""",
    "d_raw_findings": """
SELECT concat('R', lpad(cast(o_custkey % 44 + 1 AS varchar(20)), 3, '0')) AS rule, concat('models/p', cast(o_custkey % 200 AS varchar(20)), '.sql') AS path, concat('e', cast(o_custkey % 17 AS varchar(20))) AS evidence,
  cast(o_orderkey % 3 AS int) AS confidence, cast(o_orderkey % 2 AS int) AS provenance, cast(floor(o_totalprice) AS bigint) % 400 AS span, cast(o_orderkey % 120 + 1 AS int) AS line, cast(o_orderkey % 40 AS int) AS col, o_orderkey AS seq
FROM {orders}""",
    "d_owner_rules": "SELECT cast(n_nationkey AS int) AS ord, concat('%_', cast(n_nationkey * 4 % 10 AS varchar(20)), '%.sql') AS pattern, concat('@team-', lower(n_name)) AS owner FROM {nation}",
    "d_waivers": "SELECT cast(n_nationkey AS int) AS ord, concat('models/%', cast(n_nationkey AS varchar(20)), '.sql') AS pattern, CASE WHEN n_nationkey % 2 = 0 THEN concat('R', lpad(cast(n_nationkey + 1 AS varchar(20)), 3, '0')) END AS rule, n_nationkey % 3 <> 0 AS active FROM {nation}",
    "d_more_files": _numbered("n", "staging", MORE_TEMPLATES),
    "d_key_files": _numbered("j", "base", KEY_TEMPLATES),
    "d_unique_keys": """
SELECT concat('lines_', cast(p_partkey AS varchar(20))) AS name, CASE p_partkey % 3 WHEN 0 THEN 'order_id' WHEN 1 THEN 'order_id,day' END AS unique_key FROM {part}
UNION ALL SELECT CASE n_nationkey WHEN 0 THEN 'u' ELSE 'v' END AS name, CASE n_nationkey WHEN 0 THEN 'id,day' ELSE 'id' END AS unique_key FROM {nation} WHERE n_nationkey < 2""",
    "d_changed": """
SELECT DISTINCT cast(substr(h.finding_id, 2) AS bigint) AS k FROM (SELECT * FROM {d_findings} WHERE side = 'head') h LEFT JOIN (SELECT * FROM {d_findings} WHERE side = 'base') b ON b.finding_id = h.finding_id
WHERE b.finding_id IS NULL OR h.severity > b.severity OR h.savings > b.savings""",
    "d_eval": """
SELECT l.doc_id, d.source AS rule, d.lang AS severity, coalesce(l.quality, 0) AS y_true, CASE WHEN d.n_chars > 800 THEN 1 ELSE 0 END AS y_pred, d.n_chars AS score, coalesce(l.toxic, 0) AS rater
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "d_exposures": "SELECT s_suppkey AS exposure, s_suppkey * 13 % 997 AS depends_on FROM {supplier} UNION SELECT s_suppkey AS exposure, s_suppkey * 29 % 1499 AS depends_on FROM {supplier}",
    "d_refs": "SELECT k AS file, concat('model_', cast(k * 7 % 2500 AS varchar(20))) AS ref FROM {d_models} UNION ALL SELECT k AS file, concat('model_', cast(k % 40 AS varchar(20))) AS ref FROM {d_models} WHERE k % 2 = 0",
}


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)))


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder or a derived relation, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = DERIVED[name]
    return spark.sql(text, **{n: derive(spark, sf_dir, n) for n in _names(text)})


#: Rows of a task that works on derived texts.
DEALT_ROWS = 10_000


def dealt(rows: DataFrame, key: str, counted: DataFrame | None = None) -> DataFrame:
    """rows over all cores, and over more tasks the more there are: they come from few small files, but judging them is work.

    key: a column whose values differ, by which rows are dealt without a sort. counted: what has as many rows and is counted sooner.
    """
    n = (rows if counted is None else counted).count()
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // DEALT_ROWS)), key)


def oracle(text: str) -> str:
    """DuckDB's form of a query over derived relations that it names in braces."""
    needed: list[str] = []

    def need(body: str) -> None:
        for n in _names(body):
            if n in DERIVED and n not in needed:
                need(DERIVED[n])
                needed.append(n)

    need(text)
    plain = lambda t: re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", t).replace("{{", "{").replace("}}", "}")
    own = plain(text).strip()
    if not needed:
        return own
    ctes = ",\n".join(f"{n} AS ({plain(DERIVED[n])})" for n in needed)
    return f"WITH {ctes},\n{own[5:]}" if own[:5].upper() == "WITH " else f"WITH {ctes}\n{own}"
