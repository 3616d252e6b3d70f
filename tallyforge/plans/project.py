"""Registered queries over findings, settings, lineage and evaluation, beside those of `catalog`."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tallyforge.functions import lognormal as ln
from tallyforge.functions import sqltext as st
from tallyforge.functions import texts as tx
from tallyforge.functions.globs import glob_regex
from tallyforge.operators import attribution, baselines, enforcement, evaluation, governance, joins, lineage, rules, snapshot, validation
from tallyforge.operators import costs as cost_ops
from tallyforge.plans import catalog
from tallyforge.plans.derive import dealt
from tallyforge.plans.registered import ORACLES, QUERIES, query, r4, recursive
from tallyforge.sources import exports, manifests, settings
from tallyforge.sources.scratch import scratch, written

__all__ = ["ORACLES", "QUERIES"]


def _values(rows, names: str) -> str:
    one = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({names}))"


# ---- rules

#: Rules that the further texts meet, by template number.
TRUTH = {0: ["R006"], 3: ["R012"], 5: ["R014"], 7: ["R030"], 8: ["R032"], 12: ["R043"], 15: ["R029"], 16: ["R010"], 17: ["R022"], 19: ["R006", "R012"]}
TRUTH |= {20: ["R019"], 23: ["R005"], 25: ["R010"], 26: ["R010"], 27: ["R010"], 30: ["R022"], 31: ["R022"], 33: ["R030"], 36: ["R030"], 37: ["R032"], 39: ["R012"]}
TRUTH_TRINO = {k: v for k, v in TRUTH.items() if k != 12} | {10: ["R035"]}
_more_sql = lambda truth: f"SELECT model_id, rule FROM {{d_more_files}} JOIN {_values([(t, r) for t, rs in truth.items() for r in rs], 'template, rule')} v USING (template)"


@query("more_rule_findings", "d_more_files", sql=_more_sql(TRUTH))
def _(files):
    return rules.findings(rules.features(dealt(files, "model_id")), "snowflake").select("model_id", "rule")


@query("more_rule_findings_trino", "d_more_files", sql=_more_sql(TRUTH_TRINO))
def _(files):
    return rules.findings(rules.features(dealt(files, "model_id")), "trino").select("model_id", "rule")


#: How each located finding begins in the lower-case text, by rule; rules that are not here concern whole files.
NEEDLES = {
    "R001": "select *", "R002": "json_extract(", "R003": "regexp_extract(", "R007": "order", "R008": "select distinct", "R009": "lower(trim(", "R012": "cross join", "R013": "over (", "R016": "where date(", "R017": "join ", "R018": "union",
    "R020": "count(distinct", "R031": "like ''%", "R033": "on a.name like", "R034": ", (select", "R036": "unnest(", "R037": "not in (select", "R041": "unbounded preceding and", "R044": "with recursive",
}


@query("located_findings", "d_files", "d_models", sql=f"""WITH {catalog.FOUND}, needles AS (SELECT * FROM (VALUES {', '.join(f"('{r}', '{n}')" for r, n in NEEDLES.items())}) AS v(rule, needle)),
parts AS (SELECT model_id, f.rule, f.severity, text, needle, string_split(lower(text), needle) AS p FROM found f LEFT JOIN needles n ON n.rule = f.rule),
places AS (SELECT *, unnest(CASE WHEN needle IS NULL OR rule IN ('R002', 'R003', 'R009') THEN [1] ELSE range(1, len(p)) END) AS k FROM parts),
heads AS (SELECT *, CASE WHEN needle IS NOT NULL THEN left(text, cast(list_sum(list_transform(p[1:k], lambda x: len(x))) AS bigint) + (k - 1) * len(needle)) END AS head FROM places)
SELECT model_id, rule, severity, len(string_split(head, chr(10))) AS line, len(string_split(head, chr(10))[-1]) + 1 AS col FROM heads""")  # fmt: skip
def _(files, models):
    return rules.located(catalog._feature_rows(files, models), "bigquery").select("model_id", "rule", "severity", "line", "col")


#: What the occurrence that a located finding points at reads like, where it is more than its needle.
READS = NEEDLES | {"R007": "order by", "R016": "where date(event_date", "R017": "lower(a.k) = b.code", "R041": "unbounded preceding and unbounded following"}
_ids = lambda of: f"""'sem-v1:occurrence:' || sha256('key=' || coalesce({of}, '') || '|n=' || k)"""


@query("finding_ids", "d_files", "d_models", sql=f"""WITH {catalog.FOUND}, reads AS (SELECT * FROM (VALUES {', '.join(f"('{r}', '{NEEDLES[r]}', '{t}')" for r, t in READS.items())}) AS v(rule, needle, said)),
parts AS (SELECT model_id, path, f.rule, f.severity, said, len(string_split(lower(text), needle)) AS n FROM found f LEFT JOIN reads r ON r.rule = f.rule),
places AS (SELECT *, unnest(CASE WHEN said IS NULL OR rule IN ('R002', 'R003', 'R009') THEN [1] ELSE range(1, n) END) AS k FROM parts)
SELECT model_id, rule, severity, {_ids('said')} AS evidence, 'cgf_' || sha256(rule || '|' || path || '|' || {_ids('said')}) AS finding_id FROM places""")
def _(files, models):
    return rules.located(catalog._feature_rows(files, models), "bigquery").select("model_id", "rule", "severity", "evidence", "finding_id")


@query("places_behind_templates", "d_more_files", sql=f"SELECT model_id, rule, line, col FROM {{d_more_files}} JOIN {_values([(39, 'R012', 4, 3), (20, 'R019', 1, 88), (36, 'R030', 1, None), (33, 'R030', 1, 14)], 'template, rule, line, c')} v USING (template), LATERAL (SELECT coalesce(c, 40 + len(cast(k AS varchar))) AS col)")
def _(files):
    places = rules.located(rules.features(dealt(files.where("template in (39, 20, 36, 33)"), "model_id")), "snowflake", only=("R012", "R019", "R030"))
    return places.select("model_id", "rule", "line", "col")


# ---- joins

_PAIRS = [(0, "orders_@", "id", "lines_@", "order_id"), (1, "t", "id", "u", "id"), (1, "t", "day", "u", "day"), (2, None, "id", "u", "id"), (2, None, "day", "u", "day"), (13, "t", "id", "u", "id"), (16, "t", "id", "u", "id"), (16, "v", "id", "c", "id"), (18, "u", "id", "s", "id"), (18, "u", "day", "s", "day"), (18, "(query)", "id", "t", "id")]


@query("join_keys", "d_key_files", sql=f"SELECT model_id, replace(l, '@', cast(k AS varchar)) AS left_relation, lk AS left_key, replace(r, '@', cast(k AS varchar)) AS right_relation, rk AS right_key FROM {{d_key_files}} JOIN {_values(_PAIRS, 'template, l, lk, r, rk')} v USING (template)")
def _(files):
    return joins.join_keys(rules.features(dealt(files, "model_id"))).select("model_id", "left_relation", "left_key", "right_relation", "right_key")


@query("hidden_join_keys", "d_key_files", sql="SELECT model_id FROM {d_key_files} WHERE template IN (3, 12, 13, 17)")
def _(files):
    return rules.findings(rules.features(dealt(files, "model_id")), only=("R017",)).select("model_id")


def _keyed(names):
    return names.select("name", F.split("unique_key", ",").alias("unique_key"))


@query("fan_out_joins", "d_key_files", "d_unique_keys", sql=f"""SELECT model_id, 'R038' AS rule, CASE WHEN template = 0 THEN 'lines_' || k ELSE r END AS joined, CASE WHEN template = 0 THEN 'day' ELSE missing END AS missing
FROM {{d_key_files}} JOIN {_values([(0, 'lines', 'day'), (3, 'u', 'id,day'), (4, 'u', 'id,day'), (5, 'u', 'id,day'), (6, 'u', 'id'), (7, 'u', 'id,day'), (8, 'u', 'id,day'), (9, 'u', 'id,day'), (10, 'u', 'id,day'), (11, 'u', 'id'), (12, 'u', 'id,day'), (13, 'u', 'day'), (14, 'u', 'id,day'), (16, 'u', 'day'), (17, 'u', 'id,day')], 'template, r, missing')} v USING (template) WHERE template <> 0 OR k % 3 = 1""")
def _(files, names):
    found = joins.fan_out(rules.features(dealt(files, "model_id")), _keyed(names))
    return found.select("model_id", "rule", "joined", F.concat_ws(",", "missing").alias("missing"))


@recursive("propagated_keys", "d_models", "d_edges", sql="""WITH one AS (SELECT child, min(parent) AS parent FROM {d_edges} GROUP BY child HAVING count(*) = 1),
keyed AS (SELECT k, 'key_' || k AS key FROM {d_models} WHERE unique_key IS NOT NULL UNION SELECT m.k, keyed.key FROM keyed JOIN one ON one.parent = keyed.k JOIN {d_models} m ON m.k = one.child AND m.unique_key IS NULL AND m.materialized = 'view')
SELECT k AS model_id, key FROM keyed""")
def _(models, edges):
    own = models.select(F.col("k").alias("model_id"), F.when(F.col("unique_key").isNotNull(), F.array(F.concat(F.lit("key_"), F.col("k").cast("string")))).alias("unique_key"), (F.col("materialized") == "view").alias("passes"))
    return joins.propagated_keys(own, edges).select("model_id", F.concat_ws(",", "unique_key").alias("key"))


@query("line_suppressions", "d_more_files", sql="SELECT model_id, rule, 2 AS line FROM {d_more_files} JOIN (SELECT * FROM (VALUES ('R006'), ('R012')) AS v(rule)) v ON template = 19 UNION ALL SELECT model_id, 'R006', 3 FROM {d_more_files} WHERE template = 19")
def _(files):
    return files.select("model_id", F.explode(tx.suppressions(F.col("text"))).alias("s")).select("model_id", "s.rule", "s.line")


@query("refs_sources", "d_more_files", sql="""SELECT model_id, 'ref' AS kind, 'p' AS package, 't_' || k AS name FROM {d_more_files} WHERE template = 12 UNION ALL SELECT model_id, 'source', 'raw', 't_' || k FROM {d_more_files} WHERE template = 14
UNION ALL SELECT model_id, 'ref', NULL, 'a' FROM {d_more_files} WHERE template IN (16, 17) UNION ALL SELECT model_id, 'source', 'raw', 't_' || k FROM {d_more_files} WHERE template IN (20, 21, 22)
UNION ALL SELECT model_id, 'ref', NULL, unnest(['t_' || k, 'u_' || k]) FROM {d_more_files} WHERE template = 39""")
def _(files):
    return files.select("model_id", F.explode(tx.references(F.col("text"))).alias("r")).select("model_id", "r.kind", "r.package", "r.name")


def _sealed(files):
    k = F.substring("model_id", 2, 20).cast("long")
    return files.select("path", F.when(k % 9 == 4, F.lit("x")).otherwise(F.sha2("text", 256)).alias("checksum"), (k % 9).alias("d")).where("d <> 5").drop("d")


@query("metadata_findings", "d_files", sql="""WITH f AS (SELECT path, cast(substr(model_id, 2) AS bigint) AS k FROM {d_files}) SELECT path, 'R026' AS rule, 'low' AS severity FROM f WHERE k % 10 = 3
UNION ALL SELECT path, 'R046', 'low' FROM f WHERE k % 9 = 4 UNION ALL SELECT path, 'R045', 'info' FROM f WHERE k % 12 = 1""")
def _(files):
    k = F.substring("model_id", 2, 20).cast("long")
    rows = files.withColumn("size", F.when(k % 10 == 3, F.lit(6 << 20)).otherwise(F.length("text"))).withColumn("modified", F.when(k % 12 == 1, F.lit("2024-02-02")).otherwise(F.lit("2024-01-01")).cast("timestamp"))
    return rules.metadata_findings(rows, _sealed(files), "2024-01-15")


@query("checksum_counts", "d_files", sql="WITH f AS (SELECT cast(substr(model_id, 2) AS bigint) % 9 AS d FROM {d_files}) SELECT count(*) FILTER (d NOT IN (4, 5)) AS same, count(*) FILTER (d = 4) AS other, count(*) FILTER (d = 5) AS unknown FROM f")
def _(files):
    return rules.checksum_counts(files, _sealed(files))


@query("text_helpers", "part", sql="""SELECT p_partkey, cast(p_partkey AS double) * 1e9 AS bytes, CASE WHEN p_partkey >= 1000 THEN printf('%.1fTB', p_partkey / 1000.0) WHEN p_partkey >= 1 THEN p_partkey || 'GB' ELSE '0MB' END AS shown,
p_partkey % 3 = 0 AS equality, p_partkey % 2 = 0 AS sliced, 'a/b' || p_partkey AS posix, 'k' || p_partkey AS json_key FROM part""")
def _(part):
    k = F.col("p_partkey")
    number = tx.parsed_bytes(F.concat(k.cast("string"), F.lit(" gb")))
    predicate = F.when(k % 3 == 0, "a.x = b.y").when(k % 3 == 1, "a.x >= b.y").otherwise("a.x != b.y")
    name = F.when(k % 2 == 0, "x_block_time").otherwise("block_times")
    return part.select("p_partkey", number.alias("bytes"), tx.shown_bytes(number).alias("shown"), tx.has_equality(predicate).alias("equality"), tx.is_partition_column(name, st.BOUND_COLUMNS).alias("sliced"), tx.posix_path(F.concat(F.lit("a\\b"), k.cast("string"))).alias("posix"), tx.json_key(F.concat(F.lit("JSON_VALUE( K"), k.cast("string"), F.lit(" , '$.a')"))).alias("json_key"))


# ---- what findings cost

MULT = _values([(r, float(a), float(b), attribution.WAREHOUSE["bigquery"].get(r, 1.0)) for r, (a, b) in attribution.MULTIPLIERS.items()], "rule, lo, hi, f")


@query("rule_multipliers", "d_raw_findings", sql=f"SELECT DISTINCT f.rule, round(sqrt(lo * hi) * f, 6) AS median, round(CASE WHEN f = 1 THEN (ln(hi) - ln(lo)) / (2 * 1.2815515655446004) ELSE sqrt(power((ln(hi) - ln(lo)) / (2 * 1.2815515655446004), 2) + ln(1.0001)) END, 6) AS sigma FROM {{d_raw_findings}} f LEFT JOIN {MULT} m ON m.rule = f.rule")
def _(raw):
    m = raw.select("rule").distinct().withColumn("m", attribution.multiplier(F.col("rule"), "bigquery"))
    return m.select("rule", F.round(F.exp("m.mu"), 6).alias("median"), F.round("m.sigma", 6).alias("sigma"))


@query("scan_priors", "d_models", sql="""SELECT model_id, round((CASE WHEN partition_by IS NOT NULL THEN 0.5 WHEN cluster_by IS NOT NULL THEN 0.7 ELSE 1 END) * (CASE WHEN materialized = 'view' THEN 0.5 ELSE 1 END), 6) AS scan,
CASE WHEN materialized = 'incremental' AND unique_key IS NOT NULL THEN 0.05 ELSE 1.0 END AS discount, 1.0 AS discount_r005 FROM {d_models}""")
def _(models):
    rows = models.withColumn("full_refresh", F.lit(False))
    return rows.select("model_id", F.round(attribution.scan_factor("bigquery"), 6).alias("scan"), attribution.incremental_factor().alias("discount"), attribution.incremental_factor(F.lit("R005")).alias("discount_r005"))


_FAN = f"{catalog.CLOSURE}, fan AS (SELECT seed, least(count(*), 15) AS n FROM closure WHERE seed <> node GROUP BY seed), ex AS (SELECT depends_on, count(*) AS e FROM {{d_exposures}} GROUP BY depends_on)"
_SAVED = f"""raw AS (SELECT f.model_id, f.rule, f.severity, ln(sqrt(lo * hi) * m.f) AS lm, exp(c.mu - CASE WHEN c.is_observed THEN 0 ELSE ln(dd) END) AS whole,
  exp(c.mu - CASE WHEN c.is_observed THEN 0 ELSE ln(dd) END) * least(0.95, 1 - 1 / greatest(1.001, sqrt(lo * hi) * m.f)) * s AS usd, v.bytes * v.runs / dd / 1e9 * least(0.95, 1 - 1 / greatest(1.001, sqrt(lo * hi) * m.f)) * s AS gb
  FROM (SELECT found.model_id, found.rule, found.severity, (CASE found.rule WHEN 'R012' THEN CASE WHEN n_cross_join >= 2 THEN 1.25 WHEN n_cross_join = 0 THEN 0.75 ELSE 1 END WHEN 'R006' THEN least(1.5, 1 + 0.05 * n_join) WHEN 'R001' THEN 1.15 WHEN 'R013' THEN CASE WHEN n_window > 1 THEN 1.2 ELSE 1 END WHEN 'R014' THEN 1.2 ELSE 1 END)
    * least(2.0, 1 + 0.25 * log2(1 + coalesce(fan.n, 0))) * least(1.5, 1 + 0.05 * coalesce(ex.e, 0)) AS s FROM found JOIN feat USING (model_id) LEFT JOIN fan ON 'm' || fan.seed = found.model_id LEFT JOIN ex ON 'm' || ex.depends_on = found.model_id) f
  JOIN {MULT} m ON m.rule = f.rule JOIN cost c ON c.model_id = f.model_id JOIN (SELECT * FROM volume) v ON v.model_id = f.model_id, LATERAL (SELECT CASE WHEN f.rule IN {attribution.UNBOUNDED_RULES} THEN v.discount ELSE 1.0 END AS dd)),
capped AS (SELECT *, sum(usd) OVER w AS total, greatest(0.001, max(whole) OVER w - max(whole) OVER w / least(20.0, greatest(1.001, exp(sum(lm) OVER w)))) AS most FROM raw WINDOW w AS (PARTITION BY model_id)),
saved AS (SELECT model_id, rule, severity, usd * CASE WHEN total > most THEN most / total ELSE 1 END AS usd, gb * CASE WHEN total > most THEN most / total ELSE 1 END AS gb FROM capped)"""
_SAVING_INPUTS = ("d_files", "d_models", "d_obs", "d_history", "d_catalog", "d_edges", "d_exposures")


def _savings(files, models, obs, history, catalogs, edges, exposures):
    seen = cost_ops.observe_monthly(obs)
    volume = cost_ops.volumes(models, seen, history, catalogs, warehouse="bigquery")
    price = cost_ops.cost_index(volume, keep=("bytes", "runs", "discount")).withColumn("scan_bytes", F.col("bytes") * F.col("runs")).drop("bytes", "runs", "grade")
    own = rules.findings(catalog._feature_rows(files, models), "bigquery", ("n_cross_join", "n_join", "n_select_star", "n_window", "cte_reuse"))
    found = own.select("model_id", "path", "rule", "severity", attribution.structure_factor(F.col("rule")).alias("structure"))
    below = lineage.downstream_counts(edges, 15).select(F.concat(F.lit("m"), F.col("seed").cast("string")).alias("model_id"), F.col("n").alias("downstream"))
    shown = attribution.exposure_counts(exposures).select(F.concat(F.lit("m"), F.col("model_id").cast("string")).alias("model_id"), "exposures")
    return attribution.capped(attribution.attributed(found, price, below.join(shown, "model_id", "full_outer"), "bigquery"), "bigquery")


@recursive("finding_savings", *_SAVING_INPUTS, sql=f"WITH {catalog.OBS}, {catalog.VOLUME}, {catalog.COST}, {catalog.FOUND}, {_FAN}, {_SAVED} SELECT model_id, rule, round(usd, 4) AS usd, round(gb, 4) AS gb FROM saved")
def _(*frames):
    return _savings(*frames).select("model_id", "rule", F.round("savings_usd", 4).alias("usd"), F.round("gb_months", 4).alias("gb"))


@recursive("savings_totals", *_SAVING_INPUTS, sql=f"WITH {catalog.OBS}, {catalog.VOLUME}, {catalog.COST}, {catalog.FOUND}, {_FAN}, {_SAVED} SELECT count(*) AS findings, count(*) FILTER (severity = 'high') AS high, round(sum(usd), 2) AS usd, round(sum(usd) * 12) AS usd_year, round(sum(gb), 2) AS gb_months FROM saved")
def _(*frames):
    return attribution.totals(_savings(*frames)).select("findings", "high", F.round("usd", 2).alias("usd"), "usd_year", F.round("gb_months", 2).alias("gb_months"))


@recursive("downstream_cost", "d_edges", "d_models", "d_obs", "d_history", "d_catalog", sql=f"""WITH {catalog.OBS}, {catalog.VOLUME}, {catalog.COST}, {catalog.CLOSURE}
SELECT seed, count(*) AS downstream, round(sum(exp(mu + sigma * sigma / 2)), 2) AS usd FROM closure LEFT JOIN cost ON cost.model_id = 'm' || node WHERE seed <> node GROUP BY seed""")
def _(edges, models, obs, history, catalogs):
    price = catalog._costs(models, obs, history, catalogs).select(F.substring("model_id", 2, 20).cast("long").alias("model_id"), "cost")
    return attribution.downstream_cost(lineage.downstream(edges), price).select("seed", "downstream", F.round("usd", 2).alias("usd"))


def _priced(found, side):
    names = F.when(F.col("severity") >= 4, "high").otherwise("low")
    return found.where(F.col("side") == side).select("rule", "path", names.alias("severity"), F.col("savings").alias("savings_usd"), (F.col("savings") / 10).alias("gb_months"))


@query("receipt_trend", "d_findings", sql="""WITH t AS (SELECT side, count(*) AS n, count(*) FILTER (severity >= 4) AS h, sum(savings) AS u FROM {d_findings} GROUP BY side)
SELECT a.n - b.n AS findings, a.h - b.h AS high, round(a.u - b.u, 2) AS usd, round((a.u - b.u) / 10, 2) AS gb_months FROM t a JOIN t b ON a.side = 'head' AND b.side = 'base'""")
def _(found):
    t = attribution.trend(attribution.totals(_priced(found, "base")), attribution.totals(_priced(found, "head")))
    return t.select("findings", "high", F.round("usd", 2).alias("usd"), F.round("gb_months", 2).alias("gb_months"))


@query("lognormal_sum", "d_findings", sql="SELECT path, round(sum(savings * exp(ln(1.25) / 2)), 4) AS median FROM {d_findings} WHERE savings > 0 GROUP BY path")
def _(found):
    return found.where("savings > 0").groupBy("path").agg(ln.summed(ln.from_point(F.col("savings"), 0.5)).alias("e")).select("path", F.round(ln.median(F.col("e")), 4).alias("median"))


# ---- enforcement

_HEAD = f"""{catalog.DELTA}, x AS (SELECT h.*, d.status, d.status IN ('introduced', 'regressed') AS blocks, concat('@o', cast(substr(h.finding_id, 2) AS bigint) % 3) AS owner, severity = 1 AS excepted FROM h JOIN delta d USING (finding_id))"""


def _enforced(found):
    base, head = found.where("side = 'base'"), found.where("side = 'head'")
    k = F.substring("finding_id", 2, 20).cast("long")
    rows = enforcement.blocking(head, governance.delta(base, head))
    return rows.withColumn("owners", F.array(F.concat(F.lit("@o"), (k % 3).cast("string")))).withColumn("tags", F.array().cast("array<string>")).withColumn("excepted", F.col("severity") == 1).withColumn("savings_usd", F.col("savings")).withColumn("gb_months", F.col("savings") / 10)


_SCAN = "('" + "', '".join(attribution.INFRASTRUCTURE) + "')"


@query("blocking_findings", "d_findings", sql=f"WITH {_HEAD} SELECT finding_id, CASE WHEN rule IN {_SCAN} THEN NULL ELSE status END AS delta_status, blocks AND rule NOT IN {_SCAN} AS blocks FROM x")
def _(found):
    return _enforced(found).select("finding_id", "delta_status", "blocks")


FULL_GATES = [
    {"name": "default", "mode": "fail", "fail_on": 5, "min_confidence": 1, "pr_increase": 1e15},
    {"name": "marts", "mode": "warn", "paths": ["models/marts/**"], "monthly_usd": 10.0, "require_owner": True},
    {"name": "core", "mode": "fail", "paths": ["models/{core,none}/*"], "monthly_gb": 1.0, "blast_radius": 3},
    {"name": "two", "mode": "fail", "owners": ["@o2"], "fail_on": 99},
    {"name": "nobody", "mode": "fail", "owners": ["@nobody"], "monthly_usd": 1.0},
]


@recursive("full_gates", "d_findings", "d_changed", "d_models", "d_edges", sql=f"""WITH {_HEAD}, {catalog.CLOSURE}, y AS (SELECT * FROM x WHERE blocks AND NOT excepted AND rule NOT IN {_SCAN}), ch AS (SELECT m.* FROM {{d_models}} m JOIN {{d_changed}} c ON c.k = m.k),
core AS (SELECT count(DISTINCT node) AS n FROM closure JOIN ch ON ch.k = seed WHERE starts_with(ch.path, 'models/core/') AND seed <> node), bare AS (SELECT count(*) AS n FROM ch WHERE starts_with(ch.path, 'models/marts/') AND k % 2 = 0)
SELECT 'default' AS gate, CASE WHEN count(*) FILTER (severity >= 5 AND confidence >= 1) > 0 THEN 'fail' ELSE 'pass' END AS status, count(*) AS matched, CASE WHEN count(*) FILTER (severity >= 5 AND confidence >= 1) > 0 THEN 'severity' ELSE '' END AS reasons FROM y
UNION ALL SELECT 'marts', CASE WHEN coalesce(sum(savings), 0) >= 10 OR (SELECT n FROM bare) > 0 THEN 'warn' ELSE 'pass' END, count(*), concat_ws(',', CASE WHEN coalesce(sum(savings), 0) >= 10 THEN 'monthly-usd' END, CASE WHEN (SELECT n FROM bare) > 0 THEN 'owner' END) FROM y WHERE starts_with(path, 'models/marts/')
UNION ALL SELECT 'core', CASE WHEN coalesce(sum(savings), 0) / 10 >= 1 OR (SELECT n FROM core) >= 3 THEN 'fail' ELSE 'pass' END, count(*), concat_ws(',', CASE WHEN coalesce(sum(savings), 0) / 10 >= 1 THEN 'monthly-gb' END, CASE WHEN (SELECT n FROM core) >= 3 THEN 'blast-radius' END) FROM y WHERE starts_with(path, 'models/core/')
UNION ALL SELECT 'two', 'pass', count(*), '' FROM y WHERE owner = '@o2' UNION ALL SELECT 'nobody', 'pass', 0, ''""")
def _(found, changed, models, edges):
    ch = models.join(changed, "k", "left_semi").select("path", F.col("k").alias("model_id"), F.array().cast("array<string>").alias("tags"), F.when(F.col("k") % 2 == 1, F.array(F.lit("@x"))).otherwise(F.array().cast("array<string>")).alias("owners"))
    out = enforcement.gates(_enforced(found), written(ch, "changed"), None, FULL_GATES, 0.0, True, edges)
    return out.select("gate", "status", "matched", F.concat_ws(",", "reasons").alias("reasons"))


@query("scan_verdict", "d_findings", sql=f"WITH {_HEAD}, y AS (SELECT * FROM x WHERE blocks AND NOT excepted AND rule NOT IN {_SCAN}), g AS (SELECT count(*) FILTER (severity >= 5) > 0 AS s, coalesce(sum(savings), 0) >= 5 AS u FROM y) SELECT s OR u AS fails, concat_ws(',', CASE WHEN s THEN 'severity' END, CASE WHEN u THEN 'usd' END) AS grounds FROM g")
def _(found):
    rows = _enforced(found)
    none = rows.limit(0).select(F.lit("pass").alias("status"))
    return enforcement.verdict(rows, none, fail_on=5, monthly_usd=5.0).select("fails", F.concat_ws(",", "grounds").alias("grounds"))


WAIVERS = [
    {"id": "w1", "path": "models/marts/**", "rule": "R007", "expires_at": "2030-01-01"},
    {"id": "w2", "path": "models/*/dim_?.sql", "expires_at": "2030-01-01"},
    {"id": "w3", "path": "**/stg_*.sql", "rule": "R010", "expires_at": "2020-01-01"},
    {"id": "w4", "path": "**", "finding_id": "f77", "expires_at": "2030-01-01"},
]


@query("expiring_waivers", "d_findings", sql=r"""SELECT side, finding_id, CASE WHEN path LIKE 'models/marts/%' AND rule = 'R007' THEN 'w1' WHEN regexp_full_match(path, 'models/.*/dim_.\.sql') THEN 'w2' WHEN finding_id = 'f77' THEN 'w4' END AS waiver,
contains(path, '/stg_') AND rule = 'R010' AS expired FROM {d_findings}""".replace("{36}", ""))
def _(found):
    return enforcement.excused(found, WAIVERS, "2026-01-01").select("side", "finding_id", "waiver", (F.size("waiver_expired") > 0).alias("expired"))


CODE_OWNERS = [("models/**", "@all"), ("models/marts/*", "@marts"), ("models/*.sql", "@top")]


@query("owner_levels", "d_models", sql="SELECT model_id, CASE WHEN k % 10 = 0 THEN '@own' WHEN path LIKE 'models/core/%' THEN '@core' WHEN path LIKE 'models/marts/%' THEN '@marts' ELSE '@all' END AS owner FROM {d_models}")
def _(models):
    own = F.when(F.col("k") % 10 == 0, "@own")
    return models.select("model_id", enforcement.owners(F.col("path"), own, [("models/core/*", "@core")], CODE_OWNERS, F.lit("@group"), "@default").alias("owner"))


@query("enforcement_outcome", "d_findings", sql="SELECT side, finding_id, CASE WHEN severity = 1 THEN 'excepted' WHEN confidence = 0 THEN 'blocked' WHEN confidence = 1 THEN 'warned' ELSE 'observed' END AS outcome FROM {d_findings}")
def _(found):
    mode = F.when(F.col("confidence") == 0, "block").when(F.col("confidence") == 1, "warn").otherwise("observe")
    return found.select("side", "finding_id", enforcement.outcome(mode, F.col("severity") == 1).alias("outcome"))


@query("custom_rule_findings", "d_models", sql="SELECT model_id, 'C1' AS rule, 'high' AS severity FROM {d_models} WHERE path LIKE '%marts%' AND materialized = 'table' UNION ALL SELECT model_id, 'C2', 'low' FROM {d_models} WHERE unique_key IS NULL OR unique_key <> 'id'")
def _(models):
    custom = [("C1", "high", governance.predicate({"all": [{"glob": ("path", "*marts*")}, {"equals": ("materialized", "table")}]})), ("C2", "low", governance.predicate({"not": {"equals": ("unique_key", "id")}}))]
    return enforcement.custom_findings(models, custom).select("model_id", "rule", "severity")


@query("analysis_violations", "documents", sql="""WITH c AS (SELECT count(*) AS n, count(*) FILTER (n_chars > 2000) AS wide FROM documents) SELECT 'parse_failure_rate' AS code, round(wide / n, 6) AS observed, 0.0 AS allowed FROM c WHERE wide > 0
UNION ALL SELECT 'manifest_stale', 1.0, 0.0 UNION ALL SELECT 'cost_coverage', 0.5, 0.9""")
def _(docs):
    lit = lambda v, n: F.lit(v).alias(n)
    counts = docs.agg(F.count("*").alias("parsed"), F.count_if(F.col("n_chars") > 2000).alias("parse_failures")).select("*", lit(0, "compiled_failures"), lit(0, "skipped_files"), lit(0, "yaml_failures"), lit(0, "project_failures"), lit(False, "metadata_only"), lit(True, "manifest_stale"), lit(10, "models"), lit(5, "models_with_spend"))
    return enforcement.completeness(counts, least_spend=0.9).select("code", F.round("observed", 6).alias("observed"), "allowed")


@query("scope_conflicts", "d_models", sql="SELECT path, 'path' AS kind, 1 AS priority FROM {d_models} WHERE path LIKE 'models/core/%' OR path LIKE 'models/marts/%'")
def _(models):
    spec = [("a", "path", 1, "block", "models/core/*"), ("b", "path", 1, "warn", "models/core/**"), ("c", "path", 2, "warn", "models/core/*"), ("d", "path", 1, "warn", "models/marts/*"), ("e", "path", 1, "warn", "models/**/fct_*"), ("f", "team", 1, "block", "models/core/*")]
    hits = F.array(*[F.when(F.col("path").rlike(glob_regex(p)), F.struct(F.lit(s).alias("scope"), F.lit(k).alias("kind"), F.lit(n).alias("priority"), F.lit(m).alias("mode"))) for s, k, n, m, p in spec])
    scopes = models.select("path", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("s")).select("path", "s.*")
    settings = models.sparkSession.createDataFrame([("d", "R001", "high"), ("e", "R001", "low"), ("a", "R001", "low")], "scope string, rule string, setting string")
    return enforcement.scope_conflicts(scopes, settings).select("path", "kind", "priority")


@query("graph_problems", "d_models", "supplier", sql="SELECT 'm' || p_partkey % 100 AS subject, 'repeated id' AS problem FROM part GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT CAST(s_nationkey AS varchar), 'repeated exposure' FROM supplier GROUP BY 1 HAVING count(*) > 1")
def _(models, supplier):
    rows = models.select(F.concat(F.lit("m"), (F.col("k") % 100).cast("string")).alias("model_id"), "path")
    return validation.graph_problems(rows, supplier.select(F.col("s_nationkey").alias("exposure")))


@query("envelope_problems", "d_models", sql="SELECT path AS subject, 'no sha256' AS problem FROM {d_models} WHERE k % 20 = 3 UNION ALL SELECT path, 'not sealed' FROM {d_models} WHERE k % 20 = 7 UNION ALL SELECT '../' || path, 'path is not relative' FROM {d_models} WHERE k % 50 = 9 UNION ALL SELECT '../' || path, 'no such model' FROM {d_models} WHERE k % 50 = 9")
def _(models):
    k, ok = F.col("k"), F.sha2("path", 256)
    seals = models.where(k % 20 != 7).select("path", F.when(k % 20 == 3, "x").otherwise(ok).alias("sha256")).union(models.where(k % 50 == 9).select(F.concat(F.lit("../"), "path"), ok))
    return validation.envelope_problems(seals, models)


# ---- lineage

@query("reverse_adjacency", "d_edges", sql="SELECT DISTINCT child AS parent, parent AS child FROM {d_edges}")
def _(edges):
    return lineage.reversed_edges(edges)


@query("display_labels", "part", sql="WITH m AS (SELECT p_partkey, 'pkg' || p_size AS package, p_type AS name FROM part) SELECT 'm' || p_partkey AS model_id, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN package || '.' || name ELSE name END AS label FROM m")
def _(part):
    return lineage.display_labels(part.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("model_id"), F.concat(F.lit("pkg"), F.col("p_size").cast("string")).alias("package"), F.col("p_type").alias("name")))


@recursive("macro_impact", "d_edges", "d_changed", "d_models", sql="""WITH changed AS MATERIALIZED (SELECT k FROM {d_changed}), up AS (SELECT k AS node FROM changed UNION SELECT e.parent FROM up JOIN {d_edges} e ON e.child = up.node)
SELECT model_id FROM {d_models} WHERE k * 7 % 500 IN (SELECT node FROM up)""")
def _(edges, changed, models):
    calls = edges.select(F.col("parent").alias("caller"), F.col("child").alias("callee"))
    return lineage.macro_impact(calls, changed, models.select("model_id", (F.col("k") * 7 % 500).alias("macro")))


@query("source_impact", "d_refs", "d_changed", sql="SELECT DISTINCT file AS model_id FROM {d_refs} WHERE file % 700 IN (SELECT k FROM {d_changed})")
def _(refs, changed):
    return lineage.source_impact(refs.select((F.col("file") % 700).alias("file"), F.col("ref").alias("source"), F.col("file").alias("model_id")), changed)


@query("first_by_key", "d_models", "d_history", sql="SELECT m.model_id, coalesce(a.b, c.b) AS value FROM {d_models} m LEFT JOIN (SELECT substr(model_id, 2) AS id, bytes_per_run AS b FROM {d_history}) a ON a.id = cast(m.k AS varchar) LEFT JOIN (SELECT substr(model_id, 2) AS id, bytes_per_run AS b FROM {d_history}) c ON c.id = cast(m.k + 1 AS varchar)")
def _(models, history):
    rows = models.select("model_id", "k", (F.col("k") + 1).alias("next"))
    return lineage.first_by_key(rows, ["k", "next"], history.select(F.substring("model_id", 2, 20).alias("key"), F.col("bytes_per_run").alias("value"))).select("model_id", "value")


@query("folder_settings", "d_models", sql="SELECT path, CASE WHEN path LIKE 'models/marts/%' THEN 'table' WHEN path LIKE 'models/core/%' THEN 'incremental' ELSE 'view' END AS setting FROM {d_models}")
def _(models):
    folders = models.sparkSession.createDataFrame([("models", "view"), ("models/marts", "table"), ("models/core", "incremental"), ("models/mar", "no")], "folder string, setting string")
    return lineage.folder_settings(models, folders)


@query("declared_settings", "d_models", sql="SELECT model_id, coalesce(unique_key, CASE WHEN k % 2 = 0 THEN 'key' END) AS unique_key, coalesce(partition_by, CASE WHEN k % 2 = 0 THEN 'day' END) AS partition_by FROM {d_models}")
def _(models):
    declared = models.where("k % 2 = 0").select("name", F.lit("key").alias("unique_key"), F.lit("day").alias("partition_by"))
    return lineage.filled(models, declared, ["unique_key", "partition_by"]).select("model_id", "unique_key", "partition_by")


@query("unambiguous_paths", "d_files", "d_models", sql="WITH m AS (SELECT replace(path, '7', '8') AS path, model_id FROM {d_models}) SELECT path, min(model_id) AS model_id FROM m WHERE path IN (SELECT path FROM {d_files}) GROUP BY path HAVING count(*) = 1")
def _(files, models):
    return lineage.unambiguous(files, models.select(F.replace("path", F.lit("7"), F.lit("8")).alias("path"), "model_id"))


@query("changed_paths", "d_files", sql="SELECT path, CASE WHEN k % 10 = 1 THEN 'base' WHEN k % 10 = 2 THEN 'head' ELSE 'both' END AS side FROM (SELECT path, cast(substr(model_id, 2) AS bigint) AS k FROM {d_files}) f WHERE k % 10 IN (1, 2, 3)")
def _(files):
    k = F.substring("model_id", 2, 20).cast("long") % 10
    return lineage.changed_paths(files.where(k != 2), files.where(k != 1).withColumn("text", F.when(k == 3, F.concat("text", F.lit(" "))).otherwise(F.col("text"))))


# ---- evaluation

@query("diagnostic_scores", "d_findings", sql="SELECT side, finding_id, CASE WHEN confidence = 0 AND savings > 0 THEN savings ELSE severity * confidence END AS score FROM {d_findings}")
def _(found):
    rows = found.withColumn("current", F.when(F.col("confidence") == 0, F.col("savings"))).withColumn("model", F.lit(0.0))
    return rows.select("side", "finding_id", evaluation.diagnostic_score(["model", "current"], F.col("severity"), F.col("confidence")).alias("score"))


_CENSUS = """labelled AS (SELECT rule, severity, confidence > 0 AS examined, CASE WHEN severity > 2 THEN 'tp' WHEN severity = 2 THEN 'exempt' WHEN savings < 500 THEN 'fp_bug' ELSE 'unknown' END AS label FROM {d_findings}),
census AS (SELECT rule, count(*) AS total, count(*) FILTER (examined) AS examined, count(*) FILTER (examined AND label = 'tp') AS tp, count(*) FILTER (examined AND label = 'exempt') AS exempt, count(*) FILTER (examined AND label = 'fp_bug') AS fp_bug, count(*) FILTER (examined AND label = 'unknown') AS unknown FROM labelled GROUP BY rule),
judged AS (SELECT *, rule IN ('R023', 'R045') OR (fp_bug = 0 AND unknown = 0) AS passes, CASE WHEN rule IN ('R023', 'R045') THEN 'infrastructure' WHEN fp_bug + unknown > 0 THEN 'fail' WHEN examined < total THEN 'sampled_' || examined || '_of_' || total ELSE 'fully_examined' END AS reason FROM census)"""


def _census(found):
    verdict = F.when(F.col("severity") > 2, "tp").when((F.col("severity") == 2) | (F.col("savings") < 500), "fp")
    kind = F.when(F.col("severity") == 2, "exempt").otherwise("bug")
    return evaluation.census(found.select("rule", (F.col("confidence") > 0).alias("examined"), evaluation.adjudicated(verdict, kind).alias("label")), ("R023", "R045"))


@query("rule_census", "d_findings", sql=f"WITH {_CENSUS} SELECT * FROM judged")
def _(found):
    return _census(found)


@query("pooled_precision", "d_findings", sql=f"WITH {_CENSUS}, s AS (SELECT *, CASE WHEN right(rule, 1) < '5' THEN 'high' ELSE 'low' END AS severity FROM judged WHERE passes AND examined > 0) SELECT severity, sum(examined) AS examined, round(sum(tp) / sum(examined), 6) AS precision FROM s GROUP BY GROUPING SETS ((severity), ())")
def _(found):
    rows = _census(found).withColumn("severity", F.when(F.substring("rule", -1, 1) < "5", "high").otherwise("low"))
    return evaluation.pooled_precision(rows).select("severity", "examined", F.round("precision", 6).alias("precision"))


LIMITS = [("R001", "exact", 0), ("R002", "most", 1), ("R003", "most", 10**9), ("R004", "expect", 0), ("R005", "forbid", 0), ("R999", "expect", 0), ("R998", "forbid", 0)]


@query("baseline_violations", "d_findings", sql=f"WITH n AS (SELECT rule, count(*) AS c FROM {{d_findings}} GROUP BY rule), l AS {_values(LIMITS, 'rule, kind, n')} SELECT l.rule, CASE kind WHEN 'exact' THEN 'count differs' WHEN 'most' THEN 'too many' WHEN 'expect' THEN 'missing' ELSE 'forbidden' END AS problem FROM l LEFT JOIN n USING (rule) WHERE (kind = 'exact' AND coalesce(c, 0) <> n) OR (kind = 'most' AND coalesce(c, 0) > n) OR (kind = 'expect' AND c IS NULL) OR (kind = 'forbid' AND c > 0)")
def _(found):
    limits = found.sparkSession.createDataFrame(LIMITS, "rule string, kind string, n long")
    return evaluation.against_baseline(found.groupBy("rule").agg(F.count("*").alias("n")), limits)


@query("scale_growth", "part", "orders", sql="SELECT round((4000.0 / (SELECT count(*) FROM orders)) / (1000.0 / (SELECT count(*) FROM part)), 6) AS growth")
def _(part, orders):
    run = lambda d, ms: d.agg(F.lit(ms).alias("median_ms"), F.count("*").alias("models"))
    return evaluation.growth(run(part, 1000.0), run(orders, 4000.0)).select(F.round("growth", 6).alias("growth"))


#: What failed, by what the message says; the first that matches counts.
FAILURES = [("lexer", r"unterminated|unexpected character"), ("grammar", r"\bexpected\b|unexpected token"), ("unsupported", r"not supported|unsupported")]


@query("parse_failure_groups", "d_more_files", sql="""SELECT * FROM (SELECT CASE k % 4 WHEN 0 THEN 'unexpected token <value> at line #' WHEN 1 THEN 'unterminated string at #:#' WHEN 2 THEN 'expected from, found <value>' ELSE '' END AS signature,
CASE k % 4 WHEN 0 THEN 'grammar' WHEN 1 THEN 'lexer' WHEN 2 THEN 'grammar' ELSE 'other' END AS "group", count(*) AS n, min(path) AS example FROM {d_more_files} GROUP BY ALL) ORDER BY n DESC, signature LIMIT 3""")
def _(files):
    k = F.col("k").cast("string")
    message = F.when(F.col("k") % 4 == 0, F.concat(F.lit("Unexpected token 't"), k, F.lit("' at line "), k)).when(F.col("k") % 4 == 1, F.concat(F.lit("unterminated  string at "), k, F.lit(":7"))).when(F.col("k") % 4 == 2, F.concat(F.lit('Expected FROM, found "'), k, F.lit('"')))
    return evaluation.failure_groups(files.select(message.alias("message"), "path"), FAILURES, 3)


@query("stratified_sample", "d_findings", sql="WITH h AS (SELECT * FROM {d_findings} WHERE side = 'head' AND finding_id NOT IN (SELECT finding_id FROM {d_findings} WHERE side = 'base' AND severity > 3)) SELECT rule, confidence, finding_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY rule, confidence ORDER BY savings DESC, path, finding_id) AS rank FROM h) x WHERE rank <= 2")
def _(found):
    return evaluation.stratified_tail(found.where("side = 'head'"), found.where("side = 'base' AND severity > 3"), 2, ["rule", "confidence"]).select("rule", "confidence", "finding_id", "rank")


@query("merged_labels", "d_eval", sql="SELECT rule, severity, arg_max(y_true, doc_id) AS y_true FROM {d_eval} GROUP BY rule, severity")
def _(rows):
    return evaluation.merged_labels(rows.withColumn("ord", F.col("doc_id")), ["rule", "severity"])


@query("per_class_agreement", "d_eval", sql="SELECT l AS label, count(*) FILTER (y_true = l) AS support, round(count(*) FILTER (y_true = l AND rater = l) / nullif(count(*) FILTER (rater = l), 0), 6) AS precision, round(count(*) FILTER (y_true = l AND rater = l) / nullif(count(*) FILTER (y_true = l), 0), 6) AS recall FROM {d_eval}, (VALUES (0), (1)) AS v(l) GROUP BY l")
def _(rows):
    return evaluation.per_class(rows).select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall")])


_RATINGS = """r AS (SELECT doc_id % 400 AS item, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE v END AS label FROM (SELECT doc_id, y_true AS v FROM {d_eval} UNION ALL SELECT doc_id, y_pred FROM {d_eval} UNION ALL SELECT doc_id, rater FROM {d_eval})),
n AS (SELECT item, label, count(*) AS n FROM r GROUP BY item, label),
i AS (SELECT item, CAST(sum(n) AS BIGINT) AS raters, CAST(coalesce(sum(n) FILTER (label IS NULL), 0) AS BIGINT) AS abstained, count(label) AS labels, 1 - max(n) FILTER (label IS NOT NULL) / sum(n) FILTER (label IS NOT NULL) AS d FROM n GROUP BY item)"""


def _ratings(rows):
    each = rows.select((F.col("doc_id") % 400).alias("item"), "doc_id", F.posexplode(F.array(F.col("y_true").cast("int"), F.col("y_pred").cast("int"), F.col("rater").cast("int"))).alias("rater", "v"))
    return evaluation.rated_items(each.select("item", "rater", F.when(F.col("doc_id") % 7 != 0, F.col("v")).alias("label")))


@query("rating_rates", "d_eval", sql=f"WITH {_RATINGS} SELECT count(*) AS items, round(sum(abstained) / sum(raters), 6) AS abstention, round(count(*) FILTER (labels = 0) / count(*), 6) AS unjudged, round(count(*) FILTER (labels > 1) / count(*), 6) AS disputed FROM i")
def _(rows):
    return evaluation.rating_rates(_ratings(rows)).select("items", *[F.round(c, 6).alias(c) for c in ("abstention", "unjudged", "disputed")])


@query("most_disputed", "d_eval", sql=f"WITH {_RATINGS} SELECT item, raters, abstained, labels, round(d, 6) AS disagreement FROM (SELECT * FROM i WHERE labels > 1 ORDER BY d DESC, raters DESC, item LIMIT 25)")
def _(rows):
    return evaluation.most_disputed(_ratings(rows), 25).withColumn("disagreement", F.round("disagreement", 6))


# ---- settings and manifests

def _settings(part):
    """Entities of a settings file for each part: schema files with columns, sources and exposures, project files, and broken ones."""
    k = F.col("p_partkey")
    n, text = k.cast("string"), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    schema = text("models:\n  - name: m", n, "\n    config: {materialized: table, unique_key: [a, b", n, "]}\n    columns: [{name: id}, {name: c", n, "}]\n  - tags: x\nsources:\n  - name: s", n, "\n    tables: [{name: t1}, {name: t2}]\nexposures:\n  - name: e", n, "\n    depends_on: [r.m", n, "]\n    owner: {email: o@x}\n")
    project = text("name: p", n, "\nmodels:\n  p", n, ":\n    +materialized: view\n    marts:\n      +materialized: table\n      core: {partition_by: {field: day}}\n    staging: {}\n")
    body = F.when(k % 4 == 0, schema).when(k % 4 == 1, project).when(k % 4 == 2, text("models: [", n)).otherwise(text("a:\n  b: ", n))
    return settings.settings_of(dealt(part, "p_partkey").select(F.concat(F.lit("p"), n, F.when(k % 4 == 1, "/dbt_project.yml").otherwise("/schema.yml")).alias("path"), body.alias("text")))


@query("settings_entities", "part", sql="""WITH k AS (SELECT CAST(p_partkey AS varchar) AS n, p_partkey % 4 AS d FROM part) SELECT 'p' || n || '/schema.yml' AS path, 'model' AS entity, 'm' || n AS name, 'table' AS materialized, 'a,b' || n AS unique_key, 'id,c' || n AS items, '' AS owners FROM k WHERE d = 0
UNION ALL SELECT 'p' || n || '/schema.yml', 'source', 's' || n, NULL, NULL, 't1,t2', '' FROM k WHERE d = 0 UNION ALL SELECT 'p' || n || '/schema.yml', 'exposure', 'e' || n, NULL, NULL, 'r.m' || n, 'o@x' FROM k WHERE d = 0""")
def _(part):
    rows = _settings(part).where("entity in ('model', 'source', 'exposure')")
    return rows.select("path", "entity", "name", F.col("settings")["materialized"].alias("materialized"), F.col("settings")["unique_key"].alias("unique_key"), F.concat_ws(",", "items").alias("items"), F.concat_ws(",", "owners").alias("owners"))


@query("folder_inheritance", "part", sql=f"SELECT 'p' || p_partkey AS project, folder, m AS materialized, b AS partition_by FROM part, {_values([('', 'view', None), ('marts', 'table', None), ('marts/core', 'table', 'day'), ('staging', 'view', None)], 'folder, m, b')} WHERE p_partkey % 4 = 1")
def _(part):
    return settings.folder_settings(_settings(part)).select("project", "folder", F.col("settings")["materialized"].alias("materialized"), F.col("settings")["partition_by"].alias("partition_by"))


@query("settings_findings", "part", sql="SELECT 'p' || p_partkey || '/schema.yml' AS path, 'R024' AS rule, 'low' AS severity FROM part WHERE p_partkey % 4 = 2")
def _(part):
    return settings.settings_findings(_settings(part))


def _manifests(models):
    """A manifest for every 50 models, as JSON text."""
    k = F.col("k").cast("string")
    node = F.struct(F.lit("model").alias("resource_type"), F.col("name"), F.struct("materialized", F.array(F.col("unique_key"), F.lit("x")).alias("unique_key")).alias("config"), F.struct(F.array(F.concat(F.lit("model.up"), k)).alias("nodes"), F.array(F.lit("macro.p.a")).alias("macros")).alias("depends_on"), F.array(F.array(F.lit("pkg"), F.concat(F.lit("up"), k))).alias("refs"), F.array(F.array(F.lit("raw"), F.lit("t"))).alias("sources"), F.create_map(F.concat(F.lit("c"), k), F.struct(F.lit(1).alias("a"))).alias("columns"))
    source = F.struct(F.lit("raw").alias("source_name"), F.concat(F.lit("t"), k).alias("name"))
    shown = F.struct(F.concat(F.lit("e"), k).alias("name"), F.struct(F.array(F.concat(F.lit("model."), k)).alias("nodes")).alias("depends_on"), F.struct(F.lit("o@x").alias("email")).alias("owner"))
    members = lambda prefix, value: F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit(prefix), k).alias("k"), value.alias("v"))))
    by = models.groupBy(F.floor(F.col("k") / 50).alias("part")).agg(members("model.", node).alias("nodes"), members("source.", source).alias("sources"), members("exposure.", shown).alias("exposures"))  # 50 models each
    text = F.to_json(F.struct("nodes", "sources", "exposures", F.create_map(F.lit("macro.p.a"), F.struct(F.lit("a").alias("name"), F.lit("macros/a.sql").alias("path"))).alias("macros")))
    return manifests.manifest_objects(by.select(F.concat(F.lit("m"), F.col("part").cast("string")).alias("path"), F.when(F.col("part") % 10 == 9, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text).alias("text")))


_READ = "FROM {d_models} WHERE cast(floor(k / 50) AS bigint) % 10 <> 9"


@query("manifest_models", "d_models", sql=f"SELECT 'm' || cast(floor(k / 50) AS bigint) AS path, 'model.' || k AS model_id, name, materialized, CASE WHEN unique_key IS NULL THEN 'x' ELSE unique_key || ',x' END AS unique_key, 'up' || k AS refs, 'raw.t' AS source_refs, 'c' || k AS columns {_READ}")
def _(models):
    return manifests.models(_manifests(models)[0]).select("path", "model_id", "name", "materialized", "unique_key", *[F.concat_ws("|", c).alias(c) for c in ("refs", "source_refs", "columns")])


@query("manifest_edges", "d_models", sql=f"SELECT 'model.' || k AS child, 'model.up' || k AS parent, 'node' AS kind {_READ} UNION ALL SELECT 'model.' || k, 'macro.p.a', 'macro' {_READ}")
def _(models):
    return manifests.edges(_manifests(models)[0]).select("child", "parent", "kind")


@query("manifest_others", "d_models", sql=f"SELECT 'source' AS kind, 'raw.t' || k AS name, '' AS more {_READ} UNION ALL SELECT 'exposure', 'e' || k, 'model.' || k || '|o@x' {_READ} UNION ALL SELECT DISTINCT 'macro', 'm' || cast(floor(k / 50) AS bigint), 'a|macros/a.sql' {_READ} UNION ALL SELECT DISTINCT 'reject', 'm' || cast(floor(k / 50) AS bigint), 'not a JSON object' {_READ.replace('<> 9', '= 9')}")
def _(models):
    objects, rejects = _manifests(models)
    shape = lambda df, kind, name, more: df.select(F.lit(kind).alias("kind"), name.alias("name"), more.alias("more"))
    out = shape(manifests.sources(objects), "source", F.concat_ws(".", "source", "table_name"), F.lit(""))
    out = out.union(shape(manifests.exposures(objects), "exposure", F.col("exposure"), F.concat_ws("|", F.concat_ws(",", "depends_on"), "owner")))
    return out.union(shape(manifests.macros(objects), "macro", F.col("path"), F.concat_ws("|", "name", "file"))).union(shape(rejects, "reject", F.col("path"), F.col("reason")))


# ---- baselines as a table

@query("baseline_store", "d_findings", sql="SELECT finding_id, min(rule) AS rule, min(path) AS path, 3 AS version, 'semantic-v1' AS identity_scheme, 'bigquery' AS platform FROM {d_findings} GROUP BY finding_id")
def _(found):
    at = scratch(found.sparkSession, "baseline")
    baselines.write_baseline(found.where("side = 'base'"), at, "bigquery")
    for _again in range(2):  # as after a lost job
        baselines.merge_baseline(found.where("side = 'head'"), at, "bigquery")
    return baselines.read_baseline(found.sparkSession, at, "bigquery").select("finding_id", "rule", "path", "version", "identity_scheme", "platform")


# ---- from files to gates

_PLACED = f"""{catalog.FOUND}, reads AS (SELECT * FROM (VALUES {', '.join(f"('{r}', '{NEEDLES[r]}')" for r in READS)}) AS v(rule, needle)),
parts AS (SELECT model_id, path, f.rule, f.severity, needle, len(string_split(lower(text), needle)) AS n, CAST(substr(model_id, 2) AS BIGINT) % 10 AS d FROM found f LEFT JOIN reads r ON r.rule = f.rule),
places AS (SELECT *, path LIKE 'models/core/%' OR d = 4 AS context, unnest(CASE WHEN needle IS NULL OR rule IN ('R002', 'R003', 'R009') THEN [1] ELSE range(1, n) END) AS k FROM parts)"""


def _snapshot(files, models):
    """Base lacks files ending in 1, head those ending in 2; core models and files ending in 4 are context; a sixth is compiled."""
    k = F.substring("model_id", 2, 20).cast("long") % 10
    sides = files.where(k != 1).withColumn("side", F.lit("base")).union(files.where(k != 2).withColumn("side", F.lit("head")))
    only = F.col("path").like("models/core/%") | (k == 4)
    compiled = files.join(models.drop("path", "template"), "model_id").select("path", "model_id", F.explode(F.array(F.lit("base"), F.lit("head"))).alias("side"), F.when(F.col("k") % 6 == 0, F.col("text")).alias("compiled_code"), "materialized", "unique_key", "partition_by", "cluster_by")
    return snapshot.judged(snapshot.assembled(snapshot.united(sides.where(~only), sides), compiled), "bigquery")


@query("snapshot_findings", "d_files", "d_models", sql=f"WITH {_PLACED}, s AS (SELECT *, unnest(CASE d WHEN 1 THEN ['head'] WHEN 2 THEN ['base'] ELSE ['base', 'head'] END) AS side FROM places) SELECT side, NOT context AS is_target, CASE WHEN CAST(substr(model_id, 2) AS BIGINT) % 6 = 0 THEN 'compiled' ELSE 'raw' END AS input, rule, severity, count(*) AS n FROM s GROUP BY ALL")
def _(files, models):
    return _snapshot(files, models).groupBy("side", "is_target", "input", "rule", "severity").agg(F.count("*").alias("n"))


@query("context_warnings", "d_files", "d_models", sql=f"WITH {_PLACED} SELECT path, rule, count(*) AS n FROM places WHERE context AND d <> 2 GROUP BY path, rule")
def _(files, models):
    return snapshot.context_warnings(_snapshot(files, models))


@query("snapshot_delta", "d_files", "d_models", sql=f"WITH {_PLACED} SELECT rule, CASE d WHEN 1 THEN 'introduced' WHEN 2 THEN 'resolved' ELSE 'unchanged' END AS status, count(*) AS n FROM places WHERE NOT context AND rule <> 'R042' GROUP BY ALL")
def _(files, models):
    found = _snapshot(files, models)
    status = snapshot.delta(found, F.col("rule") == "R042").join(found.select("finding_id", "rule").distinct(), "finding_id")
    return status.groupBy("rule", "status").agg(F.count("*").alias("n"))


PROJECT_GATES = [{"name": "all", "mode": "fail", "fail_on": 3}, {"name": "marts", "mode": "warn", "paths": ["models/marts/**"], "fail_on": 2}, {"name": "low", "mode": "fail", "paths": ["models/staging/*"], "fail_on": 4}, {"name": "nowhere", "mode": "fail", "paths": ["none/**"], "fail_on": 0}]
PROJECT_EXCEPTIONS = [{"id": "x1", "path": "models/marts/**", "rule": "R001", "expires_at": "2030-01-01"}, {"id": "x2", "path": "**", "rule": "R007", "expires_at": "2020-01-01"}]


@query("files_to_gates", "d_files", "d_models", sql=f"""WITH {_PLACED}, y AS (SELECT *, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 END AS s FROM places WHERE NOT context AND d = 1 AND NOT (rule = 'R001' AND path LIKE 'models/marts/%'))
SELECT 'all' AS gate, CASE WHEN count(*) FILTER (s >= 3) > 0 THEN 'fail' ELSE 'pass' END AS status, count(*) AS matched FROM y UNION ALL SELECT 'marts', CASE WHEN count(*) FILTER (s >= 2) > 0 THEN 'warn' ELSE 'pass' END, count(*) FROM y WHERE path LIKE 'models/marts/%'
UNION ALL SELECT 'low', 'pass', count(*) FROM y WHERE path LIKE 'models/staging/%' UNION ALL SELECT 'nowhere', 'pass', 0""")
def _(files, models):
    found = _snapshot(files, models)
    head = enforcement.excused(snapshot.targets_only(found).where("side = 'head'"), PROJECT_EXCEPTIONS, "2026-01-01", "exception")
    new = enforcement.blocking(head, snapshot.delta(found)).withColumn("severity", F.col("severity_rank"))
    none, empty = F.lit(None).cast("double"), F.array().cast("array<string>")
    rows = new.withColumns({"excepted": F.col("exception").isNotNull(), "confidence": F.lit(2), "savings_usd": none, "gb_months": none, "tags": empty, "owners": empty})
    changed = models.limit(0).select("path", F.col("k").alias("model_id"), empty.alias("tags"), empty.alias("owners"))
    reach = models.limit(0).select(F.col("k").alias("seed"), F.col("k").alias("node"))
    return enforcement.gates(rows, changed, reach, PROJECT_GATES, None, True).select("gate", "status", "matched")


# ---- exports of costs

def _exported(part):
    """An export row for each part in one of seven formats, and the observations of all."""
    k = F.col("p_partkey")
    n = k.cast("string")
    row = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    texts = {
        "normalized": row('{"schema_version": 1, "observations": [{"model_id": "m', n, '", "window_start": "2024-01-01T00:00:00Z", "window_end": "2024-01-02T02:00:00+02:00", "executions": 3, "bytes_processed": ', n, '}]}'),
        "generic": row('[{"model": "m', n, '", "start": "2024-01-01 00:00:00", "end": "2024-01-02 00:00:00", "query_count": "3", "bytes_billed": "', n, '"}]'),
        "snowflake": row('{"rows": [{"model_id": "no", "query_tag": "m', n, '", "start_time": "2024-01-01", "end_time": "2024-01-02", "count": 3, "bytes_scanned": ', n, ', "bytes_billed": 7}]}'),
        "bigquery": row('{"labels": {"model_id": "m', n, '"}, "job_id": "j", "start_time": "2024-01-01T00:00:00", "end_time": "2024-01-02T00:00:00", "executions": 3, "bytes_processed": ', n, '}'),
        "databricks": row('{"usage_metadata": {"job_name": "m', n, '"}, "usage_start_time": "2024-01-01", "usage_end_time": "2024-01-02", "executions": 3, "bytes_processed": null, "bytes_scanned": ', n, '}'),
        "trino": row('[{"query_id": "m', n, '", "start": "2024-01-01", "end": "2024-01-02", "execution_count": 3, "bytes_scanned": ', n, ', "wall_time_ms": 1500}]'),
        "pipeline": row('[{"asset_key": "m', n, '", "start": "2024-01-01", "end": "2024-01-02", "materialization_count": 3, "bytes_processed": ', n, ', "elapsed_ms": 1500}, {"asset": "late", "start": "2024-01-02", "end": "2024-01-01"}]'),
    }
    found = [(exports.normalized(exports.json_rows(part.where(k % 7 == i).select(text.alias("text")))[0], name), name) for i, (name, text) in enumerate(texts.items())]
    return [(a.withColumn("format", F.lit(name)), b.withColumn("format", F.lit(name))) for (a, b), name in found]


_FORMAT = "CASE p_partkey % 7 WHEN 0 THEN 'normalized' WHEN 1 THEN 'generic' WHEN 2 THEN 'snowflake' WHEN 3 THEN 'bigquery' WHEN 4 THEN 'databricks' WHEN 5 THEN 'trino' ELSE 'pipeline' END"


@query("export_formats", "part", sql=f"SELECT {_FORMAT} AS format, 'm' || p_partkey AS model_id, 1 AS days, 3 AS executions, CASE WHEN p_partkey % 7 <> 4 THEN CAST(p_partkey AS double) END AS bytes_processed, CASE WHEN p_partkey % 7 >= 5 THEN 1.5 END AS compute_seconds FROM part")
def _(part):
    rows = functools.reduce(lambda a, b: a.union(b), [a for a, _ in _exported(part)])
    return rows.select("format", "model_id", F.datediff("window_end", "window_start").alias("days"), "executions", "bytes_processed", "compute_seconds")


@query("export_rejects", "part", sql="SELECT 'pipeline' AS format, 'window ends before it starts' AS problem, count(*) AS n FROM part WHERE p_partkey % 7 = 6")
def _(part):
    rows = functools.reduce(lambda a, b: a.union(b), [b for _, b in _exported(part)])
    return rows.groupBy("format", "problem").agg(F.count("*").alias("n"))


@query("cost_coverage", "d_models", "d_obs", "d_history", "d_catalog", sql=f"""WITH {catalog.OBS}, {catalog.VOLUME}, {catalog.COST}, a AS (SELECT max(a) AS a FROM (SELECT epoch(TIMESTAMP '1999-06-01') / 86400.0 - max(epoch(window_end)) / 86400.0 AS a FROM {{d_obs}} WHERE model_id IN (SELECT model_id FROM {{d_models}}) GROUP BY model_id))
SELECT count(*) AS models, count(*) FILTER (grade = 'A' OR is_observed) AS measured, round(count(*) FILTER (grade = 'A' OR is_observed) / count(*), 6) AS measured_fraction, count(*) AS with_cost, 1.0 AS cost_fraction, round((SELECT a FROM a), 4) AS age_days FROM cost""")
def _(models, obs, history, catalogs):
    found = cost_ops.coverage(catalog._costs(models, obs, history, catalogs), obs, "1999-06-01")
    return found.select("models", "measured", F.round("measured_fraction", 6).alias("measured_fraction"), "with_cost", "cost_fraction", F.round("age_days", 4).alias("age_days"))


@query("inline_settings", "d_more_files", sql="""SELECT model_id, 'incremental' AS materialized, CASE WHEN template IN (12, 13, 15, 20, 21, 22, 23, 24) THEN 'id' END AS unique_key, CASE template WHEN 12 THEN 'merge' WHEN 13 THEN 'merge' WHEN 14 THEN 'append' END AS incremental_strategy,
CASE WHEN template = 13 THEN 'x' END AS incremental_predicates, CASE WHEN template = 15 THEN 'sync_all_columns' END AS on_schema_change FROM {d_more_files} WHERE template IN (12, 13, 14, 15, 20, 21, 22, 23, 24)""")
def _(files):
    set_ = F.filter(F.array(tx.config_values(F.col("text"))), lambda c: c["materialized"].isNotNull())  # a filter on the column would read the settings twice
    found = dealt(files, "model_id").select("model_id", F.explode(set_).alias("c"))
    return found.select("model_id", *[F.col("c")[k].alias(k) for k in ("materialized", "unique_key", "incremental_strategy", "incremental_predicates", "on_schema_change")])


@query("shown_usd", "part", sql="""SELECT p_partkey, CASE WHEN s >= 1e6 THEN '$' || CAST(round_even(s / 1e6, 0) AS BIGINT) || 'M' WHEN s >= 1e4 THEN '$' || CAST(round_even(s / 1e3, 0) AS BIGINT) || 'k' WHEN s >= 1e3 THEN printf('$%.1fk', s / 1e3) ELSE '$' || CAST(round_even(s, 0) AS BIGINT) END AS shown
FROM (SELECT p_partkey, CASE WHEN v = 0 THEN 0 ELSE round(v / m) * m END AS s FROM (SELECT p_partkey, v, power(10, floor(log10(v + CASE WHEN v = 0 THEN 1 ELSE 0 END)) - 1) AS m FROM (SELECT p_partkey, (p_partkey % 1000) * (p_partkey % 1000) * 1.3 AS v FROM part)))""")
def _(part):
    return part.select("p_partkey", tx.shown_usd((F.col("p_partkey") % 1000) * (F.col("p_partkey") % 1000) * 1.3).alias("shown"))
