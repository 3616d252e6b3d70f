"""Registered queries over derived relations, each with an independent DuckDB formulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import lognormal as ln
from tallyforge.functions import sqltext as st
from tallyforge.operators import costs, evaluation, governance, lineage, rules
from tallyforge.plans.derive import dealt
from tallyforge.plans.registered import query, r4, recursive

# ---- costs

OBS = """
obs AS (SELECT model_id, sum(executions) AS ex, sum(bytes_processed) AS b, sum(credits) AS c, sum(cost_usd) AS u,
  greatest((epoch(max(window_end)) - epoch(min(window_start))) / 86400.0 / 30, 1.0 / 30) AS months FROM {d_obs} GROUP BY model_id),
observed AS (SELECT model_id, CASE WHEN u IS NOT NULL THEN 'usd' WHEN c IS NOT NULL THEN 'credits' ELSE 'bytes' END AS basis, ex / months AS me, b / months AS mb,
  CASE WHEN u IS NOT NULL THEN u WHEN c IS NOT NULL THEN c * 3.0 ELSE b * 6.25 / 1e12 END / months AS mu FROM obs WHERE u IS NOT NULL OR c IS NOT NULL OR b IS NOT NULL)"""
VOLUME = """
volume AS (SELECT m.model_id, CASE WHEN mb IS NOT NULL THEN 'observed' WHEN h.model_id IS NOT NULL THEN 'history' WHEN num_bytes IS NOT NULL THEN 'catalog-bytes' WHEN row_count IS NOT NULL THEN 'catalog-rows' ELSE 'prior' END AS basis,
  CASE WHEN mb IS NOT NULL OR h.model_id IS NOT NULL THEN 'A' WHEN c.model_id IS NOT NULL THEN 'B' ELSE 'C' END AS grade,
  CASE WHEN mb IS NOT NULL THEN CASE WHEN me > 0 THEN mb / me ELSE mb END WHEN h.model_id IS NOT NULL THEN bytes_per_run WHEN num_bytes IS NOT NULL THEN num_bytes * sc * dc WHEN row_count IS NOT NULL THEN row_count * 200 * sc * dc ELSE prior_bytes * sc * dc END AS bytes,
  CASE WHEN mb IS NOT NULL THEN greatest(me, 1) WHEN h.model_id IS NOT NULL THEN runs_per_month ELSE 30 END AS runs,
  CASE WHEN mb IS NOT NULL THEN 0.1 WHEN h.model_id IS NOT NULL THEN 0.2 WHEN num_bytes IS NOT NULL THEN 0.25 WHEN row_count IS NOT NULL THEN 0.35 ELSE 0.8 END AS cv, CASE WHEN mb IS NOT NULL OR h.model_id IS NOT NULL THEN 1.0 ELSE dc END AS discount
  FROM (SELECT *, (CASE WHEN partition_by IS NOT NULL THEN 0.5 WHEN cluster_by IS NOT NULL THEN 0.7 ELSE 1 END) * (CASE WHEN materialized = 'view' THEN 0.5 ELSE 1 END) AS sc, CASE WHEN materialized = 'incremental' AND unique_key IS NOT NULL THEN 0.05 ELSE 1.0 END AS dc FROM {d_models}) m LEFT JOIN observed o ON o.model_id = m.model_id LEFT JOIN {d_history} h ON h.model_id = m.model_id LEFT JOIN {d_catalog} c ON c.model_id = m.model_id)"""
COST = """
cost AS (SELECT v.model_id, grade, coalesce(o.mu > 0, false) AS is_observed,
  CASE WHEN o.mu > 0 THEN ln(o.mu) ELSE ln(bytes) + ln(runs) + ln(6.25 / 1e12) END AS mu,
  CASE WHEN o.mu > 0 THEN sqrt(ln(1 + 0.01)) ELSE sqrt(ln(1 + cv * cv) + ln(1 + 0.01) + ln(1 + 0.0025)) END AS sigma
  FROM volume v LEFT JOIN observed o ON o.model_id = v.model_id)"""


@query("obs_monthly", "d_obs", sql=f"WITH {OBS} SELECT model_id, basis, round(me, 4) AS monthly_executions, round(mb, 0) AS monthly_bytes, round(mu, 4) AS monthly_usd FROM observed")
def _(obs):
    return costs.observe_monthly(obs).select("model_id", "basis", *r4("monthly_executions"), F.round("monthly_bytes", 0).alias("monthly_bytes"), *r4("monthly_usd"))


@query("obs_basis_ladder", "d_obs", sql=f"WITH {OBS} SELECT basis, count(*) AS n FROM observed GROUP BY basis")
def _(obs):
    return costs.observe_monthly(obs).groupBy("basis").agg(F.count("*").alias("n"))


@query("volume_ladder", "d_models", "d_obs", "d_history", "d_catalog", sql=f"WITH {OBS}, {VOLUME} SELECT model_id, basis, grade, round(bytes, 0) AS bytes, round(runs, 4) AS runs FROM volume")
def _(models, obs, history, catalog):
    return costs.volumes(models, costs.observe_monthly(obs), history, catalog, warehouse="bigquery").select("model_id", "basis", "grade", F.round("bytes", 0).alias("bytes"), *r4("runs"))


@query("runs_sibling_median", "d_models", "d_obs", sql=f"""WITH {OBS}, s AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, greatest(me, 1) AS runs FROM {{d_models}} m JOIN observed o ON o.model_id = m.model_id),
r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY runs) - 1 AS i, count(*) OVER (PARTITION BY folder) AS n FROM s) SELECT folder, round(runs, 4) AS runs FROM r WHERE i = floor(n / 2)""")  # fmt: skip
def _(models, obs):
    return costs.sibling_runs(models, costs.observe_monthly(obs)).select("folder", *r4("runs"))


def _costs(models, obs, history, catalog):
    seen = costs.observe_monthly(obs)
    return costs.cost_index(costs.volumes(models, seen, history, catalog, warehouse="bigquery"))


@query("model_cost_index", "d_models", "d_obs", "d_history", "d_catalog", sql=f"WITH {OBS}, {VOLUME}, {COST} SELECT model_id, grade, round(exp(mu), 4) AS p50, round(exp(mu + sigma * 1.2815515655446004), 4) AS p90 FROM cost")
def _(*frames):
    return _costs(*frames).select("model_id", "grade", F.round(ln.median(F.col("cost")), 4).alias("p50"), F.round(ln.quantile(F.col("cost"), 0.9), 4).alias("p90"))


@query("top5_models", "d_models", "d_obs", "d_history", "d_catalog", sql=f"WITH {OBS}, {VOLUME}, {COST} SELECT model_id, round(exp(mu), 4) AS usd FROM cost ORDER BY exp(mu) DESC, model_id LIMIT 5")
def _(*frames):
    return costs.top_models(_costs(*frames)).select("model_id", *r4("usd"))


@query("project_summary", "d_models", "d_obs", "d_history", "d_catalog", sql=f"""WITH {OBS}, {VOLUME}, {COST}, s AS (SELECT count(*) AS models, count(*) FILTER (grade = 'A') AS grade_a, count(*) FILTER (grade = 'B') AS grade_b, count(*) FILTER (grade = 'C') AS grade_c, count(*) FILTER (is_observed) AS observed,
sum(exp(mu + sigma * sigma / 2)) AS m, sum((exp(sigma * sigma) - 1) * exp(2 * mu + sigma * sigma)) AS v FROM cost)
SELECT models, grade_a, grade_b, grade_c, observed, round(m, 2) AS p50, round(least(greatest(sqrt(v) / m, 0.01), 2.0), 4) AS cv FROM s""")  # fmt: skip
def _(*frames):
    s = costs.summary(_costs(*frames))
    return s.select("models", "grade_a", "grade_b", "grade_c", "observed", F.round(ln.median(F.col("total")), 2).alias("p50"), F.round(F.sqrt(F.expm1(F.col("total.sigma") * F.col("total.sigma"))), 4).alias("cv"))


@query("realized_savings", "d_obs", sql=f"""WITH {OBS.replace("obs AS", "obs0 AS").replace("FROM obs WHERE", "FROM obs0 WHERE").replace("{d_obs}", "(SELECT * FROM {d_obs} WHERE window_start < TIMESTAMP '1998-07-01')").replace("observed AS", "b AS")},
{OBS.replace("obs AS", "obs1 AS").replace("FROM obs WHERE", "FROM obs1 WHERE").replace("{d_obs}", "(SELECT * FROM {d_obs} WHERE window_start >= TIMESTAMP '1998-07-01')").replace("observed AS", "a AS")}
SELECT b.model_id, round(b.mu - a.mu, 4) AS saved, round((b.mu / greatest(b.me, 1) - a.mu / greatest(a.me, 1)) * (greatest(b.me, 1) + greatest(a.me, 1)) / 2, 4) AS efficiency,
round((greatest(a.me, 1) - greatest(b.me, 1)) * a.mu / greatest(a.me, 1), 4) AS volume FROM b JOIN a ON a.model_id = b.model_id""")  # fmt: skip
def _(obs):
    cut = F.lit("1998-07-01").cast("timestamp")
    return costs.realized_savings(costs.observe_monthly(obs.where(F.col("window_start") < cut)), costs.observe_monthly(obs.where(F.col("window_start") >= cut))).select("model_id", *r4("saved", "efficiency", "volume"))


@query("per_model_cap", "d_findings", sql="""WITH f AS (SELECT side, finding_id, path AS model_id, 1000.0 AS cost, 1.0 + severity / 2.0 AS multiplier, savings AS raw FROM {d_findings}),
w AS (SELECT *, sum(raw) OVER (PARTITION BY model_id) AS total, 1000.0 - 1000.0 / least(20, greatest(1.001, exp(sum(ln(multiplier)) OVER (PARTITION BY model_id)))) AS cap FROM f)
SELECT side, finding_id, round(CASE WHEN total > greatest(cap, 0.001) THEN raw * greatest(cap, 0.001) / total ELSE raw END, 4) AS scaled FROM w""")
def _(found):
    rows = found.select("side", "finding_id", F.col("path").alias("model_id"), F.lit(1000.0).alias("cost"), (1 + F.col("severity") / 2).alias("multiplier"), F.col("savings").alias("raw"))
    return costs.capped_savings(rows).select("side", "finding_id", *r4("scaled"))


@query("pr_impact", "d_findings", sql="""WITH s AS (SELECT sum(savings) FILTER (side = 'base') AS b, sum(savings) FILTER (side = 'head') AS h FROM {d_findings})
SELECT round(h - b, 2) AS net, round(greatest(h - b, 0), 2) AS introduced, round(greatest(b - h, 0), 2) AS avoided FROM s""")
def _(found):
    side = lambda s: found.where(F.col("side") == s).select(F.col("savings").alias("usd"))
    return costs.pr_impact(side("base"), side("head")).select(*[F.round(c, 2).alias(c) for c in ("net", "introduced", "avoided")])


@query("bundle_violations", "d_obs", sql="""WITH r AS (SELECT model_id, window_start, count(*) AS n FROM {d_obs} GROUP BY model_id, window_start HAVING count(*) > 1)
SELECT model_id, 'repeated' AS reason, sum(n) AS n FROM r GROUP BY model_id""")
def _(obs):
    return costs.violations(obs).groupBy("model_id", "reason").agg(F.count("*").alias("n"))


@query("export_alias_normalize", "events", sql="SELECT 'u' || user_id AS model_id, value AS bytes, 1 AS executions FROM events")
def _(events):
    rows = events.select(F.concat(F.lit("u"), "user_id").alias("Job_Name"), F.col("value").alias("bytes_scanned"), F.lit(None).cast("double").alias("bytes_billed"))
    got = costs.aliased(rows, {"model_id": ["model_id", "model", "query_tag", "job_name"], "bytes": ["bytes_processed", "bytes_scanned", "bytes_billed"], "executions": ["executions", "query_count"]})
    return got.withColumn("executions", F.coalesce(F.col("executions").cast("int"), F.lit(1)))


@query("multiplier_product", "d_findings", sql="SELECT path, round(exp(sum(ln(1.0 + severity / 10.0))), 6) AS product, round(sqrt(sum(ln(1 + 0.25)) + ln(1 + 0.0001)), 6) AS sigma FROM {d_findings} GROUP BY path")
def _(found):
    e = found.groupBy("path").agg(ln.product(ln.from_point(1 + F.col("severity") / 10, 0.5)).alias("e"))
    return e.select("path", F.round(ln.median(F.col("e")), 6).alias("product"), F.round("e.sigma", 6).alias("sigma"))


@query("savings_fraction", "d_findings", sql="SELECT side, finding_id, round(least(greatest(1 - 1 / greatest(1.0 + severity, 1.001), 0), 0.95), 6) AS fraction FROM {d_findings}")
def _(found):
    return found.select("side", "finding_id", F.round(ln.median(ln.savings_fraction(ln.from_point(1.0 + F.col("severity"), 0.5))), 6).alias("fraction"))


@query("round_sig2", "d_findings", sql="SELECT side, finding_id, CASE WHEN savings = 0 THEN 0 ELSE round(savings * power(10, 1 - floor(log10(abs(savings))))) / power(10, 1 - floor(log10(abs(savings)))) END AS shown FROM {d_findings}")
def _(found):
    return found.select("side", "finding_id", ln.round_sig2(F.col("savings")).alias("shown"))


# ---- lineage

CLOSURE = "closure AS (SELECT parent AS seed, child AS node FROM {d_edges} UNION SELECT c.seed, e.child FROM closure c JOIN {d_edges} e ON e.parent = c.node)"


@recursive("downstream_counts", "d_edges", sql=f"WITH {CLOSURE} SELECT seed, count(*) AS n FROM closure WHERE seed <> node GROUP BY seed")
def _(edges):
    return lineage.downstream_counts(edges)


@recursive("fan_out_factor", "d_edges", sql=f"WITH {CLOSURE}, n AS (SELECT seed, least(count(*), 15) AS n FROM closure WHERE seed <> node GROUP BY seed) SELECT seed, round(least(2.0, 1 + 0.25 * log2(1 + n)) * least(1.5, 1 + 0.05 * (seed % 4)), 6) AS factor FROM n")
def _(edges):
    return lineage.downstream_counts(edges, 15).select("seed", F.round(ln.fan_out_factor(F.col("n"), F.col("seed") % 4), 6).alias("factor"))


#: What lies below the changed models, followed as one set.
REACH = "changed AS MATERIALIZED (SELECT k FROM {d_changed}), reach AS (SELECT e.child AS node FROM {d_edges} e JOIN changed ON e.parent = changed.k UNION SELECT e.child FROM reach r JOIN {d_edges} e ON e.parent = r.node)"


@recursive("blast_radius", "d_edges", "d_changed", "part", sql=f"WITH {REACH}, x AS (SELECT node FROM reach WHERE node NOT IN (SELECT k FROM changed)) SELECT count(*) AS models, round(sum(p_retailprice), 2) AS usd FROM x LEFT JOIN part ON p_partkey = node")
def _(edges, changed, part):
    out = lineage.blast_radius(edges, changed, part.select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("usd")))
    return out.select("models", F.round("usd", 2).alias("usd"))


@recursive("exposures_affected", "d_edges", "d_changed", "d_exposures", sql=f"WITH {REACH} SELECT DISTINCT exposure FROM {{d_exposures}} WHERE depends_on IN (SELECT node FROM reach UNION ALL SELECT k FROM changed)")
def _(edges, changed, exposures):
    return lineage.exposures_affected(edges, changed, exposures)


@query("ref_resolution", "d_refs", "d_models", sql="WITH u AS (SELECT name, min(model_id) AS m FROM {d_models} GROUP BY name HAVING count(*) = 1) SELECT file, ref, coalesce(m, ref) AS target FROM {d_refs} LEFT JOIN u ON u.name = ref")
def _(refs, models):
    return lineage.resolved_refs(refs, models)


@query("ref_counts", "d_refs", sql="SELECT ref, count(*) AS n FROM {d_refs} GROUP BY ref")
def _(refs):
    return lineage.ref_counts(refs)


@query("heavy_view", "d_models", "d_refs", sql="WITH r AS (SELECT ref, count(*) AS n FROM {d_refs} GROUP BY ref) SELECT model_id, n FROM {d_models} JOIN r ON ref = name WHERE materialized IN ('view', 'ephemeral') AND n >= 4")
def _(models, refs):
    return lineage.heavy_views(models, refs)


# ---- text, features, rules

BARE = r"regexp_replace(text, '(''(?:[^'']|'''')*'')|--[^\n]*|/\*(?s:.*?)\*/|\{#(?s:.*?)#\}', '\1', 'g')"
MASKED = f"lower(regexp_replace({BARE}, '''(?:[^'']|'''')*''', '''''', 'g'))"


def _features_sql() -> str:
    quoted = lambda p: p.replace("'", "''").replace("{", "{{").replace("}", "}}")
    parts = [f"len(regexp_extract_all(masked, '{quoted(p)}')) AS n_{n}" for n, p in st.PATTERNS.items()] + [f"len(regexp_extract_all(bare, '{quoted(p)}')) AS n_{n}" for n, p in st.LITERAL_PATTERNS.items()]
    bound = " OR ".join(f"contains(lower(text), '{quoted(x)}')" for x in [*st.BOUND_COLUMNS, *st.BOUND_PHRASES])
    own = "t0 AS (SELECT f.*, m.materialized, m.unique_key, m.partition_by, m.cluster_by FROM {d_files} f JOIN {d_models} m ON m.model_id = f.model_id)"
    masked, bare = MASKED.replace("{", "{{").replace("}", "}}"), BARE.replace("{", "{{").replace("}", "}}")
    return f"{own}, t1 AS (SELECT *, {masked} AS masked, lower({bare}) AS bare FROM t0), feat AS (SELECT *, {', '.join(parts)}, ({bound}) AS bounded FROM t1)"


def _feature_rows(files, models):
    """Feature rows, dealt first."""
    rows = files.join(models.select("model_id", "materialized", "unique_key", "partition_by", "cluster_by"), "model_id")
    return rules.features(dealt(rows, "model_id", files))


_COUNTED = [f"n_{n}" for n in (*st.PATTERNS, *st.LITERAL_PATTERNS)]


@query("feature_counts", "d_files", "d_models", sql=f"WITH {_features_sql()} SELECT model_id, {', '.join(f'cast({c} AS int) AS {c}' for c in _COUNTED)}, bounded FROM feat")
def _(files, models):
    return _feature_rows(files, models).select("model_id", *_COUNTED, "bounded")


@query("feature_totals", "d_files", "d_models", sql=f"WITH {_features_sql()} SELECT materialized, {', '.join(f'sum({c}) AS {c}' for c in _COUNTED)} FROM feat GROUP BY materialized")
def _(files, models):
    return _feature_rows(files, models).groupBy("materialized").agg(*[F.sum(c).alias(c) for c in _COUNTED])


DOWN = "regexp_matches(lower(path), 'marts/|mart/|intermediate/|/int_|/fct_|/dim_|/core/|/analytics/|/reporting/')"
STAGE = "regexp_matches(lower(path), 'staging/|/stg_|/stage/')"
INC = "(materialized = 'incremental' OR n_config_incremental > 0)"
RULE_SQL = {
    "R001": ("medium", f"{DOWN} AND NOT {STAGE} AND n_select_star > 0"), "R002": (f"CASE WHEN {STAGE} AND contains(lower(text), 'raw') THEN 'high' ELSE 'medium' END", "n_json_call >= 2"), "R003": ("medium", "n_regex_call >= 2"),
    "R006": ("medium", "template = 32"), "R014": ("low", "template = 14"), "R004": ("high", f"{INC} AND unique_key IS NULL AND n_config_unique_key = 0"), "R005": ("high", f"{INC} AND n_is_incremental > 0 AND NOT bounded"), "R007": ("low", f"{DOWN} AND n_order_by > 0 AND n_limit = 0"),
    "R008": ("medium", "n_distinct > 0 AND n_group_by = 0"), "R009": ("low", "n_normalization > 1"), "R011": ("medium", "contains(path, 'marts/') AND n_source_call > 0"),
    "R012": ("medium", "n_cross_join > 0 AND NOT contains(text, 'date_spine')"), "R013": ("medium", "n_window > n_window_partitioned"), "R016": ("high", f"NOT {STAGE} AND n_non_sargable > 0"), "R017": ("medium", f"NOT {STAGE} AND n_wrapped_join_key > 0"),
    "R018": (f"CASE WHEN {STAGE} OR contains(path, 'intermediate/') THEN 'high' ELSE 'medium' END", "n_union > n_union_all"), "R020": ("CASE WHEN n_count_distinct > 1 THEN 'high' ELSE 'medium' END", f"{DOWN} AND n_count_distinct > 0"), "R021": ("medium", "n_wildcard_table > 0"),
    "R028": ("high", "contains(path, 'marts/') AND materialized IN ('incremental', 'table') AND partition_by IS NULL AND cluster_by IS NULL"), "R029": ("medium", f"{INC} AND n_config_full_refresh > 0"), "R031": ("medium", "n_leading_wildcard > 0"),
    "R033": ("high", "n_pattern_join > 0"), "R034": ("medium", f"{DOWN} AND n_scalar_subquery > 0"), "R036": ("high", "n_row_explosion > 0 AND (n_distinct > 0 OR n_count_distinct > 0)"), "R037": ("high", "n_not_in_subquery > 0"),
    "R040": ("medium", f"{DOWN} AND materialized = 'table' AND n_is_incremental = 0 AND bounded"), "R041": ("medium", "n_unbounded_frame > 0"), "R042": ("medium", "n_ref_call + n_source_call > 0 AND NOT bounded"), "R044": ("medium", "n_recursive_cte > 0"),
}
FOUND = f"{_features_sql()}, found AS (SELECT * FROM ({' UNION ALL '.join(f'''SELECT model_id, path, text, '{r}' AS rule, {s if s[:4] == 'CASE' else repr(s)} AS severity FROM feat WHERE {c}''' for r, (s, c) in RULE_SQL.items())}) x WHERE NOT contains(text, 'disable-file=' || rule))"


@query("rule_findings", "d_files", "d_models", sql=f"WITH {FOUND} SELECT model_id, path, rule, severity FROM found")
def _(files, models):
    return rules.findings(_feature_rows(files, models), "bigquery")


@query("rule_union_metrics", "d_files", "d_models", sql=f"WITH {FOUND} SELECT rule, severity, count(*) AS n FROM found GROUP BY GROUPING SETS ((rule, severity), (rule), (severity), ())")
def _(files, models):
    return rules.metrics(rules.findings(_feature_rows(files, models), "bigquery"))


@query("text_normalize", "documents", sql=r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS h FROM documents")
def _(docs):
    return docs.select("doc_id", F.md5(st.normalized(F.col("text"))).alias("h"))


@query("line_of_offset", "documents", sql="SELECT doc_id, len(string_split(text, chr(10))) AS line FROM documents")
def _(docs):
    return docs.select("doc_id", st.line_of(F.col("text"), F.length("text")).alias("line"))


@query("lines_of_matches", "documents", sql="SELECT doc_id, i AS line, len(regexp_extract_all(parts[i], '[.!?]')) AS n FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)) WHERE regexp_matches(parts[i], '[.!?]')")
def _(docs):
    return docs.select("doc_id", F.explode(st.lines_of(F.col("text"), "[.!?]")).alias("m")).select("doc_id", "m.line", "m.n")


@query("path_layers", "d_models", sql=f"SELECT model_id, {STAGE} AS staging, {DOWN} AS downstream FROM {{d_models}}")
def _(models):
    return models.select("model_id", st.is_staging(F.col("path")).alias("staging"), st.is_downstream(F.col("path")).alias("downstream"))


@query("shared_expressions", "d_files", sql=f"""WITH c AS (SELECT DISTINCT path, unnest(regexp_extract_all({MASKED.replace("{", "{{").replace("}", "}}")}, '\\b(?:count|sum|json_extract|regexp_extract|lower|upper)\\s*\\([^()]*\\)')) AS key FROM {{d_files}})
SELECT lower(trim(regexp_replace(key, '\\s+', ' ', 'g'))) AS key, count(DISTINCT path) AS files FROM c GROUP BY 1 HAVING count(DISTINCT path) >= 3""")
def _(files):
    return rules.shared_expressions(files)


# ---- governance

DELTA = """b AS (SELECT * FROM {d_findings} WHERE side = 'base'), h AS (SELECT * FROM {d_findings} WHERE side = 'head'),
delta AS (SELECT coalesce(b.finding_id, h.finding_id) AS finding_id, CASE WHEN b.finding_id IS NULL THEN 'introduced' WHEN h.finding_id IS NULL THEN 'resolved' WHEN h.severity > b.severity OR h.savings > b.savings THEN 'regressed' ELSE 'unchanged' END AS status FROM b FULL JOIN h ON h.finding_id = b.finding_id)"""


def _sides(found):
    return found.where("side = 'base'"), found.where("side = 'head'")


@query("findings_delta", "d_findings", sql=f"WITH {DELTA} SELECT finding_id, status FROM delta")
def _(found):
    return governance.delta(*_sides(found))


@query("delta_counts", "d_findings", sql=f"WITH {DELTA} SELECT status, count(*) AS n FROM delta GROUP BY status")
def _(found):
    return governance.delta(*_sides(found)).groupBy("status").agg(F.count("*").alias("n"))


@query("baseline_filter", "d_findings", sql="SELECT finding_id, rule, severity FROM {d_findings} WHERE side = 'head' AND finding_id NOT IN (SELECT finding_id FROM {d_findings} WHERE side = 'base')")
def _(found):
    base, head = _sides(found)
    return governance.not_in_baseline(head, base).select("finding_id", "rule", "severity")


@query("baseline_merge", "d_findings", sql="SELECT finding_id, min(rule) AS rule, min(path) AS path FROM {d_findings} GROUP BY finding_id")
def _(found):
    return governance.merged_baseline(*_sides(found))


@query("dedup_collapse", "d_raw_findings", sql="""WITH r AS (SELECT *, row_number() OVER (PARTITION BY rule, path, evidence ORDER BY confidence DESC, provenance DESC, span DESC, line, col, seq) AS i, count(*) OVER (PARTITION BY rule, path, evidence) AS n FROM {d_raw_findings})
SELECT rule, path, evidence, confidence, provenance, span, line, col, seq, n FROM r WHERE i = 1""")
def _(raw):
    return governance.collapsed(raw)


@query("identity", "d_raw_findings", sql="SELECT DISTINCT 'cgf_' || sha256(upper(rule) || '|' || path || '|' || evidence) AS finding_id, 'sem-v1:select:' || sha256('key=' || evidence || '|span=' || line) AS key FROM {d_raw_findings}")
def _(raw):
    return raw.select(governance.identity(F.col("rule"), F.col("path"), F.col("evidence")).alias("finding_id"), governance.evidence_key("select", span=F.col("line").cast("string"), key=F.col("evidence")).alias("key")).distinct()


@query("waivers", "d_findings", "d_waivers", sql="SELECT f.side, f.finding_id, min(w.ord) AS waiver FROM {d_findings} f LEFT JOIN {d_waivers} w ON w.active AND f.path LIKE w.pattern AND (w.rule IS NULL OR w.rule = f.rule) GROUP BY f.side, f.finding_id")
def _(found, waivers):
    return governance.waived(found, waivers)


@query("owners", "d_models", "d_owner_rules", sql="SELECT m.path, arg_max(r.owner, r.ord) AS owner FROM {d_models} m LEFT JOIN {d_owner_rules} r ON m.path LIKE r.pattern GROUP BY m.path")
def _(models, owner_rules):
    return governance.owned(dealt(models.select("path"), "path"), owner_rules)


@query("owner_summary", "d_models", "d_owner_rules", sql="WITH o AS (SELECT m.path, arg_max(r.owner, r.ord) AS owner FROM {d_models} m LEFT JOIN {d_owner_rules} r ON m.path LIKE r.pattern GROUP BY m.path) SELECT coalesce(owner, 'unowned') AS owner, count(*) AS n FROM o GROUP BY 1")
def _(models, owner_rules):
    return governance.owned(dealt(models.select("path"), "path"), owner_rules).groupBy(F.coalesce("owner", F.lit("unowned")).alias("owner")).agg(F.count("*").alias("n"))


@query("severity_overrides", "d_findings", "part", sql="""WITH o AS (SELECT DISTINCT 'R' || lpad(cast(p_partkey % 44 + 1 AS varchar), 3, '0') AS rule, p_partkey % 44 % 5 <> 0 AS enabled, CASE WHEN p_partkey % 44 % 3 = 0 THEN 1 END AS ns FROM part)
SELECT side, finding_id, f.rule, coalesce(ns, severity) AS severity FROM {d_findings} f LEFT JOIN o ON o.rule = f.rule WHERE coalesce(enabled, true)""")
def _(found, part):
    k = F.col("p_partkey") % 44
    overrides = part.select(F.concat(F.lit("R"), F.lpad((k + 1).cast("string"), 3, "0")).alias("rule"), (k % 5 != 0).alias("enabled"), F.when(k % 3 == 0, 1).alias("new_severity")).distinct()
    return governance.with_overrides(found, overrides).select("side", "finding_id", "rule", "severity")


GATES = (("all", "%", 4, 2, 1e12, "fail"), ("marts", "%marts%", 5, 1, 5e4, "fail"), ("staging", "%staging%", 5, 9, 1e5, "warn"), ("none", "%nowhere%", 1, 0, 1.0, "fail"))


@query("gates", "d_findings", sql=f"""WITH g(gate, pattern, fail_on, min_confidence, max_savings, mode) AS (VALUES {', '.join(map(str, GATES))}),
x AS (SELECT gate, mode, max_savings, count(*) FILTER (severity >= fail_on AND confidence >= min_confidence) AS hits, sum(savings) AS savings FROM g LEFT JOIN {{d_findings}} f ON f.path LIKE g.pattern GROUP BY gate, mode, max_savings)
SELECT gate, hits, round(savings, 2) AS savings, CASE WHEN hits = 0 AND coalesce(savings, 0) < max_savings THEN 'pass' WHEN mode = 'warn' THEN 'warn' ELSE 'fail' END AS status FROM x""")
def _(found):
    spec = found.sparkSession.createDataFrame(GATES, "gate string, pattern string, fail_on int, min_confidence int, max_savings double, mode string")
    return governance.gates(found, spec).select("gate", "hits", F.round("savings", 2).alias("savings"), "status")


POLICY = {"all": [{"any": [{"glob": ("path", "*marts*")}, {"in": ("materialized", ["table", "incremental"])}]}, {"not": {"equals": ("unique_key", "id")}}]}


@query("declarative_predicates", "d_models", sql="SELECT model_id FROM {d_models} WHERE (path LIKE '%marts%' OR materialized IN ('table', 'incremental')) AND unique_key IS NULL")
def _(models):
    return models.where(governance.predicate(POLICY)).select("model_id")


SCOPES = (("all", "%", 1), ("marts", "%marts/%", 1), ("models", "models/%", 5), ("core", "%core/%", 1), ("core2", "%core/%", 3))


@query("policy_scope", "d_models", sql=f"WITH s(scope, pattern, priority) AS (VALUES {', '.join(map(str, SCOPES))}), r AS (SELECT path, scope, row_number() OVER (PARTITION BY path ORDER BY length(pattern) DESC, priority DESC, scope DESC) AS i FROM {{d_models}} JOIN s ON path LIKE pattern) SELECT path, scope FROM r WHERE i = 1")
def _(models):
    return governance.scoped(models, models.sparkSession.createDataFrame(SCOPES, "scope string, pattern string, priority int"))


@query("completeness", "documents", sql="SELECT 'wide' AS measure, count(*) FILTER (n_chars > 5000) AS value, 1 AS most FROM documents HAVING count(*) FILTER (n_chars > 5000) > 1")
def _(docs):
    counts = docs.agg(F.count_if(F.col("text").isNull()).alias("unread"), F.count_if(F.col("n_chars") > 5000).alias("wide"))
    return governance.completeness(counts, {"unread": 0, "wide": 1})


@query("running_budget", "d_models", "d_files", sql="""WITH f AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, path, length(text) AS bytes FROM {d_files})
SELECT path, sum(bytes) OVER w AS so_far, sum(bytes) OVER w <= 9000 AS inside FROM f WINDOW w AS (PARTITION BY folder ORDER BY path ROWS UNBOUNDED PRECEDING)""")
def _(models, files):
    rows = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "path", F.length("text").alias("bytes"))
    return governance.running_budget(rows, 9000).select("path", "so_far", "inside")


# ---- evaluation

CONFUSION = """c AS (SELECT rule, severity, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn
FROM {d_eval} GROUP BY GROUPING SETS ((rule), (severity), ()))"""


@query("confusion_by_rule", "d_eval", sql=f"WITH {CONFUSION} SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c")
def _(rows):
    return evaluation.confusion(rows).select("rule", "severity", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("mcc", "d_eval", sql=f"""WITH {CONFUSION}, d AS (SELECT *, sqrt(cast(tp + fp AS double) * (tp + fn) * (tn + fp) * (tn + fn)) AS d FROM c)
SELECT rule, severity, round(CASE WHEN d > 0 THEN (tp * tn - fp * fn) / d ELSE 0 END, 6) AS mcc, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced FROM d""")
def _(rows):
    return evaluation.mcc(evaluation.confusion(rows)).select("rule", "severity", *[F.round(c, 6).alias(c) for c in ("mcc", "balanced")])


@query("wilson", "d_eval", sql="""WITH s AS (SELECT rule, cast(sum(y_true) AS double) AS h, cast(count(*) AS double) AS n FROM {d_eval} GROUP BY rule)
SELECT rule, round(greatest(0, (h / n + 3.8416 / (2 * n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS low, round(least(1, (h / n + 3.8416 / (2 * n) + 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS high FROM s""")
def _(rows):
    low, high = evaluation.wilson(F.col("h"), F.col("n"))
    return rows.groupBy("rule").agg(F.sum("y_true").alias("h"), F.count("*").alias("n")).select("rule", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("ranking", "d_eval", sql="""WITH a AS (SELECT severity, score, sum(y_true) AS p, sum(1 - y_true) AS q FROM {d_eval} GROUP BY severity, score),
b AS (SELECT *, sum(p) OVER w AS cp, sum(q) OVER w AS cq FROM a WINDOW w AS (PARTITION BY severity ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT severity, round(sum(p * cp / (cp + cq)) / nullif(sum(p), 0), 6) AS average_precision, round(sum(q * (cp - p / 2)) / nullif(sum(p) * sum(q), 0), 6) AS roc_auc FROM b GROUP BY severity""")
def _(rows):
    return evaluation.ranking(rows).select("severity", *[F.round(c, 6).alias(c) for c in ("average_precision", "roc_auc")])


@query("kappa", "d_eval", sql="""WITH s AS (SELECT count(*) AS n, avg(CASE WHEN y_true = rater THEN 1.0 ELSE 0 END) AS a, avg(y_true) AS x, avg(rater) AS y FROM {d_eval})
SELECT n, round(a, 6) AS agreement, round((a - (x * y + (1 - x) * (1 - y))) / (1 - (x * y + (1 - x) * (1 - y))), 6) AS kappa FROM s""")
def _(rows):
    return evaluation.kappa(rows).select("n", *[F.round(c, 6).alias(c) for c in ("agreement", "kappa")])


@query("precision_tiers", "d_eval", sql="""WITH s AS (SELECT rule, count(*) AS n, avg(y_true) AS p FROM {d_eval} WHERE y_pred = 1 GROUP BY rule)
SELECT rule, n, round(p, 6) AS precision, CASE WHEN n < 10 THEN 'exempt' WHEN p >= 0.95 THEN 'high' WHEN p >= 0.8 THEN 'medium' WHEN p >= 0.7 THEN 'low' ELSE 'experimental' END AS tier FROM s""")
def _(rows):
    return evaluation.tiers(rows).select("rule", "n", F.round("precision", 6).alias("precision"), "tier")


@query("recall_coverage", "d_eval", sql="SELECT rule, count(*) FILTER (y_true = 1) AS expects, count(*) FILTER (y_true = 0) AS forbids, count(*) FILTER (y_true = 1) >= 2 AND count(*) FILTER (y_true = 0) >= 1 AS ok FROM {d_eval} GROUP BY rule")
def _(rows):
    return evaluation.coverage(rows.select("rule", (F.col("y_true") == 1).alias("expect")))


@query("capped_sample", "d_findings", sql="SELECT rule, finding_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY savings DESC, path, finding_id) AS rank FROM {d_findings} WHERE side = 'head') x WHERE rank <= 3")
def _(found):
    return evaluation.capped_sample(found.where("side = 'head'"), 3).select("rule", "finding_id", "rank")
