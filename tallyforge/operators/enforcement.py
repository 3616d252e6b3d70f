"""Who may be stopped by what: exceptions and waivers with expiry, owners by level, gates with all criteria, the verdict.

Written rules (waivers, exceptions, scopes, gates, owner patterns) are short Python lists, checked by
`tallyforge.operators.validation`; they become expressions over a finding's row, so that no join or shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.globs import glob
from tallyforge.operators.attribution import INFRASTRUCTURE
from tallyforge.operators.lineage import reached_by


def _covers(rule: dict) -> Column:
    """Whether a waiver or exception names this finding: path pattern, and id or rule where given."""
    out = glob(F.col("path"), rule["path"])
    if rule.get("finding_id"):
        out = out & (F.col("finding_id") == rule["finding_id"])
    if rule.get("rule"):
        out = out & (F.upper("rule") == rule["rule"].upper())
    return F.coalesce(out, F.lit(False))


def excused(findings: DataFrame, rules: list[dict], now: str, name: str = "waiver") -> DataFrame:
    """findings with `name`, the first rule in force that covers each, and `name`_expired, the expired ones that would.

    rules: dicts with id, path, expires_at and perhaps created_at, finding_id, rule.
    """
    held, gone = [], []
    for r in rules:
        (gone if r["expires_at"] <= now else held).append(F.when(_covers(r), F.lit(r["id"])))
    expired = F.filter(F.array(*gone), lambda x: x.isNotNull()) if gone else F.array().cast("array<string>")
    return findings.withColumn(name, F.coalesce(*held) if held else F.lit(None).cast("string")).withColumn(f"{name}_expired", expired)


def owners(path: Column, explicit: Column, by_path: list[tuple[str, str]], code_owners: list[tuple[str, str]], group: Column, default: str | None = None) -> Column:
    """The owner of a model: its own, else by path setting, else the last code owner line that matches, else its group, else the default."""
    of = lambda rules, crosses: [F.when(glob(path, p, crosses), F.lit(o)) for p, o in rules]
    return F.coalesce(explicit, *of(by_path, True), *of(code_owners[::-1], False), group, F.lit(default))


def outcome(mode: Column, excepted: Column) -> Column:
    """What a policy does with a finding."""
    return F.when(excepted, "excepted").when(mode == "block", "blocked").when(mode == "warn", "warned").otherwise("observed")


def effective_overrides(local: dict[str, dict], policy: dict[str, dict] | None, may_override: bool) -> dict[str, dict]:
    """Rule settings in force: the local ones if there is no policy or it allows them, each setting replaced by the policy's."""
    out = {r: dict(s) for r, s in local.items()} if policy is None or may_override else {}
    for r, s in (policy or {}).items():
        out[r] = out.get(r, {}) | {k: v for k, v in s.items() if v is not None}
    return out


def forbidden(uses: dict[str, bool], permissions: dict[str, bool]) -> list[str]:
    """The local controls in use (baselines, severity_overrides, waivers, inline_suppressions) that a policy forbids."""
    return [k for k, used in uses.items() if used and not permissions.get(k, False)]


def custom_findings(files: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(model_id, path, rule, severity) of rules (id, severity, predicate) over feature rows: one select for all of them."""
    held = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, c in rules])
    return files.select("model_id", "path", F.explode(F.filter(held, lambda x: x.isNotNull())).alias("f")).select("model_id", "path", "f.*")


def blocking(findings: DataFrame, delta: DataFrame | None) -> DataFrame:
    """findings with `delta_status` and `blocks`: with a delta only new or worse ones block, and no infrastructure rule does.

    A finding without an id is `unknown` and blocks. delta: (finding_id, status), one row a finding.
    """
    scan = F.col("rule").isin(*INFRASTRUCTURE)
    if delta is None:
        return findings.withColumn("delta_status", F.lit(None).cast("string")).withColumn("blocks", F.col("rule") != "R047")
    rows = findings.join(delta.select("finding_id", "status"), "finding_id", "left")
    status = F.when(scan, None).when(F.coalesce("finding_id", F.lit("")) == "", "unknown").when(F.col("status").isin("introduced", "regressed"), F.col("status")).otherwise("unchanged")
    return rows.withColumn("delta_status", status).withColumn("blocks", ~scan & F.coalesce(status.isin("introduced", "regressed", "unknown"), F.lit(False))).drop("status")


def _in_gate(gate: dict) -> Column:
    out = F.lit(True)
    if gate.get("paths"):
        out = out & F.coalesce(*[F.when(glob(F.col("path"), p), True) for p in gate["paths"]], F.lit(False))
    for key in ("tags", "owners"):
        if gate.get(key):
            out = out & F.coalesce(F.arrays_overlap(F.col(key), F.array(*map(F.lit, gate[key]))), F.lit(False))
    return out


def gates(findings: DataFrame, models: DataFrame, reach: DataFrame | None, rules: list[dict], net_usd: float | None = None, only_new: bool = False, edges: DataFrame | None = None) -> DataFrame:
    """(gate, status, matched, reasons): each gate over findings, changed models and what lies below them.

    findings: path, tags, owners, rule, severity and confidence (ranks), savings_usd, gb_months, excepted, blocks. models:
    path, tags, owners, model_id. reach: (seed, node), or None and edges (parent, child): then what lies below a gate's models
    is followed as one set, and only for gates that ask for it. A gate has name, mode (fail or warn) and any of paths, tags, owners,
    fail_on, min_confidence, monthly_usd, monthly_gb, pr_increase, blast_radius, require_owner. One pass over findings and one over
    models with partial aggregates; distinct nodes are counted by gate, without a set in any task.
    """
    spark, n = findings.sparkSession, len(rules)
    live = findings.where(~F.coalesce("excepted", F.lit(False)) & ~F.col("rule").isin(*INFRASTRUCTURE))
    if only_new:
        live = live.where("blocks")
    unowned = F.coalesce(F.size("owners"), F.lit(0)) <= 0
    changed = models.select("path").distinct().withColumn("_known", F.lit(True))
    sums = []
    for i, g in enumerate(rules):
        m = _in_gate(g)
        loud = m & (F.col("severity") >= g.get("fail_on", 1 << 30)) & (F.col("confidence") >= g.get("min_confidence", 0))
        sums += [F.count_if(m).alias(f"n{i}"), F.count_if(loud).alias(f"s{i}"), F.sum(F.when(m, F.col("savings_usd"))).alias(f"u{i}"), F.sum(F.when(m, F.col("gb_months"))).alias(f"g{i}"), F.count_if(m & unowned & F.col("_known").isNull() & F.coalesce("in_change", F.lit(False))).alias(f"o{i}")]
    flagged = live if "in_change" in live.columns else live.withColumn("in_change", F.lit(False))
    found = flagged.join(changed, "path", "left").agg(*sums)
    bare = models.agg(*[F.count_if(_in_gate(g) & unowned).alias(f"m{i}") for i, g in enumerate(rules)])
    hit = F.filter(F.array(*[F.when(_in_gate(g), F.lit(i)) for i, g in enumerate(rules) if g.get("blast_radius") is not None]).cast("array<int>"), lambda x: x.isNotNull())
    asked = models.select("model_id", F.explode(hit).alias("i"))
    if reach is None:
        wide = reached_by(edges, asked.select("i", F.col("model_id").alias("node")))
    else:
        wide = asked.join(reach, F.col("model_id") == F.col("seed")).select("i", "node").distinct()
    wide = wide.groupBy("i").agg(F.count("*").alias("below"))
    line = lambda i, g: F.struct(F.lit(i).alias("i"), *[F.col(f"{c}{i}").alias(c) for c in "nsugom"])
    rows = found.join(F.broadcast(bare), F.lit(True)).select(F.inline(F.array(*[line(i, g) for i, g in enumerate(rules)])))  # one row by one row
    rows = rows.join(wide, "i", "left").withColumn("below", F.coalesce("below", F.lit(0)))
    keys = ("name", "mode", "fail_on", "monthly_usd", "monthly_gb", "pr_increase", "blast_radius", "require_owner")
    spec = spark.createDataFrame([(i, *[g.get(k) for k in keys]) for i, g in enumerate(rules)], "i int, name string, mode string, fail_on int, monthly_usd double, monthly_gb double, pr_increase double, blast_radius int, require_owner boolean") if n else None
    if spec is None:
        return spark.createDataFrame([], "gate string, status string, matched long, reasons array<string>")
    net = F.lit(net_usd).cast("double")
    tests = {
        "severity": F.col("s") > 0,
        "monthly-usd": F.coalesce("u", F.lit(0.0)) >= F.col("monthly_usd"),
        "pr-cost-unknown": F.col("pr_increase").isNotNull() & net.isNull(),
        "pr-cost": net >= F.col("pr_increase"),
        "monthly-gb": F.coalesce("g", F.lit(0.0)) >= F.col("monthly_gb"),
        "blast-radius": F.col("below") >= F.col("blast_radius"),
        "owner": F.coalesce("require_owner", F.lit(False)) & (F.col("o") + F.col("m") > 0),
    }
    reasons = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]), lambda x: x.isNotNull())
    status = F.when(F.size("reasons") == 0, "pass").when(F.col("mode") == "warn", "warn").otherwise("fail")
    return spec.join(rows, "i").withColumn("reasons", reasons).select(F.col("name").alias("gate"), status.alias("status"), F.col("n").alias("matched"), "reasons")


def verdict(findings: DataFrame, gate_rows: DataFrame, fail_on: int | None = None, min_confidence: int = 0, monthly_usd: float | None = None, monthly_gb: float | None = None, complete: bool = True, managed: bool = False) -> DataFrame:
    """One row: whether the scan fails, and each ground for it."""
    live = ~F.coalesce("excepted", F.lit(False)) & F.col("blocks")
    loud = live & (F.col("severity") >= (fail_on if fail_on is not None else 1 << 30)) & (F.col("confidence") >= min_confidence)
    if managed:
        loud = loud & (F.col("enforcement") == "blocked")
    f = findings.agg(F.count_if(loud).alias("loud"), F.coalesce(F.sum(F.when(live, F.col("savings_usd"))), F.lit(0.0)).alias("usd"), F.coalesce(F.sum(F.when(live, F.col("gb_months"))), F.lit(0.0)).alias("gb"))
    g = gate_rows.agg(F.count_if(F.col("status") == "fail").alias("failed_gates"))
    over = lambda c, most: F.col(c) >= most if most is not None else F.lit(False)
    grounds = {"incomplete": F.lit(not complete), "gate": F.col("failed_gates") > 0, "severity": F.col("loud") > 0, "usd": over("usd", monthly_usd), "gb": over("gb", monthly_gb)}
    return f.join(F.broadcast(g), F.lit(True)).select(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in grounds.items()]), lambda x: x.isNotNull()).alias("grounds")).select((F.size("grounds") > 0).alias("fails"), "grounds")  # one row by one row


def completeness(counts: DataFrame, parse_rate: float = 0.0, compiled: int = 0, skipped: int = 0, metadata_errors: bool = True, need_manifest: bool = True, least_spend: float | None = None) -> DataFrame:
    """(code, observed, allowed) of what makes an analysis incomplete.

    counts: one row with parsed, parse_failures, compiled_failures, skipped_files, yaml_failures, project_failures,
    metadata_only and manifest_stale (booleans), models, models_with_spend.
    """
    rate = F.when(F.col("parsed") > 0, F.col("parse_failures") / F.col("parsed")).otherwise(0.0)
    wrong = F.col("yaml_failures") + F.col("project_failures")
    spend = F.col("models_with_spend") / F.col("models")
    d = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("double")
    tests = [
        ("parse_failure_rate", rate > parse_rate, rate, parse_rate),
        ("compiled_parse_failures", F.col("compiled_failures") > compiled, F.col("compiled_failures"), compiled),
        ("skipped_files", F.col("skipped_files") > skipped, F.col("skipped_files"), skipped),
        ("metadata_errors", F.lit(metadata_errors) & (wrong > 0), wrong, 0),
        ("manifest_required", F.lit(need_manifest) & F.col("metadata_only"), 0, 1),
        ("manifest_stale", F.lit(need_manifest) & F.col("manifest_stale"), 1, 0),
        ("cost_coverage", F.lit(least_spend is not None) & (F.col("models") > 0) & (F.when(F.col("models") > 0, spend) < (least_spend or 0.0)), F.when(F.col("models") > 0, spend), least_spend or 0.0),
    ]
    held = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("code"), d(o).alias("observed"), d(a).alias("allowed"))) for k, c, o, a in tests])
    return counts.select(F.inline(F.filter(held, lambda x: x.isNotNull())))


def scope_conflicts(scopes: DataFrame, settings: DataFrame) -> DataFrame:
    """(path, a, b): scopes that match one path with equal kind and priority but differ in mode or in a rule's setting.

    scopes: (path, scope, kind, priority, mode), the matching ones of each path; settings: (scope, rule, setting).
    """
    one = scopes.groupBy("path", "kind", "priority").agg(F.count_distinct("mode").alias("modes"), F.min("scope").alias("a"), F.max("scope").alias("b"))
    by_mode = one.where("modes > 1").select("path", "kind", "priority")
    by_rule = scopes.join(settings, "scope").groupBy("path", "kind", "priority", "rule").agg(F.count_distinct("setting").alias("n")).where("n > 1").select("path", "kind", "priority")
    return by_mode.union(by_rule).distinct()
