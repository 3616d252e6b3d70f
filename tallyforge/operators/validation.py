"""Checks of written settings and of graphs: each gives a row (subject, problem) for what is wrong."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_CUSTOM_RULES, MOST_DEPTH = 100, 12
#: Fixed names of the predicates of custom rules.
LEAVES, GROUPS = ("equals", "glob", "regex", "in", "at_least"), ("all", "any")


def _rows(spark: SparkSession, found: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(found, "subject string, problem string")


def _time(text: object) -> datetime | None:
    try:
        return datetime.fromisoformat(str(text).replace("Z", "+00:00"))
    except ValueError:
        return None


def _positive(value: object) -> bool:
    return value is None or (isinstance(value, (int, float)) and math.isfinite(value) and value > 0)


def _twice(names: list[str]) -> list[str]:
    return sorted({n for n in names if names.count(n) > 1})


def waiver_problems(waivers: list[dict]) -> list[tuple[str, str]]:
    """Missing fields, not exactly one of finding and rule, bad or reversed times, repeated ids."""
    out = [(n, "repeated id") for n in _twice([str(w.get("id")) for w in waivers])]
    for w in waivers:
        name = str(w.get("id"))
        out += [(name, f"{k} is empty") for k in ("id", "path", "owner", "reason", "ticket_url", "approver") if not str(w.get(k) or "").strip()]
        if (w.get("finding_id") is None) == (w.get("rule") is None):
            out.append((name, "needs exactly one of finding_id and rule"))
        created, expires = _time(w.get("created_at")), _time(w.get("expires_at"))
        if created is None or expires is None:
            out.append((name, "times must be RFC 3339"))
        elif expires <= created:
            out.append((name, "expires before it is created"))
    return out


def gate_problems(gates: list[dict]) -> list[tuple[str, str]]:
    """Thresholds that are not positive, names that are empty or repeated, scopes that select nothing."""
    out = [(n, "repeated name") for n in _twice([str(g.get("name")) for g in gates])]
    for i, g in enumerate(gates):
        name = str(g.get("name") or "")
        if not name.strip():
            out.append((name, "name is empty"))
        out += [(name, f"{k} must be positive") for k in ("monthly_usd", "monthly_gb", "pr_increase", "blast_radius") if not _positive(g.get(k))]
        if i and not any(g.get(k) for k in ("paths", "tags", "owners")):  # the first gate is the global one
            out.append((name, "selects nothing"))
    return out


def policy_problems(policy: dict, known_rules: list[str]) -> list[tuple[str, str]]:
    """Version, times, repeated scopes and custom rules, unknown rules, zero thresholds, exceptions that name nothing."""
    name = str(policy.get("id") or "")
    out = [] if policy.get("schema_version") == 2 else [(name, "unsupported schema version")]
    issued, expires = _time(policy.get("issued_at")), _time(policy.get("expires_at"))
    if issued is None or expires is None or expires <= issued:
        out.append((name, "must expire after it is issued"))
    scopes = policy.get("scopes", [])
    custom = [c for s in scopes for c in s.get("custom_rules", [])]
    out += [(n, "repeated scope") for n in _twice([s["id"] for s in scopes])] + [(n, "repeated custom rule") for n in _twice([c["id"] for c in custom])]
    if len(custom) > MOST_CUSTOM_RULES:
        out.append((name, "too many custom rules"))
    names = {*known_rules, *[c["id"] for c in custom]}
    for c in custom:
        out += [(c["id"], p) for p in predicate_problems(c.get("when", {}), c.get("fields"))]
    for s in scopes:
        out += [(s["id"], f"unknown rule {r}") for r in s.get("rules", {}) if r not in known_rules]
        out += [(s["id"], f"threshold of {r} is zero") for r, v in s.get("rules", {}).items() if v.get("threshold") == 0]
        for e in s.get("exceptions", []):
            if e.get("finding_id") is None and e.get("rule") is None:
                out.append((e["id"], "names neither finding nor rule"))
            if e.get("rule") is not None and e["rule"] not in names:
                out.append((e["id"], f"unknown rule {e['rule']}"))
    return out


def predicate_problems(spec: dict, fields: dict[str, str] | None = None, depth: int = 1) -> list[str]:
    """What is wrong with a predicate: shape, depth, unknown fields, and tests that a field's type does not have."""
    if depth > MOST_DEPTH:
        return ["nested too deeply"]
    if not isinstance(spec, dict) or len(spec) != 1:
        return ["must have exactly one test"]
    (kind, body), = spec.items()
    if kind in GROUPS:
        return ["empty group"] if not body else [p for x in body for p in predicate_problems(x, fields, depth + 1)]
    if kind == "not":
        return predicate_problems(body, fields, depth + 1)
    if kind not in LEAVES:
        return [f"unknown test {kind}"]
    field = body[0]
    if fields is not None and field not in fields:
        return [f"unknown field {field}"]
    wants = {"glob": "string", "regex": "string", "at_least": "number"}.get(kind)
    return [f"{kind} does not fit {field}"] if fields is not None and wants and fields[field] != wants else []


def cost_problems(config: dict) -> list[tuple[str, str]]:
    """Ranges of cost settings."""
    within = {"interval": (0.5, 0.99), "incremental_fraction": (0.001, 1.0), "min_mapped_spend_fraction": (0.0, 1.0)}
    out = [(k, f"must be within {a} and {b}") for k, (a, b) in within.items() if config.get(k) is not None and not a <= config[k] <= b]
    out += [(k, "must be positive") for k in ("default_runs_per_month", "fail_on_monthly_delta", "fail_on_monthly_delta_gb", "usd_per_tb", "usd_per_credit") if not _positive(config.get(k))]
    model = config.get("pricing_model")
    if model is None and any(config.get(k) is not None for k in ("usd_per_tb", "usd_per_credit")):
        out.append(("pricing_model", "is required with prices"))
    if model not in (None, "scan", "compute"):
        out.append(("pricing_model", f"unknown model {model}"))
    for rule, m in config.get("multipliers", {}).items():
        low, high = m if isinstance(m, tuple) else (m, m)
        if not (_positive(low) and _positive(high) and low <= high):
            out.append((rule, "multiplier must be positive and in order"))
    return out


def problems(spark: SparkSession, found: list[tuple[str, str]]) -> DataFrame:
    return _rows(spark, found)


def graph_problems(models: DataFrame, exposures: DataFrame) -> DataFrame:
    """(subject, problem) for ids, paths and exposure names that occur twice or more: one aggregation over all of them."""
    rows = models.select(F.lit("repeated id").alias("problem"), F.col("model_id").cast("string").alias("subject"))
    rows = rows.union(models.select(F.lit("repeated path"), F.col("path"))).union(exposures.select(F.lit("repeated exposure"), F.col("exposure").cast("string")))
    return rows.where("subject is not null").groupBy("subject", "problem").agg(F.count("*").alias("n")).where("n > 1").select("subject", "problem")


def envelope_problems(sources: DataFrame, models: DataFrame) -> DataFrame:
    """(subject, problem) of a sealed set of sources (path, sha256) against the models (path) it was made for."""
    bad = F.when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "no sha256").when(F.col("path").rlike(r"^/|^[A-Za-z]:|(?:^|/)\.\.(?:/|$)"), "path is not relative")
    own = sources.select(F.col("path").alias("subject"), bad.alias("problem")).where("problem is not null")
    twice = sources.groupBy(F.col("path").alias("subject")).agg(F.count("*").alias("n")).where("n > 1").select("subject", F.lit("repeated path"))
    a, b = sources.select("path").distinct(), models.select("path").distinct()
    return own.union(twice).union(a.join(b, "path", "left_anti").select("path", F.lit("no such model"))).union(b.join(a, "path", "left_anti").select("path", F.lit("not sealed")))
