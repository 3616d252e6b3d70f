"""What happens to findings after the rules: identity, collapse, baselines, waivers, owners, deltas, gates, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.globs import glob
from tallyforge.operators.ordered import running


def identity(rule: Column, path: Column, evidence: Column) -> Column:
    """A finding's stable id; prefix and order are fixed by the format of baselines."""
    return F.concat(F.lit("cgf_"), F.sha2(F.concat_ws("|", F.upper(rule), path, evidence), 256))


def evidence_key(kind: str, **fields: Column) -> Column:
    """Evidence from named fields in the order of their names."""
    parts = [F.concat(F.lit(f"{k}="), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit(f"sem-v1:{kind}:"), F.sha2(F.concat_ws("|", *parts), 256))


def collapsed(findings: DataFrame) -> DataFrame:
    """One finding for each rule, path and evidence: the surest, then by provenance, the wider span, line and column."""
    best = F.max_by(F.struct("confidence", "provenance", "span", "line", "col", "seq"), F.struct("confidence", "provenance", "span", -F.col("line"), -F.col("col"), -F.col("seq")))
    return findings.groupBy("rule", "path", "evidence").agg(best.alias("b"), F.count("*").alias("n")).select("rule", "path", "evidence", "b.*", "n")


def delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """(finding_id, status): introduced, resolved, regressed (more severe or dearer) or unchanged."""
    b = base.select("finding_id", F.col("severity").alias("bs"), F.col("savings").alias("bc"))
    h = head.select("finding_id", F.col("severity").alias("hs"), F.col("savings").alias("hc"))
    worse = (F.col("hs") > F.col("bs")) | (F.col("hc") > F.col("bc"))
    status = F.when(F.col("bs").isNull(), "introduced").when(F.col("hs").isNull(), "resolved").when(worse, "regressed").otherwise("unchanged")
    return b.join(h, "finding_id", "full_outer").select("finding_id", status.alias("status"))


def not_in_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select("finding_id").distinct(), "finding_id", "left_anti")


def merged_baseline(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two baselines, one row for each finding; of differing rows the one with the least path."""
    both = a.select("finding_id", "rule", "path").unionByName(b.select("finding_id", "rule", "path"))
    return both.groupBy("finding_id").agg(F.min(F.struct("path", "rule")).alias("m")).select("finding_id", "m.rule", "m.path")


def waived(findings: DataFrame, waivers: DataFrame) -> DataFrame:
    """findings with the first active waiver that covers their path (LIKE pattern) and rule, else null. Waivers are few."""
    w = F.broadcast(waivers.where("active").select(F.col("ord").alias("waiver"), "pattern", F.col("rule").alias("_rule")))
    hits = findings.join(w, F.like(findings["path"], F.col("pattern")) & (F.col("_rule").isNull() | (F.col("_rule") == findings["rule"])), "left")
    return hits.groupBy("side", "finding_id").agg(F.min("waiver").alias("waiver"))


def _matching(files: DataFrame, listed: DataFrame, *fields: str) -> tuple[DataFrame, Column]:
    """files beside all of a short list, and the `fields` of those in the list whose LIKE pattern matches the path."""
    rows = files.crossJoin(F.broadcast(listed.agg(F.collect_list(F.struct("pattern", *fields)).alias("_listed"))))
    found = F.filter("_listed", lambda x: F.like(F.col("path"), x["pattern"]))
    return rows, F.transform(found, lambda x: F.struct(*[x[f].alias(f) for f in fields]))


def owned(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, owner) by the last ownership rule that matches. Rules are few: a path looks at all of them in its row, so no row is made for a match."""
    rows, found = _matching(files.select("path"), rules.where("ord is not null"), "ord", "owner")
    return rows.select("path", F.array_max(found)["owner"].alias("owner")).distinct()


def with_overrides(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """findings with rules switched off removed and severities replaced. overrides: (rule, enabled, new_severity)."""
    o = F.broadcast(overrides)
    rows = findings.join(o, "rule", "left").where(F.coalesce("enabled", F.lit(True)))
    return rows.withColumn("severity", F.coalesce("new_severity", "severity")).drop("enabled", "new_severity")


def gates(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """(gate, hits, savings, status). rules: (gate, pattern, fail_on, min_confidence, max_savings, mode), few."""
    g = F.broadcast(rules)
    rows = g.join(findings, F.like(findings["path"], g["pattern"]), "left")
    hit = (F.col("severity") >= F.col("fail_on")) & (F.col("confidence") >= F.col("min_confidence"))
    by = rows.groupBy("gate", "max_savings", "mode").agg(F.count_if(hit).alias("hits"), F.sum("savings").alias("savings"))
    tripped = (F.col("hits") > 0) | (F.coalesce("savings", F.lit(0.0)) >= F.col("max_savings"))
    return by.select("gate", "hits", "savings", F.when(~tripped, "pass").when(F.col("mode") == "warn", "warn").otherwise("fail").alias("status"))


def predicate(spec: dict) -> Column:
    """A policy predicate as a Column: all, any, not, equals, glob, regex, in, at_least. A missing field is false."""
    (kind, body), = spec.items()
    if kind in ("all", "any"):
        parts = [predicate(p) for p in body]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if kind == "all" else out | p
        return out
    if kind == "not":
        return ~predicate(body)
    field, value = body
    c = F.col(field)
    test = {"equals": lambda: c == value, "glob": lambda: glob(c, value), "regex": lambda: c.rlike(value), "in": lambda: c.isin(*value), "at_least": lambda: c >= value}[kind]()
    return F.coalesce(test, F.lit(False))


def scoped(files: DataFrame, scopes: DataFrame) -> DataFrame:
    """(path, scope): of the matching policy scopes the most specific, then the one of the highest priority, then by name."""
    rows, found = _matching(files.select("path"), scopes.withColumn("_length", F.length("pattern")), "_length", "priority", "scope")
    return rows.select("path", F.explode(F.slice(F.sort_array(found, False), 1, 1)).alias("s")).select("path", "s.scope").distinct()


def completeness(counts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(measure, value, most): the measures of one row of counts that exceed their limits."""
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).cast("long").alias("value"), F.lit(v).cast("long").alias("most")) for k, v in limits.items()])).alias("m"))
    return rows.select("m.*").where("value > most")


def running_budget(files: DataFrame, limit: int) -> DataFrame:
    """files with the bytes so far in path order within their folder, and whether that is inside the budget; see `ordered.running`."""
    return running(files, "folder", ["path"], F.col("bytes")).withColumn("inside", F.col("so_far") <= limit)
