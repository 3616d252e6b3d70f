"""What findings cost: rule multipliers, scan priors, structure and fan-out, savings of each finding, totals and trends."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import lognormal as ln

#: How much dearer a model is with a rule's finding, tenth and ninetieth percentile.
MULTIPLIERS = {
    "R001": (1.2, 2), "R002": (1.5, 3), "R003": (1.2, 2.5), "R004": (1.5, 4), "R005": (2, 8), "R006": (3, 20), "R007": (1.5, 4), "R008": (1.5, 3), "R009": (1.2, 2), "R010": (1.2, 2), "R011": (1.5, 3), "R012": (5, 50), "R013": (1.5, 3),
    "R014": (2, 6), "R015": (1.5, 4), "R016": (2, 10), "R017": (1.5, 4), "R018": (1.5, 3), "R019": (2, 8), "R020": (1.5, 3), "R021": (1.2, 2), "R022": (1.2, 2), "R028": (5, 100), "R029": (2, 10), "R030": (2, 8), "R031": (3, 20),
    "R032": (3, 30), "R033": (2, 10), "R034": (1.5, 5), "R035": (2, 8), "R036": (3, 20), "R037": (2, 10), "R038": (3, 20), "R039": (2, 8), "R040": (2, 10), "R041": (1.5, 3), "R042": (2, 10), "R043": (1.5, 4), "R044": (2, 10),
}
#: Factors of some rules by warehouse.
WAREHOUSE = {
    "bigquery": {"R001": 1.2, "R036": 1.2, "R006": 1.1, "R012": 1.1, "R028": 1.35, "R029": 1.35},
    "snowflake": {"R002": 1.15, "R003": 1.15, "R028": 1.15, "R006": 1.1, "R012": 1.1},
    "databricks": {"R006": 1.15, "R012": 1.15, "R013": 1.1, "R028": 1.25, "R029": 1.25},
    "trino": {"R001": 1.15, "R006": 1.15, "R012": 1.15, "R028": 1.2, "R029": 1.2},
    "redshift": {"R006": 1.15, "R012": 1.15, "R028": 1.15},
}
#: What part of a scan is left by (partition_by, else cluster_by, both in the other order) per warehouse.
SCAN = {"bigquery": ("partition_by", 0.5, "cluster_by", 0.7), "snowflake": ("cluster_by", 0.8, "partition_by", 0.75), "databricks": ("partition_by", 0.75, "cluster_by", 0.75)}
SCAN_ELSE, SCAN_VIEW, INCREMENTAL_FRACTION = ("partition_by", 0.7, "cluster_by", 0.7), 0.5, 0.05
#: Rules about what makes an incremental model unbounded: it gets no discount with them.
UNBOUNDED_RULES = ("R004", "R005", "R019", "R029")
#: Rules about the scan itself: they cost nothing and gate nothing.
INFRASTRUCTURE = ("R023", "R024", "R025", "R026", "R027", "R045", "R046", "R047")


def _sigma(cv: float) -> float:
    return math.sqrt(math.log1p(cv * cv))


def multiplier(rule: Column, warehouse: str = "generic", overrides: dict[str, float | tuple[float, float]] | None = None) -> Column:
    """struct<mu, sigma, basis> of a rule: an override (a point or a range), else the prior times the warehouse's factor; null without."""
    known: dict[str, tuple[float, float, str]] = {}
    for r, (low, high) in MULTIPLIERS.items():
        mu, sigma = (math.log(low) + math.log(high)) / 2, (math.log(high) - math.log(low)) / (2 * ln.Z90)
        f = WAREHOUSE.get(warehouse, {}).get(r)
        known[r] = (mu + math.log(f), math.hypot(sigma, _sigma(0.01)), f"warehouse-prior:{warehouse}") if f else (mu, sigma, "rule-prior:generic")
    for r, v in (overrides or {}).items():
        low, high = v if isinstance(v, tuple) else (v, v)
        known[r] = ((math.log(low) + math.log(high)) / 2, (math.log(high) - math.log(low)) / (2 * ln.Z90) if isinstance(v, tuple) else _sigma(0.2), "config-override")
    for r in INFRASTRUCTURE:
        known.pop(r, None)
    pairs = [x for r, (mu, s, b) in known.items() for x in (F.lit(r), F.struct(F.lit(mu).alias("mu"), F.lit(s).alias("sigma"), F.lit(b).alias("basis")))]
    return F.try_element_at(F.create_map(*pairs), F.upper(rule))


def scan_factor(warehouse: str = "generic") -> Column:
    """What a model's partitions, clusters and being a view leave of a scan. Columns: partition_by, cluster_by, materialized."""
    a, x, b, y = SCAN.get(warehouse, SCAN_ELSE)
    kept = F.when(F.col(a).isNotNull(), x).when(F.col(b).isNotNull(), y).otherwise(1.0)
    return kept * F.when(F.col("materialized") == "view", SCAN_VIEW).otherwise(1.0)


def incremental_factor(rule: Column | None = None, fraction: float = INCREMENTAL_FRACTION) -> Column:
    """A keyed incremental model without full refresh reads a fraction, unless the finding's rule says that it does not."""
    applies = (F.col("materialized") == "incremental") & ~F.coalesce(F.col("full_refresh"), F.lit(False)) & F.col("unique_key").isNotNull()
    if rule is not None:
        applies = applies & ~F.coalesce(rule.isin(*UNBOUNDED_RULES), F.lit(False))
    return F.when(applies, fraction).otherwise(1.0)


def structure_factor(rule: Column) -> Column:
    """A rule's weight by the features of its file (n_cross_join, n_join, n_select_star, n_window, cte_reuse); 1 where they are null."""
    n = lambda c: F.col(c)
    return F.coalesce(
        F.when(rule == "R012", F.when(n("n_cross_join") >= 2, 1.25).when(n("n_cross_join") == 0, 0.75))
        .when(rule == "R006", F.least(F.lit(1.5), 1 + 0.05 * n("n_join")))
        .when(rule == "R001", F.when(n("n_select_star") > 0, 1.15))
        .when(rule == "R013", F.when(n("n_window") > 1, 1.2))
        .when(rule == "R014", F.when(n("cte_reuse") > 2, 1.2)),
        F.lit(1.0),
    )


def attributed(findings: DataFrame, costs: DataFrame, fan_out: DataFrame, warehouse: str = "generic", overrides: dict | None = None) -> DataFrame:
    """findings with their savings: cost of the model x saved fraction of the rule x (structure x fan-out).

    findings: (model_id, rule, structure, ...); costs: (model_id, cost estimate, scan_bytes of a month); fan_out: (model_id,
    downstream, exposures). Findings of rules without a multiplier keep null savings and a reason; a model without a cost
    has null USD. Where costs have a `discount` (of an incremental model), rules in UNBOUNDED_RULES undo it: what they report
    is a full scan. Adds savings (estimate), savings_usd, gb_months, prior_basis, unestimated.
    """
    rows = findings.join(costs.select("model_id", "cost", "scan_bytes", *[c for c in ("discount", "is_observed") if c in costs.columns]), "model_id", "left").join(fan_out, "model_id", "left")
    if {"discount", "is_observed"} <= {*costs.columns}:
        undone = F.when(F.col("rule").isin(*UNBOUNDED_RULES), F.coalesce("discount", F.lit(1.0))).otherwise(1.0)
        cost = F.when(F.col("cost").isNotNull() & ~F.coalesce("is_observed", F.lit(False)), F.struct((F.col("cost.mu") - F.log(undone)).alias("mu"), F.col("cost.sigma").alias("sigma"))).otherwise(F.col("cost"))
        rows = rows.withColumns({"cost": cost, "scan_bytes": F.col("scan_bytes") / undone}).drop("discount", "is_observed")
    m = multiplier(F.col("rule"), warehouse, overrides)
    rows = rows.withColumn("_m", m).withColumn("fan_out", ln.fan_out_factor(F.coalesce("downstream", F.lit(0)), F.coalesce("exposures", F.lit(0))))
    weight = ln.times(ln.savings_fraction(F.col("_m")), ln.from_point(F.col("structure") * F.col("fan_out"), 0.2))
    rows = rows.withColumn("_w", F.when(F.col("_m").isNotNull(), weight)).withColumn("savings", F.when(F.col("cost").isNotNull(), ln.times(F.col("cost"), F.col("_w"))))
    reason = F.when(F.col("rule").isin(*INFRASTRUCTURE), None).when(F.col("_m").isNull(), "no default multiplier configured")
    return rows.select("*", ln.median(F.col("savings")).alias("savings_usd"), (F.col("scan_bytes") * ln.median(F.col("_w")) / 1e9).alias("gb_months"), F.col("_m.basis").alias("prior_basis"), reason.alias("unestimated")).drop("_m", "_w")


def capped(found: DataFrame, warehouse: str = "generic", overrides: dict | None = None) -> DataFrame:
    """Attributed findings whose savings, by model, sum to at most what mending all of them would save; both figures shrink alike.

    The windows are over the findings of one model.
    """
    w = Window.partitionBy("model_id")
    m = F.least(F.lit(20.0), F.greatest(F.lit(1.001), F.exp(F.sum(multiplier(F.col("rule"), warehouse, overrides)["mu"]).over(w))))
    whole = F.max(ln.median(F.col("cost"))).over(w)
    total, most = F.sum("savings_usd").over(w), F.greatest(F.lit(0.001), whole - whole / m)
    share = F.when(total > most, most / total).otherwise(1.0)
    return found.withColumn("_share", share).withColumns({"savings_usd": F.col("savings_usd") * F.col("_share"), "gb_months": F.col("gb_months") * F.coalesce("_share", F.lit(1.0))}).drop("_share")


def exposure_counts(exposures: DataFrame) -> DataFrame:
    """(model_id, exposures) of (exposure, depends_on), repeated rows once."""
    return exposures.distinct().groupBy(F.col("depends_on").alias("model_id")).agg(F.count("*").alias("exposures"))


def downstream_cost(reach: DataFrame, costs: DataFrame) -> DataFrame:
    """(seed, downstream, usd): what is below each seed and the median of its summed cost; null USD where none below has one."""
    rows = reach.join(costs.select(F.col("model_id").alias("node"), "cost"), "node", "left")
    return rows.groupBy("seed").agg(F.count("*").alias("downstream"), ln.summed(F.col("cost")).alias("_sum")).select("seed", "downstream", ln.median(F.col("_sum")).alias("usd"))


def ranked(findings: DataFrame) -> DataFrame:
    """findings in the order of a report: by USD where every priced finding has it, else by GB-months; ties by rule and path."""
    full = findings.agg(F.every(F.col("savings_usd").isNotNull()).alias("_full"))  # one row
    rows = findings.join(F.broadcast(full), F.lit(True))
    return rows.withColumn("value", F.when(F.col("_full"), F.col("savings_usd")).otherwise(F.col("gb_months"))).drop("_full").orderBy(F.desc_nulls_last("value"), "rule", "path")


def totals(findings: DataFrame) -> DataFrame:
    """One row: findings, highs, monthly and yearly USD and GB-months that they could save."""
    usd = F.sum("savings_usd")
    return findings.agg(F.count("*").alias("findings"), F.count_if(F.col("severity").isin("high", "critical")).alias("high"), usd.alias("usd"), F.round(usd * 12).alias("usd_year"), F.sum("gb_months").alias("gb_months"))


def trend(before: DataFrame, now: DataFrame) -> DataFrame:
    """One row of differences of two `totals`; a figure that either lacks stays null."""
    b = before.select(*[F.col(c).alias(f"_{c}") for c in before.columns])
    return now.join(F.broadcast(b), F.lit(True)).select(*[(F.col(c) - F.col(f"_{c}")).alias(c) for c in now.columns])  # one row by one row
