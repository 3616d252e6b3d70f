"""Monthly costs of models: observations, the volume ladder, the cost index, summaries and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import lognormal as ln
from tallyforge.operators.attribution import incremental_factor, scan_factor
from tallyforge.operators.ordered import upper_medians

PRICE_PER_BYTE = 6.25 / 1e12
CREDIT_USD = 3.0
DEFAULT_RUNS = 30.0
ROW_BYTES = 200.0
SECONDS_A_MONTH = 30 * 86400.0


def observe_monthly(observations: DataFrame, credit_usd: float = CREDIT_USD, price: float = PRICE_PER_BYTE) -> DataFrame:
    """Per model: monthly executions, bytes and USD, and the basis of the USD: usd, else credits, else bytes.

    The span runs from the first start to the last end, gaps included, and is at least a day; models without any of the
    three figures are dropped.
    """
    span = F.unix_timestamp(F.max("window_end")) - F.unix_timestamp(F.min("window_start"))
    sums = {c: F.sum(c) for c in ("executions", "bytes_processed", "credits", "cost_usd")}
    by = observations.groupBy("model_id").agg(F.greatest(span / SECONDS_A_MONTH, F.lit(1 / 30)).alias("months"), *[s.alias(c) for c, s in sums.items()])
    usd = F.when(F.col("cost_usd").isNotNull(), F.col("cost_usd")).when(F.col("credits").isNotNull(), F.col("credits") * credit_usd).otherwise(F.col("bytes_processed") * price)
    basis = F.when(F.col("cost_usd").isNotNull(), "usd").when(F.col("credits").isNotNull(), "credits").when(F.col("bytes_processed").isNotNull(), "bytes")
    return by.withColumn("basis", basis).where("basis is not null").select("model_id", "basis", (F.col("executions") / F.col("months")).alias("monthly_executions"), (F.col("bytes_processed") / F.col("months")).alias("monthly_bytes"), (usd / F.col("months")).alias("monthly_usd"))


def sibling_runs(models: DataFrame, observed: DataFrame) -> DataFrame:
    """Per folder the upper median of its models' monthly executions (no averaging of the middle two)."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    rows = models.join(observed, "model_id").select(folder.alias("folder"), F.greatest("monthly_executions", F.lit(1.0)).alias("runs"))
    return upper_medians(rows, "folder", "runs")


def volumes(models: DataFrame, observed: DataFrame, history: DataFrame, catalog: DataFrame, siblings: DataFrame | None = None, warehouse: str = "generic", overrides: DataFrame | None = None) -> DataFrame:
    """(model_id, basis, grade, bytes, runs, cv, discount, monthly_usd): observations, query history, catalog bytes, catalog rows, prior.

    What was not measured is scaled by what partitions, clusters and being a view leave of a scan, and by the discount of
    incremental models; runs that were not measured are an override (model_id, runs_override), else the siblings' median,
    else the default. discount: what the incremental discount left, 1 where it does not apply. monthly_usd: as observed.
    """
    rows = models.join(observed.select("model_id", "monthly_executions", "monthly_bytes", "monthly_usd"), "model_id", "left").join(history, "model_id", "left").join(catalog, "model_id", "left")
    for c, kind in (("partition_by", "string"), ("cluster_by", "string"), ("materialized", "string"), ("unique_key", "string"), ("full_refresh", "boolean")):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast(kind))
    seen = F.col("monthly_bytes").isNotNull()
    past, size, count = F.col("bytes_per_run").isNotNull(), F.col("num_bytes").isNotNull(), F.col("row_count").isNotNull()
    runs_default: Column = F.lit(DEFAULT_RUNS)
    if siblings is not None:
        rows = rows.withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")).join(siblings.withColumnRenamed("runs", "sibling"), "folder", "left")
        runs_default = F.coalesce("sibling", F.lit(DEFAULT_RUNS))
    if overrides is not None:
        rows = rows.join(overrides.select("model_id", "runs_override"), "model_id", "left")
        runs_default = F.coalesce("runs_override", runs_default)
    discount = F.when(seen | past, 1.0).otherwise(incremental_factor())
    scale = scan_factor(warehouse) * incremental_factor()
    return rows.select(
        "model_id",
        F.when(seen, "observed").when(past, "history").when(size, "catalog-bytes").when(count, "catalog-rows").otherwise("prior").alias("basis"),
        F.when(seen | past, "A").when(size | count, "B").otherwise("C").alias("grade"),
        F.when(seen, F.when(F.col("monthly_executions") > 0, F.col("monthly_bytes") / F.col("monthly_executions")).otherwise(F.col("monthly_bytes"))).when(past, F.col("bytes_per_run")).when(size, F.col("num_bytes") * scale).when(count, F.col("row_count") * ROW_BYTES * scale).otherwise(F.col("prior_bytes") * scale).alias("bytes"),
        F.when(seen, F.greatest("monthly_executions", F.lit(1.0))).when(past, F.col("runs_per_month")).otherwise(runs_default).alias("runs"),
        F.when(seen, 0.1).when(past, 0.2).when(size, 0.25).when(count, 0.35).otherwise(0.8).alias("cv"),
        discount.alias("discount"),
        "monthly_usd",
    )


def cost_index(volume: DataFrame, observed: DataFrame | None = None, price: float = PRICE_PER_BYTE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per model the monthly cost as an estimate: observed USD, else scan volume times the price of a byte.

    observed: where its monthly_usd counts instead of the volume's own, which spares a second aggregation of the
    observations. keep: further columns of volume.
    """
    scan = ln.times(ln.times(F.struct(F.ln("bytes").alias("mu"), F.sqrt(F.log1p(F.col("cv") * F.col("cv"))).alias("sigma")), ln.from_point(F.col("runs"), 0.1)), ln.from_point(F.lit(price), 0.05))
    rows = volume if observed is None else volume.drop("monthly_usd").join(observed.select("model_id", "monthly_usd"), "model_id", "left")
    return rows.select("model_id", "grade", F.when(F.col("monthly_usd") > 0, ln.from_point(F.col("monthly_usd"), 0.1)).otherwise(scan).alias("cost"), (F.col("monthly_usd") > 0).alias("is_observed"), *keep)


def top_models(costs: DataFrame, n: int = 5) -> DataFrame:
    """The n dearest models, ties by id: a top-k, no full sort."""
    return costs.withColumn("usd", ln.median(F.col("cost"))).orderBy(F.desc("usd"), "model_id").limit(n)


def summary(costs: DataFrame) -> DataFrame:
    """One row: totals, grades and the observed share; partial sums of moments only."""
    return costs.agg(
        F.count("*").alias("models"), *[F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABC"], F.count_if("is_observed").alias("observed"), ln.summed(F.col("cost")).alias("total"),
    )


def realized_savings(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per model in both: the change of cost, split into efficiency (cost of a run) and volume (runs)."""
    b = before.select("model_id", F.col("monthly_usd").alias("b"), F.greatest("monthly_executions", F.lit(1.0)).alias("eb"))
    a = after.select("model_id", F.col("monthly_usd").alias("a"), F.greatest("monthly_executions", F.lit(1.0)).alias("ea"))
    rows = b.join(a, "model_id")
    return rows.select("model_id", (F.col("b") - F.col("a")).alias("saved"), ((F.col("b") / F.col("eb") - F.col("a") / F.col("ea")) * (F.col("eb") + F.col("ea")) / 2).alias("efficiency"), ((F.col("ea") - F.col("eb")) * F.col("a") / F.col("ea")).alias("volume"))


def capped_savings(findings: DataFrame) -> DataFrame:
    """findings (model_id, cost, multiplier, raw) with `scaled`: a model's savings sum to at most what fixing all gives."""
    w = Window.partitionBy("model_id")
    m = F.least(F.lit(20.0), F.greatest(F.lit(1.001), F.exp(F.sum(F.ln("multiplier")).over(w))))
    cap = F.greatest(F.lit(0.001), F.col("cost") - F.col("cost") / m)
    total = F.sum("raw").over(w)
    return findings.withColumn("scaled", F.when(total > cap, F.col("raw") * cap / total).otherwise(F.col("raw")))


def pr_impact(base: DataFrame, head: DataFrame) -> DataFrame:
    """One row: net monthly change, and its introduced and avoided parts; null unless all models on both sides have USD."""
    one = lambda d, name: d.agg(F.sum("usd").alias(name), F.count_if(F.col("usd").isNull()).alias(f"{name}_missing"))
    both = one(base, "base").join(F.broadcast(one(head, "head")))  # one row by one row
    full = (F.col("base_missing") == 0) & (F.col("head_missing") == 0)
    net = F.when(full, F.col("head") - F.col("base"))
    return both.select(net.alias("net"), F.greatest(net, F.when(full, F.lit(0.0))).alias("introduced"), F.greatest(-net, F.when(full, F.lit(0.0))).alias("avoided"))


def violations(observations: DataFrame) -> DataFrame:
    """Rows of a bundle that break its rules: a window that ends before it begins, negative figures, repeated windows."""
    w = Window.partitionBy("model_id", "window_start", "window_end")
    rows = observations.withColumn("_n", F.count("*").over(w))
    bad = {
        "window": F.col("window_end") <= F.col("window_start"),
        "negative": (F.col("executions") < 0) | (F.col("bytes_processed") < 0) | (F.col("credits") < 0) | (F.col("cost_usd") < 0),
        "repeated": F.col("_n") > 1,
    }
    reasons = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in bad.items()]), lambda x: x.isNotNull())
    return rows.withColumn("reason", F.explode(reasons)).drop("_n")


def aliased(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Vendor export columns under common names: of each list the first column that is present counts, even if null."""
    names = {c.lower(): c for c in rows.columns}
    return rows.select(*[next((F.col(f"`{names[a]}`") for a in options if a in names), F.lit(None)).alias(common) for common, options in aliases.items()])


def coverage(index: DataFrame, observations: DataFrame, now: str) -> DataFrame:
    """One row: models, those with measured figures and with a cost, both as fractions, and the age in days of the stalest observation.

    index: of cost_index; observations: (model_id, window_end), of which each model's last counts.
    """
    last = observations.groupBy("model_id").agg(F.max("window_end").alias("_end"))
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("_end")) / 86400.0
    measured = (F.col("grade") == "A") | F.coalesce("is_observed", F.lit(False))
    rows = index.select("model_id", "grade", "is_observed", "cost").join(last, "model_id", "left")
    n = F.count("*")
    rows = rows.agg(n.alias("models"), F.count_if(measured).alias("measured"), F.count("cost").alias("with_cost"), F.max(age).alias("age_days"))
    fraction = lambda c: F.when(F.col("models") > 0, F.col(c) / F.col("models")).otherwise(0.0)
    return rows.select("models", "measured", fraction("measured").alias("measured_fraction"), "with_cost", fraction("with_cost").alias("cost_fraction"), "age_days")
