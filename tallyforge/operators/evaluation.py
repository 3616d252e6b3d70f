"""Measures of labelled findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def confusion(rows: DataFrame) -> DataFrame:
    """(rule, severity, tp, fp, fn, tn, precision, recall, f1): of all, by rule and by severity, in one aggregation."""
    y, p = F.col("y_true") == 1, F.col("y_pred") == 1
    by = rows.groupingSets([["rule"], ["severity"], []], "rule", "severity").agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return by.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn)).withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn))


def mcc(counts: DataFrame) -> DataFrame:
    """counts with Matthews' correlation and balanced accuracy; 0 where a margin is empty."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    d = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.withColumn("mcc", F.when(d > 0, (tp * tn - fp * fn) / d).otherwise(0.0)).withColumn("balanced", (F.coalesce(_ratio(tp, tp + fn), F.lit(0.0)) + F.coalesce(_ratio(tn, tn + fp), F.lit(0.0))) / 2)


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    p, z2 = hits / n, Z * Z
    mid, half = p + z2 / (2 * n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return F.greatest(F.lit(0.0), (mid - half) / (1 + z2 / n)), F.least(F.lit(1.0), (mid + half) / (1 + z2 / n))


def ranking(rows: DataFrame, by: str = "severity") -> DataFrame:
    """(by, average_precision, roc_auc) of `score`: ties of a score count as one step; scores are aggregated first."""
    steps = rows.groupBy(by, "score").agg(F.sum("y_true").alias("p"), F.sum(1 - F.col("y_true")).alias("q"))
    w = Window.partitionBy(by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("cp", F.sum("p").over(w)).withColumn("cq", F.sum("q").over(w))
    total = steps.groupBy(by).agg(F.sum("p").alias("P"), F.sum("q").alias("Q"), F.sum(F.col("p") * F.col("cp") / (F.col("cp") + F.col("cq"))).alias("ap"), F.sum(F.col("q") * (F.col("cp") - F.col("p") / 2)).alias("auc"))
    return total.select(by, _ratio(F.col("ap"), F.col("P")).alias("average_precision"), _ratio(F.col("auc"), F.col("P") * F.col("Q")).alias("roc_auc"))


def kappa(rows: DataFrame, a: str = "y_true", b: str = "rater") -> DataFrame:
    """One row: Cohen's kappa of two raters and their agreement."""
    n = F.count("*")
    agree = F.count_if(F.col(a) == F.col(b)) / n
    chance = (F.sum(a) / n) * (F.sum(b) / n) + (1 - F.sum(a) / n) * (1 - F.sum(b) / n)
    return rows.agg(n.alias("n"), agree.alias("agreement"), F.when(chance < 1, (agree - chance) / (1 - chance)).otherwise(1.0).alias("kappa"))


def tiers(rows: DataFrame, least: int = 10) -> DataFrame:
    """(rule, n, precision, tier): rules with fewer than `least` samples are exempt."""
    by = rows.where("y_pred = 1").groupBy("rule").agg(F.count("*").alias("n"), F.avg("y_true").alias("precision"))
    p = F.col("precision")
    return by.withColumn("tier", F.when(F.col("n") < least, "exempt").when(p >= 0.95, "high").when(p >= 0.8, "medium").when(p >= 0.7, "low").otherwise("experimental"))


def capped_sample(rows: DataFrame, cap: int, by: str = "rule") -> DataFrame:
    """At most `cap` rows of each group, by savings from the top, ties by path and id."""
    w = Window.partitionBy(by).orderBy(F.desc("savings"), "path", "finding_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def coverage(cases: DataFrame, positive: int = 2, negative: int = 1) -> DataFrame:
    """(rule, expects, forbids, ok): whether each rule has enough cases of both kinds."""
    by = cases.groupBy("rule").agg(F.count_if("expect").alias("expects"), F.count_if(~F.col("expect")).alias("forbids"))
    return by.withColumn("ok", (F.col("expects") >= positive) & (F.col("forbids") >= negative))


#: Fixed ranks of severities and confidences.
SEVERITY_RANK = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
CONFIDENCE_RANK = {"low": 1, "medium": 2, "high": 3}


def diagnostic_score(costs: list[str], severity: Column, confidence: Column) -> Column:
    """The first positive cost, else severity times confidence (ranks)."""
    return F.coalesce(*[F.when(F.col(c) > 0, F.col(c)) for c in costs], (severity * confidence).cast("double"))


def adjudicated(verdict: Column, kind: Column) -> Column:
    """A finding's label by its verdict (tp or fp) and kind of false positive: tp, exempt, fp_bug or unknown."""
    return F.when(verdict == "tp", "tp").when((verdict == "fp") & (kind == "exempt"), "exempt").when(verdict == "fp", "fp_bug").otherwise("unknown")


def census(rows: DataFrame, scan_rules: tuple[str, ...] = ()) -> DataFrame:
    """(rule, total, examined, tp, exempt, fp_bug, unknown, passes, reason) of labelled findings (rule, label, examined)."""
    seen = F.col("examined")
    by = rows.groupBy("rule").agg(F.count("*").alias("total"), F.count_if(seen).alias("examined"), *[F.count_if(seen & (F.col("label") == k)).alias(k) for k in ("tp", "exempt", "fp_bug", "unknown")])
    scan, clean = F.col("rule").isin(*scan_rules) if scan_rules else F.lit(False), (F.col("fp_bug") == 0) & (F.col("unknown") == 0)
    reason = F.when(scan, "infrastructure").when(~clean, "fail").when(F.col("examined") < F.col("total"), F.format_string("sampled_%d_of_%d", "examined", "total")).otherwise("fully_examined")
    return by.withColumn("passes", scan | clean).withColumn("reason", reason)


def pooled_precision(counts: DataFrame) -> DataFrame:
    """(severity, examined, precision): of passing rules with examined findings, by severity and of all (null severity)."""
    rows = counts.where(F.col("passes") & (F.col("examined") > 0))
    return rows.groupingSets([["severity"], []], "severity").agg(F.sum("examined").alias("examined"), F.sum("tp").alias("tp")).select("severity", "examined", _ratio(F.col("tp"), F.col("examined")).alias("precision"))


def against_baseline(actual: DataFrame, limits: DataFrame) -> DataFrame:
    """(rule, problem) where counts (rule, n) break limits (rule, kind, n): exact, most, expect or forbid; a missing rule counts 0."""
    rows = limits.join(actual.select("rule", F.col("n").alias("_n")), "rule", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    k, n, a = F.col("kind"), F.col("n"), F.col("_n")
    problem = F.when((k == "exact") & (a != n), "count differs").when((k == "most") & (a > n), "too many").when((k == "expect") & (a == 0), "missing").when((k == "forbid") & (a > 0), "forbidden")
    return rows.select("rule", problem.alias("problem")).where("problem is not null")


def growth(small: DataFrame, large: DataFrame) -> DataFrame:
    """One row: time a model in a large run over that in a small one (median_ms, models)."""
    a = small.select(_ratio(F.col("median_ms"), F.col("models")).alias("_a"))
    return large.join(F.broadcast(a), F.lit(True)).select(_ratio(F.col("median_ms") / F.col("models"), F.col("_a")).alias("growth"))  # one row by one row


def failure_groups(failures: DataFrame, classes: list[tuple[str, str]], most: int | None = None) -> DataFrame:
    """(signature, group, n, example) of failures (message, path), with `most` only the most frequent signatures.

    A signature is the message in lower case with quoted values and numbers left out, '' for none. classes: (group, pattern)
    in order, the first that matches a signature names its group, else `other`. Example: the least path.
    """
    said = F.lower(F.coalesce("message", F.lit("")))
    said = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(said, "'[^']*'|\"[^\"]*\"|`[^`]*`", "<value>"), r"\d+", "#"), r"\s+", " "))
    by = failures.groupBy(said.alias("signature")).agg(F.count("*").alias("n"), F.min("path").alias("example"))
    group = F.coalesce(*[F.when(F.col("signature").rlike(p), g) for g, p in classes], F.lit("other"))
    out = by.select("signature", group.alias("group"), "n", "example")
    return out if most is None else out.orderBy(F.desc("n"), "signature").limit(most)


def stratified_tail(rows: DataFrame, primary: DataFrame, cap: int, by: list[str]) -> DataFrame:
    """At most `cap` rows of each stratum that are not in `primary` (finding_id), by savings from the top."""
    w = Window.partitionBy(*by).orderBy(F.desc("savings"), "path", "finding_id")
    return rows.join(primary.select("finding_id"), "finding_id", "left_anti").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def high_first(rows: DataFrame, n: int, seed: int, high: int) -> DataFrame:
    """A sample of n rows: the high ones first, then others in a seeded order; a top-k, no full sort."""
    return rows.orderBy((F.col("severity") < high), F.xxhash64(F.lit(seed), "finding_id"), "finding_id").limit(n)


def negative_sample(files: DataFrame, rules: DataFrame, fired: DataFrame, share: float, seed: int) -> DataFrame:
    """(path, rule, weight): of all files x rules that did not fire, a seeded share, each weighing 1 / share.

    Pairs are made in each file's row from the short list of rules, kept by their hash, and only then compared with what fired.
    """
    names = rules.agg(F.sort_array(F.collect_set("rule")).alias("_rules"))  # one row: the rules of a catalog
    pairs = files.select("path").distinct().join(F.broadcast(names), F.lit(True)).select("path", F.explode("_rules").alias("rule"))
    kept = pairs.where(F.pmod(F.xxhash64(F.lit(seed), "path", "rule"), F.lit(1_000_000)) < int(share * 1_000_000))
    return kept.join(fired.select("path", "rule").distinct(), ["path", "rule"], "left_anti").withColumn("weight", F.lit(1 / share))


def merged_labels(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key, the one with the greatest `ord`: later labels win."""
    return rows.groupBy(*key).agg(F.max_by("y_true", "ord").alias("y_true"))


def per_class(rows: DataFrame, a: str = "y_true", b: str = "rater") -> DataFrame:
    """(label, support, precision, recall) of rater b against a; a null of b is an abstention and counts in support only."""
    both = rows.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    sides = both.select(F.col("_a").alias("label"), F.lit(1).alias("s"), F.lit(0).alias("p"), (F.col("_a") == F.col("_b")).cast("int").alias("h")).union(both.select("_b", F.lit(0), F.lit(1), F.lit(0)).where("_b is not null"))
    by = sides.groupBy("label").agg(F.sum("s").alias("support"), F.sum("p").alias("p"), F.sum(F.coalesce("h", F.lit(0))).alias("h"))
    return by.select("label", "support", _ratio(F.col("h"), F.col("p")).alias("precision"), _ratio(F.col("h"), F.col("support")).alias("recall"))


def rated_items(ratings: DataFrame) -> DataFrame:
    """(item, raters, abstained, labels, disagreement) of ratings (item, rater, label), null labels being abstentions.

    One aggregate by item and label is the sparse matrix that all else is read from. labels: how many different ones;
    disagreement: the share of those who judged that chose another label than most did, null where nobody judged.
    """
    by = ratings.groupBy("item", "label").agg(F.count("*").alias("n"))
    judged = F.sum(F.when(F.col("label").isNotNull(), F.col("n")))
    most = F.max(F.when(F.col("label").isNotNull(), F.col("n")))
    return by.groupBy("item").agg(F.sum("n").alias("raters"), F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("n"))), F.lit(0)).alias("abstained"), F.count("label").alias("labels"), (1 - most / judged).alias("disagreement"))


def rating_rates(items: DataFrame) -> DataFrame:
    """One row of rated items: how many, and the shares of abstentions, of items nobody judged, and of items in dispute."""
    n = F.count("*")
    return items.agg(n.alias("items"), _ratio(F.sum("abstained"), F.sum("raters")).alias("abstention"), _ratio(F.count_if(F.col("labels") == 0), n).alias("unjudged"), _ratio(F.count_if(F.col("labels") > 1), n).alias("disputed"))


def most_disputed(items: DataFrame, most: int) -> DataFrame:
    """The items in dispute with the most disagreement, then most raters, then the least item; `most` of them."""
    return items.where("labels > 1").orderBy(F.desc("disagreement"), F.desc("raters"), "item").limit(most)
