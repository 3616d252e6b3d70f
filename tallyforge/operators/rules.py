"""Features of SQL files and the cost rules over them.

A file's features are counts of patterns in one pass over its text; every rule is a condition on those counts, its path
and its model's settings. All rules are judged in the same pass: a row's findings are an array that is exploded, so
forty rules cost one scan and no join, and files stay where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import joins as jn
from tallyforge.functions import sqltext as st
from tallyforge.functions import templates as tp
from tallyforge.functions import texts as tx
from tallyforge.operators.governance import evidence_key, identity

SEVERITIES = ("info", "low", "medium", "high", "critical")


#: Settings of a model that a feature row has, null where a project does not tell.
SETTINGS = ("materialized", "unique_key", "partition_by", "cluster_by", "incremental_strategy", "on_schema_change")
#: Methods of dataframe libraries that go row by row, and of dataframes and cursors that bring all rows to the caller.
ROW_WISE = ("iterrows", "itertuples")
COLLECTING = ("collect", "toPandas", "to_pandas", "to_dict", "fetchall", "fetchmany")


def _calls(methods: tuple[str, ...]) -> str:
    return r"\.\s*(?:" + "|".join(dict.fromkeys(m.lower() for m in methods)) + r")\s*\("


#: An apply over rows: the axis is named somewhere in its arguments.
_BY_ROW = r"\.\s*apply\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\baxis\s*=\s*(?:1\b|'\s*')"
#: On masked text; these may use what only Java's regular expressions have.
MORE_PATTERNS = {
    "comma_join": r"\bfrom\s+[a-z_][a-z0-9_.]*(?:\s+(?:as\s+)?(?!where\b|join\b|on\b)[a-z_][a-z0-9_]*)?\s*,\s*(?!unnest\b|lateral\b|table\b|flatten\b|(?:[a-z_]+\.)*(?:" + "|".join(st.SPINES) + r")\b)[a-z_]",
    "row_wise": rf"{_calls(ROW_WISE)}|{_BY_ROW}",
    "local_collection": _calls(COLLECTING),
    "merge_predicates": r"\bincremental_predicates?\b",
}
MORE_LITERAL_PATTERNS = {
    "config_append": r"incremental_strategy\s*=\s*'append'",
    "config_merge": r"incremental_strategy\s*=\s*'merge'",
    "config_sync_columns": r"on_schema_change\s*=\s*'sync_all_columns'",
}


def features(files: DataFrame) -> DataFrame:
    """files (path, text, ...) with a count column `n_<feature>` for each pattern, and what rules need of its shape.

    shaped: the text of `joins.shape` and its breaks; joins, nested: of `joins.joins` and `joins.correlated`; sliced: where
    filters on partition columns are joined by OR; bounded, block_bounded: whether the text, and its incremental block or
    else the text, has a bound; loose_sources: sources read without one; json_repeats, normal_repeats: equal calls at most.
    """
    masked, bare, text = F.col("_masked"), F.col("_bare"), F.col("text")
    rows = files.withColumns({n: F.lit(None).cast("string") for n in SETTINGS if n not in files.columns} | {"_masked": st.masked(text), "_bare": F.lower(st.without_comments(text)), "_cut": jn.cut(text), "_block": F.trim(tx.incremental_block(F.lower(text)))})
    rows = rows.withColumns({"_plain": tp.joined(F.col("_cut")), "_breaks": tp.breaks(F.col("_cut"))})  # columns of their own: who needs no places computes no breaks
    rows = rows.withColumn("_shaped", jn.shaped(F.col("_plain")))
    counts = {f"n_{n}": st.count(masked, p) for n, p in (st.PATTERNS | MORE_PATTERNS).items()} | {f"n_{n}": st.count(bare, p) for n, p in (st.LITERAL_PATTERNS | MORE_LITERAL_PATTERNS).items()}
    counts |= {"n_open_join": tx.unbounded_joins(masked), "cte_reuse": tx.cte_reuse(masked), "n_catalog": F.size(tx.catalogs(masked)), "json_repeats": tx.most_equal(tx.json_keys(bare)), "normal_repeats": tx.most_equal(tx.normalizations(masked))}
    shape = {"_scopes": jn.scopes(F.col("_shaped")), "sliced": tx.alternatives(F.col("_shaped"), st.BOUND_COLUMNS), "bounded": st.is_bounded(text)}
    loose = F.when(F.lower(text).contains("is_incremental"), tx.loose_sources(F.lower(text), [*st.BOUND_COLUMNS, *st.BOUND_PHRASES])).otherwise(tx.no_spans())
    rows = rows.withColumns(counts | shape | {"loose_sources": loose})
    shape = {"shaped": F.struct(F.col("_shaped").alias("text"), F.col("_breaks").alias("breaks")), "block_bounded": F.when(F.col("_block") == "", F.col("bounded")).otherwise(st.is_bounded(F.col("_block")))}
    return rows.withColumns(shape | {"joins": jn.joins(F.col("_scopes")), "nested": jn.correlated(F.col("_scopes"))}).drop("_masked", "_bare", "_cut", "_plain", "_breaks", "_shaped", "_scopes", "_block")


def _n(name: str) -> Column:
    return F.col(f"n_{name}")


def _raised(when: Column, usual: str = "medium") -> Column:
    return F.when(F.coalesce(when, F.lit(False)), "high").otherwise(usual)


def conditions(platform: str = "generic", json_from: int = 2) -> dict[str, tuple[str | Column, Column, str]]:
    """rule -> (severity, condition, name). Columns: those of features(), path, and a model's settings."""
    down, stage, macro = st.is_downstream(F.col("path")), st.is_staging(F.col("path")), st.is_macro(F.col("path"))
    mart = F.lower("path").contains("marts/")
    incremental = (F.col("materialized") == "incremental") | (_n("config_incremental") > 0)
    keyed = F.col("unique_key").isNotNull() | (_n("config_unique_key") > 0)
    appends = (F.lower("incremental_strategy") == "append") | (_n("config_append") > 0)
    appends = F.coalesce(appends, F.lit(False))
    merges = (F.lower("incremental_strategy") == "merge") | (_n("config_merge") > 0)
    wide = (_n("config_full_refresh") > 0) | (_n("config_sync_columns") > 0) | F.coalesce(F.lower("on_schema_change") == "sync_all_columns", F.lit(False))
    spine = F.lower("text").rlike(r"\bcross\s+join\s+(?:[a-z_]+\.)*(?:" + "|".join(st.SPINES) + r")\b")
    looks_raw = F.lower("text").contains("raw")
    found: dict[str, tuple[str | Column, Column, str]] = {
        "R001": ("medium", down & ~stage & (_n("select_star") > 0), "select star downstream"),
        "R002": (_raised(stage & looks_raw), F.col("json_repeats") >= json_from, "repeated json extraction"),
        "R003": ("medium", _n("regex_call") >= 2, "repeated regex"),
        "R004": ("high", incremental & ~keyed & ~appends, "incremental without unique key"),
        "R005": ("high", incremental & (_n("is_incremental") > 0) & ~F.col("block_bounded") & ~F.lower("text").contains("incremental_predicate"), "incremental without date predicate"),
        "R007": ("low", down & (_n("order_by") > 0) & (_n("limit") == 0), "order by without limit"),
        "R008": ("medium", ~macro & (_n("distinct") > 0) & (_n("group_by") == 0), "blind distinct"),
        "R009": ("low", F.col("normal_repeats") > 1, "repeated normalization"),
        "R011": ("medium", mart & (_n("source_call") > 0), "source in mart"),
        "R006": ("medium", ~macro & (_n("open_join") > 0), "unbounded join"),
        "R012": ("medium", ((_n("cross_join") > 0) & ~spine) | (_n("comma_join") > 0), "cross join"),
        "R014": ("low", ~macro & (F.col("cte_reuse") >= 3), "repeated cte"),
        "R019": ("high", incremental & (_n("is_incremental") > 0) & F.col("block_bounded") & (F.size("loose_sources") > 0), "unbounded source in incremental"),
        "R030": ("high", F.size("nested") > 0, "correlated subquery"),
        "R032": ("medium", F.size("sliced") > 0, "or across partition predicates"),
        "R035": ("medium", F.lit(platform in ("trino", "databricks")) & (_n("join") > 0) & (_n("catalog") > 1), "cross-catalog join"),
        "R043": ("medium", F.lit(platform == "snowflake") & incremental & merges & (_n("merge_predicates") == 0), "merge without target pruning"),
        "R013": ("medium", _n("window") > _n("window_partitioned"), "unpartitioned window"),
        "R016": ("high", ~stage & (_n("non_sargable") > 0), "non-sargable predicate"),
        "R017": ("medium", ~macro & ~stage & F.exists("joins", lambda j: j["hidden"]), "wrapped join key"),
        "R018": (_raised(stage | F.lower("path").contains("intermediate/")), _n("union") > _n("union_all"), "union without all"),
        "R020": (_raised(_n("count_distinct") > 1), down & (_n("count_distinct") > 0), "count distinct downstream"),
        "R021": ("medium", F.lit(platform == "bigquery") & (_n("wildcard_table") > 0) & ~F.lower("text").contains("_table_suffix"), "wildcard scan"),
        "R028": ("high", F.lit(platform in ("bigquery", "snowflake", "databricks")) & mart & F.col("materialized").isin("incremental", "table") & F.col("partition_by").isNull() & F.col("cluster_by").isNull(), "mart without partition or cluster"),
        "R029": ("medium", incremental & wide, "full refresh of an incremental model"),
        "R031": ("medium", _n("leading_wildcard") > 0, "leading wildcard"),
        "R033": ("high", _n("pattern_join") > 0, "pattern join"),
        "R034": ("medium", down & (_n("scalar_subquery") > 0), "scalar subquery"),
        "R036": ("high", (_n("row_explosion") > 0) & ((_n("distinct") > 0) | (_n("count_distinct") > 0)), "row explosion with dedup"),
        "R037": ("high", _n("not_in_subquery") > 0, "not in subquery"),
        "R040": ("medium", down & (F.col("materialized") == "table") & (_n("is_incremental") == 0) & F.col("bounded"), "table should be incremental"),
        "R041": ("medium", _n("unbounded_frame") > 0, "unbounded frame"),
        "R042": ("medium", F.lit(platform == "bigquery") & (_n("ref_call") + _n("source_call") > 0) & ~F.col("bounded"), "missing partition filter"),
        "R044": ("medium", _n("recursive_cte") > 0, "recursive cte"),
    }
    return {r: (s, c & ~_is_python(), name) for r, (s, c, name) in found.items()} | {
        "R010": ("high", _is_python() & (_n("row_wise") > 0), "row-wise python"),
        "R022": ("medium", _is_python() & (_n("local_collection") > 0), "local collection"),
    }


def _grade(severity: str | Column) -> Column:
    return F.lit(severity) if isinstance(severity, str) else severity


def _is_python() -> Column:
    return F.lower("path").endswith(".py")


def _judged(platform: str, only: tuple[str, ...] | None) -> list[tuple[str, tuple[str | Column, Column, str]]]:
    return [(r, c) for r, c in sorted(conditions(platform).items()) if only is None or r in only]


def findings(rows: DataFrame, platform: str = "generic", keep: tuple[str, ...] = (), only: tuple[str, ...] | None = None) -> DataFrame:
    """(model_id, path, rule, severity) and the columns in `keep` of all rules that a file meets, less what it suppresses itself.

    only: the rules to judge, where not all; features that they do not need are not computed then.
    """
    held = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(r).alias("rule"), _grade(s).alias("severity"))) for r, (s, c, _) in _judged(platform, only)]
    off = F.regexp_extract_all("text", F.lit(r"disable-file=\s*(R[0-9]{3})"), F.lit(1))
    out = rows.withColumns({"_off": off, "_held": F.array(*held)}).withColumn("f", F.explode(F.filter("_held", lambda x: x.isNotNull() & ~F.array_contains("_off", x["rule"]))))
    return out.select("model_id", "path", "f.rule", "f.severity", *keep)


#: What a rule's finding points at: the pattern of each occurrence. Rules that are not here concern a file as a whole.
_EACH = {
    "R001": st.PATTERNS["select_star"], "R007": st.PATTERNS["order_by"], "R008": st.PATTERNS["distinct"], "R012": rf"{st.PATTERNS['cross_join']}|{MORE_PATTERNS['comma_join']}", "R013": r"\bover\s*\((?!\s*partition\b)",
    "R016": st.PATTERNS["non_sargable"], "R018": r"\bunion\b(?!\s+all\b)", "R020": st.PATTERNS["count_distinct"],
    "R033": st.PATTERNS["pattern_join"], "R034": st.PATTERNS["scalar_subquery"], "R036": st.PATTERNS["row_explosion"], "R037": st.PATTERNS["not_in_subquery"], "R041": st.PATTERNS["unbounded_frame"], "R044": st.PATTERNS["recursive_cte"],
    "R010": MORE_PATTERNS["row_wise"], "R022": MORE_PATTERNS["local_collection"],
}
#: Rules that count calls: their finding is the first one.
_FIRST = {"R002": st.PATTERNS["json_call"], "R003": st.PATTERNS["regex_call"], "R009": st.PATTERNS["normalization"]}


#: Rules whose places come with the features.
_PLACED = {"R017": lambda: F.transform(F.filter("joins", lambda j: j["hidden"]), lambda j: F.struct(j["start"].alias("start"), j["predicate"].alias("found"))), "R019": lambda: F.col("loose_sources"), "R030": lambda: F.col("nested"), "R032": lambda: F.col("sliced")}
#: Rules whose places are offsets of the source itself, not of the shaped text.
_RAW = ("R019", "R031")


def _named(rule: str, severity: str | Column):
    return lambda p: F.struct(F.lit(rule).alias("rule"), _grade(severity).alias("severity"), F.lit(rule in _RAW).alias("raw"), p["start"].alias("start"), p["found"].alias("found"))


def _mapped(places: Column, breaks: Column) -> Column:
    """Places (rule, severity, raw, start, found) with their key and their first and last offset in the source."""
    ends = F.transform(places, lambda p: F.struct(p.alias("p"), (p["start"] + F.length(p["found"]) - 1).alias("last")))

    def one(x: Column) -> Column:
        p = x["p"]
        start = F.when(p["raw"], p["start"]).otherwise(tp.source_offset(breaks, p["start"]))
        end = F.when(p["raw"], x["last"]).otherwise(tp.source_offset(breaks, x["last"])) + 1
        return F.struct(p["rule"].alias("rule"), st.normalized(F.coalesce(p["found"], F.lit(""))).alias("key"), start.alias("start"), end.alias("end"), p["severity"].alias("severity"))

    return F.transform(ends, one)


def _numbered(places: Column) -> Column:
    """Places with `n`, their number among those of equal rule and key in ascending order: a sort and one walk in the row."""
    kind = "array<struct<rule:string,key:string,start:int,end:int,severity:string,n:int>>"
    first = F.struct(F.lit("").alias("rule"), F.lit("").alias("key"), F.lit(0).alias("n"), F.array().cast(kind).alias("out"))

    def step(s: Column, p: Column) -> Column:
        n = F.when((p["rule"] == s["rule"]) & (p["key"] == s["key"]), s["n"] + 1).otherwise(F.lit(1))
        return F.struct(p["rule"].alias("rule"), p["key"].alias("key"), n.alias("n"), F.concat(s["out"], F.array(F.struct(*[p[c].alias(c) for c in ("rule", "key", "start", "end", "severity")], n.alias("n")))).alias("out"))

    return F.aggregate(F.array_sort(places), first, step, lambda s: s["out"])


def located(rows: DataFrame, platform: str = "generic", keep: tuple[str, ...] = (), only: tuple[str, ...] | None = None) -> DataFrame:
    """(model_id, path, rule, severity, line, col, span, message, evidence, finding_id, *keep): a finding for each occurrence of a rule.

    rows: those of features(). Places are found in text without comments, literals and templates and mapped back, so line,
    column and span are those of the text itself. Evidence is the occurrence's normalized text and its number among equal
    ones, so an id outlives moved lines. What the text suppresses, for the file or the line, is left out. Line, column and
    span are null for rules on a whole file. only: the rules to judge, where not all.
    """
    rows = rows.withColumn("_raw", F.lower(tx.blanked(F.col("text"), False))).withColumn("_off", tx.suppressions(F.col("text")))
    nothing = F.array(F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("found")))
    unmet = F.array().cast("array<struct<rule:string,severity:string,raw:boolean,start:int,found:string>>")  # no slice of the places: that looks for them
    parts, names = [], []
    for rule, (severity, condition, name) in _judged(platform, only):
        pattern = _EACH.get(rule) or _FIRST.get(rule)
        if rule in _PLACED:
            places = _PLACED[rule]()
        elif rule == "R031":
            places = tx.spans(F.col("_raw"), st.LITERAL_PATTERNS["leading_wildcard"])
        else:
            places = tx.spans(F.col("shaped.text"), pattern) if pattern else nothing
        places = F.slice(places, 1, 1) if rule in _FIRST else places

        held = F.transform(places, _named(rule, severity))
        parts.append(F.when(F.coalesce(condition, F.lit(False)), held).otherwise(unmet))
        names.append((rule, name))
    message = F.create_map(*[F.lit(x) for pair in names for x in pair])
    rows = rows.select("model_id", "path", "_off", "text", "shaped", *keep, F.flatten(F.array(*parts)).alias("_places"))
    rows = rows.withColumn("_places", _mapped(F.col("_places"), F.col("shaped.breaks")))
    out = rows.withColumn("f", F.explode(_numbered(F.col("_places")))).select("model_id", "path", "_off", "text", *keep, "f.*")
    out = out.withColumn("_at", F.when(F.col("start").isNotNull(), tx.line_col(F.col("text"), F.col("start")))).select("*", "_at.*")
    hidden = F.exists("_off", lambda o: (o["rule"] == F.col("rule")) & (o["line"].isNull() | (o["line"] == F.coalesce("line", F.lit(-1)))))
    out = out.where(~hidden).withColumn("evidence", evidence_key("occurrence", key=F.col("key"), n=F.col("n").cast("string")))
    return out.select("model_id", "path", "rule", "severity", "line", "col", (F.col("end") - F.col("start")).alias("span"), message[F.col("rule")].alias("message"), "evidence", identity(F.col("rule"), F.col("path"), F.col("evidence")).alias("finding_id"), *keep)


def ordered(found: DataFrame) -> DataFrame:
    """Findings in a stable order for a report."""
    return found.orderBy("path", F.asc_nulls_first("line"), "rule", F.asc_nulls_first("col"), "evidence", "finding_id")


def at_least(found: DataFrame, confidence: int) -> DataFrame:
    """Findings of at least a confidence (a rank)."""
    return found.where(F.col("confidence") >= confidence)


def metadata_findings(files: DataFrame, manifest: DataFrame | None, made_at: str | None = None, most_bytes: int = 5 << 20) -> DataFrame:
    """(path, rule, severity) about the scan itself: no manifest, a file too large, a stale manifest, another checksum.

    files: (path, text, size, modified); manifest: (path, checksum), sha256 in hex. Files that the manifest does not know
    have no checksum to differ from. Without a manifest there is one finding with a null path.
    """
    large = files.where(F.col("size") > most_bytes).select("path", F.lit("R026").alias("rule"), F.lit("low").alias("severity"))
    if manifest is None:
        return large.union(files.sparkSession.createDataFrame([(None, "R023", "info")], "path string, rule string, severity string"))
    known = manifest.select("path", "checksum").where("checksum is not null")
    other = files.join(known, "path").where(F.lower("checksum") != F.sha2("text", 256)).select("path", F.lit("R046"), F.lit("low"))
    if made_at is None:
        return large.union(other)
    return large.union(other).union(files.where(F.col("modified") > F.lit(made_at).cast("timestamp")).select("path", F.lit("R045"), F.lit("info")))


def checksum_counts(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: files whose checksum agrees, differs, or is not in the manifest."""
    rows = files.join(manifest.select("path", "checksum"), "path", "left")
    same = F.lower("checksum") == F.sha2("text", 256)
    return rows.agg(F.count_if(same).alias("same"), F.count_if(~same).alias("other"), F.count_if(F.col("checksum").isNull()).alias("unknown"))


def shared_expressions(files: DataFrame, least: int = 3) -> DataFrame:
    """(key, files): normalized calls that occur in at least `least` files."""
    calls = F.regexp_extract_all(st.masked(F.col("text")), F.lit(r"\b(?:count|sum|json_extract|regexp_extract|lower|upper)\s*\([^()]*\)"), F.lit(0))
    rows = files.select("path", F.explode(F.array_distinct(F.transform(calls, st.normalized))).alias("key"))
    return rows.groupBy("key").agg(F.count_distinct("path").alias("files")).where(F.col("files") >= least)


def metrics(found: DataFrame) -> DataFrame:
    """(rule, severity, n) with totals by rule, by severity, and of all: one aggregation with grouping sets."""
    return found.groupingSets([["rule", "severity"], ["rule"], ["severity"], []], "rule", "severity").agg(F.count("*").alias("n"))


#: Rules that are not judged from a file's shape: (severity, name).
OTHER_RULES = {
    "R015": ("medium", "expensive expression across files"), "R023": ("info", "no manifest"), "R024": ("low", "settings file does not parse"), "R025": ("low", "project file has a problem"), "R026": ("low", "file skipped"),
    "R038": ("high", "fan-out join"), "R039": ("medium", "heavy view"), "R045": ("info", "stale manifest"), "R046": ("low", "checksum differs"), "R047": ("low", "artifact integrity"),
}


def catalog(spark) -> DataFrame:
    """(rule, name, severity, raised): every rule that can be reported, with its usual severity; raised: it can be higher."""
    shape = [(r, n, s if isinstance(s, str) else "medium", not isinstance(s, str)) for r, (s, _, n) in conditions().items()]
    return spark.createDataFrame(sorted(shape + [(r, n, s, False) for r, (s, n) in OTHER_RULES.items()]), "rule string, name string, severity string, raised boolean")
