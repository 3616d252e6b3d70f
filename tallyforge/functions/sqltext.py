"""Columns over SQL source text: masking, normalization, and patterns of shapes that cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: How comments begin.
COMMENTS = ("--", "/*", "{#")


def without_comments(text: Column) -> Column:
    """Line, block and template comments removed; text inside single quotes stays."""
    bare = F.regexp_replace(text, r"('(?:[^']|'')*')|--[^\n]*|/\*(?s:.*?)\*/|\{#(?s:.*?)#\}", "$1")
    return F.when(text.contains(COMMENTS[0]) | text.contains(COMMENTS[1]) | text.contains(COMMENTS[2]), bare).otherwise(text)


def masked(text: Column) -> Column:
    """Comments removed, string literals emptied, lower case: what shape patterns look at."""
    return F.lower(F.regexp_replace(without_comments(text), "'(?:[^']|'')*'", "''"))


def normalized(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def line_of(text: Column, offset: Column) -> Column:
    """1 + the line breaks before a 0-based offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def lines_of(text: Column, pattern: str) -> Column:
    """(line, n) of each line of the whole text where a pattern without line breaks matches, n times."""
    counts = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.regexp_count(x, F.lit(pattern)).alias("n")))
    return F.filter(counts, lambda c: c["n"] > 0)


#: Fixed parts of paths that tell the layer of a model.
STAGING = ("staging/", "/stg_", "/stage/")
DOWNSTREAM = ("marts/", "mart/", "intermediate/", "/int_", "/fct_", "/dim_", "/core/", "/analytics/", "/reporting/")
MACROS = ("/macros/", "/dbt_macros/", "^dbt_macros/")


def is_staging(path: Column) -> Column:
    return F.lower(path).rlike("|".join(STAGING))


def is_downstream(path: Column) -> Column:
    return F.lower(path).rlike("|".join(DOWNSTREAM))


def is_macro(path: Column) -> Column:
    return F.lower(path).rlike("|".join(MACROS))


#: Fixed lists: columns and phrases that bound a scan.
BOUND_COLUMNS = "updated_at created_at event_date ingested_at _partitiontime _partitiondate partition_date block_time evt_block_time block_date block_timestamp block_number block_num evt_block_number evt_block_date block_day dbt_internal_dest".split()
BOUND_PHRASES = [" date_trunc(", " minute", " hour", "not in (select", "from {{ this }}", "> (select max(", "except select", "where id not in", "incremental_predicate("]
#: Fixed names of date spines.
SPINES = "check_date date_spine time_seq calendar dates time_dimension date_ranges create_date_range create_week_range create_month_range clean_month_range".split()


def is_bounded(text: Column) -> Column:
    low = F.lower(text)
    cond = F.lit(False)
    for needle in [*BOUND_COLUMNS, *BOUND_PHRASES]:
        cond = cond | low.contains(needle)
    return cond


#: Patterns on masked text; \b and classes mean the same in Java's and RE2's syntax.
PATTERNS: dict[str, str] = {
    "select_star": r"(?:\bselect\b(?:\s+(?:all|distinct)\b)?|,)\s*(?:\w+\s*\.\s*){0,3}\*",
    "order_by": r"\border\s+by\b",
    "group_by": r"\bgroup\s+by\b",
    "limit": r"\blimit\b",
    "distinct": r"\bselect\s+distinct\b",
    "union": r"\bunion\b",
    "union_all": r"\bunion\s+all\b",
    "count_distinct": r"\bcount\s*\(\s*distinct\b",
    "cross_join": r"\bcross\s+join\b",
    "join": r"\bjoin\b",
    "recursive_cte": r"\bwith\s+recursive\b",
    "window": r"\bover\s*\(",
    "window_partitioned": r"\bover\s*\(\s*partition\s+by\b",
    "unbounded_frame": r"\bunbounded\s+preceding\s+and\s+unbounded\s+following\b",
    "not_in_subquery": r"\bnot\s+in\s*\(\s*select\b",
    "scalar_subquery": r",\s*\(\s*select\b",
    "row_explosion": r"\b(?:unnest|flatten|explode)\s*\(",
    "json_call": r"\b(?:json_extract|json_extract_scalar|json_value|json_query|parse_json|get_path)\s*\(",
    "regex_call": r"\b(?:regexp_extract|regexp_replace|regexp_substr|regexp_contains|rlike|regexp_like)\s*\(",
    "normalization": r"\b(?:lower|upper)\s*\(\s*trim\s*\(",
    "wildcard_table": r"\bfrom\s+`[^`]*\*`",
    "non_sargable": r"\bwhere\b[^;]*\b(?:date|timestamp_trunc|datetime|to_date|trunc)\s*\(\s*(?:[a-z_]+\.)?(?:event_date|updated_at|created_at|event_time|partition_date|block_time|block_date)\b",
    "wrapped_join_key": r"\bon\s+(?:lower|upper|trim|cast|date|date_trunc|to_char|coalesce)\s*\(",
    "pattern_join": r"\bon\s+[a-z_.]+\s+(?:like|ilike|rlike)\b",
    "cte": r"\b[a-z_][a-z0-9_]*\s+as\s*\(\s*select\b",
}
#: Patterns that need literals: on text without comments, lower case.
LITERAL_PATTERNS: dict[str, str] = {
    "leading_wildcard": r"\blike\s+'[%_]",
    "source_call": r"\bsource\s*\(\s*'[^']*'\s*,\s*'[^']*'\s*\)",
    "ref_call": r"\bref\s*\(\s*'[^']*'\s*\)",
    "is_incremental": r"\bis_incremental\s*\(\s*\)",
    "config_incremental": r"materialized\s*=\s*'incremental'",
    "config_unique_key": r"unique_key\s*=",
    "config_full_refresh": r"full_refresh\s*=\s*true",
}


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))
