"""More columns over source text: masks that keep offsets, spans of matches, suppressions, references, sizes, tests of names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions import lognormal as ln
from tallyforge.functions import sqltext as st

_QUIET = r"'(?:[^']|'')*'|--[^\n]*|/\*(?s:.*?)\*/|\{#(?s:.*?)#\}"


def unless(text: Column, needed: tuple[str, ...], worked: Column, plain: Column) -> Column:
    """worked where text holds one of the strings that its pattern needs, else `plain`; null for null. A search for a fixed string costs little."""
    held = F.lit(False)
    for n in needed:
        held = held | text.contains(n)
    return F.when(held, worked).when(text.isNotNull(), plain)


def replaced(text: Column, pattern: str, instead) -> Column:
    """text with each match replaced by instead(match)."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(parts, found, lambda a, b: F.concat(a, F.when(b.isNull(), F.lit("")).otherwise(instead(b)))), "")


def blanked(text: Column, literals: bool = True) -> Column:
    """Comments, and what is inside single quotes with `literals`, as blanks: every other character keeps its offset and line."""
    blank = lambda t: F.regexp_replace(t, r"[^\n]", " ")
    quoted = lambda t: F.concat(F.lit("'"), blank(F.substring(t, F.lit(2), F.length(t) - 2)), F.lit("'"))
    blanks = replaced(text, _QUIET, lambda t: F.when(t.startswith("'"), quoted(t) if literals else t).otherwise(blank(t)))
    return unless(text, (*st.COMMENTS, "'") if literals else st.COMMENTS, blanks, text)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, found>>: each match of a pattern (no empty ones) with its 0-based offset, in one pass over the matches."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.filter(F.zip_with(parts, found, lambda a, b: F.struct(F.length(a).alias("before"), b.alias("found"))), lambda x: x["found"].isNotNull())

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["before"]
        return F.struct((start + F.length(x["found"])).alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), x["found"].alias("found")))).alias("out"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,found:string>>").alias("out")), step, lambda s: s["out"])


def no_spans() -> Column:
    return F.array().cast("array<struct<start:int,found:string>>")


def line_col(text: Column, offset: Column) -> Column:
    """struct<line, col> of a 0-based offset, both from 1."""
    head = F.substring(text, F.lit(1), offset)
    return F.struct((F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).alias("line"), (F.length(F.substring_index(head, "\n", -1)) + 1).alias("col"))


def _rules_after(line: Column, word: str) -> Column:
    listed = F.regexp_extract(F.coalesce(line, F.lit("")), rf"(?:^|[\s:]){word}=\s*([A-Za-z0-9_]+(?:\s*,\s*[A-Za-z0-9_]+)*)", 1)
    return F.when(listed != "", F.transform(F.split(listed, ","), lambda x: F.upper(F.trim(x)))).otherwise(F.array().cast("array<string>"))


def suppressions(text: Column) -> Column:
    """array<struct<rule, line>>: what a text switches off; line is null for the whole file.

    `disable-file=`, `disable-next-line=` and `disable=` take rules with commas between them.
    """
    lines = F.split(text, "\n")
    here = lambda x, i: F.transform(_rules_after(x, "disable"), lambda r: F.struct(r.alias("rule"), (i + 1).alias("line")))
    after = lambda x, i: F.transform(_rules_after(x, "disable-next-line"), lambda r: F.struct(r.alias("rule"), (i + 2).alias("line")))
    whole = lambda x: F.transform(_rules_after(x, "disable-file"), lambda r: F.struct(r.alias("rule"), F.lit(None).cast("int").alias("line")))
    return F.flatten(F.transform(lines, lambda x, i: F.concat(whole(x), after(x, i), here(x, i))))


def references(text: Column) -> Column:
    """array<struct<kind, package, name>> of ref('name'), ref('package', 'name') and source('package', 'name') outside comments."""
    bare = replaced(text, _QUIET, lambda t: F.when(t.startswith("'"), t).otherwise(F.lit(" ")))
    calls = F.regexp_extract_all(bare, F.lit(r"\b(?:ref|source)\s*\(\s*(?:'[^']*'|\"[^\"]*\")(?:\s*,\s*(?:'[^']*'|\"[^\"]*\"))?"), F.lit(0))

    def one(call: Column) -> Column:
        names = F.transform(F.regexp_extract_all(call, F.lit("'[^']*'|\"[^\"]*\""), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
        return F.struct(F.regexp_extract(call, "^([a-z]+)", 1).alias("kind"), F.when(F.size(names) == 2, F.get(names, F.lit(0))).alias("package"), F.get(names, F.size(names) - 1).alias("name"))

    return F.transform(calls, one).cast("array<struct<kind:string,package:string,name:string>>")


_TAG = r"\{%-?\s*(?:if|elif|else|endif)\b(?s:.*?)%\}"
_OPENS = r"^(?i)\{%-?\s*(?:if|elif)\s+is_incremental\s*\(\s*\)\s*-?%\}"


def incremental_span(text: Column) -> Column:
    """struct<start, end> of what stands between the first `if is_incremental()` and its own `endif`, nested blocks inside; else null.

    A walk over the template tags: each `if` goes a level down, each `endif` up; `else` and `elif` are part of the block.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))

    def step(s: Column, tag: Column) -> Column:
        inside, closed = s["start"].isNotNull(), s["end"].isNotNull()
        deeper = F.when(tag["found"].rlike(r"^\{%-?\s*if\b"), 1).when(tag["found"].rlike(r"^\{%-?\s*endif\b"), -1).otherwise(0)
        opens = ~inside & tag["found"].rlike(_OPENS)
        depth = F.when(opens, 1).when(inside, s["depth"] + deeper).otherwise(0)
        end = F.when(inside & (depth == 0), tag["start"])
        return F.when(closed, s).otherwise(F.struct(depth.alias("depth"), F.when(opens, tag["start"] + F.length(tag["found"])).otherwise(s["start"]).alias("start"), end.alias("end")))

    span = F.aggregate(spans(text, _TAG), start, step)
    return F.when(span["end"].isNotNull(), F.struct(span["start"].alias("start"), span["end"].alias("end")))


def incremental_block(text: Column) -> Column:
    """The text of `incremental_span`; empty without one."""
    cut = F.transform(F.array(incremental_span(text)), lambda span: F.substring(text, span["start"] + 1, span["end"] - span["start"]))
    return F.when(text.contains("is_incremental"), F.coalesce(F.get(cut, F.lit(0)), F.lit(""))).otherwise("")


def loose_sources(text: Column, bounds: list[str]) -> Column:
    """array<struct<start, found>> of the source() calls of lower-case text that are read without a bound.

    A call is read from the last select before it up to the end of its parentheses' query, or for 1,200 characters; it is
    loose if none of the spans of `bounds` lies inside.
    """
    calls, held = spans(text, r"source\("), spans(text, "|".join(map(re.escape, sorted(bounds, key=len, reverse=True))))

    def loose(c: Column) -> Column:
        head = F.substring(text, F.lit(1), c["start"])
        begin = F.when(head.contains("select"), F.length(head) - F.length(F.substring_index(head, "select", -1)) - 6).otherwise(0)
        close = F.locate("),", F.substring(text, c["start"] + 1, F.length(text)))
        end = F.when(close > 0, c["start"] + close - 1).otherwise(F.least(F.length(text), c["start"] + 1200))
        return ~F.exists(held, lambda b: (b["start"] >= begin) & (b["start"] + F.length(b["found"]) <= end))

    return F.filter(calls, loose)


def alternatives(text: Column, columns: list[str]) -> Column:
    """array<struct<start, found>> of the filters in which OR stands between predicates on listed columns."""
    filters = spans(text, r"\bwhere\b(?s:.*?)(?=\b(?:group\s+by|order\s+by|having|qualify|limit|union|where)\b|;|$)")
    filters = F.filter(filters, lambda f: f["found"].rlike(r"\bor\b"))
    named = rf"(?:^|[^a-z0-9])_?(?:{'|'.join(c.lstrip('_') for c in columns)})\b"
    return unless(text, ("where",), F.filter(filters, lambda f: F.size(F.filter(F.split(f["found"], r"\bor\b"), lambda part: part.rlike(named))) > 1), no_spans())


def json_keys(text: Column) -> Column:
    """The keys of a text's calls that take values out of JSON."""
    calls = F.regexp_extract_all(text, F.lit(r"\b(?:json_extract|json_extract_scalar|json_value|json_query|parse_json|get_path)\s*\([^)]*"), F.lit(0))
    return F.transform(calls, json_key)


def normalizations(text: Column) -> Column:
    """Calls like lower(trim(x)), each as one string."""
    calls = F.regexp_extract_all(text, F.lit(r"\b(?:lower|upper)\s*\(\s*trim\s*\([^)]*\)\s*\)"), F.lit(0))
    return F.transform(calls, lambda c: F.regexp_replace(c, r"\s+", " "))


def most_equal(values: Column) -> Column:
    """How often the most frequent of the values occurs; 0 of none."""
    return F.coalesce(F.array_max(F.transform(F.array_distinct(values), lambda d: F.size(F.filter(values, lambda v: v == d)))), F.lit(0))


def json_key(call: Column) -> Column:
    """The first argument of a call, normalized."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_extract(call, r"\(([^,)]*)", 1), r"\s+", " ")))


def posix_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


#: Fixed: decimal units of sizes.
UNITS = {"B": 1.0, "KB": 1e3, "MB": 1e6, "GB": 1e9, "TB": 1e12, "PB": 1e15}


def parsed_bytes(size: Column) -> Column:
    """'12TB' or '3.5 gb' or '100' as a number of bytes; null for anything else."""
    number, unit = F.regexp_extract(F.trim(size), r"^([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)$", 1), F.upper(F.regexp_extract(F.trim(size), r"^[0-9.]+\s*([A-Za-z]*)$", 1))
    scale = F.when(unit == "", F.lit(1.0))
    for u, s in UNITS.items():
        scale = scale.when(unit == u, F.lit(s))
    return F.when(number != "", F.expr("1D") * number.try_cast("double") * scale)


def _tenths(y: Column) -> Column:
    """y in tenths, rounded by the exact value of the double, ties to even; Java's formats round its shortest decimal form."""
    k = F.floor(y * 10)
    high = y.cast("float").cast("double")
    over = (high * 20 - (2 * k + 1)) + (y - high) * 20  # both products are exact, so the sign is
    return k + ((over > 0) | ((over == 0) & (k % 2 == 1))).cast("long")


def shown_bytes(size: Column) -> Column:
    """Bytes for reading: TB with one decimal, whole GB, whole MB; ties to even."""
    tenths, whole = _tenths(size / 1e12), lambda unit: F.rint(size / unit).cast("long").cast("string")
    return (
        F.when(size >= 1e12, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("TB")))
        .when(size >= 1e9, F.concat(whole(1e9), F.lit("GB"))).when(size.isNotNull(), F.concat(whole(1e6), F.lit("MB")))
    )


def has_equality(predicate: Column) -> Column:
    """Whether a predicate holds an = that is no part of <= >= != == or =>."""
    return predicate.rlike(r"(?<![<>!=])=(?![>=])")


def is_partition_column(name: Column, columns: list[str]) -> Column:
    """A listed name, or one that ends with _ and a listed name."""
    return F.lower(name).rlike("(?:^|_)(?:" + "|".join(columns) + ")$")


def unbounded_joins(masked: Column) -> Column:
    """How many joins other than cross joins and calls have neither USING nor an equality before the next join or clause."""
    parts = F.split(masked, r"\bjoin\b", -1)

    def open_(part: Column, i: Column) -> Column:
        before, predicate = F.get(parts, i - 1), F.element_at(F.split(part, r"\b(?:where|group\s+by|order\s+by|having|union|qualify|limit)\b", 2), 1)
        return (i > 0) & ~before.rlike(r"\b(?:cross|natural|lateral)\s*$") & ~predicate.rlike(r"\busing\s*\(|^\s*(?:lateral|unnest|flatten|table)\b") & ~has_equality(predicate)

    return unless(masked, ("join",), F.size(F.filter(parts, open_)), F.lit(0))


def cte_reuse(masked: Column) -> Column:
    """The most references, as a table, that any common table expression of a text has."""
    names = F.array_distinct(F.regexp_extract_all(masked, F.lit(r"(?:\bwith\s+(?:recursive\s+)?|\)\s*,\s*)([a-z_][a-z0-9_]*)\s+as\s*\("), F.lit(1)))
    tables = F.regexp_extract_all(masked, F.lit(r"\b(?:from|join)\s+([a-z_][a-z0-9_]*)(?![a-z0-9_.])"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(names, lambda n: F.size(F.filter(tables, lambda t: t == n)))), F.lit(0))


def catalogs(masked: Column) -> Column:
    """The different first parts of three-part table names."""
    return F.array_distinct(F.regexp_extract_all(masked, F.lit(r"\b(?:from|join)\s+`?([a-z0-9_-]+)`?\.`?[a-z0-9_-]+`?\.`?[a-z0-9_-]+"), F.lit(1)))


def config_values(text: Column) -> Column:
    """map<string, string> of the settings in a text's config() calls: quotes taken off, lists by commas; of repeated ones the last.

    Values are texts, numbers, true and false, and lists of these; others (calls, mappings) are left out, as are comments.
    """
    plain = r"'[^']*'|\"[^\"]*\"|[\w.+-]+"
    calls = F.regexp_extract_all(blanked(text, False), F.lit(r"\bconfig\s*\(((?:[^()'\"]++|'[^']*+'|\"[^\"]*+\"|\([^()]*+\))*+)\)"), F.lit(1))
    pair = rf"\b([a-z_]+)\s*=\s*(?:{plain}|\[[^\]]*\])(?=\s*(?:,|$))"
    found = F.flatten(F.transform(calls, lambda c: F.regexp_extract_all(F.regexp_replace(c, r"\s+", " "), F.lit(pair), F.lit(0))))
    bare = lambda v: F.regexp_replace(F.trim(v), r"^['\"]|['\"]$", "")
    value = lambda v: F.when(v.startswith("["), F.array_join(F.transform(F.split(F.regexp_replace(v, r"^\[\s*|\s*,?\s*\]$", ""), ","), bare), ",")).otherwise(bare(v))
    entry = lambda p: F.struct(F.regexp_extract(p, r"^([a-z_]+)", 1).alias("key"), value(F.trim(F.regexp_replace(p, r"^[a-z_]+\s*=", ""))).alias("value"))
    entries = F.transform(found, entry).cast("array<struct<key:string,value:string>>")
    keys = F.transform(entries, lambda e: e["key"])
    last = F.filter(entries, lambda e, i: F.array_position(F.slice(keys, i + 2, F.size(keys)), e["key"]) == 0)
    return F.map_from_entries(last)


def shown_usd(usd: Column) -> Column:
    """Dollars for reading, by two significant digits: $7, $1.2k, $12k, $3M; ties to even."""
    v = ln.round_sig2(usd)
    whole = lambda x: F.rint(x).cast("long").cast("string")
    return (
        F.when(v >= 1e6, F.concat(F.lit("$"), whole(v / 1e6), F.lit("M"))).when(v >= 1e4, F.concat(F.lit("$"), whole(v / 1e3), F.lit("k")))
        .when(v >= 1e3, F.concat(F.lit("$"), F.format_string("%.1f", v / 1e3), F.lit("k"))).when(v.isNotNull(), F.concat(F.lit("$"), whole(v)))
    )
