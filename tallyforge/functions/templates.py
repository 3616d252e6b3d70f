"""Template expressions in SQL text: taken out, with a map back to the offsets of the source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An expression, or a block. What is never closed stays in the text.
TEMPLATE = r"\{\{(?s:.*?)\}\}|\{%(?s:.*?)%\}"
#: Fixed: what stands for an expression that names no relation.
PLACEHOLDER = "__jinja__"
_CALL = r"^\{\{-?\s*(ref|source)\s*\(\s*['\"]([^'\"]*)['\"]\s*(?:,\s*['\"]([^'\"]*)['\"]\s*)?"
_BREAKS = "array<struct<at:int,source:int,last:int>>"


def _instead(found: Column, named: bool) -> Column:
    kind, first, second = (F.regexp_extract(found, _CALL, k) for k in (1, 2, 3))
    relation = F.when(kind == "ref", F.when(second == "", first).otherwise(second)).when(kind == "source", F.concat_ws(".", first, second))
    other = F.when(found.startswith("{%"), F.lit(" ")).otherwise(F.lit(f" {PLACEHOLDER} "))
    return F.when(relation.isNotNull(), F.concat(F.lit(" "), relation, F.lit(" "))).otherwise(other) if named else other


def pieces(text: Column, named: bool = False) -> Column:
    """array<struct<plain, own, instead>>: what stands before each template, the template, and what replaces it.

    named: ref() and source() become the name of their relation.
    """
    parts, found = F.split(text, TEMPLATE, -1), F.regexp_extract_all(text, F.lit(TEMPLATE), F.lit(0))
    return F.zip_with(parts, found, lambda a, b: F.struct(a.alias("plain"), F.coalesce(b, F.lit("")).alias("own"), F.when(b.isNull(), F.lit("")).otherwise(_instead(b, named)).alias("instead")))


def joined(cut: Column) -> Column:
    """The text of `pieces`, templates replaced."""
    return F.array_join(F.transform(cut, lambda x: F.concat(x["plain"], x["instead"])), "")


def breaks(cut: Column) -> Column:
    """For each of `pieces` its first offset in the joined text and in the source, and its last offset in the source."""

    def step(s: Column, x: Column) -> Column:
        plain, own, put = F.length(x["plain"]), F.length(x["own"]), F.length(x["instead"])
        at, source = s["at"] + plain, s["source"] + plain
        new = F.array(F.struct(s["at"].alias("at"), s["source"].alias("source"), (source - 1).alias("last")), F.struct(at.alias("at"), source.alias("source"), (source + own - 1).alias("last")))
        return F.struct((at + put).alias("at"), (source + own).alias("source"), F.concat(s["breaks"], F.filter(new, lambda b: b["last"] >= b["source"])).alias("breaks"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("source"), F.array().cast(_BREAKS).alias("breaks"))
    return F.aggregate(cut, start, step, lambda s: s["breaks"])


def stripped(text: Column, named: bool = False) -> Column:
    """struct<text, breaks>: the text with blocks as one blank and expressions as a placeholder, and where its pieces come from.

    Offsets of a placeholder all lie in its template. Null text: null members.
    """
    cut = pieces(text, named)
    return F.struct(joined(cut).alias("text"), breaks(cut).alias("breaks"))


def source_offset(breaks: Column, at: Column) -> Column:
    """The offset in the source of an offset in stripped text, by binary search among the breaks; `at` where there are none, null for null."""
    halvings = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size(breaks) + 1)).cast("int")))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        right = F.get(breaks, middle)["at"] <= at
        return F.when(right, F.struct(middle.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), F.greatest(middle - 1, F.lit(0)).alias("hi")))

    i = F.aggregate(halvings, F.struct(F.lit(0).alias("lo"), F.greatest(F.size(breaks) - 1, F.lit(0)).alias("hi")), halve, lambda s: s["lo"])
    piece = F.get(breaks, i)
    return F.when(at.isNotNull(), F.coalesce(F.least(piece["source"] + at - piece["at"], piece["last"]), at))
