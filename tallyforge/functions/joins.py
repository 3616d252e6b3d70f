"""Joins of a SQL text: scopes, relations and aliases, equality keys, and keys that a function hides.

Everything is a Column over one row: a text's queries are cut into scopes, innermost first, each scope's joins are the
pieces between its join words, and aliases are looked up among the scope's own relations. Parts keep their offsets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions import templates
from tallyforge.functions import texts as tx

#: Nested queries that are told apart; deeper ones stay part of what is around them.
DEPTH = 6
_FLAT = r"(?:[^()]++|\((?!\s*+(?:select|with)\b)(?:[^()]++|\((?!\s*+(?:select|with)\b)(?:[^()]++|\([^()]*+\))*+\))*+\))*+"
#: A query in parentheses that holds none.
INNERMOST = rf"\((?=\s*+(?:select|with)\b){_FLAT}\)"
_KIND = r"(?:inner|left|right|full|cross|natural|asof|lateral)(?:\s+(?:outer|semi|anti))?"
_CLAUSE = r"where|group\s+by|order\s+by|having|qualify|limit|union|intersect|except|window"
_NAME = r"[\w.`\"$-]+"
_ALIAS = rf"(?:\s+(?:as\s+)?(?!(?:on|using|join|{_CLAUSE}|{_KIND})\b)([a-z_]\w*))?"
_RELATION = rf"\b(?:from|join)\s+(?:lateral\s+)?({_NAME}){_ALIAS}"
_COLUMN = r"^[(\s]*(?:\w+\.)*([a-z_]\w*)[)\s]*$"

#: Fixed lists: functions that hide a key, that both sides may share, that hash, that cut time, and columns of cut time.
HIDING = "lower upper trim ltrim rtrim cast date date_trunc to_char to_varchar coalesce".split()
SHARED = "lower upper trim ltrim rtrim date_trunc coalesce cast".split()
HASHES = "keccak256 keccak sha256 sha2 md5 hash".split()
CUTTING = "date_trunc timestamp_trunc date datetime cast".split()
BUCKETS = "minute hour hr day date week month block_time evt_block_time block_date block_day block_month date_month evt_block_date timestamp ts period time".split()
#: Fixed: stands for a key that both sides hide alike.
WRAPPED = "wrapped_equality"


def cut(text: Column) -> Column:
    """The pieces of a text without comments between its templates, from which shape and breaks come."""
    return templates.pieces(tx.blanked(text, False), named=True)


def shaped(plain: Column) -> Column:
    """A joined text in lower case, literals blanked."""
    return F.lower(tx.blanked(plain))


def shape(text: Column) -> Column:
    """struct<text, breaks>: the text in lower case without comments, literals and templates; ref() and source() by name."""
    pieces = cut(text)
    return F.struct(shaped(templates.joined(pieces)).alias("text"), templates.breaks(pieces).alias("breaks"))


def scopes(shaped: Column) -> Column:
    """array<struct<start, found>> of the queries of a shaped text, the outermost first, nested ones as underscores in it."""
    start = F.struct(shaped.alias("text"), F.array().cast("array<struct<start:int,found:string>>").alias("inner"))

    def step(s: Column, _: Column) -> Column:
        flat = tx.replaced(s["text"], INNERMOST, lambda q: F.repeat(F.lit("_"), F.length(q)))
        return F.when(s["text"].rlike(r"\(\s*(?:select|with)\b"), F.struct(flat.alias("text"), F.concat(tx.spans(s["text"], INNERMOST), s["inner"]).alias("inner"))).otherwise(s)

    whole = lambda s: F.concat(F.array(F.struct(F.lit(0).alias("start"), s["text"].alias("found"))), s["inner"])
    nests = shaped.rlike(r"\(\s*(?:select|with)\b")
    return F.when(nests, F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), start, step, whole)).otherwise(whole(start))


def _bare(name: Column) -> Column:
    return F.regexp_replace(name, r"[`\"]", "")


def relations(scope: Column) -> Column:
    """array<struct<relation, alias>> of a scope: its tables by name and the name that qualifies their columns."""
    named = F.transform(F.regexp_extract_all(scope, F.lit(_RELATION), F.lit(0)), lambda m: F.struct(_bare(F.regexp_extract(m, _RELATION, 1)).alias("relation"), F.regexp_extract(m, _RELATION, 2).alias("alias")))
    return F.transform(named, lambda r: F.struct(r["relation"].alias("relation"), F.when(r["alias"] == "", F.substring_index(r["relation"], ".", -1)).otherwise(r["alias"]).alias("alias")))


def _side(text: Column) -> Column:
    """struct<called, inside, column, qualifier, literal> of a side of an equality.

    called: the function that it is a call of, cast for a::b, else ''; inside: the call's first argument.
    """
    called = F.when(text.rlike(r"::\s*\w+[)\s]*$"), "cast").otherwise(F.regexp_extract(text, r"^[(\s]*([a-z_]\w*)\s*\(", 1))
    inside = F.trim(F.regexp_extract(text, r"^[(\s]*[a-z_]\w*\s*\(((?:[^(),]++|\([^()]*+\))*+)", 1))
    literal = text.rlike(r"^[(\s]*\w+\s*\((?:\s*(?:'[^']*'|[0-9.]+)\s*,?)*\)[)\s]*$")
    qualifier = F.regexp_extract(text, r"^[(\s]*(?:\w+\.)*?(\w+)\.\w+[)\s]*$", 1)
    return F.struct(called.alias("called"), inside.alias("inside"), F.regexp_extract(text, _COLUMN, 1).alias("column"), qualifier.alias("qualifier"), literal.alias("literal"))


def _is_hidden(l: Column, r: Column) -> Column:
    """Whether a function hides the key of two sides (`_side`) that are set equal.

    It does not where both sides are hidden or hashed alike or are casts, where a side cuts time and the other is a column
    of cut time, where a side is coalesce(), and where a function is applied to the column that the other side names.
    """
    first = lambda x: F.regexp_extract(x["inside"], r"^[(\s]*([a-z_]\w*)\s*\(", 1)
    hides = lambda x: F.when(x["called"] == "cast", first(x).isin(*HIDING) & (first(x) != "cast")).otherwise(x["called"].isin(*HIDING) & ~x["literal"])
    cut = lambda x, y: x["column"].isin(*BUCKETS) & y["called"].isin(*CUTTING)
    same = lambda x, y: x["called"].isin(*HIDING) & (x["called"] != "cast") & (y["column"] != "") & (F.regexp_extract(x["inside"], _COLUMN, 1) == y["column"])
    filled = (l["called"] == "coalesce") | (r["called"] == "coalesce")
    return (hides(l) | hides(r)) & ~(_alike(l, r) | cut(l, r) | cut(r, l) | filled | same(l, r) | same(r, l))


def _alike(l: Column, r: Column) -> Column:
    return (l["called"] == r["called"]) & l["called"].isin(*SHARED, *HASHES)


_END = "struct<relation:string,key:string>"
_PAIR = f"struct<left:{_END},right:{_END},names:array<string>,hidden:boolean>"


def _pairs(conjuncts: Column, known: Column) -> Column:
    """What each equality of `conjuncts` sets equal; known: the relations of the scope. Steps bind what later ones use often."""
    sides = F.transform(conjuncts, lambda c: F.transform(F.split(c, r"(?<![<>!=])=(?![>=])", 2), _side))

    def end(side: Column) -> Column:
        return F.struct(F.get(F.filter(known, lambda r: r["alias"] == side["qualifier"]), F.lit(0))["relation"].alias("relation"), side["column"].alias("key"))

    def one(both: Column) -> Column:
        l, r = F.get(both, F.lit(0)), F.get(both, F.lit(1))
        names = F.filter(F.array(l["column"], r["column"]), lambda x: x != "")
        return F.struct(end(l).alias("left"), end(r).alias("right"), F.when(_alike(l, r), F.array(F.lit(WRAPPED))).otherwise(names).alias("names"), _is_hidden(l, r).alias("hidden"))

    return F.transform(sides, one).cast(f"array<{_PAIR}>")


JOIN = f"struct<start:int,kind:string,relation:string,alias:string,predicate:string,equality:boolean,keys:array<string>,pairs:array<struct<left:{_END},right:{_END}>>,hidden:boolean>"


def _joins_of(scope: Column) -> Column:
    """The joins of a scope struct<start, found, known, parts, words>."""
    head = rf"^\s*(?:lateral\s+)?({_NAME}){_ALIAS}"

    def read(word: Column, i: Column) -> Column:
        before, after = F.get(scope["parts"], i), F.get(scope["parts"], i + 1)
        on = F.regexp_replace(F.regexp_extract(after, rf"(?s)\bon\b(.*?)(?:\b(?:{_CLAUSE})\b|$)", 1), rf"\b{_KIND}\s*$", "")
        using = _bare(F.regexp_extract(after, r"^[^()]*\busing\s*\(([^()]*)\)", 1))
        return F.struct((scope["start"] + word["start"]).alias("start"), F.regexp_extract(before, rf"\b({_KIND})\s*$", 1).alias("kind"), _bare(F.regexp_extract(after, head, 1)).alias("relation"), F.regexp_extract(after, head, 2).alias("alias"), on.alias("on"), F.filter(F.transform(F.split(using, ","), lambda x: F.trim(x)), lambda x: x != "").alias("using"))

    def keyed(j: Column) -> Column:
        equal = F.filter(F.split(j["on"], r"\band\b"), lambda c: tx.has_equality(c) & ~c.rlike(r"\bor\b"))
        end = lambda relation, key: F.struct(relation.alias("relation"), key.alias("key"))
        shared = F.transform(j["using"], lambda c: F.struct(end(F.lit(None).cast("string"), c).alias("left"), end(j["relation"], c).alias("right"), F.array(c).alias("names"), F.lit(False).alias("hidden"))).cast(f"array<{_PAIR}>")
        return F.struct(j.alias("j"), F.concat(_pairs(equal, scope["known"]), shared).alias("pairs"))

    def told(x: Column) -> Column:
        j, pairs = x["j"], x["pairs"]
        return F.struct(
            j["start"].alias("start"), F.when(j["kind"] == "", "inner").otherwise(F.regexp_extract(j["kind"], r"^(\w+)", 1)).alias("kind"), j["relation"].alias("relation"), F.when(j["alias"] == "", F.substring_index(j["relation"], ".", -1)).otherwise(j["alias"]).alias("alias"),
            F.trim(j["on"]).alias("predicate"), (tx.has_equality(j["on"]) | (F.size(j["using"]) > 0)).alias("equality"), F.array_distinct(F.flatten(F.transform(pairs, lambda p: p["names"]))).alias("keys"),
            F.transform(F.filter(pairs, lambda p: (p["left"]["key"] != "") & (p["right"]["key"] != "")), lambda p: F.struct(p["left"].alias("left"), p["right"].alias("right"))).alias("pairs"), F.exists(pairs, lambda p: p["hidden"]).alias("hidden"),
        )

    return F.transform(F.transform(F.transform(scope["words"], read), keyed), told).cast(f"array<{JOIN}>")


def joins(scoped: Column) -> Column:
    """The joins of all scopes, each with its offset in the shaped text, its relation and alias, keys and whether one is hidden.

    keys: the names of all columns that are set equal, without OR; pairs: both sides with the relation that their alias
    stands for (null where no relation of the scope has it). USING gives the same name on both sides.
    """
    joined = F.filter(scoped, lambda s: s["found"].contains("join"))
    read = F.transform(joined, lambda s: F.struct(s["start"].alias("start"), relations(s["found"]).alias("known"), F.split(s["found"], r"\bjoin\b", -1).alias("parts"), tx.spans(s["found"], r"\bjoin\b").alias("words")))
    return F.flatten(F.transform(read, _joins_of))


def correlated(scoped: Column) -> Column:
    """array<struct<start, found>> of the nested queries that use a name of a query around them and not one of their own."""

    def read(s: Column) -> Column:
        used = F.array_distinct(F.regexp_extract_all(s["found"], F.lit(r"\b([a-z_]\w*)\.[a-z_*]"), F.lit(1)))
        return F.struct(s["start"].alias("start"), s["found"].alias("found"), relations(s["found"]).alias("known"), used.alias("used"))

    def reaching(all_: Column) -> Column:
        names = lambda s: F.transform(s["known"], lambda r: r["alias"])
        everywhere = F.flatten(F.transform(all_, names))
        own = lambda s: F.concat(names(s), F.flatten(F.transform(s["known"], lambda r: F.split(r["relation"], r"\."))))
        free = F.transform(all_, lambda s: F.struct(s["start"].alias("start"), s["found"].alias("found"), F.array_except(s["used"], own(s)).alias("free")))
        held = F.filter(free, lambda s: s["found"].startswith("(") & (F.size(s["free"]) > 0))
        return F.transform(F.filter(held, lambda s: F.size(F.array_intersect(s["free"], everywhere)) > 0), lambda s: F.struct(s["start"].alias("start"), s["found"].alias("found")))

    return F.when(F.size(scoped) > 1, F.get(F.transform(F.array(F.transform(scoped, read)), reaching), F.lit(0))).otherwise(F.filter(scoped, lambda s: F.lit(False)))


def is_covered(keys: Column, unique: Column) -> Column:
    """Whether a join on `keys` meets at most one row of a relation with that unique key; no key known counts as met."""
    return unique.isNull() | (F.size(F.array_except(unique, keys)) == 0)
