"""Quality rules by distribution divergence, in DataFrame functions alone.

A document's histograms of character classes and of common words are compared with those of its language over all
documents by the Jensen-Shannon distance; documents that are long enough for a comparison and too far away are rejected,
as are those that fail the base rules. What is common, what is usual and what is too far is learned for each language
from all its documents. The first pass measures texts and counts, the second one compares words; what is shuffled is a
row for each different word of a task, and a few numbers for each language. Each word of a text gets one or two small
functions; what needs several words is left to functions of whole arrays.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import table, written

BLANKS = " \t\n\x0b\x0c\r"
LEAST_WORDS = 50
REPEAT_PERCENT = 50
#: How many of a language's commonest words have a bin of their own; all other words share the last bin.
COMMON_WORDS = 32
#: The least letters or words that a histogram needs to be judged.
LEAST_CHARS, LEAST_JUDGED_WORDS = 200, 100
#: A document is too far away beyond its language's upper fence, the third quartile of the distances and FENCE times the
#: quartiles' difference; but never below these distances (0 to 1), so that a uniform corpus loses nothing.
FENCE, LEAST_CLASS_BOUND, LEAST_WORD_BOUND = 1.5, 0.28, 0.30
#: Decimals of the distances, which bounds the different values that quartiles are taken over.
DECIMALS = 4
#: Slots that hashes of words fall into, to look common words up.
SLOTS = 256
#: How many bits of a hash give way to the place of its window, and those bits.
LOW_BITS = 31
LOW = (1 << LOW_BITS) - 1
#: Fixed classes of characters; what is left is a class of its own.
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{N}", "blank": r"[\x20\x09-\x0D]", "stop": r"[.,;:!?'\"()-]", "symbol": r"[#*$%&|<>@=+_/\\^~{}\[\]]"}
_BINS = [*CLASSES, "rest"]
#: The columns of a language's reference.
REFERENCE = ("classes", "words", "shares", "slots")


def words_of(text: Column) -> Column:
    """The words of a text in order; empty without any."""
    spaced = text
    for blank in BLANKS[1:]:
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")  # a single character is split without a regular expression


def _tokens(text: Column) -> Column:
    """Lower-case words without the usual marks, for looking up common words; may hold empty strings."""
    return F.split(F.lower(text), r"[ ,.;:!?|\t\n\x0B\f\r]+")


def _let(value: Column, then) -> Column:
    """then(value), with value computed once however often `then` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _from(values: Column, k: int) -> Column:
    """The values from the k-th one on."""
    return F.slice(values, k, F.size(values))


def _windows(hashes: Column) -> Column:
    """A hash of each three words that follow each other, from the hashes of single words."""
    pairs = F.zip_with(hashes, _from(hashes, 2), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(hashes) > 2, F.slice(F.zip_with(pairs, _from(hashes, 3), lambda a, b: F.xxhash64(a, b)), 1, F.size(hashes) - 2)).otherwise(F.array().cast("array<bigint>"))


def _placed(windows: Column) -> Column:
    """The leading bits of each window with its place below them, in order: equal windows are neighbours. Null if all differ."""
    leading = F.transform(windows, lambda h, i: h.bitwiseAND(~LOW).bitwiseOR(i.cast("long")))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(leading))


def _repeated_words(windows: Column, placed: Column) -> Column:
    """Words that lie in a window of three words which occurs twice or more."""
    alike = F.zip_with(placed, _from(placed, 2), lambda a, b: F.when(F.shiftrightunsigned(a.bitwiseXOR(b), LOW_BITS) == 0, F.array(a, b)))
    places = F.array_distinct(F.flatten(F.array_compact(alike)))
    # what is alike in the leading bits is compared as a whole
    whole = F.transform(F.transform(places, lambda x: x.bitwiseAND(LOW).cast("int")), lambda i: F.struct(F.get(windows, i).alias("h"), i.alias("i")))
    return F.when(placed.isNull(), F.lit(0)).otherwise(_let(F.sort_array(whole), _covered)).cast("long")


def _covered(ordered: Column) -> Column:
    twice = F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    # each window adds the words from where the last one ended
    return F.aggregate(places, start, lambda s, i: F.struct((s["n"] + i + 3 - F.greatest(i, s["end"])).alias("n"), (i + 3).alias("end")), lambda s: s["n"])


def _without(text: Column, name: str) -> Column:
    return F.regexp_replace(text, f"{CLASSES[name]}+", "")


def _measures(docs: DataFrame) -> DataFrame:
    """`_row` with all columns of docs (of any name), `_base` with the base measures of each text and `_classes`: how many
    characters of each class it has, and of the rest.

    What is used twice is a column of its own; most texts are short once their small letters and blanks are out.
    """
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("_row")).select("_row", words_of(text).alias("_words"), _without(text, "lower").alias("_large"))
    rows = rows.select("_row", F.size("_words").alias("_n"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"), "_large", _without(F.col("_large"), "blank").alias("_marks"))
    rows = rows.select("_row", "_n", _windows(F.col("_hashes")).alias("_windows"), "_large", "_marks")
    rows = rows.select("_row", "_n", "_windows", _placed(F.col("_windows")).alias("_placed"), "_large", "_marks")
    n = {k: F.length("_marks") - F.length(_without(F.col("_marks"), k)) for k in CLASSES} | {"lower": F.length(text) - F.length("_large"), "blank": F.length("_large") - F.length("_marks")}
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    rows = rows.select(
        "_row", "_n", _repeated_words(F.col("_windows"), F.col("_placed")).alias("_repeated"), F.array(*[n[k] for k in CLASSES]).alias("_known"), F.length(text).alias("_size"),
        (F.length("_marks") - F.length(F.regexp_replace("_marks", r"[#*$%&|<>]+", ""))).alias("_symbols"), _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("_lines"),
    )
    known = [F.get("_known", F.lit(k)) for k in range(len(CLASSES))]
    base = F.struct(
        F.col("_n").cast("long").alias("n_words"), (F.col("_size") - known[list(CLASSES).index("blank")]).cast("long").alias("word_chars"), F.col("_symbols").cast("long").alias("n_symbols"),
        F.col("_lines").cast("long").alias("n_dup_lines"), F.col("_repeated").alias("n_repeat_words"), ((F.col("_n") < LEAST_WORDS) | (100 * F.col("_repeated") > REPEAT_PERCENT * F.col("_n"))).alias("base_failed"),
    )
    return rows.select("_row", base.alias("_base"), F.array(*known, F.col("_size") - sum(known)).cast("array<long>").alias("_classes"))


def _share(counts: Column) -> Column:
    return F.transform(counts, lambda x: x / F.greatest(F.aggregate(counts, F.lit(0.0), lambda a, b: a + b), F.lit(1.0)))


def _measured(docs: DataFrame) -> DataFrame:
    """_measures, written, so texts are measured once."""
    return written(_measures(docs), "measured")


def references(measured: DataFrame) -> DataFrame:
    """(lang, classes array<double>, words array<string>, shares array<double>, slots array<int>): each language's
    distributions over all its documents, and a row with a null lang for all documents together.

    words are the COMMON_WORDS commonest words (ties by the word), shares their parts of all words and that of the rest,
    slots where to look the words up.
    """
    lang, sums = F.col("_row.lang"), [F.sum(F.get("_classes", F.lit(k))).cast("double").alias(f"c{k}") for k in range(len(_BINS))]
    by_lang = written(measured.groupBy(lang.alias("lang")).agg(*sums), "classes")  # a row for each language
    pooled = by_lang.groupBy(F.lit(None).cast("string").alias("lang")).agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(len(_BINS))])
    classes = by_lang.where("lang is not null").union(pooled).select("lang", _share(F.array(*[F.col(f"c{k}") for k in range(len(_BINS))])).alias("classes"))
    tokens = measured.select(lang.alias("lang"), F.explode(_tokens(F.coalesce("_row.text", F.lit("")))).alias("w")).where("w <> ''")
    counts = written(tokens.groupBy("lang", "w").agg(F.count("*").alias("n")), "words")
    counts = counts.where("lang is not null").union(counts.groupBy(F.lit(None).cast("string").alias("lang"), "w").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))  # each task keeps its own commonest before the shuffle
    top = counts.withColumn("k", rank).where(F.col("k") <= COMMON_WORDS).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "w", "n"))).alias("top"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    bins = top.join(total, top["lang"].eqNullSafe(total["lang"])).select(top["lang"], F.col("top.w").alias("words"), F.transform("top.n", lambda n: n / F.col("total")).alias("own"))
    common = bins.select("lang", "words", F.concat("own", F.array(F.greatest(F.lit(0.0), 1 - F.aggregate("own", F.lit(0.0), lambda a, b: a + b)))).alias("shares"))
    both = classes.join(common, classes["lang"].eqNullSafe(common["lang"]), "left")
    both = both.select(classes["lang"], "classes", F.coalesce("words", F.array().cast("array<string>")).alias("words"), F.coalesce("shares", F.array(F.lit(1.0))).alias("shares"))
    return written(both.withColumn("slots", _slots(F.col("words"))), "references")


def _half(p: Column, q: Column) -> Column:
    """One bin's part of the Jensen-Shannon divergence in bits."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) / 2 + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0) / 2


def _distance(parts: Column) -> Column:
    return F.round(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), parts))), DECIMALS)


def class_distance(counts: Column, reference: Column) -> Column:
    """Distance of a text's counts of character classes."""
    return _distance(F.aggregate(F.zip_with(_share(counts.cast("array<double>")), reference, _half), F.lit(0.0), lambda a, b: a + b))


def _slot(word: Column) -> Column:
    return F.hash(word).bitwiseAND(SLOTS - 1)


def _slots(words: Column) -> Column:
    """For each slot 0 if none of the words falls into it, the word's place from 1 if one does, and -1 if several do."""
    taken = lambda slots: F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: _of_slot(F.array_position(slots, s).cast("int"), F.size(F.filter(slots, lambda x: x == s))))
    return _let(F.transform(words, _slot), taken)


def _of_slot(place: Column, n: Column) -> Column:
    return F.when(n > 1, F.lit(-1)).otherwise(place)


def word_hits(tokens: Column, words: Column, slots: Column) -> Column:
    """The places, from 1 and the last first, of those tokens that are among the words; slots are the words' _slots."""

    def place(token: Column, slot: Column) -> Column:
        return F.when(slot == 0, F.lit(0)).when(slot < 0, F.array_position(words, token).cast("int")).when(F.get(words, slot - 1) == token, slot).otherwise(F.lit(0))

    slot_of = F.transform(tokens, lambda w: F.get(slots, _slot(w)))
    return F.sort_array(F.array_remove(F.zip_with(tokens, slot_of, place), 0), asc=False)


def word_distance(hits: Column, n_tokens: Column, shares: Column) -> Column:
    """Distance of a text's common words, given as word_hits; null for a text with too few words to tell."""
    n, start = n_tokens.cast("double"), F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q"), F.lit(-1).alias("last"))
    # in the places' order, each bin with the end of its hits
    ends = F.transform(F.reverse(F.array_distinct(hits)), lambda k: F.struct(F.get(shares, k - 1).alias("q"), (F.size(hits) - F.array_position(hits, k)).cast("int").alias("end")))

    def step(s: Column, e: Column) -> Column:
        return F.struct((s["d"] + _half((e["end"] - s["last"]) / n, e["q"])).alias("d"), (s["q"] + e["q"]).alias("q"), e["end"].alias("last"))

    other, q_other = (n - F.size(hits)) / n, F.get(shares, F.size(shares) - 1)
    # bins that the text lacks add q / 2 each: all of q, less that of the bins it has
    parts = F.aggregate(ends, start, step, lambda s: s["d"] + (1 - q_other - s["q"]) / 2 + _half(other, q_other))
    return F.when(n_tokens >= LEAST_JUDGED_WORDS, _distance(parts))


def _fence(distance: str, least: float) -> Column:
    low, high = F.percentile(distance, F.lit(0.25)), F.percentile(distance, F.lit(0.75))
    return F.greatest(F.lit(least), F.coalesce(high + FENCE * (high - low), F.lit(least)))


def judged(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`_row` (all columns of docs, or those in `keep`), `_base` (the base measures), `_class_distance`, `_word_distance` and `_kept`.

    A document of a language without a reference, or of none, is held against all documents together. Texts under a
    minimum length, and those that fail the base rules, have null distances; null texts are empty. Rows with equal text
    and lang get equal verdicts; repeated rows stay; an empty table gives no rows.
    """
    measured = _measured(docs)
    refs = references(measured)
    known = refs.where("lang is not null").select(F.col("lang").alias("_lang"), *[F.col(c).alias(f"_{c}_of") for c in REFERENCE])
    whole = refs.where("lang is null").select(*[F.col(c).alias(f"_{c}_all") for c in REFERENCE])
    rows = measured.join(known, F.col("_row.lang") == F.col("_lang"), "left").join(F.broadcast(whole), F.lit(True), "left")  # `whole` is one row
    of = lambda c: F.coalesce(f"_{c}_of", f"_{c}_all")
    text, asked = F.coalesce("_row.text", F.lit("")), ~F.col("_base.base_failed")
    tokens = F.when(asked, F.array_remove(_tokens(text), "")).otherwise(F.array().cast("array<string>"))
    rows = rows.select(
        F.struct(*[F.col(f"_row.`{c}`") for c in keep]).alias("_row") if keep else "_row", "_base", F.col("_row.lang").alias("_lang"),
        F.when(asked & (F.length(text) >= LEAST_CHARS), class_distance(F.col("_classes"), of("classes"))).alias("_class_distance"),
        tokens.alias("_tokens"), *[of(c).alias(f"_{c}") for c in ("words", "shares", "slots")],
    )
    hits = F.when(F.size("_tokens") >= LEAST_JUDGED_WORDS, word_hits(F.col("_tokens"), F.col("_words"), F.col("_slots")))
    rows = rows.select("_row", "_base", "_lang", "_class_distance", F.size("_tokens").alias("_n"), hits.alias("_hits"), "_shares")
    rows = rows.select("_row", "_base", "_lang", "_class_distance", word_distance(F.col("_hits"), F.col("_n"), F.col("_shares")).alias("_word_distance"))
    if keep:
        rows = basis = written(rows, "distances")
    else:  # whole rows are not written twice: their distances are computed again below
        basis = written(rows.select("_lang", "_class_distance", "_word_distance"), "distances")
    bounds = basis.groupBy(F.col("_lang").alias("_of")).agg(_fence("_class_distance", LEAST_CLASS_BOUND).alias("_class_bound"), _fence("_word_distance", LEAST_WORD_BOUND).alias("_word_bound"))  # a row for each language
    bounds = written(bounds, "bounds")
    near = lambda d, b: F.coalesce(F.col(d) <= F.col(b), F.lit(True))
    return rows.join(bounds, F.col("_lang").eqNullSafe(F.col("_of")), "left").withColumn("_kept", ~F.col("_base.base_failed") & near("_class_distance", "_class_bound") & near("_word_distance", "_word_bound"))


def rules(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every document."""
    return judged(docs.select("doc_id", "lang", "text"), ["doc_id"]).select("_row.doc_id", "_base.*", F.col("_kept").alias("kept"))


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, as they are."""
    return judged(docs).where("_kept").select("_row.*")


def op10_distribution_divergence(spark, sf_dir: str) -> DataFrame:
    """One row for each document, with its base measures and the verdict; edge cases as in `judged`."""
    return rules(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    half = "(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2"
    quoted = lambda x: x.replace("'", "''")
    known = [f"len(regexp_extract_all(text, '{quoted(p)}'))" for p in CLASSES.values()]
    fence = lambda d, least: f"greatest({least}, coalesce(quantile_cont({d}, 0.75) + {FENCE} * (quantile_cont({d}, 0.75) - quantile_cont({d}, 0.25)), {least}))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
m AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
  list_filter(string_split_regex(translate(lower(text), ',.;:!?|' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), repeat(' ', 12)), ' +'), lambda x: x <> '') AS tokens FROM d),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM m)),
repeated AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY rid),
base AS (SELECT m.*, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words FROM m LEFT JOIN repeated USING (rid)),
c0 AS (SELECT rid, lang, length(text) AS size, unnest([{', '.join(known)}, length(text) - ({' + '.join(known)})]) AS c, unnest(range({len(_BINS)})) AS k FROM d),
cref AS (SELECT lang, k, c / greatest(sum(c) OVER (PARTITION BY lang), 1) AS q FROM (SELECT lang, k, sum(c) AS c FROM c0 WHERE lang IS NOT NULL GROUP BY lang, k UNION ALL SELECT NULL, k, sum(c) FROM c0 GROUP BY k)),
cd AS (SELECT rid, round(sqrt(greatest(0, least(1, sum({half})))), {DECIMALS}) AS dist FROM (SELECT rid, c / greatest(size, 1) AS p, q FROM c0 JOIN cref r ON r.lang IS NOT DISTINCT FROM c0.lang AND r.k = c0.k) GROUP BY rid),
t0 AS (SELECT rid, lang, unnest(tokens) AS t FROM m),
n0 AS (SELECT lang, t, count(*) AS n FROM t0 WHERE lang IS NOT NULL GROUP BY lang, t UNION ALL SELECT NULL, t, count(*) FROM t0 GROUP BY t),
top AS (SELECT lang, t AS b, n / sum(n) OVER (PARTITION BY lang) AS q, row_number() OVER (PARTITION BY lang ORDER BY n DESC, t) AS k FROM n0),
wref AS (SELECT lang, b, q FROM top WHERE k <= {COMMON_WORDS} UNION ALL SELECT lang, NULL, greatest(0, 1 - sum(q)) FROM top WHERE k <= {COMMON_WORDS} GROUP BY lang),
hist AS (SELECT t0.rid, r.b, count(*) AS n FROM t0 LEFT JOIN wref r ON r.lang IS NOT DISTINCT FROM t0.lang AND r.b = t0.t GROUP BY t0.rid, r.b),
wd AS (SELECT rid, round(sqrt(greatest(0, least(1, sum({half})))), {DECIMALS}) AS dist FROM (SELECT m.rid, coalesce(h.n, 0) / len(tokens) AS p, q FROM m JOIN wref r ON r.lang IS NOT DISTINCT FROM m.lang LEFT JOIN hist h ON h.rid = m.rid AND h.b IS NOT DISTINCT FROM r.b WHERE len(tokens) > 0) GROUP BY rid),
j0 AS (SELECT base.*, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed, cd.dist AS cdist, wd.dist AS wdist FROM base LEFT JOIN cd USING (rid) LEFT JOIN wd USING (rid)),
judged AS (SELECT *, CASE WHEN NOT base_failed AND length(text) >= {LEAST_CHARS} THEN cdist END AS a, CASE WHEN NOT base_failed AND len(tokens) >= {LEAST_JUDGED_WORDS} THEN wdist END AS b FROM j0),
bounds AS (SELECT lang, {fence('a', LEAST_CLASS_BOUND)} AS fa, {fence('b', LEAST_WORD_BOUND)} AS fb FROM judged GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(a <= fa, true) AND coalesce(b <= fb, true) AS kept FROM judged LEFT JOIN bounds ON bounds.lang IS NOT DISTINCT FROM judged.lang
"""


OP10_SQL = _oracle()
