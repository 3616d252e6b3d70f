"""Source divergence audit: how far the term frequencies of each source lie from those of its language's other sources.

A group is a language's documents of one source. Terms are counted by group, those in few documents are left out, and the
smoothed share of every kept term in every group is an integer of parts in 10 ** 9. The divergence of group g from h is
the sum over all kept terms of floor((p - q) ** 2 / q), p and q being the shares in g and h.

The sum is split by term. Heavy terms, in at least a quarter of the language's groups, fill dense tiles of groups by
groups. Of light terms only the postings are touched: the sum starts as if no group had the term, one-sided corrections
come from a histogram of the shares of a group's light terms, and pairs of postings of one term correct what both sides
changed. All parts are exact integers, so their sum is that of the definition.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import table, written

LEAST_DOCS, MOST_TERMS = 3, 200
#: A term is heavy from this share of its language's groups on.
HEAVY = 0.25
#: Groups on a side of a tile, heavy terms of a tile at once, and tiles that a task holds before it tells their sums.
TILE, DEPTH, MOST_TILES = 64, 64, 512
#: Different terms of all groups that a task holds before it tells their counts, and pairs it holds.
MOST_HELD, MOST_PAIRS = 500_000, 1_000_000
#: Groups of all languages together are told to every task. The result has a row for each two groups of a language, so
#: one that passes this bound could not be written anyway.
MOST_GROUPS = 1_000_000
#: A-Z to a-z; ASCII other than letters to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task: occurrences of the term and documents with it."""
    held: dict[tuple[str, str], dict[bytes, int]] = {}  # occurrences in the high bits, documents in the low 32
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            names, n = list(terms), len(terms)
            for i in range(0, n, 100_000):
                some = names[i : i + 100_000]
                both = [divmod(terms[t], 1 << 32) for t in some]
                columns = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([b[0] for b in both], pa.int64()), pa.array([b[1] for b in both], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for k, (lang, source) in enumerate(zip(langs, sources, strict=True)):
            own = held.setdefault((lang, source), {})
            before = len(own)
            for term, n in Counter(texts[k].as_py().translate(_FOLD).split()).items():
                own[term] = own.get(term, 0) + (n << 32) + 1
            size += len(own) - before
            if size > MOST_HELD:
                yield from out()
                size = 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all groups; null text, lang and source are ''."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n, total):
    """1 + floor(10 ** 9 * n / total), exactly, for n <= total < 9 * 10 ** 15: three steps of three digits. 1 for a total of 0."""
    quotient, rest, by = F.lit(0).cast("long"), n, F.nullif(total, F.lit(0).cast("long"))
    for _ in range(3):
        quotient, rest = quotient * 1000 + F.call_function("div", rest * 1000, by), (rest * 1000) % by
    return F.coalesce(quotient, F.lit(0).cast("long")) + 1


def loss(p, q):
    """floor((p - q) ** 2 / q) in longs."""
    return F.call_function("div", (p - q) * (p - q), q)


def _losses(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _pair_sums(batches: Iterator[pa.RecordBatch], absent: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Partial sums (lang, g, h, kind, value) of whole terms that come sorted: kind 0 dense tiles, 1 corrections of light pairs.

    absent: the share of an absent term in each group of a language. A tile's sum counts, for every heavy term that passes,
    all pairs of its groups, absent ones too.
    """
    tiles: dict[tuple[str, int, int], np.ndarray] = {}
    light: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]] = []
    n_light, rest = 0, None

    def rows(lang: str, g: np.ndarray, h: np.ndarray, kind: int, value: np.ndarray) -> pa.RecordBatch:
        n = len(g)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(g.astype(np.int32)), pa.array(h.astype(np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(value.astype(np.int64))], names=["lang", "g", "h", "kind", "value"])

    def told_tiles() -> Iterator[pa.RecordBatch]:
        for (lang, i, j), sums in tiles.items():
            g, h = np.divmod(np.arange(sums.size), sums.shape[1])
            yield rows(lang, g + i * TILE, h + j * TILE, 0, sums.ravel())
        tiles.clear()

    def told_light() -> Iterator[pa.RecordBatch]:
        for lang in {x[0] for x in light}:
            g, h, v = (np.concatenate([x[k] for x in light if x[0] == lang]) for k in (1, 2, 3))
            width = len(absent[lang])
            key, back = np.unique(g * width + h, return_inverse=True)
            sums = np.zeros(len(key), np.int64)
            np.add.at(sums, back, v)
            yield rows(lang, key // width, key % width, 1, sums)
        light.clear()

    def heavy_terms(lang: str, term: np.ndarray, g: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        base = absent[lang]
        for t in range(0, int(term[-1]) + 1, DEPTH):
            own = (term >= t) & (term < t + DEPTH)
            dense = np.repeat(base[None], min(DEPTH, int(term[-1]) + 1 - t), 0)
            dense[term[own] - t, g[own]] = p[own]
            for i in range(0, len(base), TILE):
                for j in range(0, len(base), TILE):
                    left, right = dense[:, i : i + TILE], dense[:, j : j + TILE]
                    key = (lang, i // TILE, j // TILE)
                    if key not in tiles:
                        if len(tiles) >= MOST_TILES:
                            yield from told_tiles()
                        tiles[key] = np.zeros((left.shape[1], right.shape[1]), np.int64)
                    for one in range(0, len(dense), 16):
                        tiles[key] += _losses(left[one : one + 16, :, None], right[one : one + 16, None, :]).sum(0)

    def light_terms(lang: str, term: np.ndarray, g: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal n_light
        base = absent[lang]
        first = np.searchsorted(term, np.arange(int(term[-1]) + 2))
        size = (first[1:] - first[:-1])[term]
        ends, i = np.cumsum(size), 0
        while i < len(term):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + MOST_PAIRS, "right")))
            x = np.repeat(np.arange(i, j), size[i:j])
            y = np.arange(len(x)) - np.repeat(np.cumsum(size[i:j]) - size[i:j], size[i:j]) + first[term[x]]
            other = x != y
            x, y = x[other], y[other]
            px, py, ax, ay = p[x], p[y], base[g[x]], base[g[y]]
            v = _losses(px, py) - _losses(px, ay) - _losses(ax, py) + _losses(ax, ay)
            light.append((lang, g[x].astype(np.int64), g[y].astype(np.int64), v))
            n_light += len(x)
            if n_light > MOST_PAIRS:
                yield from told_light()
                n_light = 0
            i = j

    def whole(lang: np.ndarray, key: np.ndarray, term: np.ndarray, g: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Terms, numbered by their turns; key: whether a term is heavy."""
        for name in dict.fromkeys(lang.tolist()):
            for heavy, work in ((True, heavy_terms), (False, light_terms)):
                own = (lang == name) & (key == heavy)
                if own.any():
                    number = np.cumsum(np.concatenate([[False], term[own][1:] != term[own][:-1]]))
                    yield from work(name, number, g[own], p[own])

    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        if rest is not None:
            columns = [np.concatenate([a, b]) for a, b in zip(rest, columns, strict=True)]
        lang, term = columns[0], columns[2]
        turns = np.flatnonzero((term[1:] != term[:-1]) | (lang[1:] != lang[:-1])) + 1
        cut = int(turns[-1]) if len(turns) else 0  # the last term may go on in the next batch
        rest = [c[cut:] for c in columns]
        if cut:
            yield from whole(*[c[:cut] for c in columns])
    if rest is not None and len(rest[0]):
        yield from whole(*rest)
    yield from told_tiles()
    yield from told_light()


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows of every two sources of a language, `term` rows of what a source has most above its language.

    Null text, lang and source are ''. A group without terms has absent shares; a language without kept terms has pairs of
    value 0. Ties go by item in UTF-8 order. Repeated rows count each. Very long texts are counted whole. An empty table
    gives no rows. Ids are not looked at, other columns neither.
    """
    spark = docs.sparkSession
    counts = written(term_counts(docs), "term-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"), F.count("*").alias("k")).where(F.col("docs") >= least_docs).drop("docs")
    kept = written(counts.drop("docs").join(terms, ["lang", "term"]), "kept-terms")
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = occurring.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0)
    numbered = groups.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("of", F.count("*").over(Window.partitionBy("lang")))
    one = F.lit(1).cast("long")
    groups = written(numbered.withColumn("absent", share(one, F.col("total") + F.col("v"))), "groups")
    if groups.count() > MOST_GROUPS:
        raise ValueError(f"over {MOST_GROUPS} groups of language and source")
    small = F.broadcast(groups)  # at most MOST_GROUPS rows

    p = share(F.col("n") + 1, F.col("total") + F.col("v"))
    heavy = F.col("k") >= F.greatest(F.lit(2), F.ceil(F.lit(HEAVY) * F.col("of")))
    postings = written(kept.join(small, ["lang", "source"]).select("lang", "source", "term", "g", p.alias("p"), heavy.alias("heavy"), share(F.col("n_lang") + 1, F.col("lang_total") + F.col("v")).alias("q")), "shares")

    shares = groups.orderBy("lang", "g").select("lang", "absent").toPandas()  # at most MOST_GROUPS rows
    absent = spark.sparkContext.broadcast({lang: own.to_numpy(np.int64) for lang, own in shares.groupby("lang")["absent"]})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pair_sums(batches, absent.value)

    streams = postings.select("lang", "heavy", "term", "g", "p").repartition("lang", "term").sortWithinPartitions("lang", "term", "g")
    both = streams.mapInArrow(sums, "lang string, g int, h int, kind int, value long").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    n_light = postings.where("not heavy").groupBy("lang").agg(F.count_distinct("term").alias("light"))

    # a group's light terms by share: against any other group, what changes where only this group has the term
    own = postings.where("not heavy").groupBy("lang", "g", "p").agg(F.count("*").alias("many"))
    mine = own.join(F.broadcast(groups.select("lang", "g", F.col("absent").alias("a"))), ["lang", "g"])
    other = F.broadcast(groups.select("lang", F.col("g").alias("h"), F.col("absent").alias("b")))
    sided = mine.join(other, "lang").where("g <> h")
    forth = F.col("many") * (loss(F.col("p"), F.col("b")) - loss(F.col("a"), F.col("b")))
    back = F.col("many") * (loss(F.col("b"), F.col("p")) - loss(F.col("b"), F.col("a")))
    sided = sided.groupBy("lang", "g", "h").agg(F.sum(forth).alias("forth"), F.sum(back).alias("back"))
    one_sided = sided.select("lang", "g", "h", F.col("forth").alias("value")).union(sided.select("lang", "h", "g", "back"))
    corrected = both.union(one_sided).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))

    left = groups.select("lang", "source", "g", "absent", "v")
    right = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("absent").alias("b"))
    pairs = left.join(right, "lang").where("g <> h").join(F.broadcast(n_light), "lang", "left").join(corrected, ["lang", "g", "h"], "left")
    zero = F.lit(0).cast("long")
    value = F.when(F.col("v") > 0, F.coalesce("value", zero) + F.coalesce("light", zero) * loss(F.col("absent"), F.col("b"))).otherwise(zero)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    above = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), loss(F.col("p"), F.col("q")).alias("value"))
    top = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)
    return ranked.union(top).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    """All documents; edge cases as in `divergence`."""
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), o AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), v AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY o.lang, o.source, o.term
), t AS (
  SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source
), g AS (
  SELECT groups.lang, groups.source, coalesce(t.total, 0) AS total, v.v FROM groups LEFT JOIN t USING (lang, source) JOIN v ON v.lang = groups.lang
), cells AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
         CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS HUGEINT) AS p
  FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value
  FROM cells AS a JOIN cells AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums AS s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), whole AS (
  SELECT kept.lang, kept.term, CAST(1 + (1000000000::HUGEINT * (kept.n + 1)) // (v.total + v.v) AS HUGEINT) AS q FROM kept JOIN v USING (lang)
), terms AS (
  SELECT cells.lang, cells.source, 'term' AS part, cells.term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value
  FROM cells JOIN whole USING (lang, term) WHERE cells.n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
