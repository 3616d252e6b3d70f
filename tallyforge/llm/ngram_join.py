"""N-gram Jaccard join with set-relation skipping.

Each distinct shingle set is indexed by a prefix of its shingles, rarest first. Index lists carry the size and position
of each entry; entries lie in blocks by size and position, and an entry's own size and position say which blocks it is
compared with, so that all others are skipped.

The join (`links`, `link_counts`) gives every pair of sets that meets the threshold. A set's answers are derived from
those of its leader: the distance 1 - Jaccard is a metric, so two sets' exact distances to one leader often settle
whether they link; the other candidates are verified. Documents of one set share its answers.

Components (`jaccard_components`) need fewer comparisons: every list first links its sets to leaders, verified exactly;
sets that turn out linked share one class, lists that hold a single class are skipped, and only pairs of different
classes are compared afterwards. No link between different classes is lost. Nothing is capped in either.

Which shingles count as frequent only decides the order in prefixes, never a result; any order gives the same links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import textvec as tv
from tallyforge.llm.shared import table, written

WIDTH = 5
PERCENT = 80
#: Most shingles that are told to all tasks as frequent (8 bytes each).
MAX_FREQUENT = 400_000
#: A shingle counts as frequent from so many documents on, if the bound allows.
FREQUENT_FROM = 12
#: Rounds of comparing sets with their lists' leaders before all pairs of different classes are compared.
MAX_LEADERS = 4
#: A shingle known to be in 2 ** HOT_LEVEL sets or more has a list that is dealt over SALTS tasks; what a task remembers of
#: sets and shingles it has seen, to tell fewer things twice.
HOT_LEVEL, SALTS = 10, 64
MOST_SEEN, MOST_HELD = 250_000, 2_000_000
#: Largest bit array (16 MB) that tells which documents' texts are to be compared, and its bits a document; beyond that the
#: texts are found by a join.
MOST_BITS, BITS_EACH = 1 << 27, 16
#: Keys that hold at least so many rows, and at least one in so many of all rows, are looked up in a table that all tasks
#: have: it has no more than MOST_HOT rows.
LEAST_HOT, MOST_HOT = 1_000, 10_000
_STEP = [tv.U64(x) for x in (0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document index and hash of each distinct shingle (ascending by both), set sizes, and a hash of each set."""
    codes, bounds = tv.flat(texts)
    codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.uint32)
    start, end = tv.runs(tv.is_word(codes), bounds)
    word = tv.span_hash(codes, start, end)
    doc = tv.doc_of(start, bounds)
    n = len(texts)
    whole = np.zeros(0, np.int64)
    if len(word) >= WIDTH:
        whole = np.flatnonzero(doc[: len(doc) - WIDTH + 1] == doc[WIDTH - 1 :])
    h = np.zeros(len(whole), tv.U64)
    for k in range(WIDTH):
        h += word[whole + k] * _STEP[k]
    ids, h = doc[whole], tv.mix(h)
    counts = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < WIDTH))
    if len(short):
        at = np.searchsorted(doc, short)
        own = np.zeros(len(short), tv.U64)
        for k in range(WIDTH - 1):
            held = counts[short] > k
            own[held] += word[at[held] + k] * _STEP[k]
        own = tv.mix(own ^ (counts[short].astype(tv.U64) * tv.U64(0x9FB21C651E98DF25)))
        ids, h = np.concatenate([ids, short]), np.concatenate([h, own])
    order = np.lexsort((h, ids))
    ids, h = ids[order], h[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (h[1:] != h[:-1])
    ids, h = ids[fresh], h[fresh]
    return ids, h, np.bincount(ids, minlength=n) if len(ids) else np.zeros(n, np.int64), tv.sums_by(tv.mix(h + tv.U64(1)), ids, n)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(tv.U64, copy=False).view(np.int64))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document (kind 0) its id, set and size; (kind 1) shingles found in two or more different sets of a task."""
    names, seen, held, n_held = ["kind", "a", "b", "c"], set(), [], 0

    def common() -> pa.RecordBatch:
        h, count = np.unique(np.concatenate(held), return_counts=True)
        h, count = h[count > 1], count[count > 1]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), _signed(h), pa.array(count.astype(np.int64)), pa.array(np.zeros(len(h), np.int64))], names=names)

    for batch in batches:
        ids = batch.column(0)
        for a, b, texts in tv.parts(batch.column(1)):
            doc, h, size, sid = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b - a, np.int32)), ids.slice(a, b - a).cast(pa.int64()), _signed(sid), pa.array(size.astype(np.int64))], names=names)
            new = np.zeros(b - a, bool)
            for k, s in enumerate(sid.tolist()):
                new[k] = s not in seen
                seen.add(s)
            if len(seen) > MOST_SEEN:
                seen.clear()
            held.append(h[new[doc]])
            n_held += len(held[-1])
            if n_held > MOST_HELD:
                yield common()
                n_held = 0
    if held:
        yield common()


def _prefixes(frequent: np.ndarray, levels: np.ndarray):
    """Index entries of each set: its rarest shingles, as many as one of which any set of enough overlap must share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for a, b, texts in tv.parts(batch.column(0)):
                doc, h, size, sid = shingle_sets(texts)
                new = np.zeros(b - a, bool)
                for k, s in enumerate(sid.tolist()):
                    new[k] = s not in seen and size[k] > 0
                    seen.add(s)
                if len(seen) > MOST_SEEN:
                    seen.clear()
                doc, h = doc[new[doc]], h[new[doc]]
                level = np.zeros(len(h), tv.U64)
                if len(frequent) and len(h):
                    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                    level = np.where(frequent[at] == h, levels[at], 0).astype(tv.U64)
                hot = level >= HOT_LEVEL
                order = np.lexsort(((level << tv.U64(57)) | (h >> tv.U64(7)), doc))
                doc, h, hot = doc[order], h[order], hot[order]
                at = np.arange(len(h)) - np.searchsorted(doc, doc)
                n = size[doc]
                keep = at < n - (PERCENT * n + 99) // 100 + 1
                doc, h, at, hot = doc[keep], h[keep], at[keep], hot[keep]
                yield pa.RecordBatch.from_arrays([_signed(h), _signed(sid[doc]), pa.array(size[doc].astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(hot)], names=["token", "sid", "n", "pos", "hot"])

    return run


def _texts_of(docs: DataFrame, named: DataFrame) -> DataFrame:
    """(sid, text) of the documents in named, and of few others: ids are told as a bit array that follows their number."""
    held = named.count()
    n_bits = 1 << max(16, (BITS_EACH * held).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared is not None:
                at = batch.column(1).to_numpy()
                batch = batch.filter(pa.array((shared.value[at // 64] >> (at % 64)) & 1 == 1))
            for _, _, texts in tv.parts(batch.column(0)):
                sid = shingle_sets(texts)[3].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(texts, pa.string())], names=["sid", "text"])

    if n_bits > MOST_BITS:
        shared = None
        return docs.join(named.select("doc_id").distinct(), "doc_id", "left_semi").select("text", F.lit(0).alias("at")).mapInArrow(run, "sid long, text string")
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(n_bits))
    words = named.select(F.floor(bit / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {n_bits}) % 64 as int))").alias("b"))
    bits = np.zeros(n_bits // 64, np.int64)
    for part in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():  # at most MOST_BITS / 64 rows
        bits[part["w"]] = part["b"]
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    return docs.where("doc_id is not null").select("text", bit.alias("at")).mapInArrow(run, "sid long, text string")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs with the sizes of intersection and union, counted exactly, and whether they meet the threshold."""
    for batch in batches:
        x, y = (batch.column(k).to_numpy() for k in (0, 1))
        tx, ty = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        sizes = [(len(p or "") + len(q or "")) for p, q in zip(tx, ty, strict=True)]
        ends = np.flatnonzero(np.diff(np.cumsum([0, *sizes]) // (2 * tv.SLICE_CHARS))) + 1
        for a, b in zip([0, *ends], [*ends, len(x)], strict=True):
            if a == b:
                continue
            number: dict[int, int] = {}
            texts: list[str | None] = []
            for s, t in [*zip(x[a:b].tolist(), tx[a:b], strict=True), *zip(y[a:b].tolist(), ty[a:b], strict=True)]:
                if s not in number:
                    number[s] = len(texts)
                    texts.append(t)
            doc, h, size, _ = shingle_sets(texts)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            shared, union = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
            for k in range(a, b):
                i, j = number[int(x[k])], number[int(y[k])]
                both = np.concatenate([h[cut[i] : cut[i + 1]], h[cut[j] : cut[j + 1]]])
                both.sort()
                shared[k - a] = (both[1:] == both[:-1]).sum()
                union[k - a] = len(both) - shared[k - a]
            yield pa.RecordBatch.from_arrays([pa.array(x[a:b]), pa.array(y[a:b]), pa.array(shared), pa.array(union), pa.array(100 * shared >= PERCENT * union)], names=["x", "y", "shared", "union", "linked"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (x, y) with the sizes `shared` and `union` and a boolean `linked`; each text travels to its pairs, pairs never gather in one group."""
    both = (
        pairs.join(texts.select(F.col("sid").alias("x"), F.col("text").alias("tx")), "x")
        .join(texts.select(F.col("sid").alias("y"), F.col("text").alias("ty")), "y")
        .select("x", "y", "tx", "ty")
    )
    return both.mapInArrow(_verified, "x long, y long, shared long, union long, linked boolean")


def components(edges: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """(node, root) of the graph's components, root the smallest node; alternating large-star and small-star steps."""
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
        e = written(small.where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _open(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries of the lists that still hold two classes or more."""
    own = written(lists.join(roots, lists.sid == roots.node, "left").select("token", "sid", "n", "pos", "held", F.coalesce("root", "sid").alias("class")), "classed")
    return _several(own, "class")


def _several(entries: DataFrame, column: str) -> DataFrame:
    """Entries of the lists in which `column` has two values or more; counted by partial aggregates, so a long list is no task's own."""
    mixed = entries.groupBy("token").agg(F.min(column).alias("lo"), F.max(column).alias("hi")).where("lo < hi").select("token")
    return entries.join(mixed, "token", "left_semi")


def _rest(n):
    """Shingles of a set of n that are not in its prefix."""
    return F.ceil(F.lit(PERCENT) * n / 100 - 1e-9) - 1


def _enough(common, nx, ny):
    """Whether two sets with so many common prefix shingles can meet the threshold.

    Common shingles up to where the first of the two prefixes ends are all counted; behind it there are no more than what
    that set has left.
    """
    return common + F.greatest(_rest(nx), _rest(ny)) >= F.ceil(F.lit(PERCENT) * (nx + ny) / (100 + PERCENT) - 1e-9)


def _led(lists: DataFrame, seed: int) -> DataFrame:
    """For each set the leader of another class that most of its lists name, if their common prefixes allow a link.

    A list's leader is first (seed 0) the set with the largest share of its prefix in lists, which the centre of a group of
    near copies has, then the least one by a seeded order.
    """
    order = -F.col("held") if seed == 0 else F.xxhash64(F.lit(seed), "sid").cast("double")
    leads = lists.groupBy("token").agg(F.min(F.struct(order.alias("o"), "sid", "n", "class")).alias("lead"))
    votes = lists.join(leads, "token").where(F.expr(f"lead.class <> class and 100 * least(n, lead.n) >= {PERCENT} * greatest(n, lead.n)")).groupBy("sid", F.col("lead.sid").alias("other")).agg(F.count("*").alias("votes"))
    pairs = votes.groupBy("sid").agg(F.max_by("other", F.struct("votes", "other")).alias("other")).withColumnRenamed("sid", "x").withColumnRenamed("other", "y")
    return _possible(pairs, lists)


def _possible(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """The pairs whose common prefix shingles, counted over all lists, allow a link."""
    mine = pairs.join(lists.select("token", F.col("sid").alias("x"), F.col("n").alias("nx")), "x")
    both = mine.join(lists.select("token", F.col("sid").alias("y"), F.col("n").alias("ny")), ["token", "y"])
    counted = both.groupBy("x", "y").agg(F.count("*").alias("common"), F.first("nx").alias("nx"), F.first("ny").alias("ny"))
    return counted.where(_enough(F.col("common"), F.col("nx"), F.col("ny"))).select("x", "y")


def _across(lists: DataFrame) -> DataFrame:
    """All pairs of different classes that lists hold in blocks of compatible size, if position and common prefix allow a link.

    Of the shingles that two sets share, the first in the order has so early a position in both that all they must share
    still follows; entries further back, which for most pairs that fall short are all they share, are skipped. So with its
    size, an entry's position gives the largest set it can lead to, and with that the blocks to look into.
    """
    base = 100 / PERCENT
    block = lambda n: F.floor(F.log(n) / F.lit(math.log(base) / 2))
    depth = lambda pos: F.floor(F.log2(pos + 1))
    least = F.ceil(F.lit(PERCENT) * F.col("n") / 100 - 1e-9)
    most = F.least(F.col("n"), F.floor(F.lit(100 + PERCENT) * (F.col("n") - F.col("pos")) / PERCENT + 1e-9) - F.col("n"))
    l = lists.where(most >= least).withColumn("block", F.explode(F.sequence(block(least), block(most))))
    # the largest set of a block may share its entry at this position at the latest, if enough is to follow
    largest = F.least(F.col("n"), F.ceil(F.pow(F.lit(base), (F.col("block") + 1) / 2)))
    latest = F.floor(largest - F.lit(PERCENT) * (F.col("n") + largest) / (100 + PERCENT) + 1e-9)
    l = l.where(latest >= 0).withColumn("depth", F.explode(F.sequence(F.lit(0).cast("long"), depth(latest)))).alias("l")
    r = lists.withColumn("block", block(F.col("n"))).withColumn("depth", depth(F.col("pos"))).alias("r")
    need = F.ceil(F.lit(PERCENT) * (F.col("l.n") + F.col("r.n")) / (100 + PERCENT) - 1e-9)
    pairs = (
        l.join(r, ["token", "block", "depth"])
        .where("l.class <> r.class and (l.n > r.n or l.n = r.n and l.sid > r.sid)")
        .where(100 * F.col("r.n") >= PERCENT * F.col("l.n"))
        .where((F.col("l.n") - F.col("l.pos") >= need) & (F.col("r.n") - F.col("r.pos") >= need))
        .select(F.col("l.sid").alias("x"), F.col("r.sid").alias("y"))
        .distinct()
    )
    return _possible(pairs, lists)


def _indexed(docs: DataFrame, id_col: str, text_col: str):
    """(doc_id, sid, n) of all documents, the lists of the index, and a function that verifies pairs of sets."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = written(docs.mapInArrow(_sizes, "kind int, a long, b long, c long"), "sets")
    sets = first.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("sid"), F.col("c").alias("n"))
    total = first.where("kind = 1").groupBy(F.col("a").alias("token")).agg(F.sum("b").alias("df"))
    held = {r["level"]: r["count"] for r in total.where(F.col("df") >= FREQUENT_FROM).groupBy(F.floor(F.log2("df")).cast("int").alias("level")).count().collect()}
    level, left = 62, MAX_FREQUENT
    while level > 0 and held.get(level, 0) <= left:
        left -= held.get(level, 0)
        level -= 1
    rows = total.where((F.col("df") >= FREQUENT_FROM) & (F.floor(F.log2("df")) > level)).select("token", F.floor(F.log2("df")).cast("int").alias("level")).toPandas()  # at most MAX_FREQUENT
    frequent, levels = rows["token"].to_numpy(np.int64).view(tv.U64), rows["level"].to_numpy(np.int64)
    order = np.argsort(frequent)
    shared = spark.sparkContext.broadcast((frequent[order], levels[order]))

    def prefixes(batches):
        yield from _prefixes(*shared.value)(batches)

    # rows without an id link with nothing, so their sets are not indexed
    entries = docs.where("doc_id is not null").select("text").mapInArrow(prefixes, "token long, sid long, n int, pos int, hot boolean")
    # a list with one set leads nowhere; a hot one has more, whatever part of it a task sees
    per = Window.partitionBy("token", "deal")
    entries = entries.withColumn("deal", F.when(F.col("hot"), F.pmod(F.xxhash64("sid"), F.lit(SALTS))).otherwise(0))
    several = entries.withColumn("lo", F.min("sid").over(per)).withColumn("hi", F.max("sid").over(per)).where("lo < hi or hot").select("token", "sid", "n", "pos")
    lists = written(several.distinct(), "shared-lists")

    prefix = F.col("n") - F.ceil(F.lit(PERCENT) * F.col("n") / 100 - 1e-9) + 1
    share = lists.groupBy("sid", "n").agg(F.count("*").alias("held")).select("sid", (F.col("held") / prefix).alias("held"))
    lists = written(lists.join(share, "sid"), "lists")
    reps = sets.where("n > 0 and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))

    def counted(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        ends = pairs.select(F.col("x").alias("sid")).union(pairs.select("y")).distinct()
        texts = written(_texts_of(docs, reps.join(ends, "sid", "left_semi")), "texts")
        return written(verified(pairs, texts), "verified")

    return sets, lists, counted


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The join: (x, y) of all pairs of different sets with a similarity of 0.8 or more, and (doc_id, sid, n) of all documents.

    Documents of one set (sid) link with each other and with all documents of linked sets; empty sets and rows with a null
    id link with nothing. A group of k different near copies has up to k * (k - 1) / 2 links, which are all given.
    """
    sets, lists, counted = _indexed(docs, id_col, text_col)
    return _joined(lists, counted)[0], sets


def _joined(lists: DataFrame, counted) -> tuple[DataFrame, DataFrame]:
    """(x, y) of all linked pairs, and (sid, lead) of the sets that link with their leader."""
    lists = lists.withColumn("class", F.col("sid"))
    led = counted(_led(lists, 0)).select(F.col("x").alias("sid"), F.col("y").alias("lead"), "shared", "union")
    itself = led.select(F.col("lead").alias("sid"), "lead", F.lit(1).cast("long").alias("shared"), F.lit(1).cast("long").alias("union")).distinct()
    answers = written(led.union(itself), "answers")
    candidates = written(_across(lists), "candidates")
    a, b = (answers.select(F.col("sid").alias(k), "lead", (F.col("union") - F.col("shared")).alias(f"d{k}"), F.col("union").alias(f"u{k}")) for k in "xy")
    both = candidates.join(a, "x").join(b, ["y", "lead"])
    # distances as exact fractions: dx / ux from x to the leader, dy / uy from y; linked up to (100 - PERCENT) / 100
    far = F.lit(100 - PERCENT).cast("long") * F.col("ux") * F.col("uy")
    p, q = 100 * F.col("dx") * F.col("uy"), 100 * F.col("dy") * F.col("ux")
    told = F.when(p + q <= far, True).when(F.abs(p - q) > far, False)
    derived = written(both.select("x", "y", told.alias("linked")).where("linked is not null").groupBy("x", "y").agg(F.first("linked").alias("linked")), "derived")
    rest = counted(candidates.join(derived, ["x", "y"], "left_anti"))
    found = derived.where("linked").select("x", "y").union(rest.where("linked").select("x", "y"))
    return found, answers.where(100 * F.col("shared") >= PERCENT * F.col("union")).select("sid", "lead")


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document: with how many others it has a similarity of 0.8 or more.

    Counts and components both come from the join's links, which are counted as they are read and written nowhere as such.
    Components follow links between sets of different leaders, and those of leaders: other links join what is joined.
    Rows are counted, so equal ids count each; rows with a null id are counted nowhere, have 0 links and no component;
    empty sets are their own component. An empty table gives no rows.
    """
    sets, lists, counted = _indexed(docs, id_col, text_col)
    pairs, led = _joined(lists, counted)
    held = written(sets.where("n > 0 and doc_id is not null").groupBy("sid").agg(F.count("*").alias("held"), F.min("doc_id").alias("lowest")), "held")
    ends = pairs.union(pairs.select("y", "x")).toDF("sid", "other")
    other = ends.join(held.select(F.col("sid").alias("other"), F.col("held").alias("more")), "other").groupBy("sid").agg(F.sum("more").alias("more"))
    of = lambda k: led.select(F.col("sid").alias(k), F.col("lead").alias(f"lead_{k}"))
    across = pairs.join(of("x"), "x", "left").join(of("y"), "y", "left").where(F.coalesce("lead_x", "x") != F.coalesce("lead_y", "y")).select("x", "y")
    roots = components(across.union(led.select("sid", "lead"))).withColumnRenamed("node", "sid")
    own = held.join(other, "sid", "left").join(roots, "sid", "left").select("sid", "lowest", F.col("held").alias("rows"), (F.col("held") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("root", "sid").alias("class"))
    own = written(own, "link-counts")
    lowest = own.groupBy("class").agg(F.min("lowest").alias("component_id"))
    found = own.drop("lowest").join(lowest, "class")
    known = looked_up(sets.where("n > 0 and doc_id is not null"), "sid", found.select("sid", "component_id", "n_links", "rows")).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    return known.union(sets.where("n = 0 or doc_id is null").select("doc_id", "n", "doc_id", F.lit(0).cast("long")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; two link at a Jaccard similarity of 0.8 or more.

    Null and wordless texts have an empty set (0 shingles) and link with nothing, their component is their own id. Rows
    with a null id get a null component and no links. Equal ids share what their sets reach. An empty table gives no rows.
    """
    sets, lists, counted = _indexed(docs, id_col, text_col)

    def checked(pairs: DataFrame) -> DataFrame:
        return counted(pairs).where("linked").select("x", "y").distinct()

    open_lists, links, roots, seed, gain = lists.withColumn("class", F.col("sid")), None, None, 0, 0
    while True:
        size = open_lists.count()
        if not size:
            break
        spread = open_lists.groupBy("token", "class").agg(F.count("*").alias("k")).groupBy("token").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"))
        rest = spread.agg(F.sum(F.col("k") * F.col("k") - F.col("kk")) / 2).first()[0]
        # leaders go on only while most of the pairs would be in open lists and leaders still find links
        last = rest <= size or seed >= MAX_LEADERS or seed > 0 and (rest <= 20 * size or gain * 20 < size)
        new = checked(_across(open_lists) if last else _led(open_lists, seed))
        gain = 0 if last else new.count()
        links = new if links is None else links.union(new)
        if last:
            break
        if seed:
            roots = components(links)
        else:  # each set has one link at most: its leader, or its leader's leader, will do as its class
            up = new.select(F.col("x").alias("node"), F.col("y").alias("root"))
            roots = up.join(up.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        open_lists, seed = written(_open(lists, roots), "open"), seed + 1
    own = sets.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("held"))
    if links is None:
        found = own.select("sid", F.col("doc_id").alias("component_id"), "held")
    else:
        roots = components(links)
        own = written(own.join(roots, own.sid == roots.node, "left").select("sid", "doc_id", "held", F.coalesce("root", "sid").alias("class")), "classes")
        lowest = own.groupBy("class").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows"))
        found = looked_up(own, "class", lowest).select("sid", "component_id", "held")
    found = found.withColumnRenamed("held", "rows")
    out = looked_up(sets.where("n > 0"), "sid", found).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return out.union(sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def looked_up(rows: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """rows with what values has for their key; values: one row for each key, `rows` says how many of rows have it."""
    values = written(values, "values")
    least = max(LEAST_HOT, (values.agg(F.sum("rows")).first()[0] or 0) // MOST_HOT)
    hot = values.where(F.col("rows") >= least)  # at most MOST_HOT rows
    many = rows.join(F.broadcast(hot), key)
    few = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(values.where(F.col("rows") < least), key)
    return many.unionByName(few)


def near_duplicate_representatives(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each group: the one with the smallest id stays, with its columns as they are.

    Rows with a null id have no group and stay; of rows that share an id, all stay if that id is its group's smallest.
    """
    found = jaccard_components(docs)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select("doc_id", F.struct("*").alias("row"))  # columns of any name stay apart
    return rows.join(gone, F.col("doc_id").cast("long") == F.col("gone"), "left_anti").select("row.*")


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id; edge cases as in `jaccard_components`."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_links(spark, sf_dir: str) -> DataFrame:
    """As op2_ngram_jaccard, from the join's links: doc_id, n_shingles, component_id and n_links; edge cases as in `link_counts`."""
    return link_counts(table(spark, sf_dir, "documents"))
