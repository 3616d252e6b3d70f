"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of lexicon hits (terms that mark toxic training documents, as words and as word beginnings),
closeness of second-person words to hits, capitals, punctuation, symbols and obfuscated spellings. The lexicon, trees and
calibration come from one bounded sample of labelled rows; scoring is one pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import textvec as tv
from tallyforge.llm.language import letter_table
from tallyforge.llm.shared import crc_mod, fraction, table, written

#: Most labelled documents of each class in the sample.
SAMPLE_TOXIC, SAMPLE_CLEAN = 8_000, 12_000
#: The folds whose features come from a lexicon of the others, and what makes a lexicon term: the least toxic documents with it, log odds, and log odds over their error.
FOLDS, LEAST_DOCUMENTS = 4, 3
LEAST_ODDS, LEAST_Z = 2.0, 2.6
THRESHOLD = 0.7
#: Trees, depth, learning rate, value bins.
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 64
NEAR = 5
FEATURES = ("hit_density", "hits", "strongest", "mean_strength", "strength_density", "near_second_person", "second_person", "capitals", "upper_words", "exclamations", "punctuation", "symbols", "obfuscated", "digits", "log_words")
#: Fixed word list: second-person words of the languages met.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os vuestro"
#: Fixed spelling table: characters that stand for letters in obfuscated words.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def _pronouns() -> np.ndarray:
    codes, bounds = tv.flat(SECOND_PERSON.split())
    return np.sort(tv.span_hash(codes, bounds[:-1], bounds[1:]))


class Words:
    """The words of many texts with their term hashes."""

    def __init__(self, texts: list[str | None]) -> None:
        self.n = len(texts)
        self.raw, self.bounds = tv.flat(texts)
        low = [t.lower() if t else None for t in texts]
        if any(t and len(t) != len(u) for t, u in zip(texts, low, strict=True)):  # some letters grow when lower-cased
            low = ["".join(c.lower()[0] for c in t) if t else None for t in texts]
        codes, _ = tv.flat(low)
        letters = letter_table()
        start, end = tv.runs(tv.is_word(codes), self.bounds)
        letter = letters[codes]
        core = letter | (codes == 64) | (codes == 36) | ((codes >= 48) & (codes <= 57))
        at = np.flatnonzero(core)
        nxt, prv = np.searchsorted(at, start), np.searchsorted(at, end) - 1
        held = nxt <= prv
        start, end = (at[nxt[held]], at[prv[held]] + 1) if len(at) else (start[:0], end[:0])
        counts = np.concatenate([[0], np.cumsum(letter)])
        n_letters = counts[end] - counts[start]
        odd = (n_letters > 0) & (n_letters < end - start)
        subs = np.arange(128, dtype=np.uint32)
        for a, b in STANDS_FOR.items():
            subs[ord(a)] = ord(b)
        plain = np.where(codes < 128, subs[np.minimum(codes, 127)], codes).astype(np.uint32)
        self.doc, self.start, self.end, self.n_letters = tv.doc_of(start, self.bounds), start, end, n_letters
        self.obfuscated = odd & (counts[np.minimum(start + 1, end)] - counts[start] > 0) & (counts[end] - counts[end - 1] > 0)
        self.word = tv.span_hash(codes, start, end)
        mixed = np.flatnonzero(odd)
        if len(mixed):
            self.word[mixed] = tv.span_hash(plain, start[mixed], end[mixed])
        self.terms = [self.word]
        for k in (4, 5):
            long = end - start > k
            h = np.zeros(len(start), tv.U64)
            h[long] = tv.mix(tv.span_hash(plain if len(mixed) else codes, start[long], start[long] + k) + tv.U64(k))
            self.terms.append(h)
        self.codes = codes


def dense(words: Words, lexicon: np.ndarray, strength: np.ndarray, pronouns: np.ndarray) -> np.ndarray:
    """The feature matrix, one row for each text."""
    n, w = words.n, words

    def found(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        return (keys[at] == h if len(keys) else np.zeros(len(h), bool)), at

    best = np.zeros(len(w.doc))
    for h in w.terms:
        hit, at = found(lexicon, h)
        best[hit] = np.maximum(best[hit], strength[at[hit]])
    hit = best > 0
    you = found(pronouns, w.word)[0]
    per = lambda mask, weights=None: np.bincount(w.doc[mask], None if weights is None else weights[mask], n)
    size = np.maximum(np.bincount(w.doc, minlength=n), 1)
    hits = per(hit)
    strongest = np.zeros(n)
    np.maximum.at(strongest, w.doc[hit], best[hit])
    total = per(hit, best)
    places = np.flatnonzero(you)
    near = np.zeros(len(w.doc), bool)
    if len(places):
        at = np.flatnonzero(hit)
        right = np.searchsorted(places, at)
        for side in (np.minimum(right, len(places) - 1), np.maximum(right - 1, 0)):
            p = places[side]
            near[at] |= (np.abs(p - at) <= NEAR) & (w.doc[p] == w.doc[at])
    chars = np.maximum(np.diff(w.bounds), 1)

    def density(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[w.bounds])

    c = w.raw
    letter = letter_table()[c]
    upper = letter & (c != w.codes)
    capitals = density(upper) / np.maximum(density(letter), 1)
    n_upper = np.concatenate([[0], np.cumsum(upper)])
    shouted = (w.n_letters > 2) & (n_upper[w.end] - n_upper[w.start] == w.n_letters)
    symbol = (c == 35) | (c == 42) | (c == 36) | (c == 37) | (c == 38) | (c == 124) | (c == 60) | (c == 62)
    punct = (c > 32) & (c < 127) & ~letter & ~((c >= 48) & (c <= 57))
    return np.stack(
        [hits / size, np.log1p(hits), strongest, total / np.maximum(hits, 1), total / size, per(near) / np.maximum(hits, 1), per(you) / size, capitals, per(shouted) / size,
         density(c == 33) / chars, density(punct) / chars, density(symbol) / chars, per(w.obfuscated) / size, density((c >= 48) & (c <= 57)) / chars, np.log1p(size)], 1)


class Trees:
    """Boosted regression trees on binned features, logistic loss."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._bins(x)
        self.base = float(np.log((weight @ y + 0.5) / (weight @ (1 - y) + 0.5)))
        self.trees: list[list[tuple[int, int, float]]] = []
        f = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = weight * (p - y), np.maximum(weight * p * (1 - p), 1e-6)
            node, tree = np.zeros(len(y), np.int64), []
            for depth in range(DEPTH):
                k = 1 << depth
                best = [(0.0, 0, BINS)] * k
                gs, hs = np.bincount(node, g, k), np.bincount(node, h, k)
                for j in range(x.shape[1]):
                    at = node * BINS + b[:, j]
                    gl = np.cumsum(np.bincount(at, g, k * BINS).reshape(k, BINS), 1)
                    hl = np.cumsum(np.bincount(at, h, k * BINS).reshape(k, BINS), 1)
                    gain = gl**2 / (hl + 1) + (gs[:, None] - gl) ** 2 / (hs[:, None] - hl + 1) - (gs**2 / (hs + 1))[:, None]
                    gain[(hl < 1e-2) | (hs[:, None] - hl < 1e-2)] = 0
                    cut = gain.argmax(1)
                    for i in range(k):
                        if gain[i, cut[i]] > best[i][0] + 1e-12:
                            best[i] = (float(gain[i, cut[i]]), j, int(cut[i]))
                tree.append([(j, c) for _, j, c in best])
                node = 2 * node + self._right(b, node, tree[-1])
            value = -RATE * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + 1)
            self.trees.append((tree, value))
            f += value[node]
        return self

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)

    @staticmethod
    def _right(b: np.ndarray, node: np.ndarray, splits: list[tuple[int, int]]) -> np.ndarray:
        j, c = np.array(splits, np.int64).T
        return (b[np.arange(len(b)), j[node]] > c[node]).astype(np.int64)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, f = self._bins(x), np.full(len(x), self.base)
        for tree, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for splits in tree:
                node = 2 * node + self._right(b, node, splits)
            f += value[node]
        return f


def isotonic(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the best non-descending fit (pool adjacent violators), for linear interpolation."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for x, v, w in zip(raw[order], y[order], weight[order], strict=True):
        blocks.append([x * w, v * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top, strict=True)]
    b = np.array(blocks) if blocks else np.array([[0.0, 0.5, 1.0]])
    return b[:, 0] / b[:, 2], (b[:, 1] + 0.05) / (b[:, 2] + 0.1)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, fold, toxic, n): in how many documents of a fold and class a term occurs."""
    for batch in batches:
        texts, toxic, fold = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for a, b in tv.slices(texts, 4 * tv.SLICE_CHARS):
            w = Words(texts[a:b])
            term, doc = np.concatenate(w.terms), np.tile(w.doc, len(w.terms))
            keep = term != 0
            term, doc = term[keep], doc[keep]
            order = np.lexsort((term, doc))
            term, doc = term[order], doc[order]
            fresh = np.ones(len(term), bool)
            fresh[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
            term, kind = term[fresh], (2 * fold[a:b] + toxic[a:b])[doc[fresh]]
            order = np.lexsort((kind, term))
            term, kind = term[order], kind[order]
            first = np.ones(len(term), bool)
            first[1:] = (term[1:] != term[:-1]) | (kind[1:] != kind[:-1])
            at = np.flatnonzero(first)
            yield pa.RecordBatch.from_arrays([pa.array(term[at].view(np.int64)), pa.array((kind[at] // 2).astype(np.int32)), pa.array((kind[at] % 2).astype(np.int32)), pa.array(np.diff(np.append(at, len(term))))], names=["term", "fold", "toxic", "n"])


def _lexicon(term: np.ndarray, tox: np.ndarray, clean: np.ndarray, n_tox: float, n_clean: float) -> tuple[np.ndarray, np.ndarray]:
    odds = np.log((tox + 0.5) / (n_tox + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    z = odds / np.sqrt(1 / (tox + 0.5) + 1 / (clean + 0.5))
    keep = (tox >= LEAST_DOCUMENTS) & (odds >= LEAST_ODDS) & (z >= LEAST_Z)
    order = np.argsort(term[keep])
    return term[keep][order], odds[keep][order]


class Model:
    """Everything that scoring needs; small."""

    def __init__(self, lexicon: np.ndarray, strength: np.ndarray, trees: Trees | None, curve: tuple[np.ndarray, np.ndarray]) -> None:
        self.lexicon, self.strength, self.trees, self.curve, self.pronouns = lexicon, strength, trees, curve, _pronouns()

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(texts))
        x = dense(Words(texts), self.lexicon, self.strength, self.pronouns)
        return np.round(np.clip(np.interp(self.trees.raw(x), *self.curve), 0.0, 1.0), 6)


def fit(docs: DataFrame, labels: DataFrame, train) -> Model:
    """A model from at most about SAMPLE_TOXIC + SAMPLE_CLEAN labelled documents, chosen by a hash of the id."""
    spark = docs.sparkSession
    known = labels.where(train & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(0, tv.U64), np.zeros(0), None, (np.zeros(1), np.zeros(1)))
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, SAMPLE_TOXIC / n1))).otherwise(F.lit(min(1.0, SAMPLE_CLEAN / n0)))
    chosen = known.where(fraction(F.xxhash64("doc_id", F.lit(5))) < share)  # about 20,000 ids at most: small enough to broadcast
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    sample = written(sample.select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(FOLDS)).cast("int").alias("fold")), "toxic-sample")
    rows = {(r["fold"], r["toxic"]): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
    size = np.array([[rows.get((f, t), 0) for t in (0, 1)] for f in range(FOLDS)], float)
    cells = [(f, t) for f in range(FOLDS) for t in (0, 1)]
    seen = sample.mapInArrow(_term_counts, "term long, fold int, toxic int, n long").groupBy("term").agg(*[F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{f}{t}") for f, t in cells])

    def telling(skip: int | None) -> F.Column:
        tox, clean = (sum(F.col(f"n{f}{t}") for f in range(FOLDS) if f != skip) + 0.5 for t in (1, 0))
        n_clean, n_tox = size.sum(0) if skip is None else size.sum(0) - size[skip]
        odds = F.log(tox / float(n_tox + 1)) - F.log(clean / float(n_clean + 1))
        return (tox > LEAST_DOCUMENTS) & (odds >= LEAST_ODDS - 1e-9) & (odds / F.sqrt(1 / tox + 1 / clean) >= LEAST_Z - 1e-9)

    wanted = telling(None)
    for f in range(FOLDS):
        wanted = wanted | telling(f)
    seen = seen.where(wanted).toPandas().sort_values("term", ignore_index=True)  # only what some lexicon takes, from the bounded sample
    terms = seen["term"].to_numpy(np.int64).view(tv.U64)
    table_ = np.stack([seen[f"n{f}{t}"].to_numpy(float) for f, t in cells]).reshape(FOLDS, 2, len(terms))
    rest = lambda x, f: x.sum(0) - x[f]
    others = [_lexicon(terms, rest(table_, f)[1], rest(table_, f)[0], rest(size, f)[1], rest(size, f)[0]) for f in range(FOLDS)]
    full = _lexicon(terms, table_[:, 1].sum(0), table_[:, 0].sum(0), size[:, 1].sum(), size[:, 0].sum())
    told = spark.sparkContext.broadcast((others, _pronouns()))

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons, pronouns = told.value
        for batch in batches:
            texts, fold = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            for f in range(FOLDS):
                own = np.flatnonzero(fold == f)
                for a, b in tv.slices([texts[i] for i in own]):
                    x = dense(Words([texts[i] for i in own[a:b]]), *lexicons[f], pronouns)
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1).take(pa.array(own[a:b]))], names=["x", "toxic"])

    got = sample.mapInArrow(crossed, "x array<double>, toxic int").toPandas()  # numbers only, for the bounded sample
    x, y = np.stack(got["x"].to_numpy()), got["toxic"].to_numpy(float)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    weight = np.where(y == 1, n1 / max(y.sum(), 1), n0 / max((1 - y).sum(), 1))
    part = np.random.default_rng(3).permutation(len(y)) % 4
    raw = np.zeros(len(y))
    for k in range(4):
        raw[part == k] = Trees().fit(x[part != k], y[part != k], weight[part != k]).raw(x[part == k])
    return Model(*full, Trees().fit(x, y, weight), isotonic(raw, y, weight))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document, one row for each row. Null and empty texts have the score of a text without hits."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in tv.parts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(shared.value.scores(texts))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op4_toxicity_trees(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(False)))
    return score(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
