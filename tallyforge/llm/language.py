"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, its character n-grams with word borders, and itself (the lexicon), hashed into one
weight table; transitions between the labels of neighbouring words are learned with them, from sequences in which pieces
of documents of different languages follow each other. Forward-backward over whole texts gives each word's label
probabilities; a document's language is the one with the greatest mean probability.

Emission scores depend on the word alone, so each task keeps a bounded table of them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import textvec as tv
from tallyforge.llm.shared import crc_mod, fraction, table, written

#: The fit sees about this many labelled documents a language, and one window of so many characters of each; the window
#: lies at a hash of the id. Predictions read whole texts. Every learned lang value can be predicted.
SAMPLE_PER_LANGUAGE = 240
SAMPLE_CHARS = 8_000
BUCKETS = 1 << 16
#: Training sequences: words in each, chance that the language may change at a word, sequences a step, steps.
LENGTH, CHANGE, BATCH, STEPS = 32, 0.05, 160, 150
PART_CHARS, GROUP_CHARS = 8_000_000, 2_000_000
MAX_WORDS = 200_000
_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """True at the code point of each letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def lowered_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, their bounds, and starts and ends of the runs of letters; offsets are those of the texts."""
    low = [t.lower() if t else None for t in texts]
    if any(t and len(t) != len(u) for t, u in zip(texts, low, strict=True)):  # some letters grow when lower-cased
        low = ["".join(c.lower()[0] for c in t) if t and len(t) != len(u) else u for t, u in zip(texts, low, strict=True)]
    codes, bounds = tv.flat(low)
    start, end = tv.runs(letter_table()[codes], bounds)
    return codes, bounds, start, end


def features(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the words in a row, and the word that each belongs to (ascending within a width)."""
    lens = end - start
    buckets, owner = [], []
    width = np.maximum(8, 1 << np.ceil(np.log2(np.maximum(lens, 1))).astype(np.int64))
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, max(1, len(rows) * int(w) // 400_000)):
            n = lens[part]
            at = np.arange(w)
            m = np.zeros((len(part), w + 2), np.uint64)
            m[:, 1:-1] = np.where(at < n[:, None], codes[np.minimum(start[part][:, None] + at, len(codes) - 1)], 0)
            m[:, 0] = 1
            m[np.arange(len(part)), n + 1] = 2

            def put(h: np.ndarray, kind: int, own: np.ndarray) -> None:
                buckets.append((tv.mix(h + np.uint64(kind << 58)) % np.uint64(BUCKETS)).astype(np.int64))
                owner.append(own)

            two = m[:, :-1] * np.uint64(0x110011) + m[:, 1:]
            r, c = np.nonzero(np.arange(w + 1) <= n[:, None])
            put(two[r, c], 1, part[r])
            three = two[:, :-1] * np.uint64(0x110011) + m[:, 2:]
            r, c = np.nonzero(np.arange(w) < n[:, None])
            put(three[r, c], 2, part[r])
            for k in (1, 2, 3, 4):
                long = np.flatnonzero(n >= k)
                for side, first in ((0, np.zeros(len(long), np.int64)), (1, n[long] - k)):
                    h = np.zeros(len(long), np.uint64)
                    for j in range(k):
                        h = h * np.uint64(0x1000003) + m[long, 1 + first + j]
                    put(h, 3 + 4 * side + k, part[long])
    words = tv.span_hash(codes, start, end)
    buckets.append((tv.mix(words + np.uint64(12 << 58)) % np.uint64(BUCKETS)).astype(np.int64))
    owner.append(np.arange(len(start)))
    return np.concatenate(buckets), np.concatenate(owner)


def emissions(weights: np.ndarray, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Scores of each word for each label."""
    bucket, owner = features(codes, start, end)
    out = np.zeros((len(start), weights.shape[1]))
    for label in range(weights.shape[1]):
        out[:, label] = np.bincount(owner, weights[bucket, label], len(start))
    return out


def marginals(scores: np.ndarray, row: np.ndarray, begin: np.ndarray, size: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The label probabilities of the word at each place, by forward-backward over all texts in step.

    scores: of distinct words; row: the distinct word at each place; begin, size: each text's places.
    """
    labels = scores.shape[1]
    e = np.exp(scores - scores.max(1, keepdims=True, initial=-1e300)) if len(scores) else scores
    a = np.exp(transitions)
    back_a = np.ascontiguousarray(a.T)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    n = int((size > 0).sum())
    steps = int(size[0]) if n else 0
    active = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
    alpha = np.zeros((len(row), labels))
    here = np.full((n, labels), 1.0 / labels)
    for t in range(steps):
        m = active[t]
        at = begin[:m] + t
        here = (here[:m] @ a if t else here[:m]) * e[row[at]]
        here /= here.sum(1, keepdims=True)
        alpha[at] = here
    beta = np.ones((n, labels))
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        if t + 1 < steps and (k := active[t + 1]):
            b = (e[row[at[:k] + 1]] * beta[:k]) @ back_a
            beta[:k] = b / b.sum(1, keepdims=True)
        p = alpha[at] * beta[:m]
        alpha[at] = p / p.sum(1, keepdims=True)
    return alpha


def marginal_sums(scores: np.ndarray, row: np.ndarray, begin: np.ndarray, size: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Sums of the words' label probabilities for each text; begin ascends and leaves no gaps."""
    p = marginals(scores, row, begin, size, transitions)
    out = np.zeros((len(size), scores.shape[1]))
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.add.reduceat(p, begin[some])
    return out


def fit(texts: list[str], labels: np.ndarray, n_labels: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights (buckets x labels) and transitions (labels x labels), by AdaGrad on sequence likelihood."""
    rng = np.random.default_rng(seed)
    weights, transitions = np.zeros((BUCKETS, n_labels)), np.zeros((n_labels, n_labels))
    codes, bounds, start, end = lowered_words(texts)
    doc = tv.doc_of(start, bounds)
    first, begin_of = np.unique(doc, return_index=True)
    size_of = np.diff(np.append(begin_of, len(doc)))
    pools = [np.flatnonzero(labels[first] == k) for k in range(n_labels)]
    if not any(len(p) for p in pools):
        return weights, transitions
    h, at, row = np.unique(tv.span_hash(codes, start, end), return_index=True, return_inverse=True)
    bucket, owner = features(codes, start[at], end[at])
    order = np.argsort(owner, kind="stable")
    bucket, cut = bucket[order], np.searchsorted(owner[order], np.arange(len(h) + 1))
    held = [k for k in range(n_labels) if len(pools[k])]
    g2, t2 = np.full_like(weights, 1e-2), np.full_like(transitions, 1.0)
    for _ in range(STEPS):
        y = np.zeros((BATCH, LENGTH), np.int64)
        x = np.zeros((BATCH, LENGTH), np.int64)
        for s in range(BATCH):
            t = 0
            while t < LENGTH:
                k = held[rng.integers(len(held))]
                d = pools[k][rng.integers(len(pools[k]))]
                n = min(LENGTH - t, int(rng.geometric(CHANGE)), int(size_of[d]))
                p = begin_of[d] + rng.integers(size_of[d] - n + 1)
                x[s, t : t + n], y[s, t : t + n] = row[p : p + n], k
                t += n
        used, inner = np.unique(x, return_inverse=True)
        inner = inner.reshape(x.shape)
        lens = cut[used + 1] - cut[used]
        own = bucket[np.repeat(cut[used] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))]
        word = np.repeat(np.arange(len(used)), lens)
        scores = np.stack([np.bincount(word, weights[own, k], len(used)) for k in range(n_labels)], 1)
        e = np.exp(scores - scores.max(1, keepdims=True))[inner]
        a = np.exp(transitions)
        alpha, beta = np.zeros(e.shape), np.ones(e.shape)
        for t in range(LENGTH):
            alpha[:, t] = (alpha[:, t - 1] @ a if t else 1.0) * e[:, t]
            alpha[:, t] /= alpha[:, t].sum(1, keepdims=True)
        pairs = np.zeros_like(transitions)
        for t in range(LENGTH - 2, -1, -1):
            ahead = e[:, t + 1] * beta[:, t + 1]
            joint = alpha[:, t, :, None] * a[None] * ahead[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            beta[:, t] = ahead @ a.T
            beta[:, t] /= beta[:, t].sum(1, keepdims=True)
        grad = alpha * beta
        grad /= grad.sum(2, keepdims=True)
        np.put_along_axis(grad, y[..., None], np.take_along_axis(grad, y[..., None], 2) - 1, 2)
        np.subtract.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        for k in range(n_labels):
            by_word = np.bincount(inner.ravel(), grad[..., k].ravel(), len(used))
            g = np.bincount(own, by_word[word], BUCKETS) / BATCH
            g2[:, k] += g * g
            weights[:, k] -= 0.3 * g / np.sqrt(g2[:, k])
        pairs = pairs / BATCH + 1e-3 * transitions
        t2 += pairs * pairs
        transitions -= 0.3 * pairs / np.sqrt(t2)
    return weights.astype(np.float32), transitions


def training_sample(docs: DataFrame, train) -> DataFrame:
    """(text, lang) of about SAMPLE_PER_LANGUAGE documents for each language, one window of each, by a hash of the id.

    The hash is compared as a fraction of all its 53 leading bits, so the bound holds for any number of documents; rows that
    repeat an id and a text count once.
    """
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    share = written(rows.groupBy("lang").agg((F.lit(SAMPLE_PER_LANGUAGE) / F.count("*")).alias("_share")), "languages")  # so Spark knows its size
    begin = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.greatest(F.lit(1), F.length("text") - F.lit(SAMPLE_CHARS) + 1)).cast("int") + 1
    chosen = rows.join(share, "lang").where(fraction(F.xxhash64("doc_id", F.lit(11))) < F.col("_share"))
    return chosen.select("doc_id", F.substring("text", begin, F.lit(SAMPLE_CHARS)).alias("text"), "lang").distinct().drop("doc_id")


class Labeller:
    """A fitted model with its bounded table of emission scores; one for each Python worker."""

    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray) -> None:
        self.languages, self.weights, self.transitions = languages, weights, transitions
        self._clear()

    def _clear(self) -> None:
        self.number: dict[int, int] = {}
        self.scores = np.zeros((1 << 12, max(1, len(self.languages))))

    def _rows(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h, at, back = np.unique(tv.span_hash(codes, start, end), return_index=True, return_inverse=True)
        keys = h.tolist()
        got = [self.number.get(k, -1) for k in keys]
        new = [i for i, g in enumerate(got) if g < 0]
        if new:
            own = emissions(self.weights, codes, start[at[new]], end[at[new]])
            n = len(self.number)
            while n + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[n : n + len(new)] = own
            for i, k in enumerate(new):
                got[k] = self.number[keys[k]] = n + i
        return np.array(got, np.int32)[back]

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The table row, start and end (within its text) of every word, and the number of words of each text."""
        rows, starts, ends, sizes = [], [], [], np.zeros(len(texts), np.int64)
        if len(self.number) > MAX_WORDS:
            self._clear()
        for a, b in tv.slices(texts):
            codes, bounds, start, end = lowered_words(texts[a:b])
            if len(start):
                rows.append(self._rows(codes, start, end))
                doc = tv.doc_of(start, bounds)
                sizes[a:b] = np.bincount(doc, minlength=b - a)
                starts.append(start - bounds[doc])
                ends.append(end - bounds[doc])
        whole = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return whole(rows, np.int32), whole(starts, np.int64), whole(ends, np.int64), sizes

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Summed label probabilities and number of words of each text."""
        if not self.languages:
            return np.zeros((len(texts), 1)), np.zeros(len(texts), np.int64)
        row, _, _, sizes = self._words(texts)
        return marginal_sums(self.scores[: len(self.number)], row, np.cumsum(sizes) - sizes, sizes, self.transitions), sizes

    def predicted(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Label and score of each text."""
        total, size = self.sums(texts)
        mean = total / np.maximum(size, 1)[:, None]
        best, some = mean.argmax(1), size > 0
        label = [self.languages[k] if s else "und" for k, s in zip(best.tolist(), some.tolist(), strict=True)]
        return label, np.round(np.where(some, np.minimum(1.0, mean[np.arange(len(texts)), best]), 0.0), 6)

    def spans(self, text: str | None) -> list[dict]:
        """Runs of words of one label: begin and end in the text, label and the least probability of its words."""
        if not text or not self.languages:
            return []
        row, start, end, sizes = self._words([text])
        p = marginals(self.scores[: len(self.number)], row, np.zeros(1, np.int64), sizes, self.transitions)
        if not len(row):
            return []
        best = p.argmax(1)
        first = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
        last = np.append(first[1:], len(best)) - 1
        low = np.minimum.reduceat(p.max(1), first)
        return [{"begin": a, "end": b, "lang": self.languages[k], "score": round(s, 6)} for a, b, k, s in zip(start[first].tolist(), end[last].tolist(), best[first].tolist(), low.tolist(), strict=True)]


def fitted(docs: DataFrame, train):
    """(languages, weights, transitions) as a broadcast value; `train` says whose lang may be learned from."""
    sample = training_sample(docs, train).toPandas().sort_values(["lang", "text"], ignore_index=True)
    languages = sorted(sample["lang"].unique().tolist())
    labels = np.searchsorted(languages, sample["lang"].to_numpy(object)) if languages else np.zeros(0, np.int64)
    return docs.sparkSession.sparkContext.broadcast((languages, *fit(sample["text"].tolist(), labels, len(languages))))


def predictor(docs: DataFrame, train):
    """A function of one column, text -> struct<lang_pred, score>; all other columns stay where they are, in the JVM.

    It is declared nondeterministic so that Spark runs it once where a filter and a projection both use its result.
    """
    shared = fitted(docs, train)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Labeller(*shared.value)
        for batch in batches:
            for _, _, texts in tv.parts(batch, PART_CHARS):
                labels, scores = np.empty(len(texts), object), np.zeros(len(texts))
                order = np.argsort([len(t) if t else 0 for t in texts], kind="stable")  # texts of like length step together
                texts = [texts[i] for i in order]
                for a, b in tv.slices(texts, GROUP_CHARS):
                    labels[order[a:b]], scores[order[a:b]] = model.predicted(texts[a:b])
                yield pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores)], names=["lang_pred", "score"])

    return predict.asNondeterministic()


def identify(docs: DataFrame, train, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) of every document; doc_id as long, so ids must be whole numbers or null.

    Null texts and texts without a letter are `und` with score 0. Without any labelled row every document is `und`. Equal
    texts get equal labels, whatever their id, source or lang; repeated rows stay; an empty table gives no rows. One pass
    over whole texts, no shuffle of them.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text", "lang")
    return rows.select("doc_id", predictor(rows, train)("text").alias("p")).select("doc_id", "p.lang_pred", "p.score")


def language_spans(docs: DataFrame, train, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, begin, end, lang, score): the runs of words of one language in code-switched texts, in code points.

    A text without a letter, and every text where nothing is labelled, has no span.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text", "lang")
    shared = fitted(rows, train)

    @F.arrow_udf("array<struct<begin: long, end: long, lang: string, score: double>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Labeller(*shared.value)
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            yield pa.array([model.spans(t) for t in batch.to_pylist()], kind)

    return rows.select("doc_id", F.explode(spans.asNondeterministic()("text")).alias("s")).select("doc_id", "s.*")


def labelled(docs: DataFrame) -> DataFrame:
    """docs without those that are `und` (null text, no letter, nothing to learn from), lang set to the predicted label.

    Its columns are those of docs, whatever their names; repeated rows stay; an empty table gives no rows.
    """
    predict = predictor(docs, F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(False)))
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = docs.select(held.alias("row"), predict("text").alias("p")).where("p.lang_pred <> 'und'")
    return found.select(*[F.col("p.lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def op3_language_crf(spark, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score. Edge cases as in `identify`; null ids are not held out and not learned from."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(False)))
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
