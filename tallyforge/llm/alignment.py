"""Cross-tokenizer alignment: which tokens of one vocabulary cover the same bytes as which of another.

Both tokenizers cut the same bytes. Byte offsets where tokens of both end cut a document into groups, and every token of
side A in a group is linked with every token of side B in it. How good a link is depends on the corpus: a pair counts in
as many documents as hold it.

Postings (A id, document, B id, multiplicity) are written once, packed by slice of documents and A id. They are shuffled
by A id; each sorted stream has the counts of the A id's pairs first, so a task knows counts and their maximum before the
first posting passes, and holds no more than one counter for each B id. What a document gets from an A id is summed by
document afterwards. A frequent A id is dealt over several streams, each of which gets the counts.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import pieces as pc
from tallyforge.llm import textvec as tv
from tallyforge.llm.bpe import OffsetTable
from tallyforge.llm.shared import table, written

#: Pairs that are told apart at once, postings of an A id in one stream, and entries that a task holds before it sums them.
MOST_PAIRS, STREAM, MOST_HELD = 4_000_000, 2_000_000, 1_000_000
#: Stands for a piece that does not give back its own bytes.
LOSSY = 0xFFFFFFFF
#: Bits of an id of side B in a key.
B_BITS = 20
#: Fixed by the vocabularies: how side B writes a space.
MARK = "▁"


class Sides:
    """Both tokenizers, their tables of pieces and the number of bytes of each token; one for each Python worker."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(a_path)
        a.encode_special_tokens = True
        a.no_truncation()
        a.no_padding()
        many = lambda texts: [e.ids for e in a.encode_batch_fast(texts, add_special_tokens=False)]
        self.whole_a, self.a = lambda text: many([text])[0], pc.PieceTable(many)
        vocab = a.get_vocab()
        self.len_a = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.len_a[i] = len(token)  # byte-level: a character for each byte
        b = SentencePieceProcessor(model_file=b_path)
        names = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.len_b = np.fromiter(map(len, self.raw_b), np.int64, len(names))
        space = b.piece_to_id(MARK)

        def encode_b(words: list[str]) -> list[list[int]]:
            """Ids of pieces that begin with a space, which the library adds itself."""
            found = b.encode([w[1:] for w in words], num_threads=1)
            found = [ids if w != " " else [space] for w, ids in zip(words, found, strict=True)]
            return [ids if b"".join([self.raw_b[i] for i in ids]) == w.encode() else [LOSSY] for w, ids in zip(words, found, strict=True)]

        self.b = pc.PieceTable(encode_b)
        self.decimals = OffsetTable([f"{i}," for i in range(max(len(self.len_a), len(names)))])


_SIDES: dict[tuple[str, str], Sides] = {}


def sides(a_path: str, b_path: str) -> Sides:
    if (a_path, b_path) not in _SIDES:
        _SIDES[a_path, b_path] = Sides(a_path, b_path)
    return _SIDES[a_path, b_path]


def _spaced_chunks(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spaces with what follows them up to the next: no token of side B has a space behind another character."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = codes == 32
    first[1:] &= codes[:-1] != 32
    opens = bounds[:-1]
    first[opens[opens < bounds[1:]]] = True
    at = np.flatnonzero(first)
    return at, np.append(at[1:], len(codes))


class Aligned:
    """The tokens of both sides of some texts, their groups, and counts by text. Texts that do not fit have no tokens."""

    def __init__(self, texts: list[str | None], both: Sides) -> None:
        self.n = n = len(texts)
        spaced = [" " + t if t else "" for t in texts]
        codes, bounds = tv.flat(spaced)
        self.a, n_a = pc.ids_of(spaced, pc.spaced_pieces, both.a, {}, both.whole_a)
        start, end = _spaced_chunks(codes, bounds)
        self.b, lens = both.b.ids(codes, start, end)
        n_b = pc.by_text(lens, start, bounds)
        size = np.ones(len(codes), np.int64)
        for least in (0x80, 0x800, 0x10000):
            size += codes >= least
        in_bytes = self._sums(size, np.diff(bounds))
        lossy = self.b == LOSSY
        len_a, len_b = both.len_a[self.a], both.len_b[np.where(lossy, 0, self.b)]
        fits = (self._sums(len_a, n_a) == in_bytes) & (self._sums(len_b, n_b) == in_bytes) & (self._sums(lossy, n_b) == 0)
        keep_a, keep_b = np.repeat(fits, n_a), np.repeat(fits, n_b)
        self.a, self.b, len_a, len_b = self.a[keep_a].astype(np.int64), self.b[keep_b].astype(np.int64), len_a[keep_a], len_b[keep_b]
        self.n_a, self.n_b = n_a * fits, n_b * fits
        end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=len(cuts)), np.bincount(self.group_b, minlength=len(cuts))
        self.text_of = np.repeat(np.arange(n), self.n_a)[np.cumsum(self.in_a) - 1] if len(cuts) else np.zeros(0, np.int64)
        self.n_groups = np.bincount(self.text_of, minlength=n)
        self.n_links = self._sums(self.in_a * self.in_b, self.n_groups)

    @staticmethod
    def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sums of runs of `counts` values."""
        return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(counts)])])

    def digests(self, decimals: OffsetTable) -> list[str]:
        """sha256 of `a1,a2|b1;a3|b2,b3` of each text; texts without tokens have ''."""
        n = len(self.a) + len(self.b)
        ids, mark = np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
        at_a = np.arange(len(self.a)) + (np.cumsum(self.in_b) - self.in_b)[self.group_a]
        at_b = np.arange(len(self.b)) + np.cumsum(self.in_a)[self.group_b]
        ids[at_a], ids[at_b] = self.a, self.b
        if n:
            mark[at_a[np.cumsum(self.in_a) - 1]] = ord("|")
            mark[at_b[np.cumsum(self.in_b) - 1]] = ord(";")
        lens = decimals.lens[ids]
        raw = decimals.data[pc.gather(decimals.off[ids], lens)]
        ends = np.cumsum(lens)
        raw[ends - 1] = mark
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist()
        data = memoryview(raw.tobytes())
        return [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(bounds[:-1], bounds[1:], strict=True)]

    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, A id, B id and multiplicity of every linked pair of every text, each pair once a text, ascending.

        Equal ids of a group are counted before they are paired, and what is paired is bounded at a time, so that a text
        whose sides never meet costs its different pairs, not its links.
        """
        key_a, many_a = np.unique(self.group_a << B_BITS | self.a, return_counts=True)
        key_b, many_b = np.unique(self.group_b << B_BITS | self.b, return_counts=True)
        group, a, b = key_a >> B_BITS, key_a & (1 << B_BITS) - 1, key_b & (1 << B_BITS) - 1
        first = np.searchsorted(key_b >> B_BITS, np.arange(len(self.in_b) + 1))
        width = (first[1:] - first[:-1])[group]
        ends, found, held, i = np.cumsum(width), [], 0, 0
        while i < len(group):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + MOST_PAIRS, "right")))
            other = pc.gather(first[group[i:j]], width[i:j])
            own = np.repeat(np.arange(i, j), width[i:j])
            # one key of 64 bits: text (24 bits), A id (20), B id (20)
            found.append(_summed(self.text_of[group[own]] << 2 * B_BITS | a[own] << B_BITS | b[other], many_a[own] * many_b[other]))
            held += len(found[-1][0])
            if len(found) > 1 and held > 2 * MOST_PAIRS:
                found = [_summed(*map(np.concatenate, zip(*found, strict=True)))]
                held = len(found[0][0])
            i = j
        key, many = _summed(*map(np.concatenate, zip(*found, strict=True))) if len(found) > 1 else found[0] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return key >> 2 * B_BITS, key >> B_BITS & (1 << B_BITS) - 1, key & (1 << B_BITS) - 1, many


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, ascending, and the sum of the values of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(values, at)


def _packed(values: np.ndarray, ends: np.ndarray, kind: str) -> pa.Array:
    """A binary column whose rows hold runs of values up to `ends`, little-endian."""
    data = values.astype(kind)
    offsets = np.concatenate([[0], ends]).astype(np.int32) * np.dtype(kind).itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column in a row, and how many each row has."""
    n, (_, offsets, data) = len(column), column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1]
    size = np.dtype(kind).itemsize
    return (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if data is not None and n else np.zeros(0, kind)), np.diff(ends) // size


WRITTEN = "kind int, uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, docs binary, bs binary, many binary"


def _tokens(a_path: str, b_path: str):
    """Per document (kind 0) its counts; per slice of documents and A id (kind 1) the postings, documents from uid on."""
    schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in WRITTEN.split(", "))])

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, uid = sides(a_path, b_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for x, y, texts in tv.parts(batch.column(1)):
                own = Aligned(texts, both)
                n = y - x
                counts = {k: pa.array(getattr(own, k).astype(np.int64)) for k in ("n_a", "n_b", "n_groups", "n_links")}
                yield rows(n, kind=pa.array(np.zeros(n, np.int32)), uid=pa.array(np.arange(uid, uid + n)), doc_id=batch.column(0).slice(x, n).cast(pa.int64()), groups_sha256=pa.array(own.digests(both.decimals), pa.string()), **counts)
                text, a, b, many = own.postings()
                order = np.argsort(a, kind="stable")
                text, a, b, many = text[order], a[order], b[order], many[order]
                ends = np.append(np.flatnonzero(a[1:] != a[:-1]) + 1, len(a)) if len(a) else np.zeros(0, np.int64)
                for u in range(0, len(ends), 4096):
                    v = min(len(ends), u + 4096)
                    i, j = (ends[u - 1] if u else 0), ends[v - 1]
                    packed = {k: _packed(w[i:j], ends[u:v] - i, kind) for k, w, kind in (("docs", text, "<u4"), ("bs", b, "<u2"), ("many", many, "<u4"))}
                    yield rows(v - u, kind=pa.array(np.ones(v - u, np.int32)), uid=pa.array(np.full(v - u, uid)), a=pa.array(a[ends[u:v] - 1].astype(np.int32)), **packed)
                uid += n

    return run


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n) of a task's postings: n documents hold the pair."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        keys, n = _summed(*map(np.concatenate, zip(*held, strict=True)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array((keys >> B_BITS).astype(np.int32)), pa.array((keys & (1 << B_BITS) - 1).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

    for batch in batches:
        b, lens = _unpacked(batch.column(1), "<u2")
        keys = np.repeat(batch.column(0).to_numpy().astype(np.int64), lens) << B_BITS | b
        held.append(_summed(keys, np.ones(len(keys), np.int64)))
        size += len(held[-1][0])
        if size > MOST_PAIRS:
            yield out()
            size = 0
    if held:
        yield out()


SUMS = "base long, docs binary, n_best binary, count_sum binary"


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the postings of each A id, whose pair counts come first in the stream, give to documents, summed and packed.

    A row holds the documents of one slice: their numbers from `base` on, and their sums.
    """
    counts, known, best, now = np.zeros(1 << B_BITS, np.int64), [], 0, None
    bases: set[int] = set()
    held, size = [], 0

    def summed() -> None:
        uid, first, total = map(np.concatenate, zip(*held, strict=True))
        keys, n_best = _summed(uid, first)
        held[:] = [(keys, n_best, _summed(uid, total)[1])]

    def out() -> pa.RecordBatch:
        summed()
        uid, n_best, total = held.pop()
        base = np.array(sorted(bases), np.int64)
        bases.clear()
        of = base[np.searchsorted(base, uid, "right") - 1]
        ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of))
        return pa.RecordBatch.from_arrays([pa.array(of[ends - 1]), _packed(uid - of, ends, "<u4"), _packed(n_best, ends, "<i8"), _packed(total, ends, "<i8")], names=["base", "docs", "n_best", "count_sum"])

    for batch in batches:
        a, salt, kind = (batch.column(k).to_numpy() for k in range(3))
        turns = np.flatnonzero((a[1:] != a[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])) + 1
        for i, j in zip([0, *turns.tolist()], [*turns.tolist(), len(a)], strict=True):
            if i == j:
                continue
            if (a[i], salt[i]) != now:
                for b in known:
                    counts[b] = 0
                known, best, now = [], 0, (a[i], salt[i])
            if kind[i] == 0:
                b, n = batch.column(3).slice(i, j - i).to_numpy(), batch.column(4).slice(i, j - i).to_numpy()
                counts[b] = n
                known.append(b)
                best = max(best, int(n.max()))
                continue
            text, lens = _unpacked(batch.column(6).slice(i, j - i), "<u4")
            b, many = (_unpacked(batch.column(k).slice(i, j - i), t)[0] for k, t in ((7, "<u2"), (8, "<u4")))
            base = batch.column(5).slice(i, j - i).to_numpy()
            bases.update(base.tolist())
            n, many = counts[b], many.astype(np.int64)
            held.append((np.repeat(base, lens) + text, many * (n == best), many * n))
            size += len(b)
            if size > MOST_HELD:
                summed()
                size = len(held[0][0])
                if 2 * size > MOST_HELD:
                    yield out()
                    size = 0
    if held:
        yield out()


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, n_best, count_sum) of every document that has any, from sorted rows of what tasks have summed."""
    now, held = None, []

    def out() -> pa.RecordBatch:
        text, first, total = map(np.concatenate, zip(*held, strict=True))
        held.clear()
        keys, n_best = _summed(text, first)
        return pa.RecordBatch.from_arrays([pa.array(now + keys), pa.array(n_best), pa.array(_summed(text, total)[1])], names=["uid", "n_best", "count_sum"])

    for batch in batches:
        base = batch.column(0).to_numpy()
        turns = np.flatnonzero(base[1:] != base[:-1]) + 1
        for i, j in zip([0, *turns.tolist()], [*turns.tolist(), len(base)], strict=True):
            if i == j:
                continue
            if base[i] != now and held:
                yield out()
            now = int(base[i])
            held.append(tuple(_unpacked(batch.column(k).slice(i, j - i), t)[0].astype(np.int64) for k, t in ((1, "<u4"), (2, "<i8"), (3, "<i8"))))
            if len(held) > 64:
                text, first, total = map(np.concatenate, zip(*held, strict=True))
                held[:] = [(*_summed(text, first), _summed(text, total)[1])]
    if held:
        yield out()


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """One row for each document as `op12` returns it, and the table of pairs (a, b, n): n documents hold a and b linked.

    a_path: a byte-level vocabulary of the tokenizers library, b_path: a model of the sentencepiece library that writes a
    space as MARK, has it nowhere behind another character, and falls back on bytes; at most 65,536 ids on side B.
    Null and empty texts, and texts that a side does not give back, have no tokens: zeros and ''. Rows are what is counted,
    so repeated rows and ids count each; null ids are kept. A long text is one slice. An empty table gives empty tables.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = written(rows.mapInArrow(_tokens(a_path, b_path), WRITTEN), "aligned")
    postings = first.where("kind = 1").select("a", "uid", "docs", "bs", "many")
    pairs = written(postings.select("a", "bs").mapInArrow(_pair_counts, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    # at most a row for each id of side A: which of them are dealt over several streams
    hot = postings.groupBy("a").agg(F.ceil(F.sum(F.octet_length("bs") / 2) / STREAM).cast("int").alias("streams")).where("streams > 1")
    dealt = lambda df: df.join(F.broadcast(hot), "a", "left").withColumn("streams", F.coalesce("streams", F.lit(1)))
    counts = dealt(pairs).select("a", F.explode(F.sequence(F.lit(0), F.col("streams") - 1)).alias("salt"), F.lit(0).alias("kind"), "b", "n", F.lit(0).cast("long").alias("uid"), *[F.lit(b"").alias(k) for k in ("docs", "bs", "many")])
    rows = dealt(postings).select("a", F.pmod(F.xxhash64("uid"), F.col("streams")).cast("int").alias("salt"), F.lit(1).alias("kind"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("n"), "uid", "docs", "bs", "many")
    streams = counts.unionByName(rows).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    sums = streams.mapInArrow(_contributions, SUMS).repartition("base").sortWithinPartitions("base").mapInArrow(_by_document, "uid long, n_best long, count_sum long")
    known = first.where("kind = 0").select("uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = F.lit(0).cast("long")
    out = known.join(sums, "uid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
    return out, pairs


def id_map(pairs: DataFrame) -> DataFrame:
    """(a, b, n) with the B id that each A id is linked with in most documents; of several the smallest."""
    best = pairs.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("less"), "b")).alias("top"))
    return best.select("a", F.col("top.b").alias("b"), (-F.col("top.less")).alias("n"))


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    """All documents, byte-level BPE against pieces with byte fallback; edge cases as in `align`."""
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
