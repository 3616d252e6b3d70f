"""Token ids in binary blocks with Elias-Fano encoded document bounds.

A block is one row of a written table: the ids of consecutive documents as one little-endian array (16 bits where the
vocabulary allows), and the ends of the documents in it as an Elias-Fano sequence: low bits packed, high bits in unary,
and the position of every 256th one for selection. There is no table of 64-bit offsets. Blocks are made in ascending
order of ids by tasks that hold a range of ids each; Spark's commit makes a lost or repeated task harmless.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import pieces as pc
from tallyforge.llm import textvec as tv
from tallyforge.llm.shared import scratch, table, written

BLOCK_IDS = 1 << 20
SAMPLE = 256
#: Input a range of documents should hold: the number of ranges follows the input.
RANGE_BYTES = 128 << 20
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_BYTE_POP = _BITS.sum(1).astype(np.int64)
#: The place of the k-th one in each byte.
_BYTE_SELECT = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.int64)


class EliasFano:
    """A non-descending sequence below `bound` in about 2 + log2(bound / n) bits an element."""

    def __init__(self, n: int, bound: int, lower: bytes, upper: bytes, samples: np.ndarray) -> None:
        self.n, self.bound, self.lower, self.upper, self.samples = n, bound, lower, upper, samples
        self.bits = self.low_bits(n, bound)

    @staticmethod
    def low_bits(n: int, bound: int) -> int:
        return max(0, (bound // max(n, 1)).bit_length() - 1)

    @classmethod
    def encode(cls, values: np.ndarray, bound: int) -> EliasFano:
        n, bits = len(values), cls.low_bits(len(values), bound)
        v = values.astype(np.uint64)
        low = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bound, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype(np.uint32))

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(index), np.int64)
        raw = np.frombuffer(self.lower, np.uint8)
        at = index[:, None] * self.bits + np.arange(self.bits)
        return ((raw[at >> 3] >> (at & 7) & 1).astype(np.int64) << np.arange(self.bits)).sum(1)

    def select_many(self, index: np.ndarray) -> np.ndarray:
        """The values at many places: the byte of the unary part by its count of ones, then the place in that byte."""
        if not len(index):
            return np.zeros(0, np.int64)
        raw = np.frombuffer(self.upper, np.uint8)
        ones = np.cumsum(_BYTE_POP[raw], dtype=np.int64)
        byte = np.searchsorted(ones, index, "right")
        one = byte * 8 + _BYTE_SELECT[raw[byte], index - (ones[byte] - _BYTE_POP[raw[byte]])]
        return ((one - index) << self.bits) + self._low(index)

    def values(self) -> np.ndarray:
        return self.select_many(np.arange(self.n))

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it and a short scan of the unary part."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        raw = np.frombuffer(self.upper, np.uint8)
        byte = at // 8
        left += int(_BYTE_POP[raw[byte] & ((1 << (at % 8)) - 1)])
        while (here := int(_BYTE_POP[raw[byte]])) <= left:
            left, byte = left - here, byte + 1
        one = byte * 8 + int(np.flatnonzero(np.unpackbits(raw[byte : byte + 1], bitorder="little"))[left])
        low = 0
        for k in range(self.bits):
            bit = i * self.bits + k
            low |= (self.lower[bit // 8] >> (bit % 8) & 1) << k
        return ((one - i) << self.bits) + low


_ENCODERS: dict[str, tuple] = {}


def _encoder(path: str):
    """The library's tokenizer and this process's table of pre-tokens."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        lib.no_truncation()
        lib.no_padding()
        many = lambda texts: [e.ids for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
        special = {t.content: i for i, t in lib.get_added_tokens_decoder().items()}
        _ENCODERS[path] = (lambda text: many([text])[0], pc.PieceTable(many), lib.get_vocab_size(), special)
    return _ENCODERS[path]


def encode(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row (null: none) and the number of ids of each."""
    whole, known, _, special = _encoder(path)
    return pc.ids_of(texts, pc.spaced_pieces, known, special, whole)


BLOCK = "part int, block int, n_docs long, n_ids long, width int, doc_ids array<long>, ids binary, lower binary, upper binary, samples binary"


def _blocks(path: str, end_id: int):
    names = [c.split()[0] for c in BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        width = 2 if max(_encoder(path)[2], end_id + 1) <= 1 << 16 else 4
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def row() -> pa.RecordBatch:
            doc_ids = pa.concat_arrays([h[0] for h in held])
            counts, ids = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            ef = EliasFano.encode(np.cumsum(counts), int(counts.sum()) + 1)
            held.clear()
            values = [part, block, len(counts), len(ids), width, None, ids.astype(f"<u{width}").tobytes(), ef.lower, ef.upper, ef.samples.astype("<u4").tobytes()]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), None, *[pa.binary()] * 4]
            cols = [pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids) if t is None else pa.array([v], t) for v, t in zip(values, types, strict=True)]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            for a, b, texts in tv.parts(batch.column(1)):
                ids, counts = encode(texts, path)
                ends = np.cumsum(counts)
                held.append((batch.column(0).slice(a, b - a).cast(pa.int64()), counts + 1, np.insert(ids, ends, end_id)))
                if sum(len(h[2]) for h in held) >= BLOCK_IDS:
                    yield row()
                    block += 1
        if held:
            yield row()

    return run


def write_token_blocks(docs: DataFrame, tokenizer: str, to: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the table of blocks: documents in ascending id order, `end_id` after each.

    Null ids come first; rows of one id lie by a hash of the text, then by text, so even an id with many rows is split
    over ranges. Null texts are empty. Ids must be whole numbers or null. An empty table gives an empty table of blocks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tie"))
    held = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(8)).alias("b")).first()["b"] or 0
    ranges = max(1, -(-held // RANGE_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism * 4, held >> 20))
    rows.repartitionByRange(int(ranges), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text").mapInArrow(_blocks(tokenizer, end_id), BLOCK).write.parquet(to)


def _opened(r: dict) -> tuple[EliasFano, np.ndarray]:
    """A block's bounds and ids."""
    return EliasFano(r["n_docs"], r["n_ids"] + 1, r["lower"], r["upper"], np.frombuffer(r["samples"], "<u4")), np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            bounds, ids = _opened(r)
            ends = bounds.select_many(np.arange(r["n_docs"]))
            starts = np.append(0, ends[:-1])
            crc = np.array([zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["before"]), pa.array(ends - starts), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            bounds, ids = _opened(r)
            own = [ids[bounds.select(i - 1) if i else 0 : bounds.select(i)].astype(np.int64) for i in r["places"]]
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_ids"][i] for i in r["places"]], pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["doc_id", "ids"])


def fetch_token_ids(spark, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents named in `wanted` (first column), each by two selections in its block.

    Only blocks that hold a wanted document are opened. Ids that are not there give no row; null ids are not looked up.
    """
    blocks = spark.read.schema(BLOCK).parquet(path)
    places = blocks.select("part", "block", F.posexplode("doc_ids").alias("place", "doc_id"))
    named = wanted.select(F.col(wanted.columns[0]).cast("long").alias("doc_id")).distinct()
    found = places.join(named, "doc_id", "left_semi").groupBy("part", "block").agg(F.sort_array(F.collect_list("place")).alias("places"))  # at most the documents of one block
    return blocks.join(found, ["part", "block"]).mapInArrow(_fetched, "doc_id long, ids array<long>")


def read_token_blocks(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document from the blocks alone; start counts all ids before it."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("earlier", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each partition
    within = blocks.select("part", "block", "n_ids").withColumn("b", F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    before = within.join(parts, "part").select("part", "block", (F.coalesce("earlier", F.lit(0)) + F.coalesce("b", F.lit(0))).cast("long").alias("before"))
    before = written(before, "block-offsets")  # a row for each block: by the written size Spark tells whether the blocks need a shuffle
    return blocks.join(before, ["part", "block"]).mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_blocks(spark, sf_dir: str) -> DataFrame:
    """All documents through the block format and back. Null texts are empty: they hold the end id alone."""
    import public_tokenizers

    to = scratch(spark, "token-blocks")
    write_token_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), to)
    return read_token_blocks(spark, to)
