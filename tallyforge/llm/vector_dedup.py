"""Near duplicates of embeddings: a navigable small-world graph per shard, every shard queried, components united.

Equal vectors of a label are one class. Classes of a label are dealt over shards of bounded size; each shard's graph is
built by one task, whose audit widens the beam until links are found, and is written. Then every class of the label is
looked up in every shard: graph and a bounded part of the queries meet in one stream, so a label with many vectors has
many such streams. A task tells, for each query, how many vectors it links with, and a spanning forest of the links it
saw; no pairs are told, so a group of near copies costs no more than its rows.

The work is that of the method: rows of a label times shards of that label.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import ngram_join
from tallyforge.llm.hnsw import Graph
from tallyforge.llm.shared import table, written

COSINE = 0.93
#: Bounds of a shard, and queries of a stream.
SHARD_ROWS, SHARD_BYTES, STREAM_ROWS = 16_384, 16 << 20, 65_536
#: Queries that are looked up at once.
BLOCK = 1024


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of length 1 in double precision; scaled by their largest component first, so that no square overflows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _built(cosine: float):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("cid")
        dim = rows["dim"][0].as_py()
        graph = Graph(_unit(rows["vector"].chunk(0), dim), cosine)
        recall = graph.audit()
        graph.cid, graph.held = rows["cid"].to_numpy()[graph.order], rows["held"].to_numpy()[graph.order]
        of = rows.slice(0, 1).select(["label", "dim", "shard"])
        return of.append_column("beam", pa.array([graph.beam])).append_column("recall", pa.array([recall])).append_column("graph", pa.array([pickle.dumps(graph, protocol=5)], pa.binary()))

    return run


class _Forest:
    """Union of nodes by their smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, at = self.up, x
        while (above := up.get(at, at)) != at:
            at = above
        while (above := up.get(x, x)) != at:
            up[x], x = at, above
        return at

    def unite(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: (class, number of vectors of other classes it links with in a shard); kind 1: (class, class) of a forest of links."""
    names = ["kind", "x", "y"]
    graph: Graph | None = None
    sizes, number, forest = np.zeros(0, np.int64), np.zeros(0, np.int64), _Forest()

    def told(kind: int, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=names)

    def linked(cid: np.ndarray, queries: np.ndarray) -> pa.RecordBatch:
        at = np.minimum(np.searchsorted(graph.cid[number], cid), len(number) - 1)
        own = np.where(graph.cid[number][at] == cid, number[at], -1)
        query, node, whole = graph.links(queries, graph.beam, own)
        weight = np.where(whole, sizes[node], graph.held[node])
        count = np.bincount(query, weight, len(cid)).astype(np.int64)
        # a query that is in the shard has itself among what it found, as a part of a ball or alone
        mine = (own >= 0)[query] & np.where(whole, graph.ball[own[query]] == node, own[query] == node)
        count[query[mine]] -= graph.held[own[query[mine]]]
        for x, y in zip(cid[query].tolist(), graph.cid[node].tolist(), strict=True):
            forest.unite(x, y)
        return told(0, cid, count)

    def forest_rows() -> Iterator[pa.RecordBatch]:
        ends = [(x, forest.root(x)) for x in list(forest.up)]
        forest.up.clear()
        if ends:
            yield told(1, *(np.array(e, np.int64) for e in zip(*ends, strict=True)))

    for batch in batches:
        is_graph = np.flatnonzero(batch.column(0).to_numpy() == 0)
        turns = np.unique(np.concatenate([[0], is_graph, is_graph + 1, [batch.num_rows]]))
        for i, j in zip(turns[:-1].tolist(), turns[1:].tolist(), strict=True):
            if i in is_graph:
                yield from forest_rows()
                graph = pickle.loads(batch.column(3)[i].as_py())
                number = np.argsort(graph.cid)
                totals = np.concatenate([[0], np.cumsum(graph.held[graph.members])])
                sizes = totals[graph.first[1:]] - totals[graph.first[:-1]]
                continue
            for a in range(i, j, BLOCK):
                own = batch.slice(a, min(BLOCK, j - a))
                yield linked(own.column(1).to_numpy(), _unit(own.column(2), graph.exact.shape[1]))
    yield from forest_rows()


def _classes(rows: DataFrame) -> DataFrame:
    """(label, key, dim, vector, held, lowest, cid): one row for each different vector of a label that can link."""
    grouped = rows.where("fit").groupBy("label", "key").agg(F.first("vector").alias("vector"), F.count("*").alias("held"), F.min("vec_id").alias("lowest"))
    return written(grouped.withColumn("dim", F.size("vector")).withColumn("cid", F.monotonically_increasing_id()), "classes")


def shard_graphs(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(label, dim, shard, beam, recall, graph) of every shard; recall: what its audit found with that beam."""
    groups = classes.select("label", "dim", "shard", "cid", "held", "vector").groupBy("label", "dim", "shard")
    return groups.applyInArrow(_built(cosine), f"label {classes.schema['label'].dataType.simpleString()}, dim int, shard long, beam long, recall double, graph binary")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; two rows of one label link from a cosine of `cosine` on.

    Null labels, null and empty vectors, zero vectors and such with null or non-finite components link with nothing: 0, the
    own id, kept. Vectors of different lengths do not link. Rows are counted, so repeated rows and ids link each other. Rows
    with a null id count as links; their component is that of the others they reach, null if there is none, and they are not
    kept. Links are found by graphs and verified; balls of near copies count whole where angles leave no doubt. An empty
    table gives no rows; further columns are not looked at.
    """
    raw = F.col(vector_col).cast("array<double>")
    usable = F.col(label_col).isNotNull() & raw.isNotNull() & (F.size(raw) > 0) & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(raw, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"), F.coalesce(usable, F.lit(False)).alias("fit"))
    rows = rows.withColumn("key", F.concat(F.hex(F.xxhash64("label", "vector")), F.lit("-"), F.hex(F.xxhash64(F.lit(11), "vector", "label"))))
    classes = _classes(rows)
    held = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where("n > 1")
    per = F.least(F.lit(SHARD_ROWS), F.greatest(F.lit(256), F.floor(F.lit(SHARD_BYTES) / (F.lit(4) * F.col("dim")))))
    placed = classes.join(held, ["label", "dim"]).withColumn("shards", F.ceil(F.col("n") / per)).withColumn("parts", F.ceil(F.col("n") / STREAM_ROWS))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("cid"), F.col("shards")))
    graphs = written(shard_graphs(placed, cosine), "graphs").join(held, ["label", "dim"]).withColumn("parts", F.ceil(F.col("n") / STREAM_ROWS))

    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    kept = ["label", "dim", "shard", "part", "kind", "cid", "vector", "graph"]
    empty = F.lit(None).cast(classes.schema["vector"].dataType)
    left = graphs.withColumn("part", every("parts")).select("label", "dim", "shard", "part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("cid"), empty.alias("vector"), "graph")
    asked = placed.drop("shard").withColumn("part", F.pmod(F.xxhash64("cid", F.lit(3)), F.col("parts"))).withColumn("shard", every("shards"))
    right = asked.withColumns({"kind": F.lit(1), "graph": F.lit(None).cast("binary")}).select(*kept)
    streams = left.select(*kept).unionByName(right).repartition("label", "dim", "shard", "part").sortWithinPartitions("label", "dim", "shard", "part", "kind")
    found = written(streams.select("kind", "cid", "vector", "graph").mapInArrow(_looked, "kind int, x long, y long"), "looked-up")

    counts = found.where("kind = 0").groupBy(F.col("x").alias("cid")).agg(F.sum("y").alias("others"))
    roots = ngram_join.components(found.where("kind = 1").select("x", "y"))
    named = classes.select("cid", "key", "lowest", "held").join(counts, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    named = written(named.select("key", "lowest", "held", F.coalesce("others", F.lit(0).cast("long")).alias("others"), F.coalesce("root", "cid").alias("root")), "named")
    lowest = named.groupBy("root").agg(F.min("lowest").alias("component_id"), F.count("*").alias("rows"))
    whole = ngram_join.looked_up(named, "root", lowest).select("key", "component_id", (F.col("held") - 1 + F.col("others")).alias("n_links"), F.col("held").alias("rows"))
    linked = ngram_join.looked_up(rows.where("fit").select("vec_id", "key"), "key", whole).select("vec_id", "n_links", "component_id")
    out = linked.union(rows.where("not fit").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op13_vector_dedup(spark, sf_dir: str) -> DataFrame:
    """All embeddings; edge cases as in `near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
