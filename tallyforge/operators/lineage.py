"""Lineage: what lies downstream of models, and what that touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.sources.scratch import scratch, written


def _steps(edges: DataFrame) -> DataFrame:
    return written(edges.select(F.col("parent").alias("_p"), F.col("child").alias("_c")).where("_p is not null and _c is not null").distinct(), "steps")


def spread(first: DataFrame, step: DataFrame, most: int | None = None) -> DataFrame:
    """first (node and perhaps seed) and all that follows from it along step (_p, _c), each row once.

    Semi-naive: a round joins only what was new in the last one, and drops what is known, so diamonds and cycles count
    once. Each round's rows are appended as Parquet in the shared folder: nothing is written twice, and no plan carries
    over from round to round. With `most`, a seed goes no further once it has that many rows.
    """
    spark, base, schema = first.sparkSession, scratch(first.sparkSession, "reached"), first.schema
    keys, paths = first.columns, [f"{base}/round-0"]
    first.write.option("compression", "zstd").parquet(paths[0])
    while True:
        frontier = spark.read.schema(schema).parquet(paths[-1])
        found = spark.read.schema(schema).parquet(*paths)
        if frontier.isEmpty():
            return found
        if most is not None:
            full = found.groupBy("seed").agg(F.count("*").alias("_n")).where(F.col("_n") >= most)
            frontier = frontier.join(full, "seed", "left_anti")
        new = frontier.join(step, F.col("node") == F.col("_p")).select(*[F.col("_c").alias("node") if k == "node" else F.col(k) for k in keys])
        if "seed" in keys:
            new = new.where("seed <> node")
        paths.append(f"{base}/round-{len(paths)}")
        new.distinct().join(found, keys, "left_anti").select(*keys).write.option("compression", "zstd").parquet(paths[-1])


def _all_pairs(first: DataFrame) -> DataFrame:
    """(seed, node) of all that follows from the pairs of single steps `first`, in as many rounds as the longest way has doublings.

    After round k all pairs at most 2^k steps apart are known, with their distance. What lies further, up to twice as far, is a
    known pair and then one exactly 2^k apart, so a way is cut at one place only and known pairs are read once a round.
    """
    spark, base, schema = first.sparkSession, scratch(first.sparkSession, "pairs"), "seed {0}, node {0}, _d int".format(first.schema["seed"].dataType.simpleString())
    far, paths = 1, [f"{base}/round-0"]
    first.select("seed", "node", F.lit(1).alias("_d")).write.option("compression", "zstd").parquet(paths[0])
    while True:
        found = spark.read.schema(schema).parquet(*paths)
        last = spark.read.schema(schema).parquet(paths[-1]).where(F.col("_d") == far)
        if last.isEmpty():
            return found.select("seed", "node")
        hops = last.select(F.col("seed").alias("_m"), F.col("node").alias("_n"))
        new = found.join(hops, F.col("node") == F.col("_m")).select("seed", F.col("_n").alias("node"), (F.col("_d") + far).alias("_d")).where("seed <> node")
        new = new.groupBy("seed", "node").agg(F.min("_d").alias("_d"))
        far, path = far * 2, f"{base}/round-{len(paths)}"
        new.join(found, ["seed", "node"], "left_anti").select("seed", "node", "_d").write.option("compression", "zstd").parquet(path)
        paths.append(path)


def reached_by(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(i, node): what is downstream of any other of a group's starts; starts: (i, node), each group followed as one set.

    A node remembers two of the starts that reach it (or the only one), which tells whether one besides itself does,
    also in cycles. So rows grow with the nodes of a group and not with its pairs.
    """
    spark, step, base = edges.sparkSession, _steps(edges), scratch(edges.sparkSession, "reached")
    heads = starts.select("i", F.col("node").alias("_s")).where("_s is not null").distinct()
    both = lambda rows: rows.where("seed <> node").groupBy("i", "node").agg(F.min("seed").alias("_a"), F.max("seed").alias("_b"))
    first = both(heads.join(step, F.col("_s") == F.col("_p")).select("i", F.col("_c").alias("node"), F.col("_s").alias("seed")))
    told = lambda rows, seeds: rows.select("i", "node", F.explode(F.array_distinct(seeds)).alias("seed"))
    rows, paths = told(first, F.array("_a", "_b")), [f"{base}/round-0"]
    schema = rows.schema
    rows.write.option("compression", "zstd").parquet(paths[0])
    while True:
        found = spark.read.schema(schema).parquet(*paths)
        frontier = spark.read.schema(schema).parquet(paths[-1])
        if frontier.isEmpty():
            return found.select("i", "node").distinct()
        known = found.groupBy("i", "node").agg(F.min("seed").alias("_l"), F.max("seed").alias("_h"))
        new = both(frontier.join(step, F.col("node") == F.col("_p")).select("i", F.col("_c").alias("node"), "seed")).join(known, ["i", "node"], "left").where("_l is null or _l = _h")
        more = F.filter(F.array("_a", "_b"), lambda x: F.col("_l").isNull() | (x != F.col("_l")))
        seeds = F.when(F.col("_l").isNull(), more).otherwise(F.slice(more, 1, 1))  # one is known, one more is enough
        paths.append(f"{base}/round-{len(paths)}")
        told(new, seeds).write.option("compression", "zstd").parquet(paths[-1])


def downstream(edges: DataFrame, seeds: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(seed, node): all that is reachable from each seed along parent -> child, seeds themselves excluded.

    With `most`, each seed keeps all it reaches if that is less, else at least `most` of it. Null ends are no edges;
    no edges or no seeds give no rows; repeated edges count once.
    """
    step = _steps(edges)
    start = step.select(F.col("_p").alias("seed")).distinct() if seeds is None else seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct()
    first = start.join(step, F.col("seed") == F.col("_p")).select("seed", F.col("_c").alias("node")).where("seed <> node").distinct()
    return _all_pairs(first) if seeds is None and most is None else spread(first, step, most)


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node): all that is downstream of any of `starts` (first column); one row a node, however many starts reach it."""
    step = _steps(edges)
    start = starts.select(F.col(starts.columns[0]).alias("_s")).distinct()
    return spread(start.join(step, F.col("_s") == F.col("_p")).select(F.col("_c").alias("node")).distinct(), step)


def downstream_counts(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(seed, n), n at most `most` where given; a seed is followed no further than that needs."""
    n = F.count("*")
    return downstream(edges, most=most).groupBy("seed").agg((F.least(n, F.lit(most)) if most else n).alias("n"))


def blast_radius(edges: DataFrame, changed: DataFrame, costs: DataFrame) -> DataFrame:
    """One row: distinct models downstream of the changed ones, and their summed cost (node, usd)."""
    touched = reached(edges, changed).join(changed.select(F.col(changed.columns[0]).alias("node")), "node", "left_anti")
    return touched.join(costs, "node", "left").agg(F.count("*").alias("models"), F.sum("usd").alias("usd"))


def exposures_affected(edges: DataFrame, changed: DataFrame, exposures: DataFrame) -> DataFrame:
    """Exposures that depend on a changed model or on one downstream of it."""
    touched = reached(edges, changed).union(changed.select(F.col(changed.columns[0]))).distinct()
    return exposures.join(touched, exposures["depends_on"] == touched["node"], "left_semi").select("exposure").distinct()


def resolved_refs(refs: DataFrame, models: DataFrame) -> DataFrame:
    """refs (file, ref) with `target`: the model of that name if only one has it, else the name as it is."""
    unique = models.groupBy("name").agg(F.count("*").alias("n"), F.min("model_id").alias("model_id")).where("n = 1")
    return refs.join(unique, refs["ref"] == unique["name"], "left").select("file", "ref", F.coalesce("model_id", "ref").alias("target"))


def ref_counts(refs: DataFrame) -> DataFrame:
    """How often each model is referred to, occurrences not files."""
    return refs.groupBy("ref").agg(F.count("*").alias("n"))


def heavy_views(models: DataFrame, refs: DataFrame, least: int = 4) -> DataFrame:
    """Views and ephemeral models that are referred to at least `least` times."""
    return models.where(F.col("materialized").isin("view", "ephemeral")).join(ref_counts(refs), F.col("name") == F.col("ref")).where(F.col("n") >= least).select("model_id", "n")


def reversed_edges(edges: DataFrame) -> DataFrame:
    """Each edge once, turned round: what a model depends on becomes what depends on it."""
    return edges.where("parent is not null and child is not null").select(F.col("child").alias("parent"), F.col("parent").alias("child")).distinct()


def display_labels(models: DataFrame) -> DataFrame:
    """(model_id, label): the name, with its package before it where two models have one name."""
    shared = models.groupBy("name").agg((F.count("*") > 1).alias("_shared"))
    rows = models.join(shared, "name", "left")
    return rows.select("model_id", F.when(F.col("_shared"), F.concat_ws(".", "package", "name")).otherwise(F.col("name")).alias("label"))


def macro_impact(calls: DataFrame, changed: DataFrame, uses: DataFrame) -> DataFrame:
    """(model_id): models that use a changed macro, or one that calls it through any number of others.

    calls: (caller, callee) of macros; changed: macros in the first column; uses: (model_id, macro).
    """
    touched = reached(calls.select(F.col("callee").alias("parent"), F.col("caller").alias("child")), changed).union(changed.select(F.col(changed.columns[0]))).distinct()
    return uses.join(touched.withColumnRenamed("node", "macro"), "macro", "left_semi").select("model_id").distinct()


def source_impact(sources: DataFrame, changed: DataFrame) -> DataFrame:
    """(model_id): models that read a source which a changed file declares. sources: (file, source, model_id); changed: files."""
    return sources.join(changed.select(F.col(changed.columns[0]).alias("file")), "file", "left_semi").select("model_id").distinct()


def first_by_key(models: DataFrame, keys: list[str], entries: DataFrame) -> DataFrame:
    """models with `value` of the first of their key columns that entries (key, value) has; null if none has one.

    The keys are one exploded column with their rank, so there is one join and one aggregation, whatever their number.
    """
    ranked = F.array(*[F.struct(F.lit(i).alias("rank"), F.col(k).cast("string").alias("key")) for i, k in enumerate(keys)])
    rows = models.select("model_id", F.explode(ranked).alias("k")).select("model_id", "k.rank", "k.key").join(entries.select("key", "value"), "key")
    return models.join(rows.groupBy("model_id").agg(F.min_by("value", "rank").alias("value")), "model_id", "left")


def folder_settings(models: DataFrame, folders: DataFrame) -> DataFrame:
    """(path, setting): of the folders (folder, setting) that hold a path, the deepest one's; null if none does.

    A path is exploded to its folders, so this is an equality join and not a comparison with every folder.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = models.select("path", F.posexplode(above).alias("depth", "folder")).join(folders, "folder")
    return models.select("path").distinct().join(rows.groupBy("path").agg(F.max_by("setting", "depth").alias("setting")), "path", "left")


def filled(models: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """models with the null ones of `keys` taken from what is declared for their name (one row a name, the least)."""
    one = declared.groupBy("name").agg(*[F.min(k).alias(f"_{k}") for k in keys])
    rows = models.join(one, "name", "left")
    return rows.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in keys else F.col(c) for c in models.columns])


def unambiguous(files: DataFrame, models: DataFrame) -> DataFrame:
    """(path, model_id) of files that exactly one model claims."""
    one = models.groupBy("path").agg(F.count("*").alias("n"), F.min("model_id").alias("model_id")).where("n = 1")
    return files.select("path").distinct().join(one, "path").select("path", "model_id")


def changed_paths(base: DataFrame, head: DataFrame) -> DataFrame:
    """(path, side): paths with another text on the two sides: both, base (gone) or head (new)."""
    b, h = base.select("path", F.sha2("text", 256).alias("_b")), head.select("path", F.sha2("text", 256).alias("_h"))
    side = F.when(F.col("_b").isNull(), "head").when(F.col("_h").isNull(), "base").otherwise("both")
    return b.join(h, "path", "full_outer").where(~F.col("_b").eqNullSafe(F.col("_h"))).select("path", side.alias("side"))
