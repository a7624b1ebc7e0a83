"""What several operators need from Spark: cut lineage, connected components, safe columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


FILTER_BITS = 1 << 26


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session that
    names none, as in tests, gets a folder of its own."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(there)
        return there
    set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def drop(spark: SparkSession, folder: str) -> None:
    """Removes a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: it outlives lost executors and ends the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch_root(spark: SparkSession) -> str | None:
    """Where a task may spill: the shared folder if it is mounted as files, else None, which
    means the directories that Spark itself gives the executor for spilling."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path.toUri().getPath() if system.getUri().getScheme() == "file" else None


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """A written table and its folder in the shared file system. Unlike a checkpoint, which keeps
    the estimates of the plan that it ends, it has the size of its files: estimates of joins in a
    loop don't multiply from round to round."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def id_column(df: DataFrame, name: str = "doc_id") -> Column:
    return df[name].cast("long").alias(name)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges (a, b), of any type that has an order; the component
    is its smallest node.

    Alternates large-star and small-star steps until the edges stop changing; each step's table is
    written, and the one before removed. A node's minimum is an aggregate with partial sums, joined
    back to its edges, so a node with very many neighbours is no single task's (its partition of the
    join is one that adaptive execution splits). The rounds grow with the logarithm of the longest
    chain; edges that still change after max_rounds are an error. Loops and repeats do no harm.
    """
    spark = edges.sparkSession

    def step(e: DataFrame, large: bool) -> tuple[DataFrame, str]:
        """Edges after a step, and their folder."""
        if large:
            e = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        else:
            e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least, at = stored(e.groupBy("u").agg(F.min("v").alias("m")))
        n = e.join(least, "u")
        if large:
            n = n.where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
        else:
            n = n.select(F.col("v").alias("a"), F.col("m").alias("b")).union(n.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after, folder = stored(n.where("a <> b").distinct())
        drop(spark, at)
        return after, folder

    e, folder = stored(edges.select("a", "b").where("a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        for large in (True, False):
            e, after = step(e, large)
            drop(spark, folder)
            folder = after
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            stars = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
            roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return stars.union(roots)
        before = now
    drop(spark, folder)
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def perhaps(rows: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """The rows whose key is in wanted, and a few others, before they are shuffled for an exact
    join. The bits sent to all tasks are FILTER_BITS at most, at any size; with more keys than
    they can tell apart rows are only shuffled that the join then drops."""
    code = F.xxhash64(*key)
    bits = min(FILTER_BITS, 1 << max(12, (16 * max(1, wanted.count())).bit_length()))
    slot = F.pmod(F.shiftright(code, 6), F.lit(bits // 64)).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(xxhash64({', '.join(key)}) & 63 as int))")
    filled = wanted.select(slot.alias("slot__"), bit.alias("bit__")).groupBy("slot__").agg(F.bit_or("bit__").alias("set__"))
    return rows.join(F.broadcast(filled), slot == F.col("slot__")).where(F.col("set__").bitwiseAND(bit) != 0).drop("slot__", "set__")


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
