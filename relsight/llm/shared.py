"""Shared-folder tables and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's spark.checkpoint.dir, else the context's checkpoint
    folder, else the warehouse: a local one only where the session is local.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else None
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir")
        if found.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it back."""
    path = f"{shared_dir(df.sparkSession)}/relsight/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._relsight_path = path
    return back


def drop_written(df: DataFrame) -> None:
    """Delete a table that ``written`` made and that nothing reads any more."""
    path = df.__dict__.get("_relsight_path")
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def settings(spark: SparkSession, **values) -> Iterator[None]:
    """SQL settings (dots written as two underscores) that hold inside the block and are as before after it."""
    before = {k.replace("__", "."): spark.conf.get(k.replace("__", "."), None) for k in values}
    for k, v in values.items():
        spark.conf.set(k.replace("__", "."), v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most ``rows`` rows from here on.

    Rows hold whole texts, and a plan that an operator returns runs after it
    has returned, so the session keeps the setting; it is only ever lowered.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def fresh(names: list[str], wanted: str) -> str:
    """A column name that none of ``names`` has, whatever its case."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


#: A key is hot with more than one of HOT rows, so there are fewer than HOT such keys; its rows are dealt to SALTS tasks.
HOT, SALTS = 512, 32


def salted_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right`` (one row a key) by ``key``, where a key may hold any share of ``left``.

    Rows of hot keys are dealt to SALTS tasks, and the right rows of those
    keys, fewer than HOT, are copied to each. ``counts`` are the keys' numbers
    of rows (``n``), where they are known; else ``left`` is read twice, so it
    should be a table.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts.select(key, "n")
    bound = F.broadcast(counts.agg((F.sum("n") / HOT).alias("bound")))  # one row
    hot = written(counts.crossJoin(bound).where("n > bound").select(key, F.lit(True).alias("hot_")), "hot")
    salt = F.when(F.col("hot_").isNotNull(), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    every = F.explode(F.when(F.col("hot_").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("salt_", salt).drop("hot_")
    copied = right.join(F.broadcast(hot), key, "left").withColumn("salt_", every).drop("hot_")
    return dealt.join(copied.hint("merge"), [key, "salt_"]).drop("salt_")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable by the links.

    Alternates large-star and small-star steps until the links form stars.
    Nodes without links don't appear; null ends and self links are ignored.
    Hot nodes meet only in partial aggregates and in joins that can be split.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        stamp = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(stamp) == before or not stamp[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        before = tuple(stamp)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        new = written(small.select("x.a", "x.b").where("a <> b").distinct(), "links")
        drop_written(now)
        drop_written(large)
        now = new
