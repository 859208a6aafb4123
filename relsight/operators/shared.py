"""The shared folder: checkpoints, and tables that cut lineages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the context's checkpoint folder, set by ``checkpoint_dir`` where it is not."""
    checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, name: str, *apart: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet, in folders by the columns ``apart``, and read it back."""
    path = f"{shared_dir(df.sparkSession)}/relsight/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(apart) or None)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._relsight_path = path
    return back


def drop_written(df: DataFrame) -> None:
    """Delete a table that ``written`` made and that nothing reads any more."""
    if path := df.__dict__.get("_relsight_path"):
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir, or else the warehouse, which is local only where the session is."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    found = context.getConf().get("spark.checkpoint.dir")
    if not found:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if warehouse.startswith("file:") and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{warehouse.rstrip('/')}/checkpoints"
    context.setCheckpointDir(found)
