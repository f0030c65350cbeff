"""Tables that a job writes for its own later steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, named by spark.checkpoint.dir or setCheckpointDir().

    Only a local session that names none, as in tests, gets a new temporary folder, until it ends.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    own = spark.conf.get("maskloom.shared.dir", None)
    if not own:
        own = tempfile.mkdtemp(prefix="maskloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.conf.set("maskloom.shared.dir", own)
    return own


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that saved() wrote, once nothing will read them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
