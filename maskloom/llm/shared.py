"""What several operators of this subpackage need: shared tables and text conventions."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a few numbers each that may be broadcast: some tens of MB at most.
BROADCAST_ROWS = 1_000_000


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


def broadcast_if_few(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """df, to be broadcast if it, or the table that bounds its size, has BROADCAST_ROWS rows at most. A written
    table is counted; rows have to be small."""
    few = (df if counted is None else counted).limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(df) if few else df


def release_memory() -> None:
    """Give what a Python worker has freed back to the system: workers live on beside the executor's other work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; its own ways have to do


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Words of a text as long; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
