"""Places for intermediate tables that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, the context's own, or in local mode a new one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="vahi-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's switch: the shuffles of a finished query are deleted at once, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark's limit of bytes for the code that it makes of a stage; above it, the stage's operators run one by one.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
#: The JVM only interprets methods above this size, which is slower than compiled operators one by one.
COMPILED_BYTES = 8000


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def no_shuffles_left(spark: SparkSession):
    """The queries that are written inside leave no shuffle files behind; what they wrote is all that later steps read."""
    return _setting(spark, CLEANUP, "true")


def compiled_stages(spark: SparkSession):
    """For wide rows of long expressions: stages of the queries that are run inside are compiled whole or not at all, never interpreted."""
    return _setting(spark, METHOD_LIMIT, str(COMPILED_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and reread: the lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with no_shuffles_left(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    object.__setattr__(out, "_stored_at", path)
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that stored() gave and that nobody reads any more: all that was made of them is stored itself. Other DataFrames are left alone."""
    for df in tables:
        if (path := df.__dict__.pop("_stored_at", None)) is not None:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
