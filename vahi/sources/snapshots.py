"""Tables that belong together, written as one transaction: folders under a run's name, and a marker that is written last.

A run's tables are in `path/run/attempt/<table>`. The marker `path/_committed/run` holds the attempt's name and appears at once, by a rename; readers take only what
a marker names. A writer that stops halfway leaves a folder that nobody reads; writing the run again makes a new attempt. A run that is committed stays as it is.
All goes through the file system that Spark uses for the path, so it works for any store that Spark reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

MARKERS = "_committed"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)


def _attempt(spark: SparkSession, path: str, run: str) -> str | None:
    """The attempt that a run's marker names."""
    fs, at = _files(spark, path)
    marker = at(f"{path}/{MARKERS}/{run}")
    return str(spark.read.text(marker.toString()).first()[0]) if fs.exists(marker) else None


def runs(spark: SparkSession, path: str) -> list[str]:
    """The committed runs, by name."""
    fs, at = _files(spark, path)
    where = at(f"{path}/{MARKERS}")
    return sorted(x.getPath().getName() for x in fs.listStatus(where) if not x.getPath().getName().startswith(("_", "."))) if fs.exists(where) else []


def commit(path: str, run: str, tables: dict[str, DataFrame]) -> bool:
    """Write a run's tables and then its marker; False, and nothing written, if the run is committed already.

    Of two writers of one run the first whose marker lands wins: a marker is created only if there is none, and the other's folder stays unread.
    """
    spark = next(iter(tables.values())).sparkSession
    if "/" in run or run.startswith(("_", ".")) or not run:
        raise ValueError(f"no name of a run: {run!r}")
    if _attempt(spark, path, run) is not None:
        return False
    attempt = uuid.uuid4().hex
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/{run}/{attempt}/{name}")
    fs, at = _files(spark, path)
    fs.mkdirs(at(f"{path}/{MARKERS}"))
    draft = at(f"{path}/{run}/{attempt}/_marker")
    out = fs.create(draft, False)
    out.write(bytearray(attempt.encode()))
    out.close()
    if fs.exists(at(f"{path}/{MARKERS}/{run}")):
        return False
    return bool(fs.rename(draft, at(f"{path}/{MARKERS}/{run}")))


def read(spark: SparkSession, path: str, run: str, table: str) -> DataFrame:
    """A table of a committed run."""
    attempt = _attempt(spark, path, run)
    if attempt is None:
        raise LookupError(f"run {run} is not committed")
    return spark.read.parquet(f"{path}/{run}/{attempt}/{table}")


def read_all(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """A table of all committed runs together; None without any."""
    found = [f"{path}/{run}/{_attempt(spark, path, run)}/{table}" for run in runs(spark, path)]
    return spark.read.parquet(*found) if found else None
