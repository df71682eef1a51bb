"""Where loops cut their lineage: Parquet tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_RECORDS: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster sets it. Where it is unset and the master is local, as in tests, a temporary folder of this process; on a cluster that is an error, as executors do not share it."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="lattica-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def stored(df: DataFrame, name: str = "step", **options: str) -> DataFrame:
    """df, written and read back: later steps start from files, which survive lost executors. options: of the Parquet writer."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    for record in _RECORDS:
        record.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that are stored while this is open."""
    paths: list[str] = []
    _RECORDS.append(paths)
    try:
        yield paths
    finally:
        _RECORDS.remove(paths)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more."""
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


class Steps:
    """Stored tables of a loop: keep() stores one and removes those that are older than the last `most`, which nothing reads any more."""

    def __init__(self, most: int = 2):
        self._most, self._paths = most, []

    def keep(self, df: DataFrame, name: str = "step") -> DataFrame:
        spark = df.sparkSession
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._paths.append(path)
        while len(self._paths) > self._most:
            remove(spark, self._paths.pop(0))
        return spark.read.schema(df.schema).parquet(path)
