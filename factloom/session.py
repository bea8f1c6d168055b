"""Session helpers: the shared checkpoint folder and table loading."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session without that
    setting (as in tests) gets a temporary folder; on a cluster a missing setting is an error.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="factloom-")
    spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to a table in the shared folder and read it from there.

    Later steps so begin at files that outlive any executor, with the sizes that they really have; a plan that
    keeps the estimates of its origin would multiply them with every join of a loop.
    """
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Paths written in each application, by its id.
_written: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table beside the checkpoints."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the tables that this application has written to the shared folder.

    To be called when the results that were built on them have been stored or used.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(spark.sparkContext.applicationId, []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Tables written inside the block are deleted at its end, when its results have been stored."""
    before = list(_written.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        _written[spark.sparkContext.applicationId] = [p for p in _written.get(spark.sparkContext.applicationId, []) if p not in before]
        release(spark)
        _written[spark.sparkContext.applicationId] = before


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
