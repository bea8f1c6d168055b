"""Written cut points."""

import os

from pyspark.sql import functions as F

from factloom import session


def test_cut_and_release(spark):
    df = session.cut(spark.range(10).withColumn("x", F.array("id")))
    assert df.schema["x"].dataType.simpleString() == "array<bigint>" and df.count() == 10
    assert session.cut(df.limit(0)).count() == 0
    paths = [p.removeprefix("file:") for p in session._written[spark.sparkContext.applicationId]]
    assert paths and all(os.path.isdir(p) for p in paths)
    session.release(spark)
    assert not any(os.path.exists(p) for p in paths)


def test_released_keeps_what_was_there(spark):
    held = session.cut(spark.range(3))
    with session.released(spark):
        inner = session.shared_path(spark, "t")
        spark.range(2).write.parquet(inner)
    assert held.count() == 3 and not os.path.exists(inner.removeprefix("file:"))
    session.release(spark)
