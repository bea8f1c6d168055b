"""Joins of many rows with unique keys, in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_join(
    rows: DataFrame, unique: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None, total: int | None = None,
    least_hot: int = 20_000, most_hot: int = 1000,
) -> DataFrame:
    """rows joined with ``unique`` (one row a key) by sort and merge, hot keys dealt over several partitions.

    A key with more than max(least_hot, rows / most_hot) rows is hot: its rows are dealt over as many salts as they
    fill, and its one row in ``unique`` is repeated for each.  Fewer than most_hot such keys can exist, whatever the
    data, so that their list is broadcast.  rows: a written table, as they are counted first, unless their number is
    given (total: that or more); counts: keys and ``c``, the rows of each key, where they are known already.  Rows with
    a null key match nothing.
    """
    share = max(1, least_hot, (rows.count() if total is None else total) // most_hot)
    per = counts if counts is not None else rows.groupBy(*keys).agg(F.count("*").alias("c"))
    hot = F.broadcast(per.where(F.col("c") > share).select(*keys, F.ceil(F.col("c") / share).cast("int").alias("_salts")))
    plain = [c for c in rows.columns if c not in keys]
    salt = F.pmod(F.xxhash64(*plain), F.coalesce("_salts", F.lit(1))).cast("int")
    dealt = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_salts")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    held = unique.join(hot, keys, "left").withColumn("_salt", each).drop("_salts")
    return dealt.hint("merge").join(held, [*keys, "_salt"], how).drop("_salt")
