"""References to records that do not exist, exist no more, or came later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.skew import hot_join
from factloom.session import cut


def dangling(refs: DataFrame, parents: DataFrame, most_hot: int = 1000, least_hot: int = 20_000) -> DataFrame:
    """The references in refs whose record is missing, deleted or later: refs' columns and ``state``.

    refs: kind, key, time and any other columns; rows with a null key refer to nothing; equal rows count once.
    parents: kind, key, valid_from, deleted, the validity interval of each record: it opens at valid_from (null:
    always open) and is empty if deleted.  A record delivered twice counts once; of several rows of one key the
    earliest valid_from counts, and deleted only if all are.

    Both streams are partitioned alike and sorted by (kind, key, salt), then merged in one linear pass
    (a sort-merge join, see skew.hot_join for records that very many rows refer to).
    """
    refs = cut(refs.where(F.col("key").isNotNull()).distinct())
    whole = parents.where(F.col("key").isNotNull()).groupBy("kind", "key").agg(
        F.when(F.count("valid_from") == F.count("*"), F.min("valid_from")).alias("_from"), F.bool_and(F.coalesce("deleted", F.lit(False))).alias("_gone")
    )
    merged = hot_join(refs, whole, ["kind", "key"], "left", least_hot=least_hot, most_hot=most_hot)
    state = (
        F.when(F.col("_gone").isNull(), "missing").when(F.col("_gone"), "deleted").when(F.col("_from") > F.col("time"), "later")
    )
    return merged.withColumn("state", state).where(F.col("state").isNotNull()).select(*refs.columns, "state")
