"""Attribute-value rows into wide tables by characteristic sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import cut


def characteristic_sets(
    rows: DataFrame, entity: str, attribute: str, value: str, order: str, columns: dict[str, tuple[str, Column]], most_tables: int = 12
) -> DataFrame:
    """One row per entity with typed columns.

    columns: attribute -> (SQL type, expression that reads the column ``_v`` as that type, null if it can't), any number.
    Each column takes the readable value of the row with the highest ``order`` (ties: the greatest value);
    rows with other attributes, or without entity or attribute, count for nothing.  An empty table gives none.

    One aggregation (combined before the shuffle, so a hot entity costs one row a task) makes each entity's record
    and its signature, the exact set of its attributes.  The records are written once, sorted by signature.  Each of
    the ``most_tables`` most frequent signatures is a dense table of its own columns; rarer ones, which may be as
    many as the entities, lie in the table of their common superset.  The tables are joined by name, missing columns
    being null, when the result is read.
    """
    if not columns:
        raise ValueError("no attributes")
    names = list(columns)
    own = {n: f"a{i}" for i, n in enumerate(names)}  # no attribute's name can clash with a column in use
    base = rows.select(
        F.col(entity).alias("_e"), F.col(attribute).alias("_a"), F.col(value).alias("_v"), F.col(order).alias("_o")
    ).where(F.col("_e").isNotNull() & F.col("_a").isin(*names))
    read = base.select("_e", "_a", "_o", *(F.when(F.col("_a") == n, columns[n][1].cast(columns[n][0])).alias(own[n]) for n in names))
    picks = [
        F.max(F.when(F.col(c).isNotNull(), F.struct(F.coalesce("_o", F.lit(-(2**63))).alias("o"), F.col(c).alias("v")))).alias(c)
        for c in own.values()
    ]
    flags = [F.max(F.when(F.col("_a") == n, "1").otherwise("0")).alias(f"h{i}") for i, n in enumerate(names)]
    record = read.groupBy("_e").agg(*flags, *picks).select(
        F.concat(*(f"h{i}" for i in range(len(names)))).alias("_sig"), "_e", *(F.col(f"{c}.v").alias(c) for c in own.values())
    )
    dense = cut(record.sortWithinPartitions("_sig"))
    often = dense.groupBy("_sig").count().orderBy(F.col("count").desc(), "_sig").limit(most_tables).collect()
    some = [r["_sig"] for r in often]
    tables = [dense.where(F.col("_sig") == s).select("_e", *(own[n] for i, n in enumerate(names) if s[i] == "1")) for s in some]
    tables.append(dense.where(~F.col("_sig").isin(*some)).select("_e", *own.values()))
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return joined.select(F.col("_e").alias(entity), *(F.col(c).alias(n) for n, c in own.items()))
