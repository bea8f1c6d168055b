"""Filling fixed-capacity containers with items: cost-balanced packing."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Bytes that a rank file may have, since all executors get it.
_MOST_RANKS = 64 << 20


@lru_cache(maxsize=4)
def _encoding(ranks: bytes, pattern: str):
    """The tokenizer of the content of a rank file, once per worker."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def _ranks(path: str) -> tuple[bytes, str]:
    """(content of a rank file, pattern by which texts are split first)."""
    import public_tokenizers

    if os.path.getsize(path) > _MOST_RANKS:
        raise ValueError(f"rank file of more than {_MOST_RANKS} bytes")
    with open(path, "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def token_counts(docs: DataFrame, doc: str, text: str, tokenizer: str | None = None) -> DataFrame:
    """(doc, tokens) of the whole texts; a null or empty text has none."""
    held = docs.sparkSession.sparkContext.broadcast(_ranks(tokenizer or default_tokenizer()))
    source = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    kind = source.schema["doc"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(*held.value).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc", "tokens"])

    return source.mapInArrow(count, f"doc {kind}, tokens bigint")


def fill(sizes: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[np.ndarray, np.ndarray]:
    """(container, place) of each item: in descending order each goes to the cheapest container with room for it.

    The containers are as many as the items fill at best; an item for which none has room opens another.
    """
    order = np.argsort(-sizes, kind="stable")
    n = max(1, -(-int(sizes.sum()) // capacity))
    room, cost = np.full(n, capacity, np.int64), np.zeros(n)
    container, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in order:
        size = int(sizes[i])
        at = int(np.argmin(np.where(room >= size, cost, np.inf)))
        if room[at] < size:
            room, cost = np.append(room, capacity), np.append(cost, 0.0)
            at = len(room) - 1
        container[i], place[i] = at, capacity - room[at]
        room[at] -= size
        cost[at] += linear * size + quadratic * size * size
    return container, place


def pack(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", capacity: int = 2048, tokenizer: str | None = None,
    linear: float = 1.0, quadratic: float = 1 / 2048, group_tokens: int = 4_000_000,
    group_rows: int = 50_000,
) -> DataFrame:
    """(doc, part, container, place, tokens): where each document's tokens lie.

    A text of at most capacity tokens is one part.  A longer one is split into parts that fill a container each and
    a rest, which is an item like others.  Empty texts are items of no tokens.  Each row of docs is an item; rows
    with a null doc are packed too.

    The items are dealt by hash into groups of about group_tokens tokens and group_rows items at most, as many as
    the corpus needs, so that every group has a bounded size and leaves at most one container poorly filled; a group is packed in one task.
    """
    counts = cut(token_counts(docs, doc, text, tokenizer).withColumn("row", F.monotonically_increasing_id()))
    full = F.when(F.col("tokens") > capacity, F.floor(F.col("tokens") / capacity)).otherwise(0).cast("int")
    sized = counts.withColumn("full", full).withColumn("rest", F.col("tokens") - F.col("full") * capacity)
    total, rows = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-total // group_tokens), -(-rows // group_rows))
    kind = counts.schema["doc"].dataType.simpleString()

    def packed(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        container, place = fill(items["rest"].to_numpy(), capacity, linear, quadratic)
        return pd.DataFrame({
            "doc": items["doc"], "part": items["full"], "container": [f"g{key[0]}-{c}" for c in container], "place": place, "tokens": items["rest"],
        })

    rests = sized.where("rest > 0 or full = 0").withColumn("g", F.pmod(F.xxhash64("doc", "row"), F.lit(groups)))
    parts = rests.groupBy("g").applyInPandas(packed, f"doc {kind}, part int, container string, place bigint, tokens bigint")
    filled = sized.where("full > 0").select(
        "doc", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part"), "row"
    ).select("doc", "part", F.concat(F.lit("d"), "row", F.lit("-"), "part").alias("container"), F.lit(0).cast("bigint").alias("place"), F.lit(capacity).cast("bigint").alias("tokens"))
    return parts.unionByName(filled).withColumnRenamed("doc", doc)


def fills(packed: DataFrame) -> DataFrame:
    """(container, items, used) of every container."""
    return packed.groupBy("container").agg(F.count("*").alias("items"), F.sum("tokens").alias("used"))
