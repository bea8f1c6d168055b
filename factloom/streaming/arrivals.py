"""Fact documents that arrive as files are ingested once each, by the same rule as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.sources.facts import FACT_SCHEMA, document_triples, insert_if_absent


def ingest_arrivals(spark: SparkSession, inbox: str, store: str, checkpoint: str):
    """Ingest all files of inbox that no earlier call has seen into the triple table at store; returns the query.

    Each micro-batch is reduced to the triples that the store lacks and appended under its own number, so that a
    batch repeated after a failure replaces its own rows only.
    """
    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        new = document_triples(batch)
        try:
            stored = session.read.parquet(store).where(f"batch <> {number}")
        except Exception as e:  # the store is made by the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = new.limit(0)
        insert_if_absent(new, stored).write.mode("overwrite").parquet(f"{store}/batch={number}")

    source = spark.readStream.schema(FACT_SCHEMA).option("multiLine", True).json(inbox)
    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
