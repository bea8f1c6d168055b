"""The numbered data-preparation queries of the core: references, hierarchies, wide, nested and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.names import address_or_text, canonical_class, canonical_predicate, text_or_null, whole_bytes, yes_no
from factloom.operators.hierarchy import hierarchies
from factloom.operators.nested import call_links
from factloom.operators.packed import split_values
from factloom.operators.references import dangling
from factloom.operators.wide import characteristic_sets
from factloom.session import table

DATA_TEXT = ("data_symbol_name", "data_section", "data_type_name")
DATA_FLAGS = ("data_readable", "data_writable", "data_executable", "data_initialized")
DATA_SIZES = ("data_size_bytes", "data_size_bytes_estimated")


def _references(spark: SparkSession, sf: str) -> DataFrame:
    """Every reference: kind (of the record named), key, row_id, ref_table, ref_field, time of the referring row."""
    evidence, hypotheses = table(spark, sf, "evidence"), table(spark, sf, "hypotheses")
    shape = lambda df, kind, key, t, f, time: df.select(
        F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col("id").alias("row_id"), F.lit(t).alias("ref_table"), F.lit(f).alias("ref_field"), F.col(time).alias("time")
    )
    cited = split_values(hypotheses, ["id", "created_at"], "supporting_evidence", evidence)
    return (
        shape(evidence, "observations", "observation_id", "evidence", "observation_id", "recorded_at")
        .unionByName(shape(cited, "evidence", "value", "hypotheses", "supporting_evidence", "created_at"))
        .unionByName(shape(hypotheses, "investigations", "created_by", "hypotheses", "created_by", "created_at"))
    )


def _records(spark: SparkSession, sf: str) -> DataFrame:
    shape = lambda name, time, gone: table(spark, sf, name).select(
        F.lit(name).alias("kind"), F.col("id").alias("key"), F.col(time).alias("valid_from"), gone.alias("deleted")
    )
    retracted = F.upper(F.trim("status")) == "RETRACTED"
    return (
        shape("observations", "created_at", retracted)
        .unionByName(shape("evidence", "recorded_at", F.lit(False)))
        .unionByName(shape("investigations", "created_at", F.lit(False)))
    )


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references with their state and the month of the referring row."""
    return dangling(_references(spark, sf), _records(spark, sf)).select(
        "ref_table", "ref_field", "row_id", F.col("key").alias("ref_id"), "state", F.date_format("time", "yyyy-MM").alias("ref_month")
    )


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references per table, field, month and state."""
    return p2_found(spark, sf).groupBy("ref_table", "ref_field", "ref_month", "state").agg(
        F.count("*").alias("n_references"), F.countDistinct("row_id").alias("n_rows")
    )


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each class with its root, depth, path and descendants."""
    links = table(spark, sf, "recovered_classes").select(canonical_class(F.col("name")).alias("name"), canonical_class(F.col("base")).alias("base"))
    return hierarchies(links, "name", "base").select(
        F.col("node").alias("class_name"), F.col("root").alias("root_name"), "depth", "state", F.col("path").alias("full_path"), F.col("descendants").alias("n_descendants")
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """One row per data object with typed columns."""
    rows = table(spark, sf, "observations").where("status = 'ACTIVE'").select(
        address_or_text(F.col("subject")).alias("subject"), canonical_predicate(F.col("predicate")).alias("predicate"), "value", "id"
    )
    columns = {n: ("string", text_or_null(F.col("_v"))) for n in DATA_TEXT}
    columns |= {n: ("int", yes_no(F.col("_v"))) for n in DATA_FLAGS}
    columns |= {n: ("bigint", whole_bytes(F.col("_v"))) for n in DATA_SIZES}
    return characteristic_sets(rows, "subject", "predicate", "value", "id", columns)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """One row per caller or callee listed in a fact document."""
    return call_links(table(spark, sf, "fact_documents"), "snapshot_id", "payload").select(
        "snapshot_id", "function_pos", "function_address", "link_side", "link_pos", "link_address"
    ).distinct()


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """One row per evidence id listed in a hypothesis."""
    fields = ("supporting_evidence", "contradicting_evidence")
    listed = table(spark, sf, "hypotheses").select("id", F.explode(F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f))))).alias("field_name", "packed"))
    return split_values(listed, ["id", "field_name"], "packed", table(spark, sf, "evidence")).select(
        F.col("id").alias("hypothesis_id"), "field_name", "pos", F.col("value").alias("evidence_id")
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p4_found, p5_found, p6_found, p7_found)}
