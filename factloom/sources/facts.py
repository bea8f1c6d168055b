"""Fact documents and linker logs as sources; versioned snapshots and partitioned text as sinks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINK = "address string, name string"
FACT_SCHEMA = f"""program string,
functions array<struct<{_LINK}, size bigint, signature string, calling_convention string, callers array<string>, callees array<string>,
  decompilation string, owner_class string, is_constructor boolean, is_destructor boolean, installs_vtable_of string>>,
strings array<struct<address string, value string>>, imports array<struct<name string, namespace string, address string>>,
exports array<struct<name string, address string>>, vtables array<struct<class_name string, address string>>,
virtual_methods array<struct<class_name string, slot int, function_address string>>, inheritance array<struct<derived string, base string>>,
fields array<struct<class_name string, offset string, type string>>,
data_objects array<struct<address string, symbol_name string, section string, readable boolean, writable boolean, executable boolean, initialized boolean,
  data_type string, size bigint, size_confident boolean, bytes_hex string, inside_function string, pointee_address string, pointee_source string, referenced_from array<string>>>"""

#: What is said of a function that stores a class's vtable pointer.
INSTALLS = (
    "stores %s's own vtable pointer into `this` early in this function's body -- the Itanium C++ ABI idiom every constructor and "
    "destructor performs (which of the two this is isn't determined)"
)


def read_fact_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document file, with the schema stated (empty arrays would be inferred as text).

    A file that can't be read is a row of nulls with its text in ``_corrupt_record``; no file vanishes.
    """
    schema = f"{FACT_SCHEMA}, _corrupt_record string"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def migrated(rows: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """rows with the columns (name -> type, default) that an older version of their table lacks; others stay as they are."""
    return rows.withColumns({c: F.lit(default).cast(kind) for c, (kind, default) in columns.items() if c not in rows.columns})


def _address(x) -> str | None:
    """The canonical address of a JSON number, text or object with an address or offset; other text as it is."""
    while isinstance(x, dict):
        x = x.get("address", x.get("offset"))
    if isinstance(x, int) and not isinstance(x, bool):
        return f"0x{x:x}" if x >= 0 else None
    if not isinstance(x, str):
        return None
    m = re.fullmatch(r"(?:0x)?0*([0-9a-f]+)h?", re.sub(r"[\s`_]", "", x).lower())
    return f"0x{m[1]}" if m else x.strip()


def _plain(payload: str) -> str | None:
    """The document with addresses as canonical text and address lists as lists; null if it is no JSON object."""
    try:
        doc = json.loads(payload)
    except (ValueError, RecursionError):
        return None
    if not isinstance(doc, dict):
        return None
    for array in doc.values():
        for x in array if isinstance(array, list) else ():
            if isinstance(x, dict):
                x |= {k: _address(x[k]) for k in ("address", "function_address", "inside_function", "pointee_address") if k in x}
                for k in ("callers", "callees", "referenced_from"):
                    if k in x:
                        x[k] = [a for a in map(_address, x[k] if isinstance(x[k], list) else [x[k]]) if a is not None]
    return json.dumps(doc)


def parsed_documents(docs: DataFrame, payload: str) -> DataFrame:
    """Fact documents kept as JSON text, of any generation of the extractor, with the columns of FACT_SCHEMA."""
    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(_plain, b.column(0).to_pylist()), pa.string())], ["text"])

    texts = docs.select(F.col(payload).alias("text")).where("text is not null").mapInArrow(plain, "text string")
    return texts.where("text is not null").select(F.from_json("text", FACT_SCHEMA).alias("d")).select("d.*")


def document_triples(docs: DataFrame) -> DataFrame:
    """(subject, predicate, value, confidence, source) of every fact array but the cross references.

    Facts without subject or value fall away; a fact that a document states twice comes once.
    """
    def part(array: str, subject: str, predicate: str, value, confidence: float, source: str) -> DataFrame:
        rows = docs.select(F.explode(array).alias("x"))
        return rows.select(F.col(f"x.{subject}").alias("subject"), F.lit(predicate).alias("predicate"), value.alias("value"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))

    x = lambda c: F.col(f"x.{c}")
    data = lambda p, v: part("data_objects", "address", f"data_{p}", v, 0.95, "ghidra:data")
    installs = F.format_string(INSTALLS, x("installs_vtable_of"))
    fn = lambda p, v: part("functions", "address", p, v, 0.95, "ghidra:function")
    parts = [
        fn("has_name", x("name")), fn("has_signature", x("signature")), fn("calling_convention", x("calling_convention")), fn("size_bytes", x("size").cast("string")),
        part("functions", "address", "decompiles_to", F.when(x("decompilation") != "", x("decompilation")), 0.95, "ghidra:decompiler"),
        fn("is_method_of", x("owner_class")), fn("is_constructor_of", F.when(x("is_constructor"), x("owner_class"))), fn("is_destructor_of", F.when(x("is_destructor"), x("owner_class"))),
        part("strings", "address", "contains_string", x("value"), 0.95, "ghidra:string"),
        part("imports", "address", "imports", F.concat_ws("!", x("namespace"), x("name")), 1.0, "ghidra:import"),
        part("exports", "address", "exports", x("name"), 1.0, "ghidra:export"),
        part("vtables", "class_name", "has_vtable_at", x("address"), 1.0, "ghidra:vtable"),
        part("virtual_methods", "class_name", "has_virtual_method", F.format_string("slot %d: %s", x("slot"), x("function_address")), 0.95, "ghidra:vtable"),
        part("inheritance", "derived", "inherits_from", x("base"), 1.0, "ghidra:rtti"),
        part("fields", "class_name", "has_field_candidate", F.concat_ws(":", x("offset"), x("type")), 0.85, "ghidra:function"),
        fn("vtable_install_pattern", F.when(x("installs_vtable_of").isNotNull(), installs)),
        *(data(c, x(c)) for c in ("symbol_name", "section", "bytes_hex", "inside_function")), data("type_name", x("data_type")),
        *(data(c, x(c).cast("string")) for c in ("readable", "writable", "executable", "initialized")),
        data("size_bytes", F.when(x("size_confident"), x("size").cast("string"))),
        data("size_bytes_estimated", F.when(~F.coalesce(x("size_confident"), F.lit(False)), x("size").cast("string"))),
        data("pointee", F.concat(x("pointee_address"), F.lit(" ("), x("pointee_source"), F.lit(")"))),
    ]
    for array, side, predicate, source in (
        ("functions", "callees", "calls", "ghidra:call_graph"), ("functions", "callers", "called_by", "ghidra:call_graph"), ("data_objects", "referenced_from", "data_referenced_from", "ghidra:data"),
    ):
        rows = docs.select(F.explode(array).alias("f")).select(F.col("f.address").alias("subject"), F.explode(f"f.{side}").alias("value"))
        parts.append(rows.select("subject", F.lit(predicate).alias("predicate"), "value", F.lit(0.95).alias("confidence"), F.lit(source).alias("source")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.where("subject is not null and value is not null").groupBy("subject", "predicate", "value").agg(F.max("confidence").alias("confidence"), F.max("source").alias("source"))


def insert_if_absent(new: DataFrame, stored: DataFrame) -> DataFrame:
    """The new triples that no stored row has, whatever that row's status."""
    key = ["subject", "predicate", "value"]
    return new.dropDuplicates(key).join(stored.select(*key).distinct(), key, "left_anti")


def read_linker_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, kind, address): undefined symbols of linker logs, once each."""
    lines = spark.read.text(path).select(F.regexp_extract("value", r"undefined reference to `([^'(]+)", 1).alias("symbol")).where("symbol <> ''").distinct()
    address = F.regexp_extract("symbol", r"^(?:thunk_)?FUN_([0-9A-Fa-f]+)$", 1)
    return lines.select("symbol", F.when(address != "", "FUNCTION").otherwise("DATA").alias("kind"), F.when(address != "", F.concat(F.lit("0x"), F.lower(address))).alias("address"))


def save_snapshot(tables: dict[str, DataFrame], root: str, version: int) -> None:
    """Write a new version beside the old ones, then name it in the pointer; nothing is overwritten."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{root}/v{version}/{name}")
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").json(f"{root}/versions")


def load_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the latest version."""
    latest = spark.read.schema("version int").json(f"{root}/versions").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/v{latest}/{name}")


def write_texts(files: DataFrame, path: str) -> None:
    """Text files by name: rows (file_name, place, text) in the order of place.

    Rows of a file are brought together in one partition, so a file is bounded by what one file may hold.
    """
    files.repartition("file_name").sortWithinPartitions("file_name", "place").select("file_name", "text").write.partitionBy("file_name").text(path)
