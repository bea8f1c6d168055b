"""Spellings of addresses, predicates, class names and values."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import names as N


def one(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_addresses(spark):
    given = ["0x1F", "0X00001f", "1fh", "000000000000001FH", "00000001`403a2390", " 0x1f ", "", None, "zz", "0x0"]
    assert one(spark, N.canonical_address, given) == ["0x1f", "0x1f", "0x1f", "0x1f", "0x1403a2390", "0x1f", None, None, None, "0x0"]


def test_predicates(spark):
    assert one(spark, N.canonical_predicate, ["hasName", "HAS_NAME", " has-name", "has_name ", "dataSizeBytes", None]) == ["has_name"] * 4 + ["data_size_bytes", None]


def test_class_names(spark):
    given = ["public virtual class ns::A", "class ns::A", "::ns::A", " ns::A ", "2ns1A", "N2ns1AE", "N2ns1AEx", "ns :: A", "struct Foo", "3Foo", "", None, "  ", "_ZTSN2ns1AE", ".?AVA@ns@@", "Vector3"]
    assert one(spark, N.canonical_class, given) == ["ns::A", "ns::A", "ns::A", "ns::A", "ns::A", "ns::A", "N2ns1AEx", "ns::A", "Foo", "Foo", None, None, None, "ns::A", "ns::A", "Vector3"]


@pytest.mark.parametrize(("text", "n"), [
    ("42", 42), (" 42 ", 42), ("0x2A", 42), ("2ah", 42), ("4,096", 4096), ("1,234,567", 1234567), ("16 B", 16), ("16b", 16), ("8 bytes", 8), ("1 byte", 1), ("2.0", 2),
    ("2 KiB", 2048), ("2.5", None), ("large", None), ("--", None), ("", None), (None, None), ("12,34", None), ("-1", None), ("0x1b", 27),
])
def test_sizes(spark, text, n):
    assert one(spark, N.whole_bytes, [text]) == [n]


def test_marks_and_flags(spark):
    assert one(spark, N.says_something, ["x", " ", "", None, "N/A", "?", "<unknown>", "not determined", "--\n"]) == [True] + [False] * 8
    assert one(spark, N.yes_no, ["true ", "Y", "1", "FALSE", "no", "maybe", None]) == [1, 1, 1, 0, 0, None, None]
