"""Walks, text functions and numbering."""

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import graph as G
from factloom.operators import views as V


def test_startup_only(spark):
    from factloom.operators.graph import startup_only

    start = [("e", "crt"), ("crt", "argv"), ("crt", "main"), ("argv", "lib")]
    main = [("main", f"m{i}") for i in range(5)] + [("m1", "lib")]
    entry = spark.createDataFrame([("e",)], "node string")
    only = lambda edges: sorted(r.node for r in startup_only(spark.createDataFrame(edges, "src string, dst string"), entry).collect())
    assert only(start + main) == ["argv", "crt", "e"]
    assert only(start + main[:3]) == []  # 4 against 2: no margin
    assert only([("e", "crt"), ("crt", "main"), *main]) == []  # no sibling
    assert only([*start, *main, ("e", "other")]) == []  # two callees of the entry


def test_reachable_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), (None, "a"), ("d", None)], "src string, dst string")
    roots = spark.createDataFrame([("a",), (None,)], "node string")
    assert {(r.node, r.depth) for r in G.reachable(edges, roots).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {r.node for r in G.reachable(edges, roots, 1).collect()} == {"a", "b"}


def test_cascade_passes_rejected(spark):
    deps = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (1, 4)], "source bigint, target bigint")
    states = spark.createDataFrame([(1, "REJECTED"), (2, "ACCEPTED"), (3, "REJECTED"), (4, "SUPPORTED")], "id bigint, status string")
    assert {r.id for r in G.stale_cascade(deps, spark.createDataFrame([(1,)], "id bigint"), states).collect()} == {2, 4}


def test_numbered(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    got = [r.new_id for r in V.numbered(df, ["k"], 7).orderBy("k").collect()]
    assert got == list(range(8, 1008))
    assert V.numbered(df.limit(0), ["k"], 7).collect() == []


def test_degenerate_bodies(spark):
    given = [
        ("int f(void);", True), ("int f(void)\n\n{...}\n", True), ("int f(void)\n{ // left out\n /* x */ }", True), ("int f(void)\n{\n  return 1;\n}\n", False),
        ("void f(void)\n{\n  int *p;\n  *p = 1;\n}", True), ("void f(void)\n{\n  int *p;\n  p = g();\n  *p = 1;\n}", False), ("void f(void)\n{\n  int *p;\n  x = p->y;\n}", True),
        ("void f(void)\n{\n  return *p;\n}", False), ("", True), ("{", True),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(given)], "i int, t string")
    assert [r.d for r in df.select("i", T.is_degenerate(F.col("t")).alias("d")).orderBy("i").collect()] == [d for _, d in given]


def test_slots_and_words(spark):
    body = "void f(Foo *this, int x)\n{\n  *this = 1; this[2] = 3; y = this + 0x8; this[2] = 4;\n}"
    row = spark.createDataFrame([(body, "Draws14x14 splitCamel of 123 io")], "b string, w string").select(
        T.first_parameter(F.col("b")).alias("p"), T.own_slots(F.col("b"), T.first_parameter(F.col("b"))).alias("n"), T.words(F.col("w")).alias("w"),
        T.fingerprint(F.lit("x = DAT_140009070 + a_12;")).alias("f"), T.fingerprint(F.lit("x = DAT_14000ffff + a_12;")).alias("g"),
    ).first()
    assert (row.p, row.n, set(row.w)) == ("this", 3, {"draws", "split", "camel"})
    assert row.f == row.g
