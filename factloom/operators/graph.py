"""Walks over call and dependency edges as loops of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut, shared_path


def reachable(edges: DataFrame, roots: DataFrame, limit: int | None = None) -> DataFrame:
    """(node, depth): every node reachable from the roots (column node), with its least number of steps.

    edges: src, dst.  The frontier is joined with the edges and reduced to new nodes until none is left, so that
    cycles end; limit bounds the steps.  Every round writes its frontier to a folder of its own under one table,
    which so holds all that was seen.
    """
    spark = edges.sparkSession
    edges = cut(edges.where("src is not null and dst is not null").distinct())
    first = roots.select("node").where("node is not null").distinct()
    kind, base = first.schema["node"].dataType.simpleString(), shared_path(spark, "reach")
    whole = lambda: spark.read.schema(f"node {kind}, depth int").parquet(base)
    first.write.parquet(f"{base}/depth=0")
    depth = 0
    while limit is None or depth < limit:
        frontier = spark.read.schema(f"node {kind}").parquet(f"{base}/depth={depth}")
        if frontier.isEmpty():
            break
        ahead = frontier.hint("merge").join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        depth += 1
        ahead.hint("merge").join(whole().select("node"), "node", "left_anti").write.parquet(f"{base}/depth={depth}")
    return whole()


def reach_by_root(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): what each root reaches, itself included; all roots walk together."""
    edges = cut(edges.where("src is not null and dst is not null").distinct())
    seen = frontier = cut(roots.select(F.col("node").alias("root"), "node").distinct())
    while not frontier.isEmpty():
        ahead = frontier.hint("merge").join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = cut(ahead.hint("merge").join(seen, ["root", "node"], "left_anti"))
        seen = cut(seen.unionByName(frontier))
    return seen


def startup_only(edges: DataFrame, entry: DataFrame, margin: int = 3) -> DataFrame:
    """(node): what the entry (one row, column node) reaches but its main function doesn't.

    The main function is, of the callees of the entry's only callee, the one with the largest reach, if there are
    at least two of them and its reach is ``margin`` times that of the next one or more.  Without it the result is
    empty: nothing is known of the boundary then.
    """
    edges = cut(edges.where("src is not null and dst is not null").distinct())
    only = sole_callees(edges.join(entry.select(F.col("node").alias("src")), "src", "left_semi")).select(F.col("dst").alias("src"))
    reach = cut(reach_by_root(edges, edges.join(only, "src", "left_semi").select(F.col("dst").alias("node"))))
    two = reach.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "root").limit(2)
    ranked = two.agg(F.reverse(F.sort_array(F.collect_list(F.struct("n", "root")))).alias("t")).where("size(t) = 2")
    main = cut(ranked.where(F.col("t")[0]["n"] >= F.col("t")[1]["n"] * margin).select(F.col("t")[0]["root"].alias("root")))
    whole = reachable(edges, entry).select("node")
    if main.isEmpty():
        return whole.limit(0)
    return whole.join(reach.join(main, "root", "left_semi").select("node"), "node", "left_anti")


def stale_cascade(dependencies: DataFrame, changed: DataFrame, states: DataFrame) -> DataFrame:
    """(id): hypotheses made stale when those in ``changed`` (id) change.

    dependencies: source depends on target.  The cascade passes through rejected and stale hypotheses but
    changes neither, nor the changed ones themselves.  states: id, status.
    """
    hit = reachable(dependencies.select(F.col("target").alias("src"), F.col("source").alias("dst")), changed.select(F.col("id").alias("node")))
    met = hit.where("depth > 0").select(F.col("node").alias("id"))
    return met.join(states.where("status not in ('REJECTED', 'STALE')").select("id"), "id", "left_semi")


def resolves_to(edges: DataFrame, targets: DataFrame, hops: int) -> DataFrame:
    """(node): nodes from which a chain of at most ``hops`` steps along edges ends in a target (column node)."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reachable(back, targets, hops).where("depth > 0").select("node")


def sole_callees(edges: DataFrame) -> DataFrame:
    """(src, dst) of the nodes with exactly one distinct callee."""
    return edges.groupBy("src").agg(F.min("dst").alias("dst"), F.max("dst").alias("last")).where("dst = last").select("src", "dst")
