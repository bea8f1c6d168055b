"""Parent-child links to full hierarchies by tree contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from factloom.operators.skew import hot_join
from factloom.session import cut

SEPARATOR = " > "


def _rank(c: str) -> Column:
    """A new rank in each round; the round is a column, so that all rounds run the same compiled code."""
    return F.xxhash64(F.col(c), F.col("turn"))


def _written(core: DataFrame, moving: Column) -> tuple[DataFrame, int, int]:
    """(core as a written table, how many of its nodes can still move, most children of a node)."""
    seen = Observation()
    table = cut(core.observe(seen, F.count(F.when(moving, 1)).alias("moves"), F.coalesce(F.max("n"), F.lit(0)).alias("most")))
    return table, seen.get["moves"], seen.get["most"]


def hierarchies(links: DataFrame, node: str, parent: str, hub: int = 20_000) -> DataFrame:
    """(node, root, depth, state, path, descendants), one row per node that has a row in links.

    state is ``tree``, ``cycle`` (its own ancestor) or ``below_cycle``.  tree: root is the last ancestor (a parent
    without a row counts as one), depth the steps to it, path the names from root to node.  cycle: root is the
    least name on the cycle, depth 0, path the own name.  below_cycle: depth and path from the first cycle node.
    descendants counts the different other nodes with a row below (on a cycle: the others on it and below).
    Rows of one node count once; of several parents the greatest counts; a null node is no node, a null parent
    makes a root.

    Rounds of raking (leaves fold into their parents) and compression (a node with one child hands it to its own
    parent; an independent set by hashed rank, so a third of every chain goes at once) contract all trees to their
    roots in a number of rounds logarithmic in the nodes.  What can't be contracted is a self-loop for each cycle.
    The recorded contractions are then undone in reverse.  In each round nodes get messages from their children, then
    from their squeezed parent: two aggregations, combined before the shuffle (a parent with very many children is
    cheap), and one written table.
    """
    own = links.select(F.col(node).alias("v"), F.col(parent).alias("p")).where(F.col("v").isNotNull()).groupBy("v").agg(F.max("p").alias("p"))
    kind = own.schema["v"].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    seen = own.select("v", "p", F.lit(1).alias("mine"), F.lit(0).alias("child")).unionByName(
        own.where(F.col("p").isNotNull()).select(F.col("p").alias("v"), none(kind).alias("p"), F.lit(0).alias("mine"), F.lit(1).alias("child"))
    )
    core = seen.groupBy("v").agg(F.max("p").alias("p"), F.max("mine").cast("bigint").alias("acc"), F.sum("child").alias("n"))
    core = core.withColumns({"w": F.lit(0).cast("bigint"), "segs": F.array().cast(f"array<{kind}>"), "row": F.col("acc") == 1, "turn": F.lit(0)})
    moving = F.col("p").isNotNull() & (F.col("p") != F.col("v"))
    leaf = F.coalesce(moving & (F.col("n") == 0), F.lit(False))
    core, moves, most = _written(core, moving)

    log: list[tuple[DataFrame, int]] = []
    state = ("p", "acc", "w", "segs", "row", "turn")
    while moves:
        up = core.where(F.col("p").isNotNull()).select(
            F.col("p").alias("v"), F.when(leaf, F.col("acc") + F.col("w")).alias("add"), F.when(~leaf, F.col("v")).alias("only"), F.when(~leaf, 1).alias("m")
        )
        told = core.where(~leaf).select("v", F.struct(*state).alias("s")).unionByName(up, allowMissingColumns=True).groupBy("v").agg(
            F.first("s", ignorenulls=True).alias("s"), F.coalesce(F.sum("add"), F.lit(0)).alias("add"), F.min("only").alias("only"), F.count("m").alias("n")
        )
        kept = told.select("v", *(F.col(f"s.{c}").alias(c) for c in state), "add", "only", "n").withColumn("acc", F.col("acc") + F.col("add"))
        mine = _rank("v")
        # a node that leaves fold into now is squeezed later, so that what a round removes hangs on what it leaves
        go = F.coalesce(moving & (F.col("n") == 1) & (F.col("add") == 0) & (mine > _rank("p")) & (mine > _rank("only")), F.lit(False))
        kept = kept.withColumn("go", go)
        down = kept.where("go").select(F.col("only").alias("v"), F.struct("v", "p", "acc", "w", "segs", "row").alias("g"))
        met = kept.where("not go").select("v", F.struct(*state, "n").alias("s")).unionByName(down, allowMissingColumns=True).groupBy("v").agg(
            F.first("s", ignorenulls=True).alias("s"), F.first("g", ignorenulls=True).alias("g")
        )
        # what each squeezed node needs to come back: its edge to the parent, and the child's edge to it
        moved = F.col("g").isNotNull()
        stay = met.select(
            "v",
            F.when(moved, F.col("g.p")).otherwise(F.col("s.p")).alias("p"),
            F.col("s.acc").alias("acc"),
            (F.col("s.w") + F.when(moved, F.col("g.acc") + F.col("g.w")).otherwise(0)).alias("w"),
            F.when(moved, F.concat("g.segs", F.array("g.v"), "s.segs")).otherwise(F.col("s.segs")).alias("segs"),
            F.col("s.row").alias("row"), (F.col("s.turn") + 1).alias("turn"), F.col("s.n").alias("n"), "g", F.col("s.w").alias("cw"),
        )
        raked = core.where(leaf).select("v", "p", F.col("v").alias("c"), "acc", F.lit(0).cast("bigint").alias("cw"), "segs", "row")
        whole, moves, n = _written(stay, moving)
        squeezed = whole.where(moved).select(F.col("g.v").alias("v"), F.col("g.p").alias("p"), F.col("v").alias("c"), F.col("g.acc").alias("acc"), "cw", F.col("g.segs").alias("segs"), F.col("g.row").alias("row"))
        log.append((raked.unionByName(squeezed), most))
        core, most = whole.drop("g", "cw"), n

    loop = F.col("p").isNotNull()
    done = core.select(
        "v",
        F.when(loop, F.array_min(F.concat("segs", F.array("v")))).otherwise(F.col("v")).alias("root"),
        F.lit(0).alias("depth"),
        F.when(loop, "cycle").otherwise("tree").alias("state"),
        F.col("v").alias("path"),
        (F.col("acc") + F.when(loop, F.col("w")).otherwise(0)).alias("total"),
        "row",
    )

    def below(total: Column, cyclic: Column) -> list[Column]:
        way = F.array_join(F.concat(F.array("a_path"), "segs", F.array("v")), SEPARATOR)
        return [
            F.col("v"),
            F.col("a_root").alias("root"),
            F.when(cyclic, 0).otherwise(F.col("a_depth") + F.size("segs") + 1).alias("depth"),
            F.when(cyclic, "cycle").when(F.col("a_state") == "tree", "tree").otherwise("below_cycle").alias("state"),
            F.when(cyclic, F.col("v")).otherwise(way).alias("path"),
            F.when(cyclic, F.col("a_total")).otherwise(total).alias("total"),
            F.col("row"),
        ]

    for removed, most in reversed(log):
        above = done.select(F.col("v").alias("p"), *(F.col(c).alias(f"a_{c}") for c in ("root", "depth", "state", "path", "total")))
        under = done.select(F.col("v").alias("c"), F.col("state").alias("c_state"), F.col("total").alias("c_total"))
        known = removed.hint("merge").join(under, "c", "left")  # a leaf stands for its own child, which is not there yet
        # the children of a hub are dealt over several tasks
        met = hot_join(known, above, ["p"], total=known.count(), least_hot=hub) if most > hub else known.hint("merge").join(above, "p")
        cyclic = F.coalesce(F.col("c_state") == "cycle", F.lit(False))
        done = cut(done.unionByName(met.select(*below(F.col("acc") + F.col("cw") + F.coalesce("c_total", F.lit(0)), cyclic))))
    return done.where("row").select(
        F.col("v").alias("node"), "root", "depth", "state", "path", (F.col("total") - 1).cast("int").alias("descendants")
    )
