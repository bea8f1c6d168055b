"""Where code comes from: shallow rules and a bounded fixpoint over the call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import first_parameter, own_slots
from factloom.operators.graph import resolves_to, sole_callees
from factloom.operators.views import OWNER_PREDICATES, call_edges, facts, is_reserved, latest_of, subject_classes
from factloom.session import cut

#: Size of a thunk, depth of the rules, share of library callees, slots of a method, length of a chain of thunks.
THUNK_BYTES, ROUNDS, DOMINANCE, OWN_SLOTS, IMPORT_HOPS = 32, 5, 0.8, 2, 3

NEEDED = ("calls", "imports", "size_bytes", "decompiles_to", "has_name", *OWNER_PREDICATES)


def thunks(obs: DataFrame) -> DataFrame:
    """(src, dst): small functions with one callee."""
    size = latest_of(obs, "size_bytes", "size").select(F.col("subject").alias("src"), F.trim("size").try_cast("bigint").alias("size"))
    return sole_callees(call_edges(obs)).join(size, "src").where(F.col("size") <= THUNK_BYTES).select("src", "dst")


def shallow(obs: DataFrame) -> DataFrame:
    """(subject, verdict): what a subject's own facts say; null if nothing."""
    imports = facts(obs, "imports").select(F.col("subject").alias("node")).distinct()
    forwarding = resolves_to(thunks(obs), imports, IMPORT_HOPS).select(F.col("node").alias("dst"))
    near_import = call_edges(obs).join(forwarding, "dst", "left_semi").select(F.col("src").alias("subject"), F.lit(True).alias("near")).distinct()
    body = latest_of(obs, "decompiles_to", "body")
    slots = body.select("subject", own_slots(F.col("body"), first_parameter(F.col("body"))).alias("slots"))
    wide = subject_classes(obs).join(near_import, "subject", "left").join(slots, "subject", "left")
    verdict = (
        F.when(F.col("class") == "LIBRARY_OR_COMPILER", "LIBRARY_OR_RUNTIME")
        .when(F.col("owner").isNotNull() & ~is_reserved(F.col("owner")), "APPLICATION")
        .when((F.col("slots") >= OWN_SLOTS) & F.col("near"), "APPLICATION")
    )
    return wide.select("subject", verdict.alias("verdict"))


def provenance(obs: DataFrame) -> DataFrame:
    """(subject, provenance): APPLICATION, LIBRARY_OR_RUNTIME or UNKNOWN of every subject.

    Round 0 applies the shallow rules; each of five rounds lets a thunk take its target's verdict, a function whose
    callees are library code to four fifths become library code, and one that calls shallow application code
    become application code.  All functions of a round are judged by the verdicts of the round before, so that
    diamonds and cycles don't matter.  The facts that the rules read are written once, so that obs is scanned twice.
    """
    names = obs.select("subject").where("subject is not null").distinct()
    read = facts(obs, *NEEDED).select("subject", "predicate", "value", "id")
    obs = cut(read.unionByName(names, allowMissingColumns=True))
    edges = cut(call_edges(obs))
    thin = cut(thunks(obs))
    base = cut(shallow(obs))
    state = base.withColumn("first", F.col("verdict"))
    called = cut(edges.join(base.select(F.col("subject").alias("dst"), F.col("verdict").alias("own")), "dst", "left"))
    for _ in range(ROUNDS):
        now = state.select(F.col("subject").alias("dst"), F.col("verdict").alias("v"))
        mixed = called.hint("merge").join(now, "dst", "left").groupBy(F.col("src").alias("subject")).agg(
            F.avg(F.when(F.col("v") == "LIBRARY_OR_RUNTIME", 1.0).otherwise(0.0)).alias("share"), F.max(F.coalesce(F.col("own") == "APPLICATION", F.lit(False))).alias("direct")
        )
        through = thin.hint("merge").join(now, "dst").select(F.col("src").alias("subject"), F.col("v").alias("target"))
        judged = state.hint("merge").join(mixed, "subject", "left").hint("merge").join(through, "subject", "left")
        verdict = F.coalesce("first", "target", "verdict", F.when(F.col("share") >= DOMINANCE, "LIBRARY_OR_RUNTIME").when(F.col("direct"), "APPLICATION"))
        state = cut(judged.select("subject", verdict.alias("verdict"), "first"))
    return state.select("subject", F.coalesce("verdict", F.lit("UNKNOWN")).alias("provenance"))
