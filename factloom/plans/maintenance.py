"""Changes of the evidence graph, contexts of its tasks, and tables of symbols; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions.names import NOTHING_KNOWN, canonical_address, canonical_class, says_something, squeeze
from factloom.operators import updates as U
from factloom.operators import views as V
from factloom.operators.hierarchy import hierarchies
from factloom.operators.packed import split_values
from factloom.operators.provenance import provenance, thunks
from factloom.plans import oracles as O
from factloom.plans.reference import _functions, _scored, _slots, f8_substantive_bodies, g17_dispositions, j2_seeds, t11_calls_in_order
from factloom.session import cut, table

FUNCTION_FACTS = ("has_name", "has_signature", "calling_convention", "size_bytes")
NEIGHBOURS, HINTS, HINT_STEPS = 5, 6, 3
# Functions of the C runtime that bodies call by name, and imports with a known alias.
CRT_CALLS = ("_initterm", "_ismbblead")
IMPORT_ALIASES = {"std!cout": "std::cout"}


def m2_supersede(spark: SparkSession, sf: str) -> DataFrame:
    """Active facts of a function that a newer active one of the same subject and predicate supersedes."""
    obs = V.observations(spark, sf, once=True).where(F.col("predicate").isin(*FUNCTION_FACTS))
    newest = obs.where("status = 'ACTIVE'").groupBy("subject", "predicate").agg(F.max("id").alias("new"))
    pairs = obs.where("status = 'ACTIVE'").join(newest, ["subject", "predicate"]).where("id < new").select(F.col("id").alias("old"), "new")
    before = obs.select("id", F.col("status").alias("old_status"), F.col("superseded_by").alias("old_by"))
    return U.superseded(obs, pairs).join(before, "id").where("status <> old_status").select("id", "status", "superseded_by")


def m3_retract(spark: SparkSession, sf: str) -> DataFrame:
    """Observations by predicate and status after those that say nothing were retracted."""
    obs = V.observations(spark, sf, once=True)
    after = U.retracted(obs, obs.where(~says_something(F.col("value"))).select("id"))
    return after.groupBy("predicate", "status").agg(F.count("*").alias("n"))


def m4_valid_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence whose observation exists."""
    rows = table(spark, sf, "evidence").select("id", "observation_id").distinct()
    return U.valid_evidence(rows, table(spark, sf, "observations")).select("id", "observation_id")


def m5_attach(spark: SparkSession, sf: str) -> DataFrame:
    """Supporting evidence of each hypothesis after that of the investigation which created it is attached."""
    evidence = table(spark, sf, "evidence").select("id").distinct()
    listed = split_values(table(spark, sf, "hypotheses"), ["id"], "supporting_evidence", evidence).select("id", F.col("value").alias("evidence_id"))
    made = table(spark, sf, "investigations").dropDuplicates(["id"]).select(F.col("id").alias("created_by"), F.explode("evidence_created").alias("evidence_id"))
    links = V.hypotheses(spark, sf).select("id", "created_by").join(made, "created_by").select("id", "evidence_id")
    return U.attached(listed, links, evidence).groupBy("id").agg(F.count("*").alias("n_evidence"))


def m9_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Contested hypotheses of which nothing is cited for and something against are rejected as insufficient."""
    hyp, evidence = V.hypotheses(spark, sf), table(spark, sf, "evidence")
    cites = lambda f: split_values(table(spark, sf, "hypotheses"), ["id"], f, evidence).select("id").distinct()
    weak = hyp.where("status = 'CONTESTED'").join(cites("supporting_evidence"), "id", "left_anti").join(cites("contradicting_evidence"), "id", "left_semi")
    after = U.rejected(hyp, weak.select("id", F.lit("INSUFFICIENT_EVIDENCE").alias("kind")))
    return after.groupBy("status", F.col("rejection_reason.kind").alias("kind")).agg(F.count("*").alias("n"))


def m13_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """Dependencies of which both hypotheses exist."""
    return U.valid_dependencies(V.dependencies(spark, sf), table(spark, sf, "hypotheses"))


def m21_reconsidered(spark: SparkSession, sf: str) -> DataFrame:
    """Roles rejected since their subject wasn't application code, which it is now; each turns stale."""
    obs = V.observations(spark, sf)
    return U.reconsidered(V.hypotheses(spark, sf), obs, provenance(obs)).select(F.col("id").alias("hypothesis_id"), "subject", "text", "superseded")


def j6_premise_links(spark: SparkSession, sf: str) -> DataFrame:
    """Active gate rejections with the newest active revision of a premise of the same subject."""
    return U.premise_links(V.observations(spark, sf))


def j7_gate_rejections(spark: SparkSession, sf: str) -> DataFrame:
    """Roles whose rejection by the provenance gate an active observation records word for word."""
    return U.gate_rejections(V.hypotheses(spark, sf), V.observations(spark, sf)).select(F.col("id").alias("hypothesis_id"), "observation_id")


def _resolved(spark: SparkSession, sf: str, field: str) -> DataFrame:
    """(hypothesis_id, pos, evidence_id, observation_id, predicate, value) of the evidence cited in a field; dangling ids fall away."""
    ev = table(spark, sf, "evidence")
    cited = split_values(table(spark, sf, "hypotheses"), ["id"], field, ev).select(F.col("id").alias("hypothesis_id"), "pos", F.col("value").alias("evidence_id"))
    held = ev.select(F.col("id").alias("evidence_id"), "observation_id").dropDuplicates(["evidence_id"])
    obs = V.observations(spark, sf, once=True).select(F.col("id").alias("observation_id"), "predicate", "value")
    return cited.join(held, "evidence_id").join(obs, "observation_id")


def c1_analyze_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What an analysis of each subject with hypotheses is told, row by row: its facts, its hypotheses, and what speaks against those in doubt."""
    hyp = V.hypotheses(spark, sf)
    facts = V.observations(spark, sf, once=True).where("predicate <> 'agent_flagged_contradiction'").join(hyp.select("subject").distinct(), "subject", "left_semi")
    doubt = hyp.where("status in ('REJECTED', 'CONTESTED')").select("subject", F.col("id").alias("hypothesis_id"))
    against = _resolved(spark, sf, "contradicting_evidence").join(doubt, "hypothesis_id")
    part = lambda df, name, owner, item: df.select("subject", F.lit(name).alias("part"), owner.alias("owner_id"), F.col(item).alias("item_id"), "value")
    none = F.lit(None).cast("bigint")
    return part(facts, "fact", none, "id").unionByName(part(hyp, "hypothesis", none, "id")).unionByName(part(against, "against", F.col("hypothesis_id"), "evidence_id")).distinct()


def c2_challenge_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What a challenge of each open hypothesis is told: the active facts of its subject and the evidence that supports it."""
    hyp = V.hypotheses(spark, sf).where("status in ('PROPOSED', 'INVESTIGATING', 'SUPPORTED', 'STALE')").select("subject", F.col("id").alias("hypothesis_id"))
    live = V.observations(spark, sf, once=True).where("status = 'ACTIVE' and predicate <> 'agent_flagged_contradiction'")
    facts = hyp.join(live, "subject").select("hypothesis_id", F.lit("fact").alias("part"), F.col("id").alias("item_id"), "predicate")
    support = _resolved(spark, sf, "supporting_evidence").join(hyp, "hypothesis_id", "left_semi")
    return facts.unionByName(support.select("hypothesis_id", F.lit("support").alias("part"), F.col("evidence_id").alias("item_id"), "predicate")).distinct()


def c3_resolve_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What the resolution of each contested hypothesis is told: the evidence for and against it, in the order it is cited."""
    contested = V.hypotheses(spark, sf).where("status = 'CONTESTED'").select(F.col("id").alias("hypothesis_id"))
    side = lambda f, name: _resolved(spark, sf, f).join(contested, "hypothesis_id", "left_semi").select("hypothesis_id", F.lit(name).alias("side"), "pos", "evidence_id", "observation_id")
    return side("supporting_evidence", "for").unionByName(side("contradicting_evidence", "against"))


def f26_mechanics(spark: SparkSession, sf: str) -> DataFrame:
    """The latest mechanical description of each subject, of any status."""
    rows = V.latest(V.hypotheses(spark, sf).where("predicate = 'mechanical_behavior'"), "subject")
    return rows.select("subject", F.col("value").alias("mechanics"))


def f29_import_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Imports, and the name by which a program may use them where one is known."""
    rows = V.latest(V.facts(V.observations(spark, sf), "imports"), "subject")
    alias = F.create_map(*(F.lit(x) for kv in IMPORT_ALIASES.items() for x in kv))
    return rows.select("subject", F.col("value").alias("import"), F.try_element_at(alias, F.col("value")).alias("alias"))


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    """(subject, fact_id): the newest substantive body of each function, else the newest, whatever the program."""
    best = F.max(F.struct(F.col("substantive").alias("good"), "fact_id"))
    return f8_substantive_bodies(spark, sf).groupBy("subject").agg(best.alias("b")).select("subject", F.col("b.fact_id").alias("fact_id"))


def j10_call_context(spark: SparkSession, sf: str) -> DataFrame:
    """The calls within five places of the first call of each function in each caller's body, with what is known of them."""
    own = cut(_bodies(spark, sf).select(F.col("subject").alias("caller"), "fact_id"))
    order = cut(t11_calls_in_order(spark, sf).join(own, "fact_id").select("caller", "pos", "callee"))
    ff = _functions(spark, sf).where("subject is not null")
    stated = ff.select("subject", F.explode("callers").alias("c")).select("subject", canonical_address(F.col("c")).alias("caller"))
    seen = V.facts(V.observations(spark, sf), "called_by").select("subject", canonical_address(F.col("value")).alias("caller"))
    first = order.groupBy("caller", F.col("callee").alias("subject")).agg(F.min("pos").alias("at"))
    at = stated.unionByName(seen).where("caller is not null").distinct().join(first, ["caller", "subject"])
    # a place is met from each of the ten places around it: an equi-join on the place, not a join of ranges
    steps = F.array(*(F.lit(d) for d in range(-NEIGHBOURS, NEIGHBOURS + 1) if d))
    near = at.select("subject", "caller", "at", F.explode(steps).alias("d")).withColumn("pos", F.col("at") + F.col("d")).join(order, ["caller", "pos"])
    hyp = V.hypotheses(spark, sf).where("status = 'ACCEPTED'")
    said = lambda p: V.latest(hyp.where(F.col("predicate") == p), "subject").select(F.col("subject").alias("address"), F.concat(F.lit(f"{p}: "), "value").alias(p))
    names = V.latest_of(V.observations(spark, sf), "has_name", "name").where("not startswith(name, 'FUN_')").withColumnRenamed("subject", "address")
    wide = near.withColumnRenamed("callee", "address").join(said("semantic_role"), "address", "left").join(said("mechanical_behavior"), "address", "left").join(names, "address", "left")
    wide = wide.join(f26_mechanics(spark, sf).withColumnRenamed("subject", "address"), "address", "left")
    side = F.when(F.col("d") < 0, "before").otherwise("after")
    return wide.select("subject", "caller", side.alias("side"), F.abs("d").alias("distance"), "address", F.coalesce("semantic_role", "mechanical_behavior", "name").alias("label"), "mechanics")


def k8_hints(spark: SparkSession, sf: str) -> DataFrame:
    """The six nearest real names within three calls of each function, by steps and name; its own name is none.

    Names travel backwards along the calls, and each function keeps no more than it can need, so that hubs don't
    multiply: the nearest names of a union are among the nearest of its parts.
    """
    obs = V.observations(spark, sf)
    edges = cut(V.call_edges(obs))
    names = cut(V.latest_of(obs, "has_name", "name").where("not startswith(name, 'FUN_')"))
    known = names.select(F.col("subject").alias("dst"), "name", F.lit(0).alias("depth"))
    mine = names.select(F.col("subject").alias("src"), F.col("name").alias("own"))
    order = W.partitionBy("src").orderBy("depth", "name")
    for _ in range(HINT_STEPS):
        told = edges.join(known, "dst").groupBy("src", "name").agg((F.min("depth") + 1).alias("depth"))
        kept = cut(told.withColumn("k", F.row_number().over(order)).where(F.col("k") <= HINTS + 1).drop("k"))
        near = kept.select(F.col("src").alias("dst"), "name", "depth").unionByName(names.select(F.col("subject").alias("dst"), "name", F.lit(0).alias("depth")))
        known = near.groupBy("dst", "name").agg(F.min("depth").alias("depth"))
    top = kept.join(mine, "src", "left").where("own is null or own <> name").withColumn("place", F.row_number().over(order)).where(F.col("place") <= HINTS)
    return top.select(F.col("src").alias("subject"), "place", "name", "depth")


def k2_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Open tasks that no investigation has taken up yet, with the score they are enqueued at."""
    done = table(spark, sf, "investigations").select("task", F.coalesce(canonical_address(F.col("target")), F.col("target")).alias("target")).distinct()
    return _scored(spark, sf).join(done, ["task", "target"], "left_anti").select("task", "target", "score")


def k6_seed_subjects(spark: SparkSession, sf: str) -> DataFrame:
    """The subjects to begin with, once each, numbered in their lexical order."""
    return V.numbered(j2_seeds(spark, sf).select("subject").distinct(), ["subject"], 0).select("subject", F.col("new_id").alias("place"))


def g11_return_types(spark: SparkSession, sf: str) -> DataFrame:
    """Functions of no committed return type whose last statement before a bare return is a call, with the type at the end of the chain of such calls.

    Chains are trees of callers, contracted by operators.hierarchy.  Functions whose chain ends in a loop, in an unknown
    function or in one of no committed type get none.
    """
    parts = r"^(.*?[ *])([A-Za-z_~][\w:~]*)\("
    last = F.max(F.struct("extracted_at", "fact_id", "signature", "decompilation")).alias("f")
    ff = _functions(spark, sf).where("subject is not null").groupBy("subject").agg(last).select("subject", "f.signature", "f.decompilation")
    typed = cut(ff.select("subject", F.trim(F.regexp_extract(squeeze(F.col("signature")), parts, 1)).alias("type"), F.regexp_extract("decompilation", r"FUN_([0-9A-Fa-f]+)\([^;{}]*\);\s*return;\s*\}\s*$", 1).alias("h")))
    open_ = typed.where("type = 'undefined' and h <> ''").select("subject", F.concat(F.lit("0x"), F.lower("h")).alias("target"))
    chains = hierarchies(open_, "subject", "target").where("state = 'tree'").select(F.col("node").alias("subject"), F.col("root").alias("target"))
    ends = typed.where("type not in ('', 'undefined')").select(F.col("subject").alias("target"), F.col("type").alias("return_type"))
    return chains.join(ends, "target").select("subject", "target", "return_type")


def k11_header_order(spark: SparkSession, sf: str) -> DataFrame:
    """The level at which each class's header can be emitted: after its base's; null for classes on or below a loop, which come last."""
    links = table(spark, sf, "recovered_classes").select(canonical_class(F.col("name")).alias("name"), canonical_class(F.col("base")).alias("base"))
    return hierarchies(links, "name", "base").select(F.col("node").alias("class_name"), F.when(F.col("state") == "tree", F.col("depth")).alias("level"))


def g18_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    """What is known of each called function: origin, disposition, size, sole callee, and its callers by whether they are recovered."""
    obs = V.observations(spark, sf)
    edges = cut(V.call_edges(obs))
    recovered = _recovered(spark, sf).withColumnRenamed("address", "src").withColumn("has", F.lit(True))
    callers = edges.join(recovered, "src", "left").groupBy(F.col("dst").alias("subject")).agg(F.count("has").alias("n_recovered_callers"), F.count(F.when(F.col("has").isNull(), 1)).alias("n_other_callers"))
    size = V.latest_of(obs, "size_bytes", "size").select("subject", F.trim("size").try_cast("bigint").alias("body_size"))
    sole = edges.groupBy(F.col("src").alias("subject")).agg(F.min("dst").alias("sole_callee"), F.count("*").alias("n")).where("n = 1").drop("n")
    wide = g17_dispositions(spark, sf).join(callers, "subject")
    for side in (size, sole):
        wide = wide.join(side, "subject", "left")
    return wide.select("subject", "disposition", "body_size", "sole_callee", "n_recovered_callers", "n_other_callers")


def _recovered(spark: SparkSession, sf: str) -> DataFrame:
    """(address): the methods of recovered classes."""
    return _slots(spark, sf).where("address is not null").select("address").distinct()


def a15_method_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Methods of a class, other than constructors and destructors, with the same name and parameters at several addresses, made distinct by their address."""
    rows = _functions(spark, sf).where("name is not null and subject is not null and owner_class is not null and not coalesce(is_constructor, false) and not coalesce(is_destructor, false)").select(
        canonical_class(F.col("owner_class")).alias("class_name"), "name", F.coalesce(F.regexp_extract("signature", r"\((.*)\)", 1), F.lit("")).alias("params"), "subject"
    ).where("class_name is not null").distinct()
    often = rows.groupBy("class_name", "name", "params").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(often, ["class_name", "name", "params"]).select("class_name", "subject", "name", "n", F.concat_ws("_", "name", F.substring("subject", 3, 16)).alias("distinct_name"))


def a16_class_methods(spark: SparkSession, sf: str) -> DataFrame:
    """Methods of each class by kind, and its destructor with the least address."""
    rows = _functions(spark, sf).where("subject is not null").select(
        canonical_class(F.col("owner_class")).alias("class_name"), "subject", F.coalesce("is_constructor", F.lit(False)).alias("c"), F.coalesce("is_destructor", F.lit(False)).alias("d")
    ).where("class_name is not null")
    each = rows.groupBy("class_name", "subject").agg(F.bool_or("c").alias("c"), F.bool_or("d").alias("d"))
    return each.groupBy("class_name").agg(
        F.count(F.when(~F.col("c") & ~F.col("d"), 1)).alias("n_methods"), F.count(F.when(F.col("c"), 1)).alias("n_constructors"), F.min(F.when(F.col("d"), F.col("subject"))).alias("destructor")
    )


def _methods(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "recovered_classes").select(canonical_class(F.col("name")).alias("class_name"), F.explode("methods").alias("m"))
    return rows.where("class_name is not null").select("class_name", canonical_address(F.col("m.address")).alias("address"), F.col("m.raw_name").alias("raw_name"), F.col("m.display_name").alias("display_name"))


def a19_trampolines(spark: SparkSession, sf: str) -> DataFrame:
    """Trampolines to virtual methods, one per name, to the least address of those that share it."""
    rows = _methods(spark, sf).where("display_name is not null and address is not null")
    name = F.concat("class_name", F.lit("__vtable_trampoline_"), "display_name")
    return rows.groupBy(name.alias("trampoline")).agg(F.min("address").alias("address"), F.countDistinct("address").alias("n_targets"))


def j15_symbol_table(spark: SparkSession, sf: str) -> DataFrame:
    """The name of each recovered address: a function's own, else that of a class's method."""
    methods = _methods(spark, sf).where("address is not null and display_name is not null").groupBy("address").agg(F.min(F.concat("class_name", F.lit("::"), "display_name")).alias("m"))
    functions = _functions(spark, sf).where("subject is not null and name is not null").groupBy(F.col("subject").alias("address")).agg(F.max_by("name", "fact_id").alias("f"))
    wide = methods.join(functions, "address", "full")
    return wide.select("address", F.coalesce("f", "m").alias("symbol"), F.when(F.col("f").isNotNull(), "function").otherwise("method").alias("kind"))


def j16_thunk_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """The symbol table with thunks under the name of what they forward to."""
    symbols = cut(j15_symbol_table(spark, sf))
    names = symbols.select(F.col("address").alias("dst"), F.col("symbol").alias("target_symbol"))
    forwarded = thunks(V.observations(spark, sf)).join(names, "dst").select(F.col("src").alias("address"), "target_symbol")
    wide = symbols.join(forwarded, "address", "full")
    return wide.select("address", F.coalesce("target_symbol", "symbol").alias("symbol"), F.when(F.col("target_symbol").isNotNull(), "thunk").otherwise(F.col("kind")).alias("kind"))


def j17_named_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Methods that bodies call by either of their names, and in how many functions."""
    alias = _methods(spark, sf).where("address is not null").select("address", F.explode(F.array("raw_name", "display_name")).alias("name")).where("name is not null").distinct()
    calls = _functions(spark, sf).select("fact_id", F.explode(F.array_distinct(F.regexp_extract_all("decompilation", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), 1))).alias("name"))
    return calls.join(alias, "name").groupBy("address").agg(F.countDistinct("fact_id").alias("n_functions"))


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _functions(spark, sf).where("decompilation is not null").select("fact_id", F.explode(F.array_distinct(F.split("decompilation", "[^A-Za-z0-9_]+"))).alias("token")).where("token <> ''")


def t6_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of the bodies, and in how many functions they stand."""
    return _tokens(spark, sf).groupBy("token").agg(F.count("*").alias("n_functions"))


def t7_data_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Generated names of data and labels in the bodies, and in how many functions they stand."""
    return _tokens(spark, sf).where(F.col("token").rlike("^(DAT_|PTR_|_refptr_|LAB_)")).groupBy("token").agg(F.count("*").alias("n_functions"))


def t9_crt_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Functions whose body names one of the undeclared functions of the C runtime."""
    return _tokens(spark, sf).where(F.col("token").isin(*CRT_CALLS)).select("fact_id", F.col("token").alias("crt_function"))


def t24_parameter_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the parameters of each signature in their order: the last word of each part between top-level commas."""
    inside = F.trim(F.regexp_extract("signature", r"\((.*)\)", 1))
    rows = _functions(spark, sf).where("signature is not null").select("fact_id", F.posexplode(T.top_level(F.when(inside != "void", inside).otherwise(""))).alias("pos", "p"))
    return rows.select("fact_id", "pos", F.regexp_extract("p", r"([^ *]+)[ *]*$", 1).alias("parameter")).where("parameter <> ''")


def t39_this_owners(spark: SparkSession, sf: str) -> DataFrame:
    """The class of the receiver that a signature names ``this``."""
    owner = F.regexp_extract("signature", r"\(\s*([A-Za-z_]\w*)\s*\*\s*this(?![A-Za-z0-9_])", 1)
    return _functions(spark, sf).select("fact_id", owner.alias("owner")).where("owner <> ''")


QUERIES = {
    f.__name__: f
    for f in (
        m2_supersede, m3_retract, m4_valid_evidence, m5_attach, m9_rejected, m13_dependencies, m21_reconsidered, j6_premise_links, j7_gate_rejections, c1_analyze_rows, c2_challenge_rows,
        c3_resolve_rows, f26_mechanics, f29_import_aliases, j10_call_context, k8_hints, k2_queue, k6_seed_subjects, g11_return_types, k11_header_order, g18_diagnosis, a15_method_collisions, a16_class_methods,
        a19_trampolines, j15_symbol_table, j16_thunk_symbols, j17_named_calls, t6_identifiers, t7_data_symbols, t9_crt_calls, t24_parameter_names, t39_this_owners,
    )
}

_w = O._with
_SAYS = f"coalesce({O.squeeze('value')} <> '' AND lower({O.squeeze('value')}) NOT IN ({O.quoted(NOTHING_KNOWN)}), false)"
_EV = "ev AS (SELECT id, min(observation_id) AS observation_id FROM evidence GROUP BY 1)"
_SIDE = lambda f: f"(SELECT c.id AS hypothesis_id, c.pos::INT AS pos, c.n AS evidence_id, ev.observation_id, o.predicate, o.value FROM {O.CITED(f)} c JOIN ev ON ev.id = c.n JOIN obs o ON o.id = ev.observation_id)"
_GATE = """gate AS (SELECT h.id, max(o.id) AS o FROM hyp h JOIN obs o ON o.subject = h.subject AND o.predicate = 'provenance_gate_rejected' AND o.status = 'ACTIVE' AND h.predicate = 'semantic_role'
  AND o.value = 'semantic_role ''' || h.value || ''' rejected: subject''s provenance is not Application' GROUP BY 1)"""
_LINKS = """links AS (SELECT DISTINCT a.id AS old, b.new FROM obs a JOIN (SELECT subject, max(id) AS new FROM obs WHERE predicate = 'rejection_premise_invalidated' AND status = 'ACTIVE' GROUP BY 1) b USING (subject)
  WHERE a.predicate = 'provenance_gate_rejected' AND a.status = 'ACTIVE')"""
_METHODS = f"ms AS (SELECT class_name, {O.address('m.address')} AS address, m.raw_name AS raw_name, m.display_name AS display_name FROM (SELECT class_name, unnest(methods) AS m FROM rc WHERE class_name IS NOT NULL))"
_SYMBOLS = """symbols AS (SELECT address, coalesce(f, m) AS symbol, CASE WHEN f IS NOT NULL THEN 'function' ELSE 'method' END AS kind FROM
  (SELECT address, min(class_name || '::' || display_name) AS m FROM ms WHERE address IS NOT NULL AND display_name IS NOT NULL GROUP BY 1)
  FULL JOIN (SELECT subject AS address, arg_max(name, fact_id) AS f FROM ff WHERE subject IS NOT NULL AND name IS NOT NULL GROUP BY 1) USING (address))"""
_OWNED = O.class_cte("(SELECT owner_class, subject, name, signature, coalesce(is_constructor, false) AS c, coalesce(is_destructor, false) AS d FROM ff WHERE subject IS NOT NULL)", {"class_name": "owner_class"}, ", subject, name, signature, c, d", name="oc")
_TOKENS = "(SELECT fact_id, unnest(list_distinct(regexp_split_to_array(decompilation, '[^A-Za-z0-9_]+'))) AS token FROM function_facts WHERE decompilation IS NOT NULL)"
_ORDER = """picked AS (SELECT subject, arg_max(fact_id, {'g': substantive, 'f': fact_id}) AS fact_id FROM (SELECT subject, program, bool_or(NOT degenerate) AS substantive,
  arg_max(fact_id, {'g': NOT degenerate, 'e': coalesce(extracted_at, TIMESTAMP '0001-01-01'), 'f': fact_id}) AS fact_id FROM judged GROUP BY 1, 2) GROUP BY 1)"""
_CALL_ORDER = "ord AS (SELECT p.subject AS caller, (generate_subscripts(l, 1) - 1)::INT AS pos, '0x' || lower(unnest(l)) AS callee FROM (SELECT fact_id, regexp_extract_all(decompilation, 'FUN_([0-9A-Fa-f]+)', 1) AS l FROM function_facts) b JOIN picked p USING (fact_id))"
_LAST_WORD = r"regexp_extract(p, '([^ *]+)[ *]*$', 1)"
ORACLES = {
    "m2_supersede": _w(O.OBS) + f"""SELECT id, 'SUPERSEDED' AS status, new AS superseded_by FROM obs JOIN (SELECT subject, predicate, max(id) AS new FROM obs WHERE status = 'ACTIVE' AND predicate IN ({O.quoted(FUNCTION_FACTS)}) GROUP BY 1, 2) USING (subject, predicate) WHERE status = 'ACTIVE' AND id < new""",
    "m3_retract": _w(O.OBS) + f"SELECT predicate, CASE WHEN {_SAYS} THEN status ELSE 'RETRACTED' END AS status, count(*) AS n FROM obs GROUP BY 1, 2",
    "m4_valid_evidence": "SELECT DISTINCT id, observation_id FROM evidence WHERE observation_id IN (SELECT id FROM observations)",
    "m5_attach": _w(O.HYP, O.INV) + f"""SELECT id, count(*) AS n_evidence FROM (SELECT id, n FROM {O.CITED('supporting_evidence')} UNION
      SELECT h.id, e FROM hyp h JOIN (SELECT id AS inv, unnest(evidence_created) AS e FROM inv) ON h.created_by = inv WHERE e IN (SELECT id FROM evidence)) GROUP BY 1""",
    "m9_rejected": _w(O.HYP, f"weak AS (SELECT id FROM hyp WHERE status = 'CONTESTED' AND id NOT IN (SELECT id FROM {O.CITED('supporting_evidence')}) AND id IN (SELECT id FROM {O.CITED('contradicting_evidence')}))")
    + "SELECT CASE WHEN w THEN 'REJECTED' ELSE status END AS status, CASE WHEN w THEN 'INSUFFICIENT_EVIDENCE' ELSE rejection_reason.kind END AS kind, count(*) AS n FROM (SELECT *, id IN (SELECT id FROM weak) AS w FROM hyp) GROUP BY 1, 2",
    "m13_dependencies": _w(O.HYP, O.INV, O.DEPS) + "SELECT source, target FROM deps WHERE source IN (SELECT id FROM hyp) AND target IN (SELECT id FROM hyp)",
    "m21_reconsidered": _w(O.OBS, O.CALLS, O.NAMES, O.CLASSES, *O.PROVENANCE, O.HYP, _GATE, _LINKS, recursive=True)
    + """SELECT h.id AS hypothesis_id, h.subject, 'semantic_role ''' || h.value || ''' was rejected when this subject''s provenance wasn''t Application; provenance now classifies as Application, so the rejection''s premise no longer holds -- marked STALE for reevaluation' AS text,
      CASE WHEN g.o NOT IN (SELECT old FROM links) THEN g.o END AS superseded FROM hyp h LEFT JOIN gate g ON g.id = h.id JOIN prov p ON p.subject = h.subject AND p.provenance = 'APPLICATION'
      WHERE h.status = 'REJECTED' AND (h.rejection_reason.kind = 'PROVENANCE_NOT_APPLICATION' OR (h.rejection_reason IS NULL AND g.o IS NOT NULL AND g.o NOT IN (SELECT old FROM links)))""",
    "j6_premise_links": _w(O.OBS, _LINKS) + "SELECT old, new FROM links",
    "j7_gate_rejections": _w(O.OBS, O.HYP, _GATE) + "SELECT id AS hypothesis_id, o AS observation_id FROM gate",
    "c1_analyze_rows": _w(O.OBS, O.HYP, _EV) + f"""SELECT subject, 'fact' AS part, NULL::BIGINT AS owner_id, id AS item_id, value FROM obs WHERE predicate <> 'agent_flagged_contradiction' AND subject IN (SELECT subject FROM hyp)
      UNION SELECT subject, 'hypothesis', NULL, id, value FROM hyp UNION SELECT h.subject, 'against', h.id, s.evidence_id, s.value FROM {_SIDE('contradicting_evidence')} s JOIN hyp h ON h.id = s.hypothesis_id AND h.status IN ('REJECTED', 'CONTESTED')""",
    "c2_challenge_rows": _w(O.OBS, O.HYP, _EV, "op AS (SELECT id, subject FROM hyp WHERE status IN ('PROPOSED', 'INVESTIGATING', 'SUPPORTED', 'STALE'))") + f"""SELECT op.id AS hypothesis_id, 'fact' AS part, o.id AS item_id, o.predicate FROM op JOIN obs o USING (subject) WHERE o.status = 'ACTIVE' AND o.predicate <> 'agent_flagged_contradiction'
      UNION SELECT hypothesis_id, 'support', evidence_id, predicate FROM {_SIDE('supporting_evidence')} WHERE hypothesis_id IN (SELECT id FROM op)""",
    "c3_resolve_rows": _w(O.OBS, O.HYP, _EV) + " UNION ALL ".join(f"SELECT hypothesis_id, '{n}' AS side, pos, evidence_id, observation_id FROM {_SIDE(f)} WHERE hypothesis_id IN (SELECT id FROM hyp WHERE status = 'CONTESTED')" for f, n in (("supporting_evidence", "for"), ("contradicting_evidence", "against"))),
    "f26_mechanics": _w(O.HYP) + "SELECT subject, arg_max(value, id) AS mechanics FROM hyp WHERE predicate = 'mechanical_behavior' AND value IS NOT NULL GROUP BY 1",
    "f29_import_aliases": _w(O.OBS) + "SELECT subject, value AS import, CASE WHEN value = 'std!cout' THEN 'std::cout' END AS alias FROM (SELECT subject, arg_max(value, id) AS value FROM obs WHERE predicate = 'imports' AND value IS NOT NULL GROUP BY 1)",
    "j10_call_context": _w(O.OBS, O.FUNCTIONS, O.BODIES, _ORDER, _CALL_ORDER, O.HYP, O.NAMES,
        f"cb AS (SELECT DISTINCT subject, caller FROM (SELECT subject, {O.address('c')} AS caller FROM (SELECT subject, unnest(callers) AS c FROM ff) UNION ALL SELECT subject, {O.address('value')} FROM obs WHERE predicate = 'called_by') WHERE subject IS NOT NULL AND caller IS NOT NULL)",
        "fst AS (SELECT cb.subject, cb.caller, min(pos) AS a FROM cb JOIN ord ON ord.caller = cb.caller AND ord.callee = cb.subject GROUP BY 1, 2)")
    + """SELECT fst.subject, fst.caller, CASE WHEN pos < a THEN 'before' ELSE 'after' END AS side, abs(pos - a)::INT AS distance, callee AS address, coalesce('semantic_role: ' || r, 'mechanical_behavior: ' || m, CASE WHEN NOT starts_with(name, 'FUN_') THEN name END) AS label, mechanics
      FROM fst JOIN ord ON ord.caller = fst.caller AND pos <> a AND pos BETWEEN a - 5 AND a + 5 LEFT JOIN names ON names.subject = callee
      LEFT JOIN (SELECT subject, arg_max(value, id) AS r FROM hyp WHERE status = 'ACCEPTED' AND predicate = 'semantic_role' AND value IS NOT NULL GROUP BY 1) x ON x.subject = callee
      LEFT JOIN (SELECT subject, arg_max(value, id) AS m FROM hyp WHERE status = 'ACCEPTED' AND predicate = 'mechanical_behavior' AND value IS NOT NULL GROUP BY 1) y ON y.subject = callee
      LEFT JOIN (SELECT subject, arg_max(value, id) AS mechanics FROM hyp WHERE predicate = 'mechanical_behavior' AND value IS NOT NULL GROUP BY 1) z ON z.subject = callee""",
    "k8_hints": _w(O.OBS, O.CALLS, O.NAMES, "w AS (SELECT src AS subject, dst AS node, 1 AS depth FROM calls WHERE src IS NOT NULL UNION SELECT subject, dst, depth + 1 FROM w JOIN calls ON src = node WHERE depth < 3)",
        "nm AS (SELECT w.subject, n.name, min(depth) AS depth FROM w JOIN names n ON n.subject = node LEFT JOIN names o ON o.subject = w.subject WHERE NOT starts_with(n.name, 'FUN_') AND (o.name IS NULL OR o.name <> n.name) GROUP BY 1, 2)", recursive=True)
    + "SELECT subject, place::INT AS place, name, depth::INT AS depth FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY depth, name) AS place FROM nm) WHERE place <= 6",
    "k2_queue": O._SCORED + f"SELECT task, target, score FROM sc WHERE NOT EXISTS (SELECT 1 FROM investigations i WHERE i.task = sc.task AND coalesce({O.address('i.target')}, i.target) = sc.target)",
    "k6_seed_subjects": _w(O.OBS, O.HYP, O.NAMES, O.OWNERS, O.NOISE) + "SELECT subject, row_number() OVER (ORDER BY subject) AS place FROM (SELECT DISTINCT subject FROM noise WHERE NOT noise AND NOT EXISTS (SELECT 1 FROM hyp WHERE hyp.subject = noise.subject))",
    "g11_return_types": _w(O.FUNCTIONS, r"""one AS (SELECT subject, arg_max({'s': signature, 'd': decompilation}, {'e': coalesce(extracted_at, TIMESTAMP '0001-01-01'), 'f': fact_id}) AS f FROM ff WHERE subject IS NOT NULL GROUP BY 1)""",
        rf"""typed AS (SELECT subject, trim(regexp_extract({O.squeeze('f.s')}, '^(.*?[ *])([A-Za-z_~][\w:~]*)\(', 1)) AS type, regexp_extract(f.d, 'FUN_([0-9A-Fa-f]+)\([^;{{}}]*\);\s*return;\s*\}}\s*$', 1) AS h FROM one)""",
        "op AS (SELECT subject, '0x' || lower(h) AS target FROM typed WHERE type = 'undefined' AND h <> '')",
        "ch AS (SELECT subject, target FROM op UNION SELECT ch.subject, op.target FROM ch JOIN op ON op.subject = ch.target)", recursive=True)
    + "SELECT ch.subject, ch.target, t.type AS return_type FROM ch JOIN typed t ON t.subject = ch.target WHERE t.type NOT IN ('', 'undefined')",
    "k11_header_order": "SELECT class_name, CASE WHEN state = 'tree' THEN depth END AS level FROM (" + O.ORACLES["p4_found"] + ")",
    "g18_diagnosis": _w(*O._ALL, O._DISPOSED, O.RC, O.SLOTS, "rec AS (SELECT DISTINCT address FROM slots WHERE address IS NOT NULL)", recursive=True)
    + """SELECT d.subject, disposition, size AS body_size, sole.dst AS sole_callee, n_recovered_callers, n_other_callers FROM disposed d JOIN (SELECT dst, count(*) FILTER (src IN (SELECT address FROM rec)) AS n_recovered_callers,
      count(*) FILTER (coalesce(src NOT IN (SELECT address FROM rec), true)) AS n_other_callers FROM calls GROUP BY 1) c ON c.dst = d.subject LEFT JOIN sized USING (subject) LEFT JOIN sole ON sole.src = d.subject""",
    "a15_method_collisions": _w(O.FUNCTIONS, _OWNED) + r"""SELECT class_name, subject, name, n, name || '_' || substr(subject, 3) AS distinct_name FROM (SELECT *, count(*) OVER (PARTITION BY class_name, name, params) AS n FROM (
      SELECT DISTINCT class_name, name, coalesce(regexp_extract(signature, '\((.*)\)', 1), '') AS params, subject FROM oc WHERE class_name IS NOT NULL AND name IS NOT NULL AND NOT c AND NOT d)) WHERE n > 1""",
    "a16_class_methods": _w(O.FUNCTIONS, _OWNED) + """SELECT class_name, count(*) FILTER (NOT c AND NOT d) AS n_methods, count(*) FILTER (c) AS n_constructors, min(subject) FILTER (d) AS destructor FROM (
      SELECT class_name, subject, bool_or(c) AS c, bool_or(d) AS d FROM oc WHERE class_name IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
    "a19_trampolines": _w(O.RC, _METHODS) + "SELECT class_name || '__vtable_trampoline_' || display_name AS trampoline, min(address) AS address, count(DISTINCT address) AS n_targets FROM ms WHERE display_name IS NOT NULL AND address IS NOT NULL GROUP BY 1",
    "j15_symbol_table": _w(O.RC, _METHODS, O.FUNCTIONS, _SYMBOLS) + "SELECT address, symbol, kind FROM symbols",
    "j16_thunk_symbols": _w(O.OBS, O.CALLS, O.RC, _METHODS, O.FUNCTIONS, _SYMBOLS, O.SOLE, O.THIN)
    + "SELECT address, coalesce(t.symbol, s.symbol) AS symbol, CASE WHEN t.symbol IS NOT NULL THEN 'thunk' ELSE kind END AS kind FROM symbols s FULL JOIN (SELECT src AS address, x.symbol FROM thin JOIN symbols x ON x.address = dst) t USING (address)",
    "j17_named_calls": _w(O.RC, _METHODS) + r"""SELECT address, count(DISTINCT fact_id) AS n_functions FROM (SELECT fact_id, unnest(list_distinct(regexp_extract_all(decompilation, '([A-Za-z_][A-Za-z0-9_]*)\(', 1))) AS name FROM function_facts)
      JOIN (SELECT address, raw_name AS name FROM ms UNION SELECT address, display_name FROM ms) USING (name) WHERE address IS NOT NULL GROUP BY 1""",
    "t6_identifiers": f"SELECT token, count(*) AS n_functions FROM {_TOKENS} WHERE token <> '' GROUP BY 1",
    "t7_data_symbols": f"SELECT token, count(*) AS n_functions FROM {_TOKENS} WHERE starts_with(token, 'DAT_') OR starts_with(token, 'PTR_') OR starts_with(token, '_refptr_') OR starts_with(token, 'LAB_') GROUP BY 1",
    "t9_crt_calls": f"SELECT fact_id, token AS crt_function FROM {_TOKENS} WHERE token IN ({O.quoted(CRT_CALLS)})",
    "t24_parameter_names": rf"""SELECT fact_id, pos, {_LAST_WORD} AS parameter FROM (SELECT fact_id, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS p FROM (SELECT fact_id, string_split(trim(regexp_extract(signature, '\((.*)\)', 1)), ',') AS l FROM function_facts
      WHERE signature IS NOT NULL AND trim(regexp_extract(signature, '\((.*)\)', 1)) NOT IN ('', 'void'))) WHERE {_LAST_WORD} <> ''""",
    "t39_this_owners": r"SELECT * FROM (SELECT fact_id, regexp_extract(signature, '\(\s*([A-Za-z_]\w*)\s*\*\s*this\b', 1) AS owner FROM function_facts) WHERE owner <> ''",
}
