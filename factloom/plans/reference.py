"""Queries over the evidence tables, by operator id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions.names import canonical_address, canonical_class, squeeze
from factloom.operators import graph as G
from factloom.operators import views as V
from factloom.operators.hierarchy import hierarchies
from factloom.operators.packed import split_values
from factloom.operators.provenance import provenance, thunks
from factloom.session import cut, table
from factloom.sources.facts import document_triples, parsed_documents

ACCEPT, SUPPORT, MOST_ATTEMPTS, CLUSTER, WAVE = 0.85, 0.6, 3, 5, 16


def _functions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "function_facts").withColumn("subject", canonical_address(F.col("address")))


def _triples(spark: SparkSession, sf: str) -> DataFrame:
    """Function facts as distinct (subject, predicate, value, confidence, source)."""
    ff = _functions(spark, sf)
    one = lambda p, v, s="ghidra:function": F.struct(F.lit(p).alias("predicate"), v.alias("value"), F.lit(s).alias("source"))
    single = F.array(
        one("has_name", F.col("name")), one("has_signature", F.col("signature")), one("calling_convention", F.col("calling_convention")),
        one("size_bytes", F.col("size").cast("string")), one("decompiles_to", F.when(F.col("decompilation") != "", F.col("decompilation")), "ghidra:decompiler"),
        one("is_method_of", F.col("owner_class")), one("is_constructor_of", F.when(F.col("is_constructor"), F.col("owner_class"))),
        one("is_destructor_of", F.when(F.col("is_destructor"), F.col("owner_class"))),
    )
    many = lambda p, c: F.transform(F.coalesce(F.col(c), F.array()), lambda x: one(p, canonical_address(x), "ghidra:call_graph"))
    rows = ff.select("subject", F.explode(F.concat(single, many("calls", "callees"), many("called_by", "callers"))).alias("t")).select("subject", "t.*")
    return rows.where("value is not null and subject is not null").groupBy("subject", "predicate", "value").agg(F.lit(0.95).alias("confidence"), F.max("source").alias("source"))


def f1_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Triples of the function facts that aren't stored yet, with their new ids."""
    return _new_triples(spark, sf, _triples(spark, sf))


def f2_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Triples of the function facts and of all fact documents that aren't stored yet, with their new ids."""
    both = _triples(spark, sf).unionByName(document_triples(parsed_documents(table(spark, sf, "fact_documents"), "payload")))
    once = both.groupBy("subject", "predicate", "value").agg(F.max("confidence").alias("confidence"), F.max("source").alias("source"))
    return _new_triples(spark, sf, once)


def _new_triples(spark: SparkSession, sf: str, triples: DataFrame) -> DataFrame:
    obs = V.observations(spark, sf)
    top = obs.agg(F.max("id")).first()[0] or 0
    new = triples.join(obs.select("subject", "predicate", "value").distinct(), ["subject", "predicate", "value"], "left_anti")
    return V.numbered(new, ["subject", "predicate", "value"], top)


def f3_live_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Active observations and their subjects per predicate."""
    live = V.observations(spark, sf, once=True).where("status = 'ACTIVE'")
    return live.groupBy("predicate").agg(F.count("*").alias("n_facts"), F.countDistinct("subject").alias("n_subjects"))


def f4_latest_values(spark: SparkSession, sf: str) -> DataFrame:
    """The value with the highest id of each subject and predicate."""
    return V.latest(V.observations(spark, sf), "subject", "predicate")


def f8_substantive_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Per function the newest body that isn't degenerate, else the newest."""
    rows = _functions(spark, sf).where("decompilation is not null").withColumn("degenerate", T.is_degenerate(F.col("decompilation")))
    top = F.max(F.struct((~F.col("degenerate")).alias("good"), "extracted_at", "fact_id"))
    return rows.groupBy("program", "subject").agg(top.alias("t")).select("program", "subject", F.col("t.fact_id").alias("fact_id"), F.col("t.good").alias("substantive"))


def f9_empty_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Functions whose body has no brace, is elided, or holds comments only."""
    return _functions(spark, sf).where(T.is_empty_body(F.col("decompilation"))).select("fact_id", F.length("decompilation").alias("n_chars"))


def f12_reserved_names(spark: SparkSession, sf: str) -> DataFrame:
    """Observed names that the language keeps for its implementation, with their subjects."""
    named = V.facts(V.observations(spark, sf), "has_name", "is_method_of")
    return named.where(V.is_reserved(F.col("value"))).groupBy("predicate", "value").agg(F.countDistinct("subject").alias("n_subjects"))


def f13_subject_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Application or library code, by import, owner and name."""
    return V.subject_classes(V.observations(spark, sf)).select("subject", "class")


def f15_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Owner by precedence of predicate."""
    return V.owners(V.observations(spark, sf))


def f16_noise(spark: SparkSession, sf: str) -> DataFrame:
    """Named subjects and whether their name or owner marks runtime code."""
    return V.noise(V.observations(spark, sf))


def f22_accepted_names(spark: SparkSession, sf: str) -> DataFrame:
    """The latest accepted role of each subject."""
    rows = V.hypotheses(spark, sf).where("status = 'ACCEPTED' and predicate = 'semantic_role' and trim(value) <> ''")
    return V.latest(rows, "subject").select("subject", F.col("value").alias("role"), F.col("id").alias("hypothesis_id"))


def f25_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Best label of each named subject: accepted role, accepted mechanics, a real name."""
    obs, hyp = V.observations(spark, sf), V.hypotheses(spark, sf).where("status = 'ACCEPTED'")
    role = V.latest(hyp.where("predicate = 'semantic_role'"), "subject").select("subject", F.col("value").alias("role"))
    does = V.latest(hyp.where("predicate = 'mechanical_behavior'"), "subject").select("subject", F.col("value").alias("does"))
    wide = V.latest_of(obs, "has_name", "name").join(role, "subject", "left").join(does, "subject", "left")
    real = F.when(~F.col("name").startswith("FUN_"), F.col("name"))
    kind = F.when(F.col("role").isNotNull(), "role").when(F.col("does").isNotNull(), "mechanics").when(real.isNotNull(), "name").otherwise("none")
    return wide.select("subject", F.coalesce("role", "does", real).alias("label"), kind.alias("label_kind"))


def f27_symbol_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses spelled in data symbol names: the last part that is all hex, of six digits or more if it has no letter."""
    names = V.facts(V.observations(spark, sf), "data_symbol_name").select(squeeze(F.col("value")).alias("symbol")).where("symbol <> ''").distinct()
    return names.withColumn("address", T.symbol_address(F.col("symbol"))).where("address is not null")


def _data_facts(spark: SparkSession, sf: str, *predicates: str) -> DataFrame:
    """(subject, one column per predicate): the latest values of data objects, without blanks around them."""
    rows = V.latest(V.facts(V.observations(spark, sf), *predicates), "subject", "predicate").groupBy("subject")
    return rows.agg(*(F.max(F.when(F.col("predicate") == p, squeeze(F.col("value")))).alias(p) for p in predicates))


def f28_sized_data(spark: SparkSession, sf: str) -> DataFrame:
    """Data objects whose size is stated, not estimated, of a committed type, and that aren't program text; their bytes where known."""
    wide = _data_facts(spark, sf, "data_size_bytes", "data_section", "data_executable", "data_type_name", "data_bytes_hex")
    code = F.coalesce((F.col("data_executable") == "true") & (F.col("data_section") == ".text"), F.lit(False))
    typed = F.coalesce(F.col("data_type_name") != "undefined", F.lit(True))
    size, whole = F.col("data_size_bytes").try_cast("bigint"), F.col("data_size_bytes").rlike("^[+]?[0-9]+$")
    return wide.where(~code & typed & whole & size.isNotNull()).select("subject", size.alias("size_bytes"), F.col("data_bytes_hex").alias("bytes_hex"))


def f28_confident_data(spark: SparkSession, sf: str) -> DataFrame:
    """The objects of f28_sized_data whose bytes are known as well-formed hex."""
    return f28_sized_data(spark, sf).where(F.col("bytes_hex").rlike("^([0-9a-fA-F]{2})*$"))


def f30_known_callees(spark: SparkSession, sf: str) -> DataFrame:
    """Callees and whether they are known functions or imports."""
    obs = V.observations(spark, sf)
    callees = V.call_edges(obs).groupBy(F.col("dst").alias("subject")).agg(F.count("*").alias("n_callers"))
    is_function = V.facts(obs, "calling_convention").select("subject", F.lit(True).alias("is_function")).distinct()
    is_import = V.facts(obs, "imports").select("subject", F.lit(True).alias("is_import")).distinct()
    wide = callees.join(is_function, "subject", "left").join(is_import, "subject", "left")
    return wide.select("subject", "n_callers", F.coalesce("is_function", F.lit(False)).alias("is_function"), F.coalesce("is_import", F.lit(False)).alias("is_import"))


def j1_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Supporting evidence of each hypothesis with the observation behind it; dangling ids fall away."""
    ev = table(spark, sf, "evidence")
    cited = split_values(table(spark, sf, "hypotheses"), ["id"], "supporting_evidence", ev)
    obs = V.observations(spark, sf, once=True).select(F.col("id").alias("observation_id"), "subject", "predicate")
    held = ev.select(F.col("id").alias("value"), "observation_id").dropDuplicates(["value"])
    return cited.join(held, "value").join(obs, "observation_id").select(
        F.col("id").alias("hypothesis_id"), "pos", F.col("value").alias("evidence_id"), "observation_id", "subject", "predicate"
    )


def j2_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Named subjects without any hypothesis that aren't noise."""
    named = V.noise(V.observations(spark, sf)).where("not noise")
    return named.join(V.hypotheses(spark, sf).select("subject"), "subject", "left_anti").select("subject", "name")


def j3_fingerprint_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Functions without an accepted role whose normalised body equals that of a function with one."""
    rows = _functions(spark, sf).where("subject is not null").withColumn("fp", T.fingerprint(F.col("decompilation"))).where("fp is not null")
    prints = rows.groupBy("subject").agg(F.max_by("fp", "fact_id").alias("fp"))
    roles = f22_accepted_names(spark, sf).select("subject", "role")
    known = prints.join(roles, "subject").groupBy("fp").agg(F.min(F.struct("subject", "role")).alias("k"))
    open_ = prints.join(roles.select("subject"), "subject", "left_anti")
    return open_.join(known, "fp").select("subject", F.col("k.subject").alias("source_subject"), F.col("k.role").alias("role"))


def _slots(spark: SparkSession, sf: str) -> DataFrame:
    """(class_name, base, slot, address): methods by place; the more detailed row of a class counts."""
    rows = table(spark, sf, "recovered_classes").select(
        canonical_class(F.col("name")).alias("class_name"), canonical_class(F.col("base")).alias("base"), "methods", F.size(F.coalesce("methods", F.array())).alias("n")
    )
    best = rows.where("class_name is not null").groupBy("class_name").agg(F.max("base").alias("base"), F.max("n").alias("most"))
    full = rows.join(best.select("class_name", F.col("base").alias("b"), "most"), "class_name").where("n = most").select(
        "class_name", F.col("b").alias("base"), F.posexplode("methods").alias("slot", "m")
    )
    return full.select("class_name", "base", "slot", canonical_address(F.col("m.address")).alias("address")).distinct()


def j4_sibling_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Methods at the same slot of classes with the same base: how many siblings each has, and the least class."""
    s = _slots(spark, sf).where("base is not null")
    per = s.groupBy("base", "slot").agg(F.countDistinct("class_name").alias("n_classes"), F.min("class_name").alias("first_class"))
    return per.where("n_classes > 1")


def j5_sibling_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Roles accepted for a method, offered to the same slot of classes with the same base that have none."""
    s = _slots(spark, sf).where("base is not null and address is not null")
    roles = f22_accepted_names(spark, sf).select(F.col("subject").alias("address"), "role")
    given = s.join(roles, "address").groupBy("base", "slot").agg(F.min(F.struct("class_name", "role")).alias("g"))
    return s.join(roles.select("address"), "address", "left_anti").join(given, ["base", "slot"]).select(
        "class_name", "slot", "address", F.col("g.class_name").alias("from_class"), F.col("g.role").alias("role")
    )


def _rooted_slots(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of _slots with the root of each class's hierarchy (a root is its own)."""
    links = table(spark, sf, "recovered_classes").select(canonical_class(F.col("name")).alias("name"), canonical_class(F.col("base")).alias("base"))
    return _slots(spark, sf).join(hierarchies(links, "name", "base").select(F.col("node").alias("class_name"), "root"), "class_name")


def j4_hierarchy_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Methods at the same slot of classes of the same hierarchy: how many classes have it, and the least class."""
    per = _rooted_slots(spark, sf).groupBy("root", "slot").agg(F.countDistinct("class_name").alias("n_classes"), F.min("class_name").alias("first_class"))
    return per.where("n_classes > 1")


def j5_hierarchy_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Roles accepted for a method, offered to the same slot of classes of the same hierarchy that have none."""
    s = cut(_rooted_slots(spark, sf).where("address is not null"))
    roles = f22_accepted_names(spark, sf).select(F.col("subject").alias("address"), "role")
    given = s.join(roles, "address").groupBy("root", "slot").agg(F.min(F.struct("class_name", "role")).alias("g"))
    return s.join(roles.select("address"), "address", "left_anti").join(given, ["root", "slot"]).select(
        "class_name", "slot", "address", F.col("g.class_name").alias("from_class"), F.col("g.role").alias("role")
    )


def j6_supersessions(spark: SparkSession, sf: str) -> DataFrame:
    """Superseded observations with the newest active one of the same subject and predicate."""
    obs = V.observations(spark, sf, once=True).where("subject is not null and predicate is not null")
    newest = obs.where("status = 'ACTIVE'").groupBy("subject", "predicate").agg(F.max("id").alias("newest_id"))
    return obs.where("status = 'SUPERSEDED'").join(newest, ["subject", "predicate"]).select("id", "superseded_by", "newest_id")


def j8_restated_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Roles all of whose words stand in a mechanical description of the same subject."""
    hyp = V.hypotheses(spark, sf).withColumn("words", T.words(F.col("value")))
    role = hyp.where("predicate = 'semantic_role'").where(F.size("words") > 0).select("subject", "id", "words")
    does = hyp.where("predicate = 'mechanical_behavior'").select("subject", F.col("words").alias("other")).distinct()
    # different texts meet once, however often a subject repeats them
    told = role.select("subject", "words").distinct().join(does, "subject").where(F.size(F.array_except("words", "other")) == 0).select("subject", "words").distinct()
    return role.join(told, ["subject", "words"]).select(F.col("id").alias("hypothesis_id"), "subject").distinct()


def t11_calls_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Call targets in the order of the text of each function."""
    rows = _functions(spark, sf).select("fact_id", F.posexplode(F.regexp_extract_all("decompilation", F.lit("FUN_([0-9A-Fa-f]+)"), 1)).alias("pos", "t"))
    return rows.select("fact_id", "pos", F.concat(F.lit("0x"), F.lower("t")).alias("callee"))


def j9_call_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Calls within five places of each call in the same function."""
    near = W.partitionBy("fact_id").orderBy("pos").rowsBetween(-5, 5)
    rows = t11_calls_in_order(spark, sf).withColumn("near", F.collect_list("callee").over(near))
    return rows.select("fact_id", "pos", "callee", F.array_join("near", ",").alias("neighbours"), (F.size("near") - 1).alias("n_neighbours"))


def j11_vfunc0(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses sixteen bytes after a class's vtable."""
    rows = table(spark, sf, "recovered_classes").select(canonical_class(F.col("name")).alias("class_name"), canonical_address(F.col("vtable_address")).alias("vtable"))
    base = F.conv(F.substring("vtable", 3, 16), 16, 10).cast("bigint")
    return rows.where("vtable is not null and class_name is not null").distinct().withColumn("vfunc0", F.concat(F.lit("0x"), F.lower(F.hex(base + 16))))


def j18_sole_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects that only one distinct owner was ever stated for."""
    rows = V.facts(V.observations(spark, sf), *V.OWNER_PREDICATES)
    return rows.groupBy("subject").agg(F.min("value").alias("owner"), F.max("value").alias("last")).where("owner = last").select("subject", "owner")


def j19_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Each investigation with the hypotheses that name it as their origin; none is an error row."""
    inv = table(spark, sf, "investigations").dropDuplicates(["id"]).select("id", "task")
    made = V.hypotheses(spark, sf).groupBy(F.col("created_by").alias("id")).agg(F.count("*").alias("n"), F.min(F.col("id")).alias("first_id"))
    wide = inv.join(made, "id", "left")
    return wide.select("id", "task", F.coalesce("n", F.lit(0)).alias("n_hypotheses"), "first_id", F.col("n").isNull().alias("missing"))


def j23_new_inheritance(spark: SparkSession, sf: str) -> DataFrame:
    """Inheritance pairs of the fact documents that no recovered class states."""
    docs = table(spark, sf, "fact_documents").where(F.try_parse_json("payload").isNotNull())
    pairs = docs.select(F.explode(F.from_json("payload", "inheritance array<struct<derived string, base string>>")["inheritance"]).alias("i"))
    pairs = pairs.select(canonical_class(F.col("i.derived")).alias("derived"), canonical_class(F.col("i.base")).alias("base")).where("derived is not null and base is not null").distinct()
    known = table(spark, sf, "recovered_classes").select(canonical_class(F.col("name")).alias("derived"), canonical_class(F.col("base")).alias("base"))
    return pairs.join(known, ["derived", "base"], "left_anti")


def j24_class_references(spark: SparkSession, sf: str) -> DataFrame:
    """References of a class to other recovered classes than itself and its base."""
    rows = table(spark, sf, "recovered_classes").select(canonical_class(F.col("name")).alias("class_name"), canonical_class(F.col("base")).alias("base"), "class_refs")
    names = rows.select(F.col("class_name").alias("ref")).distinct()
    refs = rows.select("class_name", "base", F.explode("class_refs").alias("r")).select("class_name", "base", canonical_class(F.col("r")).alias("ref"))
    return refs.where("ref <> class_name and (base is null or ref <> base)").join(names, "ref", "left_semi").select("class_name", "ref").distinct()


def a1_investigation_report(spark: SparkSession, sf: str) -> DataFrame:
    """Work done per kind of task."""
    inv = table(spark, sf, "investigations").dropDuplicates(["id"])
    accepted = V.hypotheses(spark, sf).where("status = 'ACCEPTED'").select(F.col("id").alias("h"))
    won = inv.select("task", F.explode("hypotheses_created").alias("h")).join(accepted, "h", "left_semi").groupBy("task").agg(F.count("*").alias("won"))
    n = lambda c: F.coalesce(F.size(F.coalesce(c, F.array())), F.lit(0))
    idle = (F.col("task") != "ResolveContradiction") & (n("hypotheses_created") == 0) & (n("evidence_created") == 0)
    per = inv.groupBy("task").agg(
        F.count("*").alias("executed"), F.sum(n("hypotheses_created")).alias("hypotheses_created"), F.sum(n("hypotheses_modified")).alias("hypotheses_modified"),
        F.sum(n("evidence_created")).alias("evidence_created"), F.count(F.when(idle, 1)).alias("no_op"),
    )
    return per.join(won, "task", "left").select(
        "task", "executed", "hypotheses_created", "hypotheses_modified", "evidence_created", F.coalesce("won", F.lit(0)).alias("accepted_from_created"),
        "no_op", (F.col("executed") - F.col("no_op")).alias("productive"),
        F.round(F.when(F.col("executed") == 0, 0.0).otherwise((F.col("executed") - F.col("no_op")) / F.col("executed")), 6).alias("productive_rate"),
    )


def a5_library_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Share of library code among the callees of each caller."""
    obs = V.observations(spark, sf)
    cls = V.subject_classes(obs).select(F.col("subject").alias("dst"), "class")
    called = V.call_edges(obs).join(cls, "dst", "left")
    return called.groupBy(F.col("src").alias("subject")).agg(
        F.count("*").alias("n_callees"), F.round(F.avg(F.when(F.col("class") == "LIBRARY_OR_COMPILER", 1.0).otherwise(0.0)), 6).alias("library_ratio")
    )


def a6_dependents(spark: SparkSession, sf: str) -> DataFrame:
    """Hypotheses that depend on each hypothesis."""
    return V.dependencies(spark, sf).groupBy(F.col("target").alias("hypothesis_id")).agg(F.count("*").alias("n_dependents"))


def a7_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Analyses of each target."""
    inv = table(spark, sf, "investigations").dropDuplicates(["id"]).where("task = 'AnalyzeFunction'")
    return inv.groupBy(F.coalesce(canonical_address(F.col("target")), F.col("target")).alias("subject")).agg(F.count("*").alias("n_attempts"))


def a8_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects with hypotheses, by whether they are resolved."""
    waits = "(status = 'PROPOSED' and last_verified_at is null) or status in ('INVESTIGATING', 'CONTESTED')"
    per = V.hypotheses(spark, sf).groupBy("subject").agg(F.bool_or(F.expr("status = 'ACCEPTED'")).alias("won"), F.bool_or(F.expr(waits)).alias("waits"))
    done = F.coalesce("won", F.lit(False)) | ~F.coalesce("waits", F.lit(False))
    return per.groupBy(done.alias("resolved")).agg(F.count("*").alias("n_subjects"))


def a10_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Hypotheses by predicate and status."""
    return V.hypotheses(spark, sf).groupBy("predicate", "status").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def a12_sole_callees(spark: SparkSession, sf: str) -> DataFrame:
    """Functions with exactly one distinct callee."""
    return G.sole_callees(V.call_edges(V.observations(spark, sf))).select(F.col("src").alias("subject"), F.col("dst").alias("callee"))


def a13_thunks(spark: SparkSession, sf: str) -> DataFrame:
    """Small functions with one callee."""
    return thunks(V.observations(spark, sf)).select(F.col("src").alias("subject"), F.col("dst").alias("target"))


def a14_name_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Names with the same signature at several addresses, made distinct by their address."""
    rows = _functions(spark, sf).where("name is not null and subject is not null").select(
        "name", F.coalesce(F.regexp_extract("signature", r"\((.*)\)", 1), F.lit("")).alias("params"), "subject"
    ).distinct()
    often = rows.groupBy("name", "params").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(often, ["name", "params"]).select("subject", "name", "params", "n", F.concat_ws("_", "name", F.substring("subject", 3, 16)).alias("distinct_name"))


def a16_field_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate types of each field of each class."""
    rows = table(spark, sf, "recovered_classes").select(canonical_class(F.col("name")).alias("class_name"), F.explode("fields").alias("f"))
    types = rows.select("class_name", T.int_literal(F.col("f.field_offset")).alias("field_offset"), F.explode("f.candidate_types").alias("t"))
    return types.where("field_offset is not null").groupBy("class_name", "field_offset").agg(F.array_join(F.sort_array(F.collect_set("t")), ",").alias("types"), F.countDistinct("t").alias("n_types"))


WIDTHS = {
    "char": 1, "byte": 1, "bool": 1, "undefined": 1, "short": 2, "ushort": 2, "undefined2": 2, "int": 4, "uint": 4, "float": 4, "undefined4": 4,
    "long": 8, "ulong": 8, "longlong": 8, "ulonglong": 8, "double": 8, "undefined8": 8, "pointer": 8,
}


def a17_extents(spark: SparkSession, sf: str) -> DataFrame:
    """Least size of each class: the end of its last field, and the third word after a pair of words."""
    width = F.coalesce(*(F.when(F.col("t") == k, v) for k, v in WIDTHS.items()))
    rows = table(spark, sf, "recovered_classes").select(canonical_class(F.col("name")).alias("class_name"), F.explode("fields").alias("f"))
    types = rows.select("class_name", T.int_literal(F.col("f.field_offset")).alias("o"), F.explode("f.candidate_types").alias("t")).withColumn("w", width)
    spans = types.where("o is not null and w is not null").select("class_name", "o", "w").distinct()
    wide = spans.where("w = 8")
    pairs = wide.join(wide.select("class_name", (F.col("o") - 8).alias("o")), ["class_name", "o"]).select("class_name", (F.col("o") + 24).alias("e"))
    return spans.select("class_name", (F.col("o") + F.col("w")).alias("e")).unionByName(pairs).groupBy("class_name").agg(F.max("e").alias("extent"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    hyp = V.hypotheses(spark, sf).where("status in ('PROPOSED', 'INVESTIGATING', 'SUPPORTED', 'STALE', 'CONTESTED')")
    deps = a6_dependents(spark, sf).select(F.col("hypothesis_id").alias("id"), "n_dependents")
    wide = hyp.join(deps, "id", "left").withColumn("d", F.coalesce("n_dependents", F.lit(0)) * 0.05)
    task = F.when(F.col("status") == "CONTESTED", "ResolveContradiction").otherwise("ChallengeHypothesis")
    score = F.when(F.col("status") == "CONTESTED", 0.9 + F.col("d")).otherwise(0.6 + F.coalesce("confidence", F.lit(0.0)) * 0.3 + F.col("d"))
    seeds = j2_seeds(spark, sf).select(F.lit("AnalyzeFunction").alias("task"), F.col("subject").alias("target"), F.lit(0.5).alias("score"))
    return wide.select(task.alias("task"), F.concat(F.lit("H"), "id").alias("target"), F.round(score, 6).alias("score")).unionByName(seeds)


def k1_priorities(spark: SparkSession, sf: str) -> DataFrame:
    """The score of every open task."""
    return _scored(spark, sf)


def k4_wave(spark: SparkSession, sf: str) -> DataFrame:
    """The sixteen most urgent tasks (a top-k report), in clusters of five per kind."""
    top = _scored(spark, sf).orderBy(F.col("score").desc(), "task", "target").limit(WAVE)
    at = F.row_number().over(W.partitionBy("task").orderBy(F.col("score").desc(), "target"))
    return top.withColumn("cluster", F.floor((at - 1) / CLUSTER).cast("bigint"))


def g1_stale_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Hypotheses that turn stale because those they depend on are rejected."""
    hyp = V.hypotheses(spark, sf).select("id", "status")
    return G.stale_cascade(V.dependencies(spark, sf), hyp.where("status = 'REJECTED'").select("id"), hyp)


def _roots(obs: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): the exported entry point; without one, the functions that call others and that nobody calls."""
    entry = V.facts(obs, "exports").where("value = 'entry'").select(F.col("subject").alias("node")).distinct()
    if not entry.isEmpty():
        return entry
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def g2_reachable(spark: SparkSession, sf: str) -> DataFrame:
    """What the entry point reaches by calls, and in how many steps."""
    obs = V.observations(spark, sf)
    edges = cut(V.call_edges(obs))
    return G.reachable(edges, _roots(obs, edges)).withColumnRenamed("node", "subject")


def g4_api_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Real names within three calls of the entry point, and how near."""
    obs = V.observations(spark, sf)
    edges = cut(V.call_edges(obs))
    near = G.reachable(edges, _roots(obs, edges), 3).where("depth > 0")
    names = V.latest_of(obs, "has_name", "name").withColumnRenamed("subject", "node").where("not startswith(name, 'FUN_')")
    return near.join(names, "node").groupBy("name").agg(F.min("depth").alias("depth"))


def g5_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Application, library or unknown, by rules and the call graph."""
    return provenance(V.observations(spark, sf))


def g10_import_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Functions whose chain of sole callees ends in an import within five steps."""
    obs = V.observations(spark, sf)
    imports = V.facts(obs, "imports").select(F.col("subject").alias("node")).distinct()
    return G.resolves_to(G.sole_callees(V.call_edges(obs)), imports, 5).withColumnRenamed("node", "subject")


def s10_linker_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Undefined symbols of the linker logs, once each, as functions with an address or data."""
    logs = table(spark, sf, "documents").where("doc_type = 'link_log'")
    names = logs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"undefined reference to `([^'(]+)"), 1)).alias("symbol"))
    address = F.regexp_extract("symbol", r"^(?:thunk_)?FUN_([0-9A-Fa-f]+)$", 1)
    kind = F.when(address != "", "FUNCTION").otherwise("DATA")
    return names.groupBy("symbol").agg(F.countDistinct("doc_id").alias("n_logs"), F.min("doc_id").alias("first_doc")).select(
        "symbol", kind.alias("kind"), F.when(address != "", F.concat(F.lit("0x"), F.lower(address))).alias("address"), "n_logs", "first_doc"
    )


def g16_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """Called functions without a stored body: reachable, and what their origin asks for."""
    obs = V.observations(spark, sf)
    edges = cut(V.call_edges(obs))
    bodies = V.facts(obs, "decompiles_to").select("subject").distinct()
    open_ = edges.select(F.col("dst").alias("subject")).distinct().join(bodies, "subject", "left_anti")
    reach = G.reachable(edges, _roots(obs, edges)).select(F.col("node").alias("subject"), F.lit(True).alias("r"))
    wide = open_.join(reach, "subject", "left").join(provenance(obs), "subject", "left")
    bucket = F.when(F.col("provenance") == "LIBRARY_OR_RUNTIME", "LIBRARY_OR_RUNTIME").when(F.col("r") & (F.col("provenance") == "APPLICATION"), "NEEDS_RECOVERY").otherwise("DEFERRED")
    return wide.select("subject", F.coalesce("r", F.lit(False)).alias("reachable"), bucket.alias("bucket"))


def g17_dispositions(spark: SparkSession, sf: str) -> DataFrame:
    """What to do with each called function."""
    obs = V.observations(spark, sf)
    edges = cut(V.call_edges(obs))
    body = _functions(spark, sf).where("subject is not null").groupBy("subject").agg(F.bool_or(~T.is_degenerate(F.col("decompilation"))).alias("body"))
    reach = G.reachable(edges, _roots(obs, edges)).select(F.col("node").alias("subject"), F.lit(True).alias("r"))
    chained = g10_import_chains(spark, sf).withColumn("chained", F.lit(True))
    wide = edges.groupBy(F.col("dst").alias("subject")).agg(F.count("*").alias("n_callers"))
    startup = u1_startup_only(spark, sf).withColumn("startup", F.lit(True))
    for side in (reach, provenance(obs), body, chained, startup):
        wide = wide.join(side, "subject", "left")
    origin, has = F.coalesce("provenance", F.lit("UNKNOWN")), F.coalesce("body", F.lit(False))
    what = (
        F.when(F.col("r").isNull(), "UNREACHABLE")
        .when(F.col("startup"), "RUNTIME_ARTIFACT")
        .when(origin == "APPLICATION", "REQUIRED_APPLICATION")
        .when((origin == "UNKNOWN") & has, "REQUIRED_UNKNOWN")
        .when(origin == "UNKNOWN", "DEFERRED")
        .when(has, "REQUIRED_RUNTIME_BODY")
        .when(F.col("chained"), "EXTERNAL_LIBRARY")
        .otherwise("COMPILER_RUNTIME")
    )
    return wide.select("subject", "n_callers", what.alias("disposition"))


def u1_startup_only(spark: SparkSession, sf: str) -> DataFrame:
    """What the entry point reaches but the main function (see graph.startup_only) doesn't; empty if none stands out."""
    obs = V.observations(spark, sf)
    edges = cut(V.call_edges(obs))
    entry = _roots(obs, edges).agg(F.min("node").alias("node")).where("node is not null")
    return G.startup_only(edges, entry).withColumnRenamed("node", "subject")


def m15_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The status each open hypothesis gets from its confidence and verification, after the two gates."""
    obs = V.observations(spark, sf)
    hyp = V.hypotheses(spark, sf).where("status not in ('CONTESTED', 'REJECTED')")
    restated = j8_restated_roles(spark, sf).select(F.col("hypothesis_id").alias("id"), F.lit(True).alias("restated"))
    wide = hyp.join(provenance(obs), "subject", "left").join(restated, "id", "left")
    plain = F.when(F.col("last_verified_at").isNotNull() & (F.col("confidence") >= ACCEPT), "ACCEPTED").when(F.col("confidence") >= SUPPORT, "SUPPORTED").otherwise("PROPOSED")
    gated = (
        F.when((plain == "ACCEPTED") & (F.col("predicate") == "semantic_role") & (F.coalesce("provenance", F.lit("UNKNOWN")) != "APPLICATION"), "REJECTED")
        .when((plain == "ACCEPTED") & F.col("restated"), "CONTESTED")
        .otherwise(plain)
    )
    return wide.select(F.col("id").alias("hypothesis_id"), F.col("status").alias("old_status"), gated.alias("new_status"))


def m22_retries(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects to analyse again after a rejection, with fewer than three attempts so far."""
    lost = V.hypotheses(spark, sf).where("status = 'REJECTED'").select("subject").distinct()
    return lost.join(a7_attempts(spark, sf), "subject", "left").where(F.coalesce("n_attempts", F.lit(0)) < MOST_ATTEMPTS).select("subject", F.coalesce("n_attempts", F.lit(0)).alias("n_attempts"))


def c1_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """What an analysis of each subject with hypotheses would be told: its facts, hypotheses and rejections, as counts."""
    obs = V.observations(spark, sf, once=True).where("predicate <> 'agent_flagged_contradiction'")
    hyp = V.hypotheses(spark, sf).groupBy("subject").agg(
        F.count("*").alias("n_hypotheses"), F.count(F.when(F.col("rejection_reason").isNotNull(), 1)).alias("n_reasons"),
        F.array_join(F.sort_array(F.collect_set("status")), ",").alias("statuses"),
    )
    own = obs.groupBy("subject").agg(F.count("*").alias("n_facts"), F.countDistinct("predicate").alias("n_predicates"))
    return hyp.join(own, "subject", "left").select("subject", "n_hypotheses", "n_reasons", "statuses", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("n_predicates", F.lit(0)).alias("n_predicates"))


def t1_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Functions by the fingerprint of their normalised body."""
    rows = _functions(spark, sf).withColumn("fp", T.fingerprint(F.col("decompilation"))).where("fp is not null")
    return rows.groupBy("fp").agg(F.count("*").alias("n_functions"), F.min("fact_id").alias("first_fact"))


def t4_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the hypotheses' values, by how many use them."""
    rows = V.hypotheses(spark, sf).select("id", F.explode(T.words(F.col("value"))).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("n_hypotheses"))


def t10_data_references(spark: SparkSession, sf: str) -> DataFrame:
    """Data symbols that each body mentions."""
    found = F.array_distinct(F.regexp_extract_all("decompilation", F.lit(r"(?<![A-Za-z0-9_])((?:DAT|PTR)_[A-Za-z0-9_]+)"), 1))
    return _functions(spark, sf).select("fact_id", F.explode(found).alias("symbol"))


def t23_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """First parameter of each body, and how many slots of it the body touches."""
    rows = _functions(spark, sf).withColumn("parameter", T.first_parameter(F.col("decompilation"))).where("parameter <> ''")
    return rows.select("fact_id", "parameter", T.own_slots(F.col("decompilation"), F.col("parameter")).alias("n_slots"))


def t26_comments(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies that lose text when comments are stripped."""
    rows = _functions(spark, sf).where("decompilation is not null").select("fact_id", F.length("decompilation").alias("n_chars"), F.length(T.stripped(F.col("decompilation"))).alias("n_code"))
    return rows.where("n_code < n_chars")


def t27_literals(spark: SparkSession, sf: str) -> DataFrame:
    """Hex literals of the bodies: how often, and in how many functions."""
    rows = _functions(spark, sf).select("fact_id", F.explode(F.regexp_extract_all("decompilation", F.lit(r"(?<![A-Za-z0-9_])(0x[0-9a-fA-F]+)(?![A-Za-z0-9_])"), 1)).alias("t"))
    return rows.groupBy(T.int_literal(F.col("t")).alias("value")).agg(F.count("*").alias("n"), F.countDistinct("fact_id").alias("n_functions"))


def t38_field_accesses(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets other than zero at which a body reads or writes through a parameter."""
    found = F.regexp_extract_all("decompilation", F.lit(r"\*\([a-z0-9]+ \*\)\(param_[0-9]+ \+ (0x[0-9a-f]+)\)"), 1)
    rows = _functions(spark, sf).select("fact_id", F.explode(F.array_distinct(found)).alias("t")).withColumn("field_offset", T.int_literal(F.col("t")))
    return rows.where("field_offset <> 0").groupBy("fact_id").agg(F.count("*").alias("n_fields"), F.max("field_offset").alias("last_offset"))


QUERIES = {
    f.__name__: f
    for f in (
        f1_ingest, f2_ingest, f3_live_facts, f4_latest_values, f8_substantive_bodies, f9_empty_bodies, f12_reserved_names, f13_subject_classes, f15_owners, f16_noise,
        f22_accepted_names, f25_labels, f27_symbol_addresses, f28_sized_data, f28_confident_data, f30_known_callees, j1_evidence, j2_seeds, j3_fingerprint_reuse,
        j4_sibling_slots, j5_sibling_roles, j4_hierarchy_slots, j5_hierarchy_roles, j6_supersessions, j8_restated_roles, j9_call_neighbours, j11_vfunc0, j18_sole_owners, j19_outcomes,
        j23_new_inheritance, j24_class_references, a1_investigation_report, a5_library_ratio, a6_dependents, a7_attempts, a8_coverage, a10_statuses,
        a12_sole_callees, a13_thunks, a14_name_collisions, a16_field_candidates, a17_extents, k1_priorities, k4_wave, g1_stale_cascade, g2_reachable,
        g4_api_hints, g5_provenance, g10_import_chains, s10_linker_symbols, g16_frontier, g17_dispositions, u1_startup_only, m15_gate, m22_retries,
        c1_contexts, t1_fingerprints, t4_words, t10_data_references, t11_calls_in_order, t23_parameters, t26_comments, t27_literals, t38_field_accesses,
    )
}
