"""Further queries over the evidence tables: typed reads, name rules, signatures, fields, tokens; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions.names import canonical_class, squeeze
from factloom.operators import graph as G
from factloom.operators import views as V
from factloom.operators.provenance import provenance
from factloom.plans import oracles as O
from factloom.plans.reference import WIDTHS, _functions, _scored, _slots, g17_dispositions
from factloom.session import table

FLAGS = ("data_readable", "data_writable", "data_executable", "data_initialized")



def f7_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Latest yes/no facts that are spelled exactly true or false."""
    rows = V.latest(V.facts(V.observations(spark, sf), *FLAGS), "subject", "predicate")
    return rows.where("value in ('true', 'false')").select("subject", "predicate", (F.col("value") == "true").alias("flag"))


def f18_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """Stated names that can't stand as an identifier."""
    names = V.facts(V.observations(spark, sf, once=True), "has_name").select(squeeze(F.col("value")).alias("name"))
    return names.where(~F.col("name").rlike("^[A-Za-z_][A-Za-z0-9_]*$")).groupBy("name").agg(F.count("*").alias("n"))


def f20_accepted(spark: SparkSession, sf: str) -> DataFrame:
    """The accepted view of the program."""
    return V.hypotheses(spark, sf).where("status = 'ACCEPTED'").select("id", "subject", "predicate", "value", "confidence")


def f23_field_names(spark: SparkSession, sf: str) -> DataFrame:
    """The latest accepted field name of each subject."""
    rows = V.hypotheses(spark, sf).where("status = 'ACCEPTED' and predicate = 'field_semantic_name'")
    return V.latest(rows, "subject").select("subject", F.col("value").alias("field_name"))


def f24_display_names(spark: SparkSession, sf: str) -> DataFrame:
    """The accepted role of a named subject, else its stated name, and which of both it is."""
    obs = V.observations(spark, sf)
    role = V.latest(V.hypotheses(spark, sf).where("status = 'ACCEPTED' and predicate = 'semantic_role' and trim(value) <> ''"), "subject").select("subject", F.col("value").alias("role"))
    wide = V.latest_of(obs, "has_name", "name").join(role, "subject", "left")
    return wide.select("subject", F.coalesce("role", "name").alias("display_name"), F.when(F.col("role").isNotNull(), "ACCEPTED").otherwise("STATED").alias("name_source"))


def f33_apply_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted roles of addresses whose stated name isn't the role yet."""
    rows = V.hypotheses(spark, sf).where("status = 'ACCEPTED' and predicate = 'semantic_role' and subject like '0x%'")
    named = V.facts(V.observations(spark, sf), "has_name").select("subject", "value").distinct()
    return rows.join(named, ["subject", "value"], "left_anti").select("id", "subject", "value")


def j13_method_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Slots in which each method address stands."""
    return _slots(spark, sf).where("address is not null").groupBy("address").agg(F.count("*").alias("n_places"), F.min("slot").alias("first_slot"), F.countDistinct("class_name").alias("n_classes"))


def j25_function_references(spark: SparkSession, sf: str) -> DataFrame:
    """Named functions that are called in other bodies, by how many."""
    names = _functions(spark, sf).where("name is not null").select("name").distinct()
    calls = _functions(spark, sf).select("fact_id", F.col("name").alias("own"), F.explode(F.array_distinct(F.regexp_extract_all("decompilation", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), 1))).alias("name"))
    return calls.where("own is null or own <> name").join(names, "name", "left_semi").groupBy("name").agg(F.count("*").alias("n_functions"))


def j26_sibling_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Each field of a class with the next one and the room between."""
    rows = table(spark, sf, "recovered_classes").select(canonical_class(F.col("name")).alias("class_name"), F.explode("fields").alias("f"))
    fields = rows.select("class_name", T.int_literal(F.col("f.field_offset")).alias("field_offset")).where("class_name is not null and field_offset is not null").distinct()
    nxt = F.lead("field_offset").over(W.partitionBy("class_name").orderBy("field_offset"))
    return fields.withColumn("next_offset", nxt).where("next_offset is not null").select("class_name", "field_offset", "next_offset", (F.col("next_offset") - F.col("field_offset")).alias("room"))


def a4_claim_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted roles by the origin of their subject."""
    rows = V.hypotheses(spark, sf).where("status = 'ACCEPTED' and predicate = 'semantic_role'")
    wide = rows.join(provenance(V.observations(spark, sf)), "subject", "left")
    return wide.groupBy(F.coalesce("provenance", F.lit("UNKNOWN")).alias("provenance")).agg(F.count("*").alias("n_claims"))


def a11_dispositions(spark: SparkSession, sf: str) -> DataFrame:
    """How many functions have each disposition."""
    return g17_dispositions(spark, sf).groupBy("disposition").agg(F.count("*").alias("n"), F.sum("n_callers").alias("n_callers"))


def k6_subjects(spark: SparkSession, sf: str) -> DataFrame:
    """Open work by kind of task."""
    return _scored(spark, sf).groupBy("task").agg(F.count("*").alias("n"), F.max("score").alias("top_score"))


def u3_methods_without_special(spark: SparkSession, sf: str) -> DataFrame:
    """Methods that are neither constructors nor destructors, per owner."""
    ff = _functions(spark, sf).where("owner_class is not null and subject is not null").select("subject", canonical_class(F.col("owner_class")).alias("owner"), F.coalesce("is_constructor", F.lit(False)).alias("c"), F.coalesce("is_destructor", F.lit(False)).alias("d"))
    special = ff.where("c or d").select("subject", "owner").distinct()
    return ff.select("subject", "owner").distinct().join(special, ["subject", "owner"], "left_anti").groupBy("owner").agg(F.count("*").alias("n_methods"))


def u4_recovered(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses that a class's methods or the extracted functions recover, and by which of both."""
    m = _slots(spark, sf).where("address is not null").select("address", F.lit(1).alias("by_class"), F.lit(0).alias("by_function"))
    f = _functions(spark, sf).where("subject is not null").select(F.col("subject").alias("address"), F.lit(0).alias("by_class"), F.lit(1).alias("by_function"))
    return m.unionByName(f).groupBy("address").agg(F.max("by_class").alias("by_class"), F.max("by_function").alias("by_function"))


def m8_next_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Every hypothesis after the rejected ones have made their dependents stale."""
    hyp = V.hypotheses(spark, sf)
    stale = G.stale_cascade(V.dependencies(spark, sf), hyp.where("status = 'REJECTED'").select("id"), hyp.select("id", "status")).withColumn("hit", F.lit(True))
    hit = F.col("hit").isNotNull()
    return hyp.join(stale, "id", "left").select("id", F.when(hit, "STALE").otherwise(F.col("status")).alias("status"), F.when(hit, F.lit(None)).otherwise(F.col("last_verified_at")).isNotNull().alias("verified"))


def t5_significant_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of evidence locations and artifacts that cite code: four or more characters with ``_`` or a digit."""
    rows = table(spark, sf, "evidence").distinct().select("id", F.explode(F.array_distinct(F.split(F.concat_ws(" ", "location", "artifact_reference"), "[^A-Za-z0-9_]+"))).alias("token"))
    return rows.where((F.length("token") >= 4) & F.col("token").rlike("[_0-9]")).groupBy("token").agg(F.count("*").alias("n"))


def t8_intrinsics(spark: SparkSession, sf: str) -> DataFrame:
    """Intrinsics that the bodies use, and in how many functions."""
    rows = _functions(spark, sf).select("fact_id", F.explode(F.regexp_extract_all("decompilation", F.lit(r"(?<![A-Za-z0-9_])((?:CONCAT|ZEXT|SEXT|SUB)[0-9]{2})(?![A-Za-z0-9_])"), 1)).alias("intrinsic"))
    return rows.groupBy("intrinsic").agg(F.count("*").alias("n"), F.countDistinct("fact_id").alias("n_functions"))


def t21_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Each signature in parts: return type, name, number of parameters."""
    rows = _functions(spark, sf).where("signature is not null").select("fact_id", squeeze(F.col("signature")).alias("s"))
    parts = r"^(.*?[ *])([A-Za-z_~][\w:~]*)\((.*)\)$"
    inside = F.trim(F.regexp_extract("s", parts, 3))
    n = F.when(inside.isin("", "void"), 0).otherwise(F.size(T.top_level(inside)))
    return rows.where(F.regexp_extract("s", parts, 2) != "").select("fact_id", F.trim(F.regexp_extract("s", parts, 1)).alias("return_type"), F.regexp_extract("s", parts, 2).alias("name"), n.alias("n_params"))


def t25_parameter_types(spark: SparkSession, sf: str) -> DataFrame:
    """Types of parameters over all signatures, with the width where it is known."""
    inside = F.regexp_extract("signature", r"\((.*)\)", 1)
    rows = _functions(spark, sf).where("signature is not null").select(F.explode(T.top_level(inside)).alias("p"))
    # a last word is the name only after a blank, a star or a reference, and if it is no basic type itself
    named, last = F.trim(F.regexp_extract("p", r"^(.*[ *&])\w+$", 1)), F.regexp_extract("p", r"(\w+)$", 1)
    kind = F.when((named != "") & ~last.isin(*WIDTHS), named).otherwise(F.col("p"))
    width = F.when(F.col("type").contains("*"), 8).otherwise(F.coalesce(*(F.when(F.col("type") == k, v) for k, v in WIDTHS.items())))
    return rows.select(kind.alias("type")).where("type <> ''").groupBy("type").agg(F.count("*").alias("n")).withColumn("width", width)


def t28_stack_locals(spark: SparkSession, sf: str) -> DataFrame:
    """Stack offsets of locals, as spelled in their names."""
    rows = _functions(spark, sf).select("fact_id", F.explode(F.array_distinct(F.regexp_extract_all("decompilation", F.lit(r"local_([0-9a-f]+)"), 1))).alias("h"))
    return rows.groupBy(F.conv("h", 16, 10).cast("bigint").alias("stack_offset")).agg(F.count("*").alias("n_functions"))


def x61_strings(spark: SparkSession, sf: str) -> DataFrame:
    """String facts without the quotes around them, if they have any."""
    rows = V.latest(V.facts(V.observations(spark, sf), "contains_string"), "subject")
    return rows.select("subject", F.coalesce(F.nullif(F.regexp_extract("value", r'(?s)^\s*"(.*)"\s*$', 1), F.lit("")), squeeze(F.col("value"))).alias("text")).where("text not in ('', '\"\"')")


QUERIES = {
    f.__name__: f
    for f in (
        f7_flags, f18_identifiers, f20_accepted, f23_field_names, f24_display_names, f33_apply_candidates, j13_method_slots, j25_function_references, j26_sibling_fields,
        a4_claim_breakdown, a11_dispositions, k6_subjects, u3_methods_without_special, u4_recovered, m8_next_snapshot, t5_significant_tokens, t8_intrinsics, t21_signatures,
        t25_parameter_types, t28_stack_locals, x61_strings,
    )
}

_w, _rc = O._with, O.RC
_OWNER = O.class_cte("(SELECT owner_class, subject, coalesce(is_constructor, false) AS c, coalesce(is_destructor, false) AS d FROM ff)", {"owner": "owner_class"}, ", subject, c, d", name="oc")
_SIG = O.squeeze("signature")
ORACLES = {
    "f7_flags": _w(O.OBS) + f"SELECT subject, predicate, v = 'true' AS flag FROM (SELECT subject, predicate, arg_max(value, id) AS v FROM obs WHERE predicate IN ({O.quoted(FLAGS)}) AND value IS NOT NULL GROUP BY 1, 2) WHERE v IN ('true', 'false')",
    "f18_identifiers": _w(O.OBS) + f"SELECT name, count(*) AS n FROM (SELECT {O.squeeze('value')} AS name FROM obs WHERE predicate = 'has_name' AND value IS NOT NULL) WHERE NOT regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$') GROUP BY 1",
    "f20_accepted": _w(O.HYP) + "SELECT id, subject, predicate, value, confidence FROM hyp WHERE status = 'ACCEPTED'",
    "f23_field_names": _w(O.HYP) + "SELECT subject, arg_max(value, id) AS field_name FROM hyp WHERE status = 'ACCEPTED' AND predicate = 'field_semantic_name' AND value IS NOT NULL GROUP BY 1",
    "f24_display_names": _w(O.OBS, O.HYP, O.NAMES, O.ROLES) + "SELECT names.subject, coalesce(role, name) AS display_name, CASE WHEN role IS NOT NULL THEN 'ACCEPTED' ELSE 'STATED' END AS name_source FROM names LEFT JOIN roles USING (subject)",
    "f33_apply_candidates": _w(O.OBS, O.HYP) + "SELECT id, subject, value FROM hyp WHERE status = 'ACCEPTED' AND predicate = 'semantic_role' AND subject LIKE '0x%' AND NOT EXISTS (SELECT 1 FROM obs o WHERE o.predicate = 'has_name' AND o.subject = hyp.subject AND o.value = hyp.value)",
    "j13_method_slots": _w(_rc, O.SLOTS) + "SELECT address, count(*) AS n_places, min(slot)::INT AS first_slot, count(DISTINCT class_name) AS n_classes FROM slots WHERE address IS NOT NULL GROUP BY 1",
    "j25_function_references": r"""SELECT name, count(*) AS n_functions FROM (SELECT fact_id, name AS own, unnest(list_distinct(regexp_extract_all(decompilation, '([A-Za-z_][A-Za-z0-9_]*)\(', 1))) AS name FROM function_facts)
      WHERE (own IS NULL OR own <> name) AND name IN (SELECT name FROM function_facts WHERE name IS NOT NULL) GROUP BY 1""",
    "j26_sibling_fields": _w(_rc, O.FIELDS.replace("unnest(ts) AS t", "1 AS t")) + """SELECT class_name, o AS field_offset, nx AS next_offset, nx - o AS room FROM (SELECT *, lead(o) OVER (PARTITION BY class_name ORDER BY o) AS nx FROM (SELECT DISTINCT class_name, o FROM flds WHERE o IS NOT NULL)) WHERE nx IS NOT NULL""",
    "k6_subjects": O._SCORED + "SELECT task, count(*) AS n, max(score) AS top_score FROM sc GROUP BY 1",
    "u3_methods_without_special": _w(O.FUNCTIONS, _OWNER) + "SELECT owner, count(*) AS n_methods FROM (SELECT DISTINCT subject, owner FROM oc WHERE owner IS NOT NULL AND subject IS NOT NULL EXCEPT SELECT subject, owner FROM oc WHERE c OR d) GROUP BY 1",
    "u4_recovered": _w(_rc, O.SLOTS, O.FUNCTIONS) + "SELECT address, max(a)::INT AS by_class, max(b)::INT AS by_function FROM (SELECT address, 1 AS a, 0 AS b FROM slots UNION ALL SELECT subject, 0, 1 FROM ff) WHERE address IS NOT NULL GROUP BY 1",
    "m8_next_snapshot": _w(O.HYP, O.INV, O.DEPS, "hit AS (SELECT id FROM hyp WHERE status = 'REJECTED' UNION SELECT source FROM deps JOIN hit ON target = id)", recursive=True)
    + "SELECT id, CASE WHEN h THEN 'STALE' ELSE status END AS status, NOT h AND last_verified_at IS NOT NULL AS verified FROM (SELECT hyp.*, hit.id IS NOT NULL AND status NOT IN ('REJECTED', 'STALE') AS h FROM hyp LEFT JOIN hit USING (id))",
    "t5_significant_tokens": "SELECT token, count(*) AS n FROM (SELECT id, unnest(list_distinct(regexp_split_to_array(concat_ws(' ', location, artifact_reference), '[^A-Za-z0-9_]+'))) AS token FROM (SELECT DISTINCT * FROM evidence)) WHERE length(token) >= 4 AND regexp_matches(token, '[_0-9]') GROUP BY 1",
    "t8_intrinsics": r"SELECT intrinsic, count(*) AS n, count(DISTINCT fact_id) AS n_functions FROM (SELECT fact_id, unnest(regexp_extract_all(decompilation, '\b((?:CONCAT|ZEXT|SEXT|SUB)[0-9]{2})\b', 1)) AS intrinsic FROM function_facts) GROUP BY 1",
    "t21_signatures": rf"""SELECT fact_id, trim(regexp_extract(s, '{(_p := r"^(.*?[ *])([A-Za-z_~][\w:~]*)\((.*)\)$")}', 1)) AS return_type, regexp_extract(s, '{_p}', 2) AS name,
      (CASE WHEN trim(regexp_extract(s, '{_p}', 3)) IN ('', 'void') THEN 0 ELSE len(string_split(trim(regexp_extract(s, '{_p}', 3)), ',')) END)::INT AS n_params FROM (SELECT fact_id, {_SIG} AS s FROM function_facts) WHERE regexp_extract(s, '{_p}', 2) <> ''""",
    "t25_parameter_types": rf"""SELECT type, n, (CASE WHEN contains(type, '*') THEN 8 {' '.join(f"WHEN type = '{k}' THEN {v}" for k, v in WIDTHS.items())} END)::INT AS width FROM (SELECT type, count(*) AS n FROM (
      SELECT trim(regexp_extract(trim(p), '^(.*?)\s*\w+$', 1)) AS type FROM (SELECT unnest(string_split(regexp_extract(signature, '\((.*)\)', 1), ',')) AS p FROM function_facts WHERE signature IS NOT NULL)) WHERE type <> '' GROUP BY 1)""",
    "t28_stack_locals": "SELECT ('0x' || h)::BIGINT AS stack_offset, count(*) AS n_functions FROM (SELECT fact_id, unnest(list_distinct(regexp_extract_all(decompilation, 'local_([0-9a-f]+)', 1))) AS h FROM function_facts) GROUP BY 1",
    "x61_strings": _w(O.OBS, f"s AS (SELECT subject, {O.squeeze('arg_max(value, id)')} AS v FROM obs WHERE predicate = 'contains_string' AND value IS NOT NULL GROUP BY 1)")
    + """SELECT subject, text FROM (SELECT subject, CASE WHEN length(v) > 1 AND starts_with(v, '"') AND ends_with(v, '"') THEN substr(v, 2, length(v) - 2) ELSE v END AS text FROM s) WHERE text <> ''""",
}
