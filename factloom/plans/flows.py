"""Values that flow through calls and parameters of decompiled bodies; subjects to recover; with their SQL.

A body's calls are those whose arguments hold no call themselves, after casts are taken out; of several bodies of a
function the one with the highest id counts, of several functions of one name the one with the least address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import graph as G
from factloom.operators import views as V
from factloom.operators.provenance import provenance
from factloom.plans import oracles as O
from factloom.plans.reference import WIDTHS, _functions, _roots, _slots, u1_startup_only
from factloom.session import cut

FIELD_HOPS, VALUE_HOPS = 4, 3
_HEADER = r"(?s)^[^{(]*\(([^{]*)\)[^{)]*\{"
_CAST = r"\(([a-z0-9_]+ ?\**)\)([A-Za-z_&*(0-9])"
_CALL = r"([A-Za-z_][A-Za-z0-9_]*\([^()]*\))"
# Words before a parenthesis that are no call.
NO_CALL = ("if", "while", "for", "switch", "return", "sizeof")


def _width(c: Column) -> Column:
    return F.coalesce(*(F.when(c == k, v) for k, v in WIDTHS.items()))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """(subject, name, body): the body with the highest id of each function."""
    rows = _functions(spark, sf).where("subject is not null and decompilation is not null")
    return rows.groupBy("subject").agg(F.max_by(F.struct("name", "decompilation"), "fact_id").alias("f")).select("subject", F.col("f.name").alias("name"), F.col("f.decompilation").alias("body"))


def _parameters(texts: DataFrame) -> DataFrame:
    """(subject, pos, parameter, scale): named parameters of the header, and by how many bytes one step moves them."""
    inside = F.trim(F.regexp_extract("body", _HEADER, 1))
    rows = texts.select("subject", F.posexplode(T.top_level(F.when(inside != "void", inside).otherwise(""))).alias("pos", "p"))
    kind = F.trim(F.regexp_extract("p", r"^(.*?)[ *]*[A-Za-z_]\w*$", 1))
    scale = F.when(F.col("p").contains("*"), _width(kind)).when(_width(kind).isNotNull(), 1)
    return rows.select("subject", "pos", F.regexp_extract("p", r"([A-Za-z_]\w*)$", 1).alias("parameter"), scale.alias("scale")).where("parameter <> ''")


def _arguments(texts: DataFrame) -> DataFrame:
    """(subject, name, callee, n_args, pos, arg): arguments of each distinct call in a body."""
    code = F.regexp_replace(F.regexp_extract("body", r"(?s)\{(.*)$", 1), _CAST, "$2")
    calls = texts.select("subject", "name", F.explode(F.array_distinct(F.regexp_extract_all(code, F.lit(_CALL), 1))).alias("c"))
    callee = F.regexp_extract("c", r"^(\w+)\(", 1)
    args = F.transform(F.split(F.regexp_extract("c", r"(?s)\((.*)\)$", 1), ","), lambda x: F.trim(x))
    rows = calls.select("subject", "name", callee.alias("callee"), args.alias("args")).where(~F.col("callee").isin(*NO_CALL) & (F.col("name").isNull() | (F.col("name") != F.col("callee"))))
    return rows.select("subject", "name", "callee", F.size("args").alias("n_args"), F.posexplode("args").alias("pos", "arg"))


def _named(texts: DataFrame) -> DataFrame:
    return texts.where("name is not null").groupBy(F.col("name").alias("callee")).agg(F.min("subject").alias("target"))


def _flows(texts: DataFrame) -> DataFrame:
    """(subject, pos, target, target_pos, shift): parameters that are passed on, as they are or a fixed number of bytes further."""
    arguments = _arguments(texts).withColumnRenamed("pos", "target_pos")
    shape = r"^([A-Za-z_]\w*)(?: \+ (0x[0-9a-fA-F]+|[0-9]+))?$"
    read = arguments.select("subject", "callee", "target_pos", F.regexp_extract("arg", shape, 1).alias("parameter"), F.regexp_extract("arg", shape, 2).alias("step")).where("parameter <> ''")
    step = F.when(F.col("step") == "", 0).otherwise(T.int_literal(F.col("step")))
    met = read.join(_parameters(texts), ["subject", "parameter"]).join(_named(texts), "callee")
    return met.select("subject", "pos", "target", "target_pos", (step * F.col("scale")).alias("shift")).where("shift is not null").distinct()


def t12_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Functions that bodies call by name, by the number of arguments, and in how many bodies."""
    rows = _arguments(_texts(spark, sf)).where("pos = 0")
    count = F.when((F.col("n_args") == 1) & (F.col("arg") == ""), 0).otherwise(F.col("n_args"))
    return rows.groupBy("callee", count.alias("n_args")).agg(F.countDistinct("subject").alias("n_functions"))


def j14_resolved_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls by name of functions whose body is known, and whether they pass as many arguments as the header takes."""
    texts = cut(_texts(spark, sf))
    rows = _arguments(texts).where("pos = 0")
    count = F.when((F.col("n_args") == 1) & (F.col("arg") == ""), 0).otherwise(F.col("n_args"))
    calls = rows.select("subject", "callee", count.alias("n_args")).distinct().join(_named(texts), "callee")
    takes = _parameters(texts).groupBy(F.col("subject").alias("target")).agg(F.count("*").cast("int").alias("takes"))
    wide = calls.join(takes, "target", "left")
    return wide.select("subject", "callee", "target", "n_args", (F.col("n_args") == F.coalesce("takes", F.lit(0))).alias("fits"))


def t30_dereferences(spark: SparkSession, sf: str) -> DataFrame:
    """Dereferences through a cast at a fixed place of a named pointer, by type, and in how many functions."""
    found = F.regexp_extract_all("body", F.lit(_DEREF), 0)
    rows = _texts(spark, sf).select("subject", F.explode(F.array_distinct(found)).alias("d"))
    kind, step = F.regexp_extract("d", _DEREF, 1), F.regexp_extract("d", _DEREF, 3)
    rows = rows.select("subject", kind.alias("type"), F.when(step == "", 0).otherwise(T.int_literal(step)).alias("field_offset"))
    return rows.groupBy("type", "field_offset").agg(F.countDistinct("subject").alias("n_functions"))


_DEREF = r"\*\(([a-z0-9_]+) \*\)\(?([A-Za-z_]\w*)(?: \+ (0x[0-9a-fA-F]+|[0-9]+)\))?"


def _fields(texts: DataFrame) -> DataFrame:
    """(subject, pos, field_offset, width): fields that a body reads or writes through a parameter itself."""
    rows = texts.select("subject", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(_DEREF), 0))).alias("d"))
    step = F.regexp_extract("d", _DEREF, 3)
    read = rows.select("subject", F.regexp_extract("d", _DEREF, 2).alias("parameter"), _width(F.regexp_extract("d", _DEREF, 1)).alias("width"), F.when(step == "", 0).otherwise(T.int_literal(step)).alias("step"))
    met = read.join(_parameters(texts), ["subject", "parameter"])
    return met.select("subject", "pos", (F.col("step") * F.col("scale")).alias("field_offset"), "width").where("field_offset is not null and width is not null").distinct()


def a18_passed_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Functions that get, as their first argument, a field of a caller's parameter: from how many callers, and the least and greatest place."""
    rows = _flows(cut(_texts(spark, sf))).where("target_pos = 0 and shift <> 0")
    return rows.groupBy("target").agg(F.countDistinct("subject").alias("n_callers"), F.min("shift").alias("least_offset"), F.max("shift").alias("greatest_offset"))


def g13_field_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of the object behind each parameter, also those that callees use up to four calls away, their places added up."""
    texts = cut(_texts(spark, sf))
    flows = cut(_flows(texts).withColumnRenamed("shift", "delta"))
    seen = new = cut(_fields(texts).withColumn("hops", F.lit(0)))
    for hop in range(1, FIELD_HOPS + 1):
        if new.isEmpty():
            break
        told = new.select(F.col("subject").alias("target"), F.col("pos").alias("target_pos"), "field_offset", "width")
        up = flows.join(told, ["target", "target_pos"]).select("subject", "pos", (F.col("field_offset") + F.col("delta")).alias("field_offset"), "width").distinct()
        new = cut(up.join(seen, ["subject", "pos", "field_offset", "width"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = cut(seen.unionByName(new))
    return seen


def g14_value_consumers(spark: SparkSession, sf: str) -> DataFrame:
    """Where the value of each parameter is passed on unchanged, up to three calls away, and in how many steps at least."""
    flows = cut(_flows(cut(_texts(spark, sf))).where("shift = 0").select("subject", "pos", "target", "target_pos").distinct())
    seen = new = cut(flows.withColumn("hops", F.lit(1)))
    for hop in range(2, VALUE_HOPS + 1):
        ahead = flows.select(F.col("subject").alias("target"), F.col("pos").alias("target_pos"), F.col("target").alias("t"), F.col("target_pos").alias("tp"))
        far = new.join(ahead, ["target", "target_pos"]).select("subject", "pos", F.col("t").alias("target"), F.col("tp").alias("target_pos")).distinct()
        new = cut(far.join(seen, ["subject", "pos", "target", "target_pos"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = cut(seen.unionByName(new))
    return seen


def u2_recoverable(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects to recover as functions: those with an accepted role, and other named ones outside classes with a real body that are
    application code, or reachable and of unknown origin, and no startup code."""
    obs = V.observations(spark, sf)
    edges = cut(V.call_edges(obs))
    roles = V.hypotheses(spark, sf).where("status = 'ACCEPTED' and predicate = 'semantic_role' and subject is not null").select("subject", F.lit("role").alias("rule")).distinct()
    named = V.facts(obs, "has_name").select("subject").where("subject is not null").distinct()
    methods = _slots(spark, sf).where("address is not null").select(F.col("address").alias("subject"))
    body = _functions(spark, sf).where("subject is not null").groupBy("subject").agg(F.bool_or(~T.is_degenerate(F.col("decompilation"))).alias("body")).where("body")
    rest = named.join(methods, "subject", "left_anti").join(roles, "subject", "left_anti").join(body, "subject", "left_semi")
    reach = G.reachable(edges, _roots(obs, edges)).select(F.col("node").alias("subject"), F.lit(True).alias("reached"))
    wide = rest.join(provenance(obs), "subject").join(reach, "subject", "left").join(u1_startup_only(spark, sf).withColumn("startup", F.lit(True)), "subject", "left")
    found = wide.where("provenance = 'APPLICATION' or (provenance = 'UNKNOWN' and reached and startup is null)")
    return roles.unionByName(found.select("subject", F.lower("provenance").alias("rule")))


QUERIES = {f.__name__: f for f in (t12_calls, j14_resolved_calls, t30_dereferences, a18_passed_offsets, g13_field_facts, g14_value_consumers, u2_recoverable)}

_WIDTH = lambda x: f"CASE {x} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in WIDTHS.items())} END"
_STEP = lambda x: f"CASE WHEN {x} = '' THEN 0 ELSE {x}::BIGINT END"
_TEXTS = "txt AS (SELECT subject, f.n AS name, f.d AS body FROM (SELECT subject, arg_max({'n': name, 'd': decompilation}, fact_id) AS f FROM ff WHERE subject IS NOT NULL AND decompilation IS NOT NULL GROUP BY 1))"
_PARTS = rf"""par0 AS (SELECT subject, (generate_subscripts(l, 1) - 1)::INT AS pos, trim(unnest(l)) AS p FROM (SELECT subject, string_split(x, ',') AS l FROM (SELECT subject, trim(regexp_extract(body, '{_HEADER}', 1)) AS x FROM txt) WHERE x NOT IN ('', 'void'))),
par AS (SELECT subject, pos, regexp_extract(p, '([A-Za-z_]\w*)$', 1) AS parameter, CASE WHEN contains(p, '*') THEN {_WIDTH("k")} WHEN {_WIDTH("k")} IS NOT NULL THEN 1 END AS scale
  FROM (SELECT *, trim(regexp_extract(p, '^(.*?)[ *]*[A-Za-z_]\w*$', 1)) AS k FROM par0) WHERE regexp_extract(p, '([A-Za-z_]\w*)$', 1) <> '')"""
_ARGS = rf"""args AS (SELECT subject, name, callee, len(l) AS n_args, (generate_subscripts(l, 1) - 1)::INT AS pos, trim(unnest(l)) AS arg FROM (
  SELECT subject, name, regexp_extract(c, '^(\w+)\(', 1) AS callee, string_split(regexp_extract(c, '(?s)\((.*)\)$', 1), ',') AS l FROM (
    SELECT subject, name, unnest(list_distinct(regexp_extract_all(regexp_replace(regexp_extract(body, '(?s)\{{(.*)$', 1), '{_CAST}', '\2', 'g'), '{_CALL}', 1))) AS c FROM txt))
  WHERE callee NOT IN ({O.quoted(NO_CALL)}) AND (name IS NULL OR name <> callee)),
fnm AS (SELECT name AS callee, min(subject) AS target FROM txt WHERE name IS NOT NULL GROUP BY 1)"""
_SHAPE = r"^([A-Za-z_]\w*)(?: \+ (0x[0-9a-fA-F]+|[0-9]+))?$"
_FLOWS = rf"""flows AS (SELECT DISTINCT a.subject, par.pos, fnm.target, a.pos AS target_pos, {_STEP("a.st")} * scale AS delta FROM (SELECT subject, callee, pos, regexp_extract(arg, '{_SHAPE}', 1) AS parameter, regexp_extract(arg, '{_SHAPE}', 2) AS st FROM args) a
  JOIN par ON par.subject = a.subject AND par.parameter = a.parameter JOIN fnm ON fnm.callee = a.callee WHERE a.parameter <> '' AND scale IS NOT NULL)"""
_READS = rf"derefs AS (SELECT subject, regexp_extract(d, '{_DEREF}', 1) AS type, regexp_extract(d, '{_DEREF}', 2) AS parameter, {_STEP(f'regexp_extract(d, {chr(39)}{_DEREF}{chr(39)}, 3)')} AS st FROM (SELECT subject, unnest(list_distinct(regexp_extract_all(body, '{_DEREF}', 0))) AS d FROM txt))"
_FIELDS = f"fields AS (SELECT DISTINCT subject, pos, st * scale AS field_offset, {_WIDTH('type')} AS width FROM derefs JOIN par USING (subject, parameter) WHERE scale IS NOT NULL AND {_WIDTH('type')} IS NOT NULL)"
_COUNT = "(CASE WHEN n_args = 1 AND arg = '' THEN 0 ELSE n_args END)::INT"
_ALL = (O.FUNCTIONS, _TEXTS, _PARTS, _ARGS, _FLOWS)
ORACLES = {
    "t12_calls": O._with(O.FUNCTIONS, _TEXTS, _ARGS) + f"SELECT callee, {_COUNT} AS n_args, count(DISTINCT subject) AS n_functions FROM args WHERE pos = 0 GROUP BY 1, 2",
    "j14_resolved_calls": O._with(*_ALL) + f"""SELECT c.subject, c.callee, fnm.target, c.n AS n_args, c.n = coalesce(t.takes, 0) AS fits FROM (SELECT DISTINCT subject, callee, {_COUNT} AS n FROM args WHERE pos = 0) c JOIN fnm USING (callee)
      LEFT JOIN (SELECT subject, count(*) AS takes FROM par GROUP BY 1) t ON t.subject = fnm.target""",
    "t30_dereferences": O._with(O.FUNCTIONS, _TEXTS, _READS) + "SELECT type, st AS field_offset, count(DISTINCT subject) AS n_functions FROM derefs GROUP BY 1, 2",
    "a18_passed_offsets": O._with(*_ALL) + "SELECT target, count(DISTINCT subject) AS n_callers, min(delta) AS least_offset, max(delta) AS greatest_offset FROM flows WHERE target_pos = 0 AND delta <> 0 GROUP BY 1",
    "g13_field_facts": O._with(*_ALL, _READS, _FIELDS, "ff4 AS (SELECT subject, pos, field_offset, width, 0 AS hops FROM fields UNION SELECT f.subject, f.pos, ff4.field_offset + f.delta, ff4.width, hops + 1 FROM ff4 JOIN flows f ON f.target = ff4.subject AND f.target_pos = ff4.pos WHERE hops < 4)", recursive=True)
    + "SELECT subject, pos, field_offset, width, min(hops)::INT AS hops FROM ff4 GROUP BY 1, 2, 3, 4",
    "g14_value_consumers": O._with(*_ALL, "same AS (SELECT DISTINCT subject, pos, target, target_pos FROM flows WHERE delta = 0)",
        "ch AS (SELECT *, 1 AS hops FROM same UNION SELECT ch.subject, ch.pos, s.target, s.target_pos, hops + 1 FROM ch JOIN same s ON s.subject = ch.target AND s.pos = ch.target_pos WHERE hops < 3)", recursive=True)
    + "SELECT subject, pos, target, target_pos, min(hops)::INT AS hops FROM ch GROUP BY 1, 2, 3, 4",
    "u2_recoverable": O._with(*O._ALL, O.HYP, O.RC, O.SLOTS, "ro AS (SELECT DISTINCT subject FROM hyp WHERE status = 'ACCEPTED' AND predicate = 'semantic_role' AND subject IS NOT NULL)", recursive=True)
    + """SELECT subject, 'role' AS rule FROM ro UNION ALL SELECT subject, lower(provenance) FROM (SELECT DISTINCT subject FROM obs WHERE predicate = 'has_name' AND value IS NOT NULL AND subject IS NOT NULL) JOIN prov USING (subject)
      WHERE subject NOT IN (SELECT address FROM slots WHERE address IS NOT NULL) AND subject NOT IN (SELECT subject FROM ro) AND subject IN (SELECT subject FROM judged WHERE NOT degenerate AND subject IS NOT NULL)
      AND (provenance = 'APPLICATION' OR (provenance = 'UNKNOWN' AND subject IN (SELECT node FROM reached) AND subject NOT IN (SELECT node FROM startup)))""",
}
