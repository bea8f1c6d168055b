"""Registered queries of the subpackage, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.names import NOTHING_KNOWN, address_or_text, canonical_predicate, says_something, squeeze
from factloom.llm.leakage import RUN_MASKS, find_leaks
from factloom.llm.neardup import near_groups, near_pairs
from factloom.llm.packing import fills, pack
from factloom.llm.spans import shared_spans
from factloom.llm.survivors import judged_values, stated_survivors, survivors
from factloom.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of functions whose bodies nearly agree."""
    pairs = near_pairs(table(spark, sf, "function_facts"), "fact_id", "decompilation")
    return pairs.select(F.col("a").alias("fact_id_a"), F.col("b").alias("fact_id_b"))


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each function with near duplicates, its group and the number of its links."""
    groups = near_groups(table(spark, sf, "function_facts"), "fact_id", "decompilation")
    return groups.select(F.col("id").alias("fact_id"), "group_id", "n_links")


FUNCTION_FACTS = ("has_name", "has_signature", "calling_convention", "size_bytes")


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "observations").withColumn("predicate", canonical_predicate(F.col("predicate")))
    return rows.where(F.col("predicate").isin(*FUNCTION_FACTS)).select(
        "id", address_or_text(F.col("subject")).alias("subject"), "predicate", squeeze(F.col("value")).alias("value"),
        "confidence", F.concat_ws("@", "source", "artifact").alias("source"), "created_at", says_something(F.col("value")).alias("says"),
    )


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The surviving rows of each function's facts, by the order that is stated for them."""
    return stated_survivors(_facts(spark, sf)).select("first_id", "value_id", "created_id")


def p3_records(spark: SparkSession, sf: str) -> DataFrame:
    """The record of each group whose value the model of the sources holds most probable, with every value judged true."""
    return survivors(_facts(spark, sf)).select(
        "subject", "predicate", "value", F.round("probability", 4).alias("probability"), F.array_join("true_values", " | ").alias("true_values")
    )


def p3_true_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every stated value with the probability that it is true, by predicate and rounded probability."""
    values = judged_values(_facts(spark, sf))
    return values.groupBy("predicate", F.round("probability", 1).alias("probability")).agg(F.count("*").alias("n_values"))


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place in a container of 2,048 tokens."""
    return pack(table(spark, sf, "documents"))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full each container is."""
    return fills(pack(table(spark, sf, "documents"))).withColumn("unused", 2048 - F.col("used"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold 13 or more consecutive words of an evaluation item."""
    pairs = find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), masks=RUN_MASKS, substitutions=0)
    return pairs.where("exact_words >= 13").select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Per evaluation item: documents that hold it exactly or with few substituted words."""
    pairs = find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    return pairs.where("overlap_words >= 13").groupBy("item_id").agg(
        F.count("*").alias("n_docs"), F.count(F.when(F.col("exact_words") >= 13, 1)).alias("n_exact"), F.max("overlap_words").alias("longest")
    )


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of each document that lie in a span of 400 or more shared with another document."""
    return shared_spans(table(spark, sf, "documents")).select("doc_id", F.col("shared").alias("shared_chars"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p3_found, p3_records, p3_true_values, p8_pack, p8_fill, p9_found, p9_leaks, p10_found)}

_V = r"regexp_replace(value, '^\s+|\s+$', '', 'g')"
_DIGITS = r"regexp_extract(lower(regexp_replace(subject, '[\s`_]', '', 'g')), '^(?:0x)?0*([0-9a-f]+)h?$', 1)"
_PREDICATE = r"lower(regexp_replace(regexp_replace(regexp_replace(predicate, '^\s+|\s+$', '', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[\s\-]+', '_', 'g'))"
_NOTHING = ", ".join(f"'{x}'" for x in NOTHING_KNOWN)
_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_NEVER = "coalesce(created_at, TIMESTAMP '0001-01-01')"

ORACLES: dict[str, str] = {
    "p3_found": f"""WITH o AS (SELECT DISTINCT id, CASE WHEN {_DIGITS} <> '' THEN '0x' || {_DIGITS} ELSE trim(subject) END AS s, {_PREDICATE} AS p, value, coalesce(confidence, -1) AS c, {_NEVER} AS t FROM observations),
      g AS (SELECT * FROM o WHERE p IN ('has_name', 'has_signature', 'calling_convention', 'size_bytes'))
      SELECT min(id) AS first_id, arg_max(id, {{'c': c, 't': t, 'id': id}}) FILTER (coalesce({_V} <> '' AND lower({_V}) NOT IN ({_NOTHING}), false)) AS value_id,
      arg_max(id, {{'t': t, 'id': id}}) AS created_id FROM g GROUP BY s, p HAVING count(DISTINCT id) > 1""",
    "p9_found": f"""WITH d AS (SELECT doc_id, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT doc_id, {_WORDS} AS w FROM documents))),
      e AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT item_id, {_WORDS} AS w FROM eval_items)))
      SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (g)""",
    "p10_found": """WITH w AS (SELECT doc_id, i, hash(substr(text, i, 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400)),
      m AS (SELECT h FROM w GROUP BY 1 HAVING min(doc_id) < max(doc_id)), s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w WHERE h IN (SELECT h FROM m))
      SELECT doc_id, sum(CASE WHEN p IS NULL OR p + 400 <= i THEN 400 ELSE i - p END)::BIGINT AS shared_chars FROM s GROUP BY 1""",
    "p1_found": r"""WITH t AS (SELECT fact_id, regexp_extract_all(decompilation, '[A-Za-z0-9_]+|[^\sA-Za-z0-9_]') AS t FROM function_facts WHERE decompilation IS NOT NULL),
      s AS (SELECT DISTINCT fact_id, hash(t[i : i + 2]) AS g FROM (SELECT fact_id, t, unnest(range(1, len(t) - 1)) AS i FROM t WHERE len(t) >= 40)), n AS (SELECT fact_id, count(*) AS n FROM s GROUP BY 1),
      x AS (SELECT a.fact_id AS a, b.fact_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.fact_id < b.fact_id GROUP BY 1, 2)
      SELECT a AS fact_id_a, b AS fact_id_b FROM x JOIN n na ON na.fact_id = a JOIN n nb ON nb.fact_id = b WHERE k >= 0.6 * (na.n + nb.n - k)""",
}
