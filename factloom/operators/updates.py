"""Set-oriented changes of the evidence tables: each takes whole tables and gives the next state.

Ids that name no row change nothing; a null id names none; a change that is stated twice counts once.  Only rows that
are named change, all other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The texts by which a rejection and its revision are recorded.
GATE_REJECTED = "semantic_role '%s' rejected: subject's provenance is not Application"
PREMISE_INVALIDATED = (
    "semantic_role '%s' was rejected when this subject's provenance wasn't Application; provenance now classifies as Application, "
    "so the rejection's premise no longer holds -- marked STALE for reevaluation"
)
NOT_APPLICATION = "PROVENANCE_NOT_APPLICATION"


def existing(ids: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """The rows of ids whose column names a row of table."""
    return ids.join(table.select(F.col("id").alias(column)), column, "left_semi")


def superseded(observations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Observations after each pair (old, new) of existing ids: old has the status SUPERSEDED and points to new.

    Of several new ids for one old the greatest counts.
    """
    valid = existing(existing(pairs.where("old <> new"), "old", observations), "new", observations).groupBy(F.col("old").alias("id")).agg(F.max("new").alias("_new"))
    both = observations.join(valid, "id", "left")
    status = F.when(F.col("_new").isNotNull(), "SUPERSEDED").otherwise(F.col("status"))
    return both.withColumns({"status": status, "superseded_by": F.coalesce("_new", "superseded_by")}).select(*observations.columns)


def _marked(rows: DataFrame, ids: DataFrame, **changes: Column) -> DataFrame:
    hit = ids.select("id").where("id is not null").distinct().withColumn("_hit", F.lit(True))
    both = rows.join(hit, "id", "left")
    return both.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in changes.items()}).select(*rows.columns)


def retracted(observations: DataFrame, ids: DataFrame) -> DataFrame:
    """Observations after those in ids (id) have the status RETRACTED."""
    return _marked(observations, ids, status=F.lit("RETRACTED"))


def verified(hypotheses: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Hypotheses after those in ids (id) were verified at a time."""
    return _marked(hypotheses, ids, last_verified_at=at)


def rejected(hypotheses: DataFrame, reasons: DataFrame) -> DataFrame:
    """Hypotheses after those in reasons (id, kind) are REJECTED for that reason (the least, if there are several)."""
    why = reasons.where("id is not null").groupBy("id").agg(F.min("kind").alias("_kind"))
    both, shape = hypotheses.join(why, "id", "left"), hypotheses.schema["rejection_reason"].dataType
    reason = F.struct(*(F.col("_kind").alias(f.name) if f.name == "kind" else F.lit(None).cast(f.dataType).alias(f.name) for f in shape.fields))
    hit = F.col("_kind").isNotNull()
    return both.withColumns({"status": F.when(hit, "REJECTED").otherwise(F.col("status")), "rejection_reason": F.when(hit, reason).otherwise(F.col("rejection_reason"))}).select(*hypotheses.columns)


def valid_evidence(evidence: DataFrame, observations: DataFrame) -> DataFrame:
    """The evidence whose observation exists."""
    return existing(evidence, "observation_id", observations)


def attached(listed: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, evidence_id): the evidence listed for each hypothesis, then what links (id, evidence_id) adds to it.

    listed: the same columns, as they are; evidence that doesn't exist is not added.
    """
    return listed.select("id", "evidence_id").unionByName(existing(links.select("id", "evidence_id"), "evidence_id", evidence)).distinct()


def valid_dependencies(dependencies: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """The distinct dependencies (source, target) of which both ends exist."""
    return existing(existing(dependencies.select("source", "target"), "source", hypotheses), "target", hypotheses).distinct()


def gate_rejections(hypotheses: DataFrame, observations: DataFrame) -> DataFrame:
    """(id, observation_id): each role and the greatest active observation that records its rejection by the provenance gate."""
    said = observations.where("status = 'ACTIVE' and predicate = 'provenance_gate_rejected'").select("subject", F.col("value").alias("text"), F.col("id").alias("o"))
    roles = hypotheses.where("predicate = 'semantic_role'").select("id", "subject", F.format_string(GATE_REJECTED, "value").alias("text"))
    return roles.join(said, ["subject", "text"]).groupBy("id").agg(F.max("o").alias("observation_id"))


def premise_links(observations: DataFrame) -> DataFrame:
    """(old, new): active gate rejections and the newest active revision of a premise of the same subject."""
    live = observations.where("status = 'ACTIVE'")
    new = live.where("predicate = 'rejection_premise_invalidated'").groupBy("subject").agg(F.max("id").alias("new"))
    return live.where("predicate = 'provenance_gate_rejected'").select("subject", F.col("id").alias("old")).join(new, "subject").select("old", "new").distinct()


def with_reasons(hypotheses: DataFrame, observations: DataFrame) -> DataFrame:
    """Hypotheses with ``kind``, the kind of their rejection: the one that is kept, else the gate's if it recorded one."""
    gate = gate_rejections(hypotheses, observations).select("id", F.lit(NOT_APPLICATION).alias("_gate"))
    lost = (F.col("status") == "REJECTED") & F.col("rejection_reason").isNull()
    return hypotheses.join(gate, "id", "left").withColumn("kind", F.coalesce("rejection_reason.kind", F.when(lost, F.col("_gate")))).drop("_gate")


def reconsidered(hypotheses: DataFrame, observations: DataFrame, provenance: DataFrame) -> DataFrame:
    """(id, subject, text, superseded): roles rejected only since their subject wasn't application code, and now is.

    Each turns STALE; text is the observation to record and superseded the rejection's record that it replaces, null if
    there is none.  Gate rejections that have a revision already are superseded by it first.  A role counts as rejected by
    the gate if its reason says so, or if it has none and an active observation records it.
    """
    now = superseded(observations, premise_links(observations))
    lost = with_reasons(hypotheses, now).where(f"status = 'REJECTED' and kind = '{NOT_APPLICATION}'")
    app = provenance.where("provenance = 'APPLICATION'").select("subject")
    back = lost.join(app, "subject", "left_semi").join(gate_rejections(hypotheses, now), "id", "left")
    return back.select("id", "subject", F.format_string(PREMISE_INVALIDATED, "value").alias("text"), F.col("observation_id").alias("superseded"))
