"""State as an append-only event log: inferences, flags, patches, sessions.

Nothing is changed in place; the current state is the latest event per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.joins import apart


def flags(log: DataFrame) -> DataFrame:
    """(target, flagged, last_flag, verified): a flag is verified by a later verification of its target."""
    summed = log.filter("kind in ('flag', 'verify')").groupBy("target").agg(
        F.count_if(F.col("kind") == "flag").alias("flagged"), F.max(F.when(F.col("kind") == "flag", F.col("seq"))).alias("last_flag"), F.max(F.when(F.col("kind") == "verify", F.col("seq"))).alias("last_verify"))
    return summed.filter("flagged > 0").select("target", "flagged", "last_flag", F.coalesce(F.col("last_verify") > F.col("last_flag"), F.lit(False)).alias("verified"))


def flag_events(log: DataFrame) -> DataFrame:
    """(seq, target, verified): every flag by itself; a later verification of its target verifies all flags before it."""
    last = log.filter("kind = 'verify'").groupBy("target").agg(F.max("seq").alias("checked"))
    flagged = log.filter("kind = 'flag'").select("seq", "target")
    return apart(flagged, "target").join(apart(last, "target"), ["target", "apart"], "left").select("seq", "target", F.coalesce(F.col("checked") > F.col("seq"), F.lit(False)).alias("verified"))


def latest_inferences(log: DataFrame) -> DataFrame:
    """The newest inference of each target."""
    return log.filter("kind = 'infer'").groupBy("target").agg(F.max_by(F.struct("seq", "confidence", "agent"), "seq").alias("x")).select("target", "x.seq", "x.confidence", "x.agent")


def agents(log: DataFrame) -> DataFrame:
    """(target, agents, inferences, newest): several agents on one target are shown one by one, else the newest counts."""
    return log.filter("kind = 'infer'").groupBy("target").agg(F.countDistinct("agent").alias("agents"), F.count("*").alias("inferences"), F.max("seq").alias("newest"))


def operations(log: DataFrame) -> DataFrame:
    return log.groupBy("kind").agg(F.count("*").alias("n"))


def top_targets(log: DataFrame, most: int = 20) -> DataFrame:
    return log.groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(most)


def patches(log: DataFrame) -> DataFrame:
    """(patch_id, status, seq) from events propose, apply, reject: only a pending patch moves, so the first move counts."""
    order = Window.partitionBy("patch_id").orderBy("seq")
    moves = log.filter("kind in ('apply', 'reject')").withColumn("place", F.row_number().over(order)).filter("place = 1").select("patch_id", "kind", F.col("seq").alias("moved"))
    proposed = log.filter("kind = 'propose'").groupBy("patch_id").agg(F.min("seq").alias("seq"))
    joined = proposed.join(moves, "patch_id", "left").withColumn("moved", F.when(F.col("moved") > F.col("seq"), F.col("moved")))
    status = F.when(F.col("moved").isNull(), "pending").when(F.col("kind") == "apply", "applied").otherwise("rejected")
    return joined.select("patch_id", status.alias("status"), F.coalesce("moved", "seq").alias("seq"))


def next_patch_number(patch_ids: DataFrame) -> DataFrame:
    return patch_ids.agg((F.coalesce(F.max(F.regexp_extract("patch_id", r"([0-9]+)$", 1).cast("int")), F.lit(0)) + 1).alias("number"))


def drifted(proposals: DataFrame, symbols: DataFrame) -> DataFrame:
    """Patches (patch_id, id, signature_hash) whose symbol has another signature now or is gone."""
    now = symbols.select("id", F.substring(F.sha2("signature", 256), 1, 8).alias("now"))
    return proposals.join(now, "id", "left").filter(F.col("now").isNull() | (F.col("now") != F.col("signature_hash")))


def resume(cached: DataFrame, generated: DataFrame) -> DataFrame:
    """The cached briefing (project, text) if there is one, else a generated one."""
    return cached.withColumnRenamed("text", "kept").join(generated, "project", "full").select("project", F.coalesce("kept", "text").alias("text"))
