"""Uploads as commits: what each repository gets sent, and what it copies from where that content was sent first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def commit_plan(jobs: DataFrame) -> DataFrame:
    """repo, target, sha256, bytes, phase, source_repo and source_target of the jobs (repo, target, sha256, bytes, action) that change something.

    Content is sent once, to its first place by repository and target: phase 1.
    Its other places copy from there in phase 2, when that commit exists, and
    send no bytes. Jobs whose action is neither upload nor overwrite have no
    part. Content with very many places is summed up before it meets them; a job
    without a checksum is sent by itself.
    """
    todo = jobs.where(F.col("action").isin("upload", "overwrite")).select("repo", "target", "sha256", "bytes")
    first = todo.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min(F.struct("repo", "target")).alias("first"))
    rows = todo.join(first, "sha256", "left")
    sent = F.col("first").isNull() | (F.struct("repo", "target") == F.col("first"))
    source = lambda name: F.when(~sent, F.col(f"first.{name}")).alias(f"source_{name}")
    return rows.select("repo", "target", "sha256", "bytes", F.when(sent, 1).otherwise(2).alias("phase"), source("repo"), source("target"))


def commits(planned: DataFrame) -> DataFrame:
    """repo, phase, files, bytes: one commit for each repository and phase of ``commit_plan``, with the bytes that it sends."""
    sent = F.when(F.col("phase") == 1, F.col("bytes")).otherwise(0)
    return planned.groupBy("repo", "phase").agg(F.count(F.lit(1)).alias("files"), F.sum(sent).alias("bytes"))


def unfinished(planned: DataFrame, done: DataFrame) -> DataFrame:
    """The rows of a plan whose commit (repo, phase of ``done``, which has those that succeeded) is still to be made.

    Copies also wait for the commit that sends what they copy: ``ready`` tells
    whether it is done.
    """
    made = done.select("repo", "phase").distinct()
    left = planned.join(made, ["repo", "phase"], "left_anti")
    first = made.where("phase = 1").select(F.col("repo").alias("source_repo"), F.lit(True).alias("_sent"))
    return left.join(first, "source_repo", "left").withColumn("ready", (F.col("phase") == 1) | F.coalesce("_sent", F.lit(False))).select(*planned.columns, "ready")
