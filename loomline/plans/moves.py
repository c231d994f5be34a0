"""File changes as tables of what to do: source, destination, action. A sink may apply a plan; queries never change inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def route(files: DataFrame, folder: Column, action: str = "move") -> DataFrame:
    """src, dst, action: every file into the folder a column names, its name kept."""
    return files.select(F.col("path").alias("src"), F.concat_ws("/", folder, F.regexp_extract("path", r"([^/]*)$", 1)).alias("dst"), F.lit(action).alias("action"))


def _suffixed(dst: Column, suffix: Column) -> Column:
    stem, ext = F.regexp_replace(dst, r"(?<=[^/])\.[^./]*$", ""), F.regexp_extract(dst, r"[^/](\.[^./]*)$", 1)
    return F.concat(stem, F.lit("_"), suffix, ext)


def numbered(plan: DataFrame, taken: DataFrame | None = None, first: int = 1) -> DataFrame:
    """Destinations made unique: the second of equal ones gets ``_1`` (or counts from ``first``), the next ``_2`` …

    Paths of ``taken`` (path) count as the first holder of their name.
    """
    place = F.row_number().over(Window.partitionBy("dst").orderBy("src")) - 1
    rows = plan.withColumn("_k", place)
    if taken is not None:
        held = taken.select(F.col("path").alias("dst"), F.lit(1).alias("_held")).distinct()
        rows = rows.join(held, "dst", "left").withColumn("_k", F.col("_k") + F.coalesce("_held", F.lit(0))).drop("_held")
    return rows.withColumn("dst", F.when(F.col("_k") == 0, F.col("dst")).otherwise(_suffixed(F.col("dst"), (F.col("_k") + first - 1).cast("string")))).drop("_k")


def hashed(plan: DataFrame, digits: int = 8) -> DataFrame:
    """Destinations made unique by a hash of the source, the same each time."""
    n = F.count(F.lit(1)).over(Window.partitionBy("dst"))
    return plan.withColumn("dst", F.when(n == 1, F.col("dst")).otherwise(_suffixed(F.col("dst"), F.substring(F.md5("src"), 1, digits))))


def overwriting(plan: DataFrame) -> DataFrame:
    """Of equal destinations the last source wins; the others are replaced."""
    last = F.row_number().over(Window.partitionBy("dst").orderBy(F.col("src").desc()))
    return plan.withColumn("action", F.when(last == 1, F.col("action")).otherwise("replaced"))


def changed(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Rows whose value changes: what a sink has to write."""
    return rows.where(~F.col(old).eqNullSafe(F.col(new)))


def with_backup(plan: DataFrame, suffix: str = ".bak", keep: bool = True, existing: DataFrame | None = None) -> DataFrame:
    """A copy to ``src + suffix`` before each change; one that exists is kept or overwritten."""
    copies = plan.select("src", F.concat("src", F.lit(suffix)).alias("dst"), F.lit("backup").alias("action"))
    if keep and existing is not None:
        copies = copies.join(existing.select(F.col("path").alias("dst")), "dst", "left_anti").select("src", "dst", "action")
    return copies.unionByName(plan.select("src", "dst", "action"))


def retention(files: DataFrame, keep: int, uploaded: Column) -> DataFrame:
    """Removals of the oldest uploaded files while there are more than ``keep``."""
    newest = F.row_number().over(Window.partitionBy("parent").orderBy(F.col("modificationTime").desc(), "path"))
    return files.withColumns({"_rank": newest, "_up": uploaded}).where((F.col("_rank") > keep) & F.col("_up")).select(F.col("path").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit("remove").alias("action"))


def undo(plan: DataFrame) -> DataFrame:
    """The plan that takes moves back."""
    return plan.where("action = 'move'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "action")
