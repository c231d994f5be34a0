"""Counts, roll-ups and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import tags as T


def tag_frequency(captions: DataFrame, column: str = "text") -> DataFrame:
    """tag, n over all tags of all captions."""
    return captions.select(F.explode(T.parse(F.col(column))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def first_tag_frequency(captions: DataFrame, column: str = "text") -> DataFrame:
    """tag, n over first tags; captions without tags have none."""
    return captions.select(F.get(T.parse(F.col(column)), F.lit(0)).alias("tag")).where("tag IS NOT NULL").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def first_line_tag_frequency(captions: DataFrame, column: str = "text", first: bool = False) -> DataFrame:
    """tag, n over the first line's tags, case kept, the empty string counted; of each line all tags or the first."""
    parts = F.transform(F.split(F.split_part(F.col(column), F.lit("\n"), F.lit(1)), ","), T.strip)
    return captions.where(F.col(column).isNotNull()).select(F.explode(F.slice(parts, 1, 1) if first else parts).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def bucket_delta(events: DataFrame, key: list[str], seconds: int, value: str = "value", at: str = "ts") -> DataFrame:
    """key, bucket (epoch seconds), delta: the largest less the smallest reading of each time bucket."""
    bucket = (F.floor(F.unix_timestamp(F.col(at).cast("timestamp")) / seconds) * seconds).cast("long")
    return events.groupBy(*key, bucket.alias("bucket")).agg((F.max(value) - F.min(value)).alias("delta"))


def depth_counts(paths: DataFrame, depth: int, column: str = "path") -> DataFrame:
    """folder, n: at the given depth files of the whole subtree, above it a folder's own files."""
    parts = F.split(column, "/")
    folder = F.array_join(F.slice(parts, 1, F.least(F.size(parts) - 1, F.lit(depth))), "/")
    return paths.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"))


def folder_counts(paths: DataFrame, depth: int, counted: Column, column: str = "path") -> DataFrame:
    """folder, n: like ``depth_counts`` over files of which only some are counted.

    A folder at the depth is there with a count of 0 too; one above only with
    files of its own that count.
    """
    parts = F.split(column, "/")
    level = F.least(F.size(parts) - 1, F.lit(depth))
    found = paths.groupBy(F.array_join(F.slice(parts, 1, level), "/").alias("folder")).agg(F.count_if(counted).alias("n"), F.max(level).alias("_level"))
    return found.where((F.col("_level") == depth) | (F.col("n") > 0)).select("folder", "n")


def planned_totals(plan: DataFrame, action: str = "action", size: str = "bytes") -> DataFrame:
    """One row: files, uploads, copies and skips of a plan, and the bytes to upload and to copy."""
    of = lambda kind: F.col(action) == kind
    total = lambda kind: F.coalesce(F.sum(F.when(of(kind), F.col(size))), F.lit(0)).cast("long")
    return plan.agg(
        F.count_if(of("upload") | of("copy")).alias("files_planned"),
        F.count_if(of("upload")).alias("uploads_planned"),
        F.count_if(of("copy")).alias("copies_planned"),
        F.count_if(of("skip")).alias("skipped_planned"),
        total("upload").alias("bytes_planned"),
        total("copy").alias("copy_bytes_planned"),
    )


def share_rollup(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts per (outer, inner) and per inner over all, with the share of each level's total."""
    counted = rows.groupingSets([[outer, inner], [inner]], outer, inner).agg(F.count(F.lit(1)).alias("n"), F.grouping(outer).cast("int").alias("combined"))
    total = F.sum("n").over(Window.partitionBy("combined", outer))
    return counted.withColumn("percent", F.round(100 * F.col("n") / total, 4))


def mean_median(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Mean and exact median; an even count takes the middle two's mean."""
    return rows.groupBy(*key).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.median(value), 6).alias("median"))


def most_common(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The commonest value per key; ties go to the smallest."""
    counted = rows.groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*key).agg(F.min_by(F.struct(value, "n"), F.struct((-F.col("n")).alias("n"), value)).alias("m")).select(*key, f"m.{value}", "m.n")


def move_to_front(values: Column, value: Column) -> Column:
    """An array with the value's first occurrence moved to the front; unchanged without one."""
    at = F.array_position(values, value).cast("int")
    rest = F.concat(F.slice(values, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(values, at + 1, F.greatest(F.size(values) - at, F.lit(0))))
    return F.when(at > 0, F.concat(F.array(value), rest)).otherwise(values)


def duplicates(rows: DataFrame, key: list[str], member: str) -> DataFrame:
    """Keys with several members: count, smallest and largest member."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("first_member"), F.max(member).alias("last_member")).where("n > 1")


def duplicate_members(rows: DataFrame, key: list[str], member: str) -> DataFrame:
    """Every member of the keys that have several, with their number: a row each, so that no key's list has to fit a task."""
    many = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.select(*key, member).join(many, key)


def distinct_per_period(rows: DataFrame, at: str, unit: str, identity: Column, key: list[str]) -> DataFrame:
    """Exact distinct identities per key and UTC day, Monday week or month."""
    return rows.groupBy(*key, F.date_trunc(unit, F.col(at)).cast("date").alias("period")).agg(F.count_distinct(identity).alias("n"))


def gauge(rows: DataFrame, key: list[str], at: str, value: str, order: list[str]) -> DataFrame:
    """samples, least, most and last known reading per key; missing readings count for none of the three."""
    seen = F.when(F.col(value).isNotNull(), F.struct(at, *order))
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("samples"), F.min(value).alias("least"), F.max(value).alias("most"), F.max_by(value, seen).alias("last_known"))


def repeats(epochs: int, multiplier: Column) -> Column:
    """Repeats of a folder: the product rounded up, at least one."""
    return F.greatest(F.ceil(F.lit(epochs) * multiplier), F.lit(1)).cast("long")


def tally(rows: DataFrame, key: list[str]) -> DataFrame:
    """planned, succeeded, failed per key of rows with ``status``, and whether a key failed everywhere."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("planned"), n("ok").alias("succeeded"), n("failed").alias("failed"))
    return out.withColumn("failed_everywhere", F.expr("planned > 0 AND succeeded = 0 AND failed > 0"))


def merged_records(rows: DataFrame, key: list[str], fields: list[str], seq: str) -> DataFrame:
    """One row per key; of each field the last value that is not null, of equally late ones the largest."""
    return rows.groupBy(*key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(seq, f))).alias(f) for f in fields])


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts, white space collapsed, joined by pipes; nulls are empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.trim(F.regexp_replace(p.cast("string"), r"\s+", " ")), F.lit("")) for p in parts]), 256)


def cleanup_plan(rows: DataFrame, group: str, member: str, tags: str, original: Column, position: str) -> DataFrame:
    """keep or remove for every member of a group of two or more distinct members.

    Kept is the member with the most tags (the earliest of several), without any
    tags the original, else the earliest. A group with a member that is not a
    number blocks its removals.
    """
    once = rows.groupBy(group, member).agg(F.max(F.size(tags)).alias("n_tags"), F.max(original).alias("is_original"), F.min(position).alias("at"))
    w = Window.partitionBy(group)
    best = w.orderBy(F.col("n_tags").desc(), F.when(F.col("n_tags") > 0, F.lit(False)).otherwise(F.col("is_original")).desc(), "at", member)
    ranked = once.withColumns({"size": F.count(F.lit(1)).over(w), "blocked": F.max(~F.col(member).cast("string").rlike("^[0-9]+$")).over(w), "rank": F.row_number().over(best)})
    action = F.when(F.col("rank") == 1, "keep").when(F.col("blocked"), "blocked").otherwise("remove")
    return ranked.where("size >= 2").select(group, member, action.alias("action"))


def balances(rows: DataFrame, key: list[str], order: list[str], delta: str, name: str = "balance") -> DataFrame:
    """The rows with a running sum of ``delta`` per key that never falls below 0: what is taken back of nothing is lost.

    It is the plain running sum less its least value so far, where that is
    negative. Rows of a key are sorted in one task, which can spill.
    """
    upto = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn(name, F.sum(F.coalesce(delta, F.lit(0))).over(upto))
    return summed.withColumn(name, F.col(name) - F.least(F.lit(0), F.min(name).over(upto)))
