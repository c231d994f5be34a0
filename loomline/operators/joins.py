"""Pairing and reconciliation joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.operators.ordering import drawn_number, ordinal
from loomline.session import new_path, written

#: Destinations that a plan takes at most.
MOST_DESTINATIONS = 10_000


def preferred(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``, which should be total."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def pair_captions(captions: DataFrame, images: DataFrame, extensions: list[str], key: str = "stem_path") -> DataFrame:
    """Captions with the image of the first listed extension; ``paired`` tells those without one."""
    rank = F.array_position(F.array(*[F.lit(e) for e in extensions]), F.col("ext"))
    best = images.where(F.col("ext").isin(extensions)).groupBy(key).agg(F.min_by("path", F.struct(rank, "path")).alias("image_path"))
    return captions.join(best, key, "left").withColumn("paired", F.col("image_path").isNotNull())


def without_partner(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner."""
    return left.join(right.select(*key).distinct(), key, "left_anti")


def transfer(work: DataFrame, reference: DataFrame) -> DataFrame:
    """Captions for work rows (name, raw_name, folder) from reference rows (name, folder, seq, caption).

    By the cleaned name, else by the raw one; of several candidates one in the
    same folder comes first, then the earliest. The reference is cut to one row
    per name and folder and one per name before it meets the work, so each join
    adds at most one row to a work row. A chosen row's caption counts even where
    it is null.
    """
    best = F.min_by(F.struct("caption", F.lit(True).alias("found")), "seq")
    here = reference.groupBy("name", "folder").agg(best.alias("here"))
    anywhere = reference.groupBy("name").agg(best.alias("anywhere"))

    def chosen(rows: DataFrame, name: str, out: str) -> DataFrame:
        near = here.select(F.col("name").alias(name), "folder", "here")
        far = anywhere.select(F.col("name").alias(name), "anywhere")
        return rows.join(near, [name, "folder"], "left").join(far, name, "left").withColumn(out, F.coalesce("here", "anywhere")).drop("here", "anywhere")

    found = chosen(chosen(work, "name", "_clean"), "raw_name", "_raw")
    return found.select(*work.columns, F.coalesce("_clean", "_raw")["caption"].alias("caption"))


def reconcile(refs: DataFrame, local: DataFrame, forced: bool = False) -> DataFrame:
    """Local files (path, base) with how a reference (path, base) chose them: path, base, or null.

    A file is chosen by its whole path; else by its base name if that names one
    file alone, or always where ``forced``.
    """
    by_path = local.join(refs.select("path").distinct(), "path", "left_semi").select("path", F.lit("path").alias("chosen"))
    rest = local.join(by_path.select("path"), "path", "left_anti")
    single = local.groupBy("base").agg(F.count(F.lit(1)).alias("n")).where(F.lit(forced) | (F.col("n") == 1)).select("base")
    open_refs = refs.join(by_path.select("path"), "path", "left_anti").select("base").distinct()
    by_base = rest.join(single, "base", "left_semi").join(open_refs, "base", "left_semi").select("path", F.lit("base").alias("chosen"))
    return local.join(by_path.unionByName(by_base), "path", "left")


def locate(local: DataFrame, manifest: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Local rows with the first place of a manifest (repo, path, key), or ``NOT FOUND``."""
    first = manifest.groupBy(key).agg(F.min_by(F.concat_ws("/", "repo", "path"), F.struct(*order)).alias("location"))
    return local.join(first, key, "left").withColumn("location", F.coalesce("location", F.lit("NOT FOUND")))


def theta_first_match(vectors: DataFrame, known: DataFrame, threshold: float, most_known: int = 10_000) -> DataFrame:
    """vec_id, name, distance of the first known vector (by ``seq``) within the threshold; null where none is.

    The known side is broadcast behind a check of its size; a larger one is
    refused, as the distance to all must be taken.
    """
    n = known.count()
    if n > most_known:
        raise ValueError(f"{n} known vectors; at most {most_known} are compared")
    distance = F.sqrt(F.aggregate(F.zip_with("v.embedding", "k.embedding", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    pairs = vectors.alias("v").join(F.broadcast(known.alias("k")), distance <= threshold, "left")
    return pairs.groupBy("v.vec_id").agg(F.min_by(F.struct("k.name", F.round(distance, 6).alias("distance")), "k.seq").alias("m")).select("vec_id", "m.name", "m.distance")


def downloads_by_model(downloads: DataFrame, models: DataFrame, owner: Column, seconds: int, at: str = "timestamp") -> DataFrame:
    """model_id, model_name, bucket, downloads: how far an owner's counters (model_id, model_name, download_count) rose in each time bucket."""
    own = models.where(owner).select(F.col("id").alias("model_id")).distinct()
    bucket = (F.floor(F.unix_timestamp(F.col(at).cast("timestamp")) / seconds) * seconds).cast("long")
    rows = downloads.join(own, "model_id", "left_semi")
    return rows.groupBy("model_id", "model_name", bucket.alias("bucket")).agg((F.max("download_count") - F.min("download_count")).alias("downloads"))


def last_value_by_key(rows: DataFrame, values: DataFrame, key: str, value: str, seq: list[str]) -> DataFrame:
    """Rows with the value last associated with their key (a URL, say); null where none is. Empty keys and values associate nothing."""
    kept = values.where((F.col(key) != "") & F.col(value).isNotNull())
    last = kept.groupBy(key).agg(F.max_by(value, F.struct(*seq)).alias(value))
    return rows.join(last, key, "left")


def merge_right_wins(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join in which a non-null value of the right wins."""
    names = [c for c in left.columns if c not in key]
    joined = left.alias("l").join(right.alias("r"), key, "full")
    return joined.select(*key, *[F.coalesce(F.col(f"r.{c}"), F.col(f"l.{c}")).alias(c) for c in names])


def merge_history(a: DataFrame, b: DataFrame, key: list[str], largest: list[str], smallest: list[str], flags: list[str], latest: list[str]) -> DataFrame:
    """Two states of a daily history as one: maxima, minima, ors, and values where the second wins; nulls count as missing."""
    j = a.alias("a").join(b.alias("b"), key, "full")
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    return j.select(
        *key,
        *[F.greatest(x(c), y(c)).alias(c) for c in largest],
        *[F.least(x(c), y(c)).alias(c) for c in smallest],
        *[(F.coalesce(x(c), F.lit(False)) | F.coalesce(y(c), F.lit(False))).alias(c) for c in flags],
        *[F.coalesce(y(c), x(c)).alias(c) for c in latest],
    )


def zip_merge(items: DataFrame, separator: str = " ") -> DataFrame:
    """row, merged: the items (list_id, pos, value) of several lists side by side, in order of list_id.

    There are as many rows as the longest list has items; shorter lists start
    again. Items of a list go by ``pos``, then value. No list is held whole: each
    item is sent to the rows it belongs to, and a row holds one of each list.
    """
    placed = ordinal(items.select("list_id", "pos", "value"), [F.col("list_id"), F.col("pos"), F.col("value")], "_place")
    sizes = placed.groupBy("list_id").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_size"))
    longest = sizes.agg(F.max("_size")).first()[0] or 0
    rows = placed.join(sizes, "list_id").select("list_id", "value", F.explode(F.sequence(F.col("_place") - F.col("_first"), F.lit(longest - 1), F.col("_size"))).alias("row"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("list_id", F.col("value").alias("v")))), lambda x: x["v"])
    return rows.groupBy("row").agg(F.array_join(parts, separator).alias("merged"))


def any_equal(left: DataFrame, right: DataFrame, keys: list[str], id_left: str, id_right: str) -> DataFrame:
    """Pairs that agree in any of the keys: a union of equi-joins instead of a join on a disjunction."""
    found = None
    for k in keys:
        pairs = left.where(F.col(k).isNotNull()).select(id_left, k).join(right.where(F.col(k).isNotNull()).select(id_right, k), k).select(id_left, id_right)
        found = pairs if found is None else found.union(pairs)
    return found.distinct()


def plan_uploads(files: DataFrame, destinations: DataFrame, existing: DataFrame, policy: Column) -> DataFrame:
    """Every file (path, sha256, bytes) at every destination (repo, prefix) with its action.

    upload where nothing lies at the target, ``same`` where the checksum agrees,
    else what ``policy`` says: skip, overwrite or fail. Destinations are a
    configuration and are broadcast; more than MOST_DESTINATIONS are refused, as
    the plan has a row for every file at each of them.
    """
    if destinations.limit(MOST_DESTINATIONS + 1).count() > MOST_DESTINATIONS:
        raise ValueError(f"more than {MOST_DESTINATIONS} destinations")
    jobs = files.join(F.broadcast(destinations)).withColumn("target", F.concat_ws("/", F.nullif("prefix", F.lit("")), "path"))
    there = existing.select("repo", F.col("path").alias("target"), F.col("sha256").alias("there_sha"))
    action = F.when(F.col("there_sha").isNull(), "upload").when(F.col("there_sha") == F.col("sha256"), "same").otherwise(policy)
    return jobs.join(there, ["repo", "target"], "left").withColumn("action", action)


def with_backgrounds(subjects: DataFrame, backgrounds: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """Every subject (id) with ``draws`` backgrounds (place from 0, path), drawn with replacement; no cross product is made."""
    n = backgrounds.count()
    picks = subjects.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picks = picks.withColumn("place", drawn_number(F.col("id"), F.col("draw"), seed=seed) % max(n, 1))
    return picks.join(backgrounds, "place")


def filter_if_known(rows: DataFrame, attribute: str, wanted: Column) -> DataFrame:
    """A filter that holds only where any row carries the attribute at all."""
    known = rows.agg(F.max(F.col(attribute).isNotNull()).alias("_known"))
    return rows.join(F.broadcast(known)).where(~F.coalesce("_known", F.lit(False)) | F.coalesce(wanted, F.lit(False))).drop("_known")


def most_specific(paths: DataFrame, column: str = "path") -> DataFrame:
    """Paths without those that are a folder above another one: each path's ancestors are exploded and removed by an anti join."""
    parts = F.split(column, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    ancestors = paths.select(F.explode(above).alias("_above"), column).where(F.col("_above") != F.col(column)).select(F.col("_above").alias(column)).distinct()
    return paths.join(ancestors, column, "left_anti")


def handled(records: DataFrame, entries: DataFrame) -> DataFrame:
    """Records (id, fingerprint, original_id) with their entry (seq, fingerprint, original_id): by fingerprint, else by the original, the first of several."""
    by_print = entries.groupBy("fingerprint").agg(F.min("seq").alias("by_print"))
    by_origin = entries.where("original_id IS NOT NULL").groupBy("original_id").agg(F.min("seq").alias("by_origin"))
    return records.join(by_print, "fingerprint", "left").join(by_origin, "original_id", "left").withColumn("entry", F.coalesce("by_print", "by_origin")).drop("by_print", "by_origin")


#: Undecided vectors of which a round finds the exemplars; the exemplars of one round are sent to every task.
ROUND_VECTORS = 4096


def _first_within(vectors: np.ndarray, places: np.ndarray, exemplars: np.ndarray, own: np.ndarray, threshold: float) -> np.ndarray:
    """For each vector the number of the first exemplar within the threshold (an exemplar is its own, NaN or not), else -1."""
    found, left = np.full(len(vectors), -1), np.arange(len(vectors))
    for k in range(len(exemplars)):
        if not len(left):
            break
        hit = (np.linalg.norm(vectors[left] - exemplars[k], axis=1) <= threshold) | (places[left] == own[k])
        found[left[hit]] = k
        left = left[~hit]
    return found


def _exemplars(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Places of the vectors that are within the threshold of no exemplar before them."""
    chosen, left = [], np.arange(len(vectors))
    while len(left):
        chosen.append(left[0])
        left = left[1:]
        left = left[~(np.linalg.norm(vectors[left] - vectors[chosen[-1]], axis=1) <= threshold)]
    return np.array(chosen, int)


def online_clusters(vectors: DataFrame, order: str, threshold: float) -> DataFrame:
    """order, cluster: in order, a vector joins the first exemplar of the whole table within the threshold or becomes one.

    A round takes the first ROUND_VECTORS undecided vectors, finds their
    exemplars in one task and assigns all undecided vectors to them in
    parallel; earlier exemplars are within the threshold of none of these. Equal
    places in the order are told apart by the vectors. A round decides all that
    it took, so there is at most one for each ROUND_VECTORS exemplars; the work
    is the number of vectors times that of exemplars.
    """
    spark = vectors.sparkSession
    rows = vectors.select(order, F.col("embedding").cast("array<double>").alias("embedding"))
    left = written(ordinal(rows, [F.col(order), F.col("embedding")], "_place"), "clusters-rows")
    schema = T.StructType([*left.schema.fields, T.StructField("cluster", T.LongType())])
    matrix = lambda column, n: column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    paths, base = [], 0

    def first_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # ROUND_VECTORS rows at most
        if held:
            table = pa.Table.from_batches(held).sort_by("_place").combine_chunks()
            yield from table.take(pa.array(_exemplars(matrix(table["embedding"].combine_chunks(), table.num_rows), threshold))).to_batches()

    while (found := left.orderBy("_place").limit(ROUND_VECTORS).select("_place", "embedding").coalesce(1).mapInArrow(first_ones, "_place long, embedding array<double>").toArrow().sort_by("_place")).num_rows:
        shared = spark.sparkContext.broadcast((matrix(found["embedding"].combine_chunks(), found.num_rows), found["_place"].to_numpy(), base))

        def assign(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            exemplars, own, base = shared.value
            for batch in batches:
                if batch.num_rows:
                    found = _first_within(matrix(batch["embedding"], batch.num_rows), batch["_place"].to_numpy(), exemplars, own, threshold)
                    yield batch.append_column("cluster", pa.array(found + base, pa.int64(), mask=found < 0))

        paths.append(new_path(spark, "clusters-round"))
        left.mapInArrow(assign, schema).write.parquet(paths[-1])
        left = spark.read.schema(schema).parquet(paths[-1]).where("cluster IS NULL").drop("cluster")
        base += found.num_rows
    if not paths:
        return spark.createDataFrame([], schema).select(order, "cluster")
    return spark.read.schema(schema).parquet(*paths).where("cluster IS NOT NULL").select(order, "cluster")
