"""Scans of file trees and text sources as DataFrames."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.ordering import ordinal
from loomline.session import tasks, written

IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp", "bmp", "gif")


def _named(files: DataFrame) -> DataFrame:
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.withColumns(
        {
            "parent": F.regexp_extract("path", r"^(.*)/[^/]*$", 1),
            "base": base,
            "stem": F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""),
            "ext": F.lower(F.regexp_extract(base, r".\.([^.]*)$", 1)),
        }
    )


#: A piece of rows that leaves a task at once.
PIECE_ROWS, PIECE_BYTES = 1000, 8 << 20

_LISTED = pa.schema([("lead", pa.string()), ("place", pa.string()), ("folder", pa.bool_()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64())])


def _store(lead: str, place: str, open_: dict[str, pafs.FileSystem]) -> pafs.FileSystem:
    """The file system of a place, by what its paths begin with; those opened before are taken again."""
    if lead not in open_:
        open_[lead] = pafs.LocalFileSystem() if lead == "file:" else pafs.FileSystem.from_uri(lead + quote(place))[0]
    return open_[lead]


def _roots(spark: SparkSession, roots: list[str]) -> list[tuple[str, str]] | None:
    """Each root as what its path begins with and its place in the store; None if one is a pattern or in a store that Spark alone opens."""
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        shown = path.getFileSystem(conf).makeQualified(path).toString()
        if any(c in root for c in "*?[{"):
            return None
        if shown.startswith("file:"):
            found.append(("file:", shown.removeprefix("file:")))
            continue
        try:
            _, place = pafs.FileSystem.from_uri(shown)
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
            return None
        if not shown.endswith(place):
            return None
        found.append((shown.removesuffix(place), place))
    return found


def _hidden(place: str) -> bool:
    """As Spark's listing has it."""
    name = place.rsplit("/", 1)[-1]
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _listed(spark: SparkSession, roots: list[tuple[str, str]]) -> DataFrame:
    """lead, place, modificationTime, length of the files below the roots, as written tables.

    Folders are listed in tasks, level by level; one task lists one folder at a
    time, so what a task holds is the names of the largest folder. Nothing is
    listed on the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[str, pafs.FileSystem] = {}
        for batch in batches:
            for lead, place in zip(*batch.columns, strict=True):
                lead, place = lead.as_py(), place.as_py()
                store = _store(lead, place, stores)
                own = store.get_file_info(place)
                inside = [own] if own.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(place))
                for at in range(0, len(inside), 10 * PIECE_ROWS):
                    rows = [f for f in inside[at : at + 10 * PIECE_ROWS] if not _hidden(f.path)]
                    columns = [[lead] * len(rows), [f.path for f in rows], [f.type == pafs.FileType.Directory for f in rows], [(f.mtime_ns or 0) // 1000 for f in rows], [f.size for f in rows]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(t.type) if k == 3 else pa.array(c, t.type) for k, (c, t) in enumerate(zip(columns, _LISTED, strict=True))], schema=_LISTED)

    level, found = spark.createDataFrame(roots, "lead string, place string"), None
    while True:
        dealt = level.repartition(tasks(spark), "place")
        rows = written(dealt.mapInArrow(run, "lead string, place string, folder boolean, modificationTime timestamp, length long"), "listing")
        here = rows.where("NOT folder").drop("folder")
        found = here if found is None else found.union(here)
        level = rows.where("folder").select("lead", "place")
        if level.isEmpty():
            return found


def _contents(files: DataFrame) -> DataFrame:
    """The files of a listing with ``content``, dealt evenly over tasks; a task holds a file, or some small ones up to PIECE_BYTES."""
    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[str, pafs.FileSystem] = {}
        for batch in batches:
            leads, places, begin, held, size = batch["lead"], batch["place"], 0, [], 0
            for k in range(batch.num_rows):
                place = places[k].as_py()
                with _store(leads[k].as_py(), place, stores).open_input_stream(place) as source:
                    held.append(source.read())
                size += len(held[-1])
                if len(held) >= PIECE_ROWS or size >= PIECE_BYTES or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(held)).columns, pa.array(held, pa.binary())], [*names, "content"])
                    begin, held, size = k + 1, [], 0

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.repartition(tasks(files.sparkSession), "place").mapInArrow(run, kinds + ", content binary")


def scan(spark: SparkSession, roots: list[str], recursive: bool = True, content: bool = False) -> DataFrame:
    """path, modificationTime, length (and content), parent, base, stem, ext of the files under the roots.

    Whole trees are listed and read in tasks, and the listing is a written table;
    patterns, single folders and stores that only Spark opens go by Spark's own
    listing, on its driver, which leaves empty files out. Without ``content`` no
    file is opened. A root that does not exist fails the scan; ``scan_present``
    skips it.
    """
    known = _roots(spark, roots) if recursive else None
    if known is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(roots)
        return _named(files if content else files.drop("content"))
    files = _listed(spark, known)
    files = _contents(files) if content else files
    return _named(files.select(F.concat("lead", "place").alias("path"), "modificationTime", "length", *(["content"] if content else [])))


def scan_present(spark: SparkSession, roots: list[str], **options) -> DataFrame:
    """Like ``scan``, without roots that cannot be listed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = [r for r in roots if (p := jvm.org.apache.hadoop.fs.Path(r)).getFileSystem(conf).exists(p)]
    return scan(spark, there, **options)


def walked(files: DataFrame) -> DataFrame:
    """The files with ``place``, from 0: folder by folder in order of their paths, names in order inside each. Numbered by ranges, not in one task."""
    return ordinal(files, [F.col("parent"), F.col("base"), F.col("path")])


def images(files: DataFrame, extensions: tuple[str, ...] = IMAGE_EXTENSIONS, exact_case: bool = False) -> DataFrame:
    """Files with an image extension: in any case, or all lower or all upper alone."""
    raw = F.regexp_extract("base", r"\.([^.]*)$", 1)
    return files.where(raw.isin([*extensions, *(e.upper() for e in extensions)]) if exact_case else F.col("ext").isin(list(extensions)))


def subfolders(files: DataFrame, root: str, direct: bool = False) -> DataFrame:
    """Folders with files under a root: all, or its direct children."""
    below = F.regexp_replace("parent", "^" + root.rstrip("/") + "/?", "")
    folder = F.split_part(below, F.lit("/"), F.lit(1)) if direct else F.col("parent")
    return files.where(F.col("parent").startswith(root.rstrip("/"))).select(folder.alias("folder")).distinct().where("folder <> ''")


def _any_match(columns: list[Column], patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        regex = fnmatch.translate(p).replace("\\Z", "$").replace("\\z", "$").replace("(?>", "(?:")
        for c in columns:
            out = out | c.rlike("^" + regex)
    return out


def match_globs(files: DataFrame, root: str, includes: list[str] = (), excludes: list[str] = (), extensions: list[str] = ()) -> DataFrame:
    """Files by include and exclude patterns on the whole path, the path under the root or the name.

    Exclusion wins; with include patterns the extension is not looked at.
    """
    relative = F.regexp_replace("path", "^.*?" + root.rstrip("/") + "/", "")
    columns = [F.col("path"), relative, F.col("base")]
    wanted = _any_match(columns, list(includes)) if includes else (F.col("ext").isin(list(extensions)) if extensions else F.lit(True))
    return files.where(wanted & ~_any_match(columns, list(excludes)))


def visible(files: DataFrame) -> DataFrame:
    return files.where(~F.col("base").startswith("."))


def texts(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, text of whole text files below the roots, listed and read as in ``scan``."""
    known = _roots(spark, roots)
    if known is None:
        return spark.read.text(roots, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return _contents(_listed(spark, known)).select(F.concat("lead", "place").alias("path"), F.col("content").cast("string").alias("text"))


def first_lines(texts_: DataFrame) -> DataFrame:
    return texts_.withColumn("text", F.split_part("text", F.lit("\n"), F.lit(1)))


def lines(spark: SparkSession, roots: list[str], comments: bool = True) -> DataFrame:
    """Lines without blank ones and, with ``comments``, without those that begin with ``#``."""
    rows = spark.read.text(roots).select(F.trim("value").alias("line")).where("line <> ''")
    return rows.where("line NOT LIKE '#%'") if comments else rows


def delimited(rows: DataFrame, delimiter: str, column: str = "line") -> DataFrame:
    """url, text: lines divided once at a delimiter."""
    at = F.position(F.lit(delimiter), F.col(column))
    head = F.when(at > 0, F.substr(F.col(column), F.lit(1), at - 1)).otherwise(F.col(column))
    return rows.select(head.alias("url"), F.when(at > 0, F.substr(F.col(column), at + len(delimiter))).alias("text"))


def json_records(spark: SparkSession, roots: list[str], schema: str) -> DataFrame:
    """Records of JSON files of a schema; malformed files give no row."""
    rows = texts(spark, roots).select("path", F.from_json("text", schema, {"mode": "PERMISSIVE"}).alias("record"))
    empty = F.to_json("record") == F.lit("{}")
    return rows.where(F.col("record").isNotNull() & ~empty)


def json_lines(bodies: DataFrame, column: str, schema: str) -> DataFrame:
    """Objects of bodies that hold a JSON object, an array of them, or one per line; other lines are ignored."""
    body = F.trim(F.col(column))
    parts = F.when(body.startswith("["), F.from_json(body, f"array<{schema}>")).otherwise(F.transform(F.split(body, "\n"), lambda x: F.from_json(x, schema)))
    return bodies.select(*[c for c in bodies.columns if c != column], F.explode(F.filter(parts, lambda r: r.isNotNull())).alias("record")).where(F.to_json("record") != "{}")


def harvest(bodies: DataFrame, column: str) -> DataFrame:
    """Every object that has an ``id``, at any place of a JSON document, once per id.

    Each level is one pass of ``variant_explode`` over a written table; the last
    level is the one that has no objects or arrays left, however deep that is.
    Nothing is parsed in Python.
    """
    keep = [c for c in bodies.columns if c != column]
    level = bodies.select(*keep, F.try_parse_json(F.col(column)).alias("v")).where("v IS NOT NULL")
    found = None
    while True:
        level = written(level, "harvest-level")
        here = level.where("try_variant_get(v, '$.id', 'string') IS NOT NULL").selectExpr(*keep, "try_variant_get(v, '$.id', 'string') AS id", "to_json(v) AS object")
        found = here if found is None else found.unionByName(here)
        level = level.where("schema_of_variant(v) LIKE 'OBJECT%' OR schema_of_variant(v) LIKE 'ARRAY%'")
        if level.isEmpty():
            break
        level = level.lateralJoin(bodies.sparkSession.tvf.variant_explode(F.col("v").outer())).select(*keep, F.col("value").alias("v"))
    return found.groupBy(*keep, "id").agg(F.min("object").alias("object"))


def srcset_best(pages: DataFrame, id_col: str = "page_id", column: str = "srcset") -> DataFrame:
    """The candidate of a srcset with the largest width or density; ties go to the first."""
    parts = F.filter(F.transform(F.split(column, r",\s+"), F.trim), lambda x: x != "")
    rows = pages.select(id_col, F.posexplode(parts).alias("pos", "part"))
    number = F.coalesce(F.regexp_extract("part", r"\s([\d.]+)[wx]$", 1).try_cast("double"), F.lit(1.0))
    return rows.groupBy(id_col).agg(F.max_by(F.regexp_extract("part", r"^(\S+)", 1), F.struct(number, -F.col("pos"))).alias("best"))


def id_range(spark: SparkSession, start: int, end: int, known: DataFrame, id_col: str = "id") -> DataFrame:
    """Every id of a range with the known record, nulls where there is none."""
    return spark.range(start, end + 1).withColumnRenamed("id", id_col).join(known, id_col, "left")


def not_yet(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key has not been handled: the resumable part of a sync."""
    return rows.join(done.select(*key).distinct(), key, "left_anti")


def by_basename(files: DataFrame) -> DataFrame:
    """base, n, first_path: how many files share a name."""
    return files.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


def folders_with_images(files: DataFrame, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """Folders that hold a file with exactly such an extension; other cases do not count."""
    raw = F.regexp_extract("base", r"\.([^.]*)$", 1)
    return files.where(raw.isin(list(extensions))).select("parent").distinct()
