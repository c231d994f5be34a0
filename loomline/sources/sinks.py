"""Sinks: reports, dataset files, scripts and archives as DataFrames and Spark writes."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.session import tasks, written
from loomline.sources.files import PIECE_BYTES, PIECE_ROWS


def text_report(rows: DataFrame, key: str, value: str, path: str) -> None:
    """``key: value`` lines."""
    rows.select(F.concat_ws(": ", F.col(key).cast("string"), F.col(value).cast("string")).alias("value")).write.mode("overwrite").text(path)


def csv_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def json_map(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """A JSON object of key to value per group; a group's entries must fit a row."""
    return rows.groupBy(group).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_set(F.struct(key, value))))).alias("json"))


def dataset_toml(folders: DataFrame, settings: dict[str, object]) -> DataFrame:
    """A TOML dataset entry per folder (folder, repeats); numbers and booleans as Python prints them, text quoted."""
    shown = lambda v: str(v) if isinstance(v, (bool, int, float)) else f'"{v}"'
    lines = [F.lit(f"{k} = {shown(v)}") for k, v in settings.items()]
    return folders.select("folder", F.concat_ws("\n", F.lit("[[datasets.subsets]]"), F.format_string('image_dir = "%s"', "folder"), F.format_string("num_repeats = %d", "repeats"), *lines).alias("toml"))


def script_lines(files: DataFrame, command: Column) -> DataFrame:
    """seq, line: the command of each file by (folder, path), a header before the first of each folder."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rows = files.select("path", folder.alias("folder"), command.alias("command"))
    first = F.row_number().over(Window.partitionBy("folder").orderBy("path")) == 1
    lines = F.when(first, F.array(F.concat(F.lit("# "), F.col("folder")), F.col("command"))).otherwise(F.array("command"))
    return rows.withColumn("lines", lines).select("folder", "path", F.posexplode("lines").alias("part", "line")).orderBy("folder", "path", "part")


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Write every row (path under ``root``, content) as a file of its own; path and bytes of each, as a written table.

    A file is written beside its place under a name of its own and then moved
    there, so that nobody sees half a file and a task that runs again changes
    nothing. A null content is an empty file. Of rows that share a path any one
    wins: resolve them with ``plans.moves`` first. ``..`` in a path is refused.
    Rows are dealt evenly over tasks, as a short table may stand for many files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pafs.FileSystem.from_uri(root)
        there: set[str] = set()
        for batch in batches:
            sizes = []
            for path, content in zip(*batch.columns, strict=True):
                path, data = path.as_py(), content.as_py() or b""
                if ".." in path.split("/"):
                    raise ValueError(f"{path} leaves its root")
                place = f"{folder}/{path.strip('/')}"
                parent = place.rsplit("/", 1)[0]
                if parent not in there:
                    files.create_dir(parent, recursive=True)
                    there = there if len(there) < PIECE_ROWS else set()
                    there.add(parent)
                part = f"{place}.{uuid.uuid4().hex}.part"
                with files.open_output_stream(part) as sink:
                    sink.write(data)
                files.move(part, place)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["path", "bytes"])

    dealt = rows.select("path", F.col("content").cast("binary").alias("content")).repartition(tasks(rows.sparkSession), "path")
    return written(dealt.mapInArrow(run, "path string, bytes long"), "files-written")


class _Pieces(io.RawIOBase):
    """A sink that cannot seek, for an archive that is written as it grows."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.sink.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at


#: What an archive holds: each file alone, the files of a source, or those of a folder.
ZIP_MODES = {"file": lambda: F.col("path"), "source": lambda: F.split_part("path", F.lit("/"), F.lit(1)), "folder": lambda: F.regexp_extract("path", r"^(.*)/[^/]*$", 1)}


def zipped(files: DataFrame, mode: str, out: str) -> DataFrame:
    """archive, path, entries, bytes of the ZIP files that the files (path, content) make in the folder ``out``, one for each group of ZIP_MODES.

    A group's files come sorted by path and go into its archive one at a time,
    with fixed times, so that a task holds one file, however large the group; the
    same files give the same bytes. Archive names carry the attempt, and only
    those count that this manifest, a written table, names.
    """
    kept = files.select(ZIP_MODES[mode]().alias("archive"), "path", F.col("content").cast("binary").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(out)
        store.create_dir(folder, recursive=True)
        now, target, archive, name, entries, done = None, None, None, "", 0, []

        def close() -> None:
            archive.close()
            target.sink.close()
            done.append({"archive": now, "path": out.rsplit(folder, 1)[0] + name, "entries": entries, "bytes": target.at})

        def listed() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_pylist(done, pa.schema([("archive", pa.string()), ("path", pa.string()), ("entries", pa.int64()), ("bytes", pa.int64())]))
            done.clear()
            return rows

        for batch in batches:
            for group, path, content in zip(*batch.columns, strict=True):
                if archive is None or group.as_py() != now:
                    if archive is not None:
                        close()
                    if len(done) >= PIECE_ROWS:
                        yield listed()
                    now, entries, name = group.as_py(), 0, f"{folder}/{uuid.uuid4().hex}.zip"
                    target = _Pieces(store.open_output_stream(name))
                    archive = zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED)
                info = zipfile.ZipInfo(path.as_py())
                info.compress_type = zipfile.ZIP_DEFLATED
                archive.writestr(info, content.as_py() or b"")
                entries += 1
        if archive is not None:
            close()
        if done:
            yield listed()

    ordered = kept.repartition(tasks(files.sparkSession), "archive").sortWithinPartitions("archive", "path")
    return written(ordered.mapInArrow(run, "archive string, path string, entries long, bytes long"), "zip-manifest")


def unzipped(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """archive, path, content of the files in the archives of a manifest, an archive to a task at a time.

    Files leave a task in pieces of up to PIECE_ROWS rows and about PIECE_BYTES
    bytes. Archives are dealt evenly over the tasks, however short the manifest is.
    Spark takes the files to be as small as the manifest, so a join of them has the
    hint to sort and merge: else it would broadcast all contents through the driver.
    """
    schema = pa.schema([("archive", pa.string()), ("path", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                store, name = pafs.FileSystem.from_uri(row["path"])
                with store.open_input_file(name) as source, zipfile.ZipFile(source) as archive:
                    for info in archive.infolist():
                        held.append({"archive": row["archive"], "path": info.filename, "content": archive.read(info)})
                        size += len(held[-1]["content"])
                        if len(held) >= PIECE_ROWS or size >= PIECE_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return manifest.select("archive", "path").repartitionByRange(tasks(spark), "path").mapInArrow(run, "archive string, path string, content binary").hint("merge")


def remembered(seen: DataFrame, new: DataFrame, key: list[str], at: str, most: int) -> DataFrame:
    """The ``most`` keys that were seen last, of what was remembered and what is new; a key seen again counts by its last time.

    The bound is by ``at``, then the key; the keys beyond it are forgotten.
    """
    rows = seen.select(*key, at).unionByName(new.select(*key, at)).groupBy(*key).agg(F.max(at).alias(at))
    return rows.orderBy(F.col(at).desc(), *key).limit(most)


def insert_or_ignore(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The table with rows of new keys; of repeated new keys one stays."""
    return table.unionByName(new.dropDuplicates(key).join(table.select(*key), key, "left_anti").select(*table.columns))


def partitioned(rows: DataFrame, path: str, column: str) -> None:
    """A table by folders of a column, one shuffle by it and few files each."""
    rows.repartition(column).write.mode("overwrite").partitionBy(column).parquet(path)
