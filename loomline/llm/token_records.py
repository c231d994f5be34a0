"""Token ids in length-delimited binary records with a separate offset index.

A record is ``length u64 | masked crc of the length u32 | data | masked crc of
the data u32``, little-endian. The data is one sequence of ids: unsigned 16-bit
where the vocabulary fits, else 32-bit. ``shard-*.idx`` beside each
``shard-*.rec`` holds (id i64, offset u64, tokens u64) per record, so a reader
can fetch records in any order. Records lie in ascending id over the shards and,
inside a shard, over its files, which are closed at about ``file_bytes``.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomline.session import new_path, written

#: Rotation and addend of the checksum mask: a checksum stored among checksummed data must not look like one.
MASK_DELTA = 0xA282EAD8
INDEX = np.dtype([("id", "<i8"), ("offset", "<u8"), ("tokens", "<u8")])
#: Bytes of text for a shard, at most on average, and bytes of a file, after which a shard begins a new one.
SHARD_BYTES, FILE_BYTES = 256 << 20, 64 << 20
#: Records of which a reader holds the numbers at once.
READ_ROWS = 1 << 16
#: Words that a worker process remembers; this bounds the memory for them.
CACHE_WORDS = 1_200_000


def masked_crc(data: bytes) -> int:
    """CRC-32 of the data, rotated right by 15 bits and shifted by a constant."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    head = len(data).to_bytes(8, "little")
    return b"".join((head, masked_crc(head).to_bytes(4, "little"), data, masked_crc(data).to_bytes(4, "little")))


def read_frame(source, width: int) -> np.ndarray | None:
    """The next record's ids, or None at the end; a failed checksum raises ValueError."""
    head = source.read(12)
    if not head:
        return None
    if len(head) < 12 or masked_crc(head[:8]) != int.from_bytes(head[8:], "little"):
        raise ValueError("record length fails its checksum")
    n = int.from_bytes(head[:8], "little")
    data = source.read(n + 4)
    if len(data) < n + 4 or masked_crc(data[:n]) != int.from_bytes(data[n:], "little"):
        raise ValueError("record data fails its checksum")
    return np.frombuffer(data[:n], f"<u{width}")


def read_index(files: pafs.FileSystem, path: str) -> np.ndarray:
    with files.open_input_stream(path) as source:
        return np.frombuffer(source.read(), INDEX)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class WordEncoder:
    """Encodes texts by a vocabulary whose pre-tokens never span white space.

    Pre-tokens are single numbers, runs of letters or runs of other characters,
    so a word's ids are those of its stem and of the punctuation after it, and a
    word met before needs no second encoding. Stems of letters alone go to the
    tokenizer many at a time, joined by spaces; the tokens that end a word tell
    them apart again. Once ``CACHE_WORDS`` are known, all are forgotten.
    """

    #: Characters that may follow a stem and always form a pre-token apart from it.
    TAIL = b".,;:!?%$#*&|"

    def __init__(self, path: str, width: int):
        self.coder, self.kind, self.known = tokenizer(path), f"<u{width}", {b"": b""}
        self.width = width
        self.added = [t.content.lower().encode() for t in self.coder.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.coder.get_vocab_size(), bool)
        for token, i in self.coder.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def __call__(self, text: bytes) -> bytes:
        """The ids of one text as little-endian integers."""
        if any(t in low for low in [text.lower()] for t in self.added):
            return np.array(self.coder.encode(text.decode(), add_special_tokens=False).ids, self.kind).tobytes()
        split, known = text.split(), self.known
        if new := set(split).difference(known):
            if len(known) > CACHE_WORDS:
                known.clear()
                known[b""] = b""
                new = set(split)
            self._learn(new)
        return b"".join(map(known.__getitem__, split))

    def _learn(self, words: set[bytes]) -> None:
        known, parts = self.known, {}
        for w in words:
            low = w.lower()
            stem = low.rstrip(self.TAIL)
            if len(stem) == len(low) or not stem or not stem.decode().lower()[-1].isalpha():
                stem, tail = low, b""
            else:
                tail = low[len(stem) :]
            parts[w] = stem, tail
        needed = {x for pair in parts.values() for x in pair if x not in known}
        plain = [x for x in needed if x.decode().isalpha()]
        for at in range(0, len(plain), 2048):
            some = plain[at : at + 2048]
            ids = np.array(self.coder.encode(b" ".join(some).decode(), add_special_tokens=False).ids, self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                raw, at_byte = ids.tobytes(), (ends * self.width).tolist()
                for x, a, b in zip(some, [0, *at_byte[:-1]], at_byte, strict=True):
                    known[x] = raw[a:b]
        for x in needed:
            if x not in known:
                known[x] = np.array(self.coder.encode(x.decode(), add_special_tokens=False).ids, self.kind).tobytes()
        for w, (stem, tail) in parts.items():
            known[w] = known[stem] + known[tail]


@functools.lru_cache(maxsize=2)
def word_encoder(path: str, width: int) -> WordEncoder:
    """One encoder, with the words it knows, for all tasks of a worker process."""
    return WordEncoder(path, width)


def write_records(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 1, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every text, append ``end_id``, and write shards in ascending id order.

    Rows are range-partitioned by id and sorted inside the shard (ties by text,
    null ids first), so shard order is id order and no task sees more than its
    range. There is a shard for each SHARD_BYTES of text, and for each shuffle
    partition; where one id has more rows than that, they are one shard of
    several files. Returns the manifest, a row a file: shard, part, path,
    index_path, records, tokens, id_width. A file name carries the attempt that
    wrote it and only the manifest's rows count, so a retried task leaves no
    double records. A null text is empty and has only the end id; equal ids keep
    all their rows; an empty table writes no file.
    """
    spark = docs.sparkSession
    if shards is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
        shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    width = 2 if max(tokenizer(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    names = ["shard", "part", "path", "index_path", "records", "tokens", "id_width"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(tokenizer_path, width), end_id.to_bytes(width, "little")
        files, folder = pafs.FileSystem.from_uri(out)
        files.create_dir(folder, recursive=True)
        uri, shard = out.rsplit(folder, 1)[0], TaskContext.get().partitionId()
        lead, part, sink, name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}", 0, None, ""
        index: list[tuple[int, int, int]] = []
        offset = tokens = 0

        def closed() -> pa.RecordBatch:
            sink.close()
            with files.open_output_stream(name + ".idx") as side:
                side.write(np.array(index, INDEX).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard, part, f"{uri}{name}.rec", f"{uri}{name}.idx", len(index), tokens, width)], names)

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                if sink is None:
                    name, index, offset, tokens = f"{lead}-{part:04d}", [], 0, 0
                    sink = files.open_output_stream(name + ".rec")
                data = encoder(text.as_py() or b"") + end
                record, i = frame(data), i.as_py()
                sink.write(record)
                index.append((np.iinfo(np.int64).min if i is None else i, offset, len(data) // width))
                offset += len(record)
                tokens += len(data) // width
                if offset >= file_bytes:
                    yield closed()
                    sink, part = None, part + 1
        if sink is not None:
            yield closed()

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange(shards, "id").sortWithinPartitions("id", "text")
    return written(ordered.mapInArrow(run, "shard long, part long, path string, index_path string, records long, tokens long, id_width long"), "token-manifest")


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per record from the files: shard, part, seq, doc_id, n_tokens, ids_crc32, before (ids earlier in the file).

    Every record's checksums are verified; a mismatch between index and file
    raises. A file is read one record at a time, and READ_ROWS rows are held.
    """
    names = ["shard", "part", "seq", "doc_id", "n_tokens", "ids_crc32", "before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.to_pylist():
                files, path = pafs.FileSystem.from_uri(own["path"])
                seq = before = 0
                with files.open_input_stream(path, buffer_size=1 << 20) as source, files.open_input_stream(pafs.FileSystem.from_uri(own["index_path"])[1], buffer_size=1 << 20) as side:
                    while True:
                        index = np.frombuffer(side.read(READ_ROWS * INDEX.itemsize), INDEX)
                        counts, crcs = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
                        for k in range(len(index)):
                            if (ids := read_frame(source, own["id_width"])) is None or len(ids) != index["tokens"][k]:
                                raise ValueError(f"{own['path']} and its index differ")
                            counts[k], crcs[k] = len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                        if not len(index):
                            break
                        ids = index["id"].copy()
                        columns = [np.full(len(ids), own["shard"]), np.full(len(ids), own["part"]), np.arange(seq, seq + len(ids)), None, counts, crcs, before + np.cumsum(counts) - counts]
                        doc_ids = pa.array(ids, mask=ids == np.iinfo(np.int64).min)
                        yield pa.RecordBatch.from_arrays([doc_ids if c is None else pa.array(c) for c in columns], names)
                        seq, before = seq + len(ids), before + int(counts.sum())
                    if read_frame(source, own["id_width"]) is not None:
                        raise ValueError(f"{own['path']} and its index differ")

    files = max(1, manifest.count())
    return manifest.repartitionByRange(files, "shard", "part").mapInArrow(run, "shard long, part long, seq long, doc_id long, n_tokens long, ids_crc32 long, before long")


def fetch(uri: str, offset: int, width: int) -> np.ndarray:
    """One record by its offset from the index: the access of a shuffled reader."""
    files, path = pafs.FileSystem.from_uri(uri)
    with files.open_input_file(path) as source:
        source.seek(offset)
        return read_frame(source, width)


def token_records(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from files that this call writes to the shared folder.

    ``start`` counts the ids of all earlier documents: a running sum inside the
    file plus the totals of earlier files, which the manifest holds (a row per
    file). A null text is empty; whole texts are encoded, however long; of equal
    ids, ordered by text, each has its own row; an empty table gives no rows.
    Other columns are not read.
    """
    from pyspark.sql import Window

    spark = docs.sparkSession
    manifest = write_records(docs, new_path(spark, "token-records"), tokenizer_path, end_id)
    earlier = manifest.select("shard", "part", (F.sum("tokens").over(Window.orderBy("shard", "part")) - F.col("tokens")).alias("base"))
    rows = read_records(spark, manifest).join(earlier, ["shard", "part"])  # broadcast only where Spark finds the manifest small enough
    return rows.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
