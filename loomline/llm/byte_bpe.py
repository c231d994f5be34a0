"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters after which a long text is cut at the next safe boundary.
PIECE_CHARS = 50_000
#: Cut before white space that follows another character: no match of the pre-split pattern spans that place. U+001C to U+001F are
#: white space for Python alone, so they are neither.
_SAFE = re.compile(r"(?<=\S)(?=[^\S\x1c-\x1f])")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, once per worker process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _decimals(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """The text in parts that encode to the same ids as the whole."""
    at = 0
    while len(text) - at > most:
        cut = _SAFE.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str, path: str, pattern: str) -> list[int]:
    """Ids of one text, without special tokens."""
    coder = encoding(path, pattern)
    if len(text) <= PIECE_CHARS:
        return coder.encode_ordinary(text)
    return [i for part in pieces(text) for i in coder.encode_ordinary(part)]


def encode_column(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row; a null text is empty. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = pa.array([encode(t.as_py() or "", path, pattern) for t in part.column(1)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")


def decode_column(encoded: DataFrame, path: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes) of rows of ids; null ids give empty bytes. Bytes stay raw, so ids that split a character are safe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path, pattern)
        for batch in batches:
            raw = pa.array([coder.decode_bytes(x or []) for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), raw], ["id", "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    Encodes and decodes in one pass over each Arrow batch, so ids never leave
    the task. A null or empty text has no ids; both digests are then of empty
    input. Repeated rows give repeated results; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path, pattern)
        names = _decimals(coder.n_vocab)
        for batch in batches:
            counts, coded, decoded = [], [], []
            for value in batch.column(1):
                total, digest, raw = 0, hashlib.sha256(), hashlib.sha256()
                for part in pieces(value.as_py() or ""):
                    ids = coder.encode_ordinary(part)
                    if ids:
                        digest.update(((" " if total else "") + " ".join([names[i] for i in ids])).encode())
                        raw.update(coder.decode_bytes(ids))
                        total += len(ids)
                counts.append(total)
                coded.append(digest.hexdigest())
                decoded.append(raw.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
