"""Prefix trie of conversations by truncation peeling.

Conversations are paths of turn digests. Paths in ascending order are cut into
chunks of neighbours, and each chunk is peeled: from the greatest depth down,
conversations that end at a depth are merged with the nodes that survive from
below, every group is a node whose figures are then complete, its last turn is
stripped, and what is left is regrouped one turn higher. A node can reach over
the edge of its chunk only if it begins the chunk's first or last path. Such
nodes stay open: what was gathered for them goes on to the next round, in which
the open nodes alone are ordered, cut into larger chunks and peeled in the same
way, until one chunk holds all that is left. A round keeps a few open nodes a
chunk, so two or three rounds do, however deep or wide the trie is.

Equal paths are packed before they meet, so that many copies of one
conversation are few rows, and a first turn that most conversations share is
spread over all chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import written

#: Bytes of a turn's digest in a path.
DIGEST = 16
#: Paths of a chunk, and bytes of its paths, which bound the nodes that a task holds to a quarter of a million; a round's chunks are twice as large as those of the round before.
CHUNK, CHUNK_BYTES = 10_000, 4 << 20
#: Ids that one packed row holds.
PACK = 10_000
#: Open nodes up to this number are sent to all tasks that look for their parents' ids.
SMALL = 20_000

NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODE = "open boolean, path binary, chars array<int>, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (digest, chars), of every conversation.

    Turns go by ``turn``, null first; those with one number by role, then by the
    digest of role and text. A null role or text is empty. Rows without conv_id
    belong to no conversation and are left out; repeated rows are turns of their
    own. Other columns are not read. One conversation's digests fit a task: its
    texts do not travel.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn"), role.alias("role"), digest.alias("digest"), F.char_length(text).alias("chars"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), turn.alias("t"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """The conversations with their first h turns taken from the one that leads their ``group``: h is the checksum of the id modulo ``most``.

    Of the leader's turns the first h are taken, all if it has fewer, none if it
    is absent; a conversation's own turns follow after its first h. As in SQL, a
    remainder has the sign of the id.
    """
    own = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    heads = turns.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    joined = own.join(heads, "base", "left")
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))


@dataclass
class _Node:
    """What is gathered of a node: conversations, children and their sums, from one chunk."""

    chars: list[int]
    n: int = 0
    conv: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str | None = None
    below: list[dict] = field(default_factory=list)

    def add(self, n: int, conv: int, children: int = 0, leaves: int = 0, saved: int = 0, ends: str | None = None) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(conv, self.conv)
        self.children += children
        self.leaves += leaves
        self.saved += saved
        self.ends = ends or self.ends


def peel(chunk: list[tuple[bytes, _Node]], whole: bool) -> Iterator[dict]:
    """Rows of the closed nodes, and of the open ones, of a chunk of ascending paths; ``whole``: the chunk is all there is.

    Closed nodes whose parent is open have its key instead of its conv_id.
    """
    edges = (chunk[0][0], chunk[-1][0])
    ending: dict[int, list[tuple[bytes, _Node]]] = {}
    for path, node in chunk:
        ending.setdefault(len(path) // DIGEST, []).append((path, node))
    level: dict[bytes, _Node] = {}
    for depth in range(max(ending), -1, -1):
        for path, node in ending.pop(depth, []):
            if path in level:
                level[path].add(node.n, node.conv, node.children, node.leaves, node.saved, node.ends)
            else:
                level[path] = node
        above: dict[bytes, _Node] = {}
        for path, node in level.items():
            if not whole and any(edge.startswith(path) for edge in edges):
                key = hashlib.md5(path).digest()
                for row in node.below:
                    yield row | {"parent_key": key}
                yield {"open": True, "path": path, "chars": node.chars[:depth], "conv_id": node.conv, "depth": depth, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "ends_sha256": node.ends}
                continue
            for row in node.below:
                yield row | {"parent_conv_id": node.conv}
            leaves = node.leaves if node.children else 1
            saved = node.saved + ((node.n - 1) * node.chars[depth - 1] if depth else 0)
            row = {"open": False, "path": path, "conv_id": node.conv, "depth": depth, "n_convs": node.n, "n_children": node.children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": node.ends or NO_ENDS}
            if not depth:
                yield row
                continue
            parent = above.setdefault(path[:-DIGEST], _Node(node.chars))
            parent.add(node.n, node.conv, 1, leaves, saved)
            parent.below.append(row)
        level = above


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to PACK neighbouring rows (path, chars, conv_id) of one path in one row, ids in order."""
    out: list[dict] = []
    path, chars, ids = None, None, []

    def flush() -> None:
        if ids:
            out.append({"path": path, "chars": chars, "first": ids[0], "n": len(ids), "ids": ",".join(map(str, ids))})

    schema = pa.schema([("path", pa.binary()), ("chars", pa.list_(pa.int32())), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        for row in batch.to_pylist():
            if row["path"] != path or len(ids) == PACK:
                flush()
                path, chars, ids = row["path"], row["chars"], []
            ids.append(row["conv_id"])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
    flush()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, _Node]]:
    """Each path of the packed rows once, in order; its ids go through the digest one row at a time."""
    path, node, digest = None, None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["path"] == path:
                digest.update(b",")
            else:
                if node is not None:
                    node.ends = digest.hexdigest()
                    yield path, node
                path, node, digest = row["path"], _Node(row["chars"]), hashlib.sha256()
            digest.update(row["ids"].encode())
            node.add(row["n"], row["first"])
    if node is not None:
        node.ends = digest.hexdigest()
        yield path, node


def _left_open(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, _Node]]:
    """Each path of the open rows once, in order."""
    path, node = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["path"] != path:
                if node is not None:
                    yield path, node
                path, node = row["path"], _Node(row["chars"])
            node.add(row["n_convs"], row["conv_id"], row["n_children"], row["n_leaves"], row["saved_tokens"], row["ends_sha256"])
    if node is not None:
        yield path, node


def _peeled(batches: Iterator[pa.RecordBatch], first: bool, most: int, whole: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("open", pa.bool_()), ("path", pa.binary()), ("chars", pa.list_(pa.int32())), ("key", pa.binary()), ("parent_key", pa.binary()), *((n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string())])

    def rows(chunk: list[tuple[bytes, _Node]]) -> Iterator[pa.RecordBatch]:
        found = []
        for row in peel(chunk, whole):
            if not row["open"]:
                path = row.pop("path")
                row["key"] = None if first else hashlib.md5(path).digest()  # a node that one chunk of the first round holds has all its children there
            found.append(row)
            if len(found) == 10_000:
                yield pa.RecordBatch.from_pylist(found, schema)
                found = []
        if found:
            yield pa.RecordBatch.from_pylist(found, schema)

    chunk, held = [], 0
    for path, node in (_ended if first else _left_open)(batches):
        chunk.append((path, node))
        held += len(path)
        if not whole and (len(chunk) >= most or held >= CHUNK_BYTES * most // CHUNK):
            yield from rows(chunk)
            chunk, held = [], 0
    if chunk:
        yield from rows(chunk)


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of conversations (conv_id, turns).

    A node is a distinct sequence of first turns, from the root, which has none;
    its conv_id is the smallest conversation that begins with it, so that its
    texts are that one's first ``depth`` turns. parent_conv_id is null for the
    root. n_convs counts the conversations that begin with it, those without
    turns begin with the root alone. n_leaves counts childless nodes at or below
    it, saved_tokens sums (n_convs - 1) times the characters of the last turn at
    or below it, and ends_sha256 digests the ids that end here, in numeric order.
    Without conversations there are no nodes. A conversation is to have one row;
    several rows of one id are conversations of their own.
    """
    digests = F.transform("turns", lambda t: t["digest"])
    paths = written(turns.select("conv_id", F.unhex(F.array_join(digests, "")).alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars")), "trie-paths")
    ordered = paths.select("path", "chars", "conv_id").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    packed = written(ordered.mapInArrow(_packed, "path binary, chars array<int>, first long, n long, ids string"), "trie-packed")
    left = packed.repartitionByRange("path").sortWithinPartitions("path", "first")
    most, first, whole, rounds = CHUNK, True, False, []
    while True:
        found = written(left.mapInArrow(partial(_peeled, first=first, most=most, whole=whole), _NODE), "trie-nodes")
        rounds.append(found.where("NOT open"))
        left = found.where("open")
        n = left.count()
        if not n:
            break
        most, first, whole = 2 * most, False, n <= 2 * most
        left = (left.repartition(1) if whole else left.repartitionByRange("path")).sortWithinPartitions("path")
    nodes = rounds[0]
    for more in rounds[1:]:
        nodes = nodes.union(more)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    settled = nodes.where("parent_key IS NULL").select(*columns)
    parents = nodes.where("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
    if parents.limit(SMALL + 1).count() <= SMALL:
        parents = F.broadcast(parents)
    rest = nodes.where("parent_key IS NOT NULL").drop("parent_conv_id").join(parents, "parent_key").withColumnRenamed("found", "parent_conv_id")
    return settled.union(rest.select(*columns))


ORACLE = r"""
WITH tab AS (
  SELECT list(list_reduce(list_prepend(n::UBIGINT, range(8)::UBIGINT[]), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)) ORDER BY n) AS t FROM range(256) r(n)),
ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
h AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::UBIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)::BIGINT])), 4294967295::UBIGINT)::BIGINT % 6 AS h FROM ids, tab),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS k,
    struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT h.conv_id, turns.turn, h.h + k AS k FROM h JOIN turns ON turns.conv_id = h.conv_id AND turns.k > h.h
  UNION ALL SELECT h.conv_id, turns.turn, k FROM h JOIN turns ON turns.conv_id = h.conv_id - h.conv_id % 100 AND turns.k <= h.h),
seqs AS (SELECT h.conv_id, coalesce(list(turn ORDER BY own.k) FILTER (turn IS NOT NULL), []) AS s FROM h LEFT JOIN own ON own.conv_id = h.conv_id GROUP BY h.conv_id),
pre AS (SELECT conv_id, len(s) AS n, unnest(range(len(s) + 1)) AS depth, s FROM seqs),
nodes AS (
  SELECT s[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE any_value(length(s[depth].t)) END AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM pre GROUP BY s[1:depth], depth),
kids AS (SELECT c.p[1:c.depth - 1] AS p, count(*) AS n_children FROM nodes c WHERE c.depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.p = nodes.p),
up AS (SELECT p[1:a] AS p, saved, n_children FROM (SELECT *, unnest(range(depth + 1)) AS a FROM full_nodes)),
sums AS (SELECT p, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY p)
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON s.p = n.p LEFT JOIN full_nodes q ON n.depth > 0 AND q.p = n.p[1:n.depth - 1]
"""
