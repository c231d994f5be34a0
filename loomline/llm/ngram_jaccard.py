"""Exact Jaccard join of shingle sets by T-occurrence search (DivideSkip).

1. Documents with equal sets are one class; only classes go on.
2. A sketch of each class, its 64 smallest shingle hashes, tells whether enough
   of them occur in another class. Most documents end here.
3. A class goes by its first hashes, at most 32. The smallest class that goes by
   a hash leads all classes that go by it: they meet in the leader's block. A
   block holds only classes that share a hash with its leader, so blocks do not
   chain, and copies of one text have few different leaders.
4. A block's full sets are indexed by shingle. Each set searches the index for
   sets that hold at least T of its shingles: short inverted lists are merged,
   long ones are probed for the few that can still reach T. Large blocks are cut
   into chunks by set size and hash, and only pairs of chunks whose sizes can
   link are searched. Two classes that meet in several blocks are judged in the
   first of them alone, and blocks that could add no pair are left out.
5. Links give components.

Two linked sets differ in at most a third of the smaller one's size, and the
smallest shingle that they share is among the first |S| - 0.75 |S| + 1 of either.
By these bounds the sketch is exact for sets of up to 153 shingles and the
choice of hashes for sets of up to 127. For larger ones at least 0.75 of the
smallest hashes of the union are shared whatever the texts are, so that fewer
than 13 of 64, or none of 32, are shared with a chance below 2**-64: that of two
shingles having one 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomline.llm.arrow_text import fresh, shingle_sets, slices
from loomline.llm.components import components
from loomline.session import written

WORDS = 5
#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 75
SKETCH = 64
#: Of the sketch of a large set, so many hashes occur in a linked set's sketch.
NEED = 13
#: Hashes that a class goes by, at most.
FIRST = 32
#: Shingles of a chunk at most; blocks beyond FINE_SHINGLES are cut into up to FINE_CHUNKS smaller ones for an even load.
CHUNK_SHINGLES = 2_000_000
FINE_SHINGLES, FINE_CHUNKS = 100_000, 6
#: Sizes of linked sets lie in one band or in two neighbours: bands grow by a little more than 4/3.
BAND = 1.34
#: DivideSkip's weight of a probe against a merge step.
MU = 0.01


def class_id(shingles: np.ndarray) -> int:
    """64-bit id of a set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def sketches(docs: DataFrame, words: int = WORDS, with_tokens: bool = True) -> DataFrame:
    """doc_id, n_shingles, class (null without words) and, if asked for, tag (hash of the text) and tokens: the smallest hashes in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                sets = list(shingle_sets(data, offsets, words))
                sizes = np.array([len(s) for s in sets], np.int64)
                classes = pa.array([class_id(s) if len(s) else None for s in sets], pa.int64())
                columns = [batch.column(0).slice(a, b - a), pa.array(sizes), classes]
                if with_tokens:
                    heads = [s[:SKETCH].view(np.int64) for s in sets]
                    ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
                    columns += [batch.column(2).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(heads)))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "class", "tag", "tokens"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "text", *[F.xxhash64("text").alias("tag")] * with_tokens]
    return docs.select(*columns).mapInArrow(run, f"doc_id {kind}, n_shingles long, class long" + ", tag long, tokens array<long>" * with_tokens)


def _index(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, the start of each one's list, and the lists: ascending places of the sets that hold it."""
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens = tokens[order]
    first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    return tokens[first], np.r_[first, len(tokens)], owner[order]


def search(sets: list[np.ndarray], queries: list[np.ndarray], percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the query, ascending places of sets that it links to), by DivideSkip.

    A set that equals the query is found like any other. Short lists are merged
    by a sort of their concatenation, whose work is that of a heap merge: it
    grows with the lists and not with the number of sets.
    """
    vocabulary, starts, postings = _index(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    lengths = np.diff(starts)
    for q, tokens in enumerate(queries):
        n = len(tokens)
        least = -(-percent * n // 100)  # of any partner's overlap with this set
        at = np.minimum(np.searchsorted(vocabulary, tokens), len(vocabulary) - 1)
        lists = at[vocabulary[at] == tokens]
        if len(lists) < least:
            continue
        lists = lists[np.argsort(lengths[lists], kind="stable")]
        long = min(least - 1, int(least / (MU * np.log2(max(2, lengths[lists[-1]])) + 1)))
        short, probed = lists[: len(lists) - long], lists[len(lists) - long :]
        each = lengths[short]
        places = np.arange(each.sum()) + np.repeat(starts[short] - np.r_[0, np.cumsum(each)[:-1]], each)
        merged = np.sort(postings[places], kind="stable")
        head = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1]]) if len(merged) else np.zeros(0, np.int64)
        found, total = merged[head], np.diff(np.r_[head, len(merged)])
        some = (total >= least - long) & (100 * sizes[found] >= percent * n) & (100 * n >= percent * sizes[found])
        found, total = found[some], total[some]
        for t in probed:
            if not len(found):
                break
            own = postings[starts[t] : starts[t + 1]]
            total = total + (own[np.minimum(np.searchsorted(own, found), len(own) - 1)] == found)
        yield q, found[(100 + percent) * total >= percent * (n + sizes[found])]


def _roots(n: int, links: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Smallest place of each place's component."""
    parent = np.arange(n)

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for q, found in links:
        for r in found:
            a, b = top(q), top(int(r))
            if a != b:
                parent[max(a, b)] = min(a, b)
    return np.array([top(i) for i in range(n)], np.int64)


def _search_block(block: pd.DataFrame) -> pd.DataFrame:
    """(class, root, n_links) of the classes of a block, or of one pair of its chunks, that have links.

    n_links counts the documents of linked classes found here; the root is a
    class of the same component. Pairs that also meet in the block of a smaller
    leader are left to that one.
    """
    block = block.drop_duplicates("class").sort_values("class", ignore_index=True)
    sets = [np.frombuffer(x, np.uint64) for x in block["shingles"]]
    left, right = (np.flatnonzero(block["chunk"] == c) for c in (block["i"].iloc[0], block["j"].iloc[0]))
    same = block["i"].iloc[0] == block["j"].iloc[0]
    weight, n_links, links = block["size"].to_numpy(), np.zeros(len(block), np.int64), []
    if len(left) and len(right):
        leader = block["block"].iloc[0]
        earlier = [[x for x in led if x < leader] for led in block["leaders"]]
        others: dict[int, list[int]] = {}
        for k, r in enumerate(right):
            for x in earlier[r]:
                others.setdefault(x, []).append(k)
        met: dict[int, np.ndarray] = {}
        todo = []
        for q in left:
            if lists := [others[x] for x in earlier[q] if x in others]:
                met[q] = np.zeros(len(right), bool)
                for own in lists:
                    met[q][own] = True
                if met[q].all():
                    continue
            todo.append(q)
        if todo:
            for at, found in search([sets[r] for r in right], [sets[q] for q in todo]):
                q = todo[at]
                found = right[found[~met[q][found]] if q in met else found]
                found = found[found != q]
                n_links[q] += weight[found].sum()
                if not same:
                    np.add.at(n_links, found, weight[q])
                if len(found):
                    links.append((q, found))
    roots = _roots(len(block), links)
    some = n_links > 0
    return pd.DataFrame({"class": block["class"][some], "root": block["class"].to_numpy()[roots[some]], "n_links": n_links[some]})


def _search_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks arrive sorted; one block at a time is held."""
    held: list[pd.DataFrame] = []
    key = None
    for batch in batches:
        for own, part in batch.groupby(["block", "i", "j"], sort=False):
            if own != key and held:
                yield _search_block(pd.concat(held, ignore_index=True))
                held = []
            key = own
            held.append(part)
    if held:
        yield _search_block(pd.concat(held, ignore_index=True))


def _classes(docs: DataFrame) -> DataFrame:
    """class, n, tokens, rep (smallest doc_id), tag (of a text of rep), size (documents) of every distinct non-empty set."""
    rows = sketches(docs).where("class IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag"))
    found = rows.groupBy("class").agg(F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"), first.alias("first"), F.count(F.lit(1)).alias("size"))
    return written(found.select("class", "n", "tokens", F.col("first.doc_id").alias("rep"), "first.tag", "size"), "jaccard-classes")


def _candidates(classes: DataFrame) -> DataFrame:
    """class, rep, tag, size, n and tokens of the classes that can have a partner."""
    places = classes.select("class", "n", F.explode("tokens").alias("token"))
    # a token occurs in several classes if its smallest and largest class differ: two numbers a token, combined on the map side
    shared = places.groupBy("token").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("token")
    overlap = F.ceil(F.col("n") * PERCENT / 100)
    need = F.greatest(F.least(F.lit(NEED), overlap), F.least(overlap, F.lit(SKETCH) - F.floor(F.col("n") / 3)))
    met = places.join(shared, "token").groupBy("class").agg(F.count(F.lit(1)).alias("met"), F.first("n").alias("n")).where(F.col("met") >= need).select("class")
    return written(classes.join(met, "class"), "jaccard-candidates")


def _cells(candidates: DataFrame) -> DataFrame:
    """class, leaders (ascending) and cells: the block, pair of chunks (i, j) and own chunk in which a class is searched."""
    prefix = F.least(F.lit(FIRST), F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1).cast("int")
    heads = candidates.select("class", "n", F.explode(F.slice("tokens", F.lit(1), prefix)).alias("token"))
    leaders = heads.groupBy("token").agg(F.min("class").alias("block"), F.max("class").alias("hi")).where("block <> hi").select("token", "block")
    members = written(heads.join(leaders, "token").select("class", "n", "block").distinct(), "jaccard-members")
    # a block whose members all have one smaller first leader adds nothing: every pair of them meets in that one's block
    first = members.groupBy("class").agg(F.min("block").alias("first"))
    ends = members.join(first, "class").groupBy("block").agg(F.min("first").alias("lo"), F.max("first").alias("hi"))
    members = members.join(ends.where("lo <> hi OR lo = block").select("block"), "block", "left_semi")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(BAND))
    members = members.withColumn("band", band)
    count = F.greatest(F.ceil(F.col("x") / CHUNK_SHINGLES), F.least(F.lit(FINE_CHUNKS), F.ceil(F.col("x") / FINE_SHINGLES)))
    shape = members.groupBy("block", "band").agg(F.sum("n").alias("x")).withColumn("k", count)
    shape = shape.groupBy("block").agg(F.sum("x").alias("total"), F.map_from_entries(F.collect_list(F.struct("band", "k"))).alias("chunks"))  # an entry a band, of which there are few
    chunk = lambda b, h: b * (1 << 32) + h
    small = F.col("total") <= min(FINE_SHINGLES, CHUNK_SHINGLES)
    own = chunk(F.col("band"), F.pmod(F.xxhash64("class"), F.col("chunks")[F.col("band")]))
    near = F.filter(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1), lambda b: F.map_contains_key("chunks", b))
    others = F.flatten(F.transform(near, lambda b: F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks")[b] - 1), lambda h: chunk(b, h))))
    placed = members.join(shape, "block").withColumn("chunk", F.when(small, F.lit(0).cast("long")).otherwise(own)).withColumn("others", F.when(small, F.array(F.lit(0).cast("long"))).otherwise(others))
    cells = F.transform("others", lambda o: F.struct("block", F.least("chunk", o).alias("i"), F.greatest("chunk", o).alias("j"), "chunk"))
    return placed.select("class", "block", cells.alias("cells")).groupBy("class").agg(F.sort_array(F.collect_set("block")).alias("leaders"), F.flatten(F.collect_list("cells")).alias("cells"))


def _linked(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """class, root, n_links of the classes that link to another class."""
    placed = candidates.select("class", "rep", "tag", "size").join(_cells(candidates), "class").withColumnRenamed("class", "of")
    texts = docs.select("doc_id", "text").join(placed, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.xxhash64("text") == F.col("tag")))
    texts = texts.select("text", "of", "size", "leaders", "cells").dropDuplicates(["of"])  # rows that share an id and a text

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(0)):
                found = pa.array([s.tobytes() for s in shingle_sets(data, offsets)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(1, 5)), found], ["class", "size", "leaders", "cells", "shingles"])

    full = texts.mapInArrow(sets, "class long, size long, leaders array<long>, cells array<struct<block: long, i: long, j: long, chunk: long>>, shingles binary")
    keyed = full.withColumn("cell", F.explode("cells")).select("class", "size", "leaders", "cell.block", "cell.i", "cell.j", "cell.chunk", "shingles")
    found = keyed.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j").mapInPandas(_search_blocks, "class long, root long, n_links long")
    return written(found, "jaccard-links")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, class and component class of every row.

    Words are lower-cased (A-Z) runs of other characters than white space. A
    document's set holds its distinct 5-word shingles, or its whole sequence
    where it has fewer words; without words or text it is empty and linked with
    nothing, and component_id is its own doc_id. component_id is the smallest
    doc_id reachable by links, n_links the number of documents linked directly
    (copies included). Null ids count as larger than all others. Repeated rows
    are copies of each other. Other columns are not read.
    """
    classes = _classes(docs)
    links = _linked(docs, _candidates(classes))
    roots = components(links.select(F.col("class").alias("u"), F.col("root").alias("v")))
    counted = links.groupBy("class").agg(F.sum("n_links").alias("n_links"))
    of = classes.select("class", "rep", "size").join(roots.select(F.col("id").alias("class"), "root"), "class", "left")
    of = of.join(counted, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = of.where("root <> class OR n_links > 0").groupBy("root").agg(F.min("rep").alias("least"))
    found = of.join(least, "root", "left").select("class", "root", F.coalesce("least", "rep").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    rows = sketches(docs, with_tokens=False)
    return rows.join(found, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "class", "root")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every document; see ``groups``."""
    return groups(docs).select("doc_id", "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """The input rows of one document of each component, that with the smallest doc_id.

    Rows without words are all kept, as they link with nothing; of repeated rows
    one stays. All input columns are returned.
    """
    names = docs.columns
    kind, keep_id, keep_class = fresh(names, "class", "keep_id", "keep_class")
    own = groups(docs.select("doc_id", "text"))
    first = own.where(F.col("class").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("class").alias("class"), F.first("doc_id").alias("doc_id"))
    keep = first.select(F.col("doc_id").alias(keep_id), F.col("class").alias(keep_class))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for a, b, data, offsets in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                classes = pa.array([class_id(s) if len(s) else None for s in shingle_sets(data, offsets)], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, classes], [*names, kind])

    typed = docs.mapInArrow(marked, StructType([*docs.schema.fields, StructField(kind, LongType())]))
    joined = typed.join(keep, F.col("doc_id").eqNullSafe(F.col(keep_id)) & (F.col(kind) == F.col(keep_class)), "left_semi")
    once = joined.dropDuplicates(["doc_id", kind])
    return once.unionByName(typed.where(F.col(kind).isNull())).select(*[F.col(f"`{c}`") for c in names])


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 75 * (nx.n + ny.n - o)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.y),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, coalesce(k.n_links, 0)::BIGINT AS n_links
FROM d JOIN c ON c.x = d.doc_id LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.x = d.doc_id
"""
