"""Files, archives, memories, lists, draws and commits on odd rows."""

import hashlib
import io
import zipfile
from datetime import datetime, timedelta

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from loomline import file_queries as Q
from loomline.functions import tags as T
from loomline.operators import aggregates as A
from loomline.operators import filters as P
from loomline.operators import joins as J
from loomline.operators import ordering as O
from loomline.plans import commits as C
from loomline.session import new_path
from loomline.sources import files as S
from loomline.sources import metadata as M
from loomline.sources import sinks as K
from loomline.streaming import usage as U


def test_written_files(spark):
    root = new_path(spark, "files-test")
    rows = [("a/b.txt", b"one"), ("/a/c.txt", None), ("d é.bin", bytes(range(256)))]
    made = K.write_files(spark.createDataFrame(rows, "path string, content binary"), root)
    assert {(r["path"], r["bytes"]) for r in made.collect()} == {("a/b.txt", 3), ("/a/c.txt", 0), ("d é.bin", 256)}
    K.write_files(spark.createDataFrame(rows[:1], "path string, content binary"), root)  # again changes nothing
    store, folder = pafs.FileSystem.from_uri(root)
    names = {f.path[len(folder) :]: f.size for f in store.get_file_info(pafs.FileSelector(folder, recursive=True)) if f.is_file and not f.path.endswith(".crc")}
    assert names == {"/a/b.txt": 3, "/a/c.txt": 0, "/d é.bin": 256}
    with pytest.raises(Exception, match="leaves its root"):
        K.write_files(spark.createDataFrame([("../x", b"")], "path string, content binary"), root)


def test_archives_are_alike_and_whole(spark):
    rows = [(f"s{k % 3}/f{k % 7}/{k}.txt", None if k == 5 else (f"text {k} " * k).encode()) for k in range(60)]
    digests = []
    for parts in (1, 5):
        files = spark.createDataFrame(rows, "path string, content binary").repartition(parts)
        made = K.zipped(files, "source", new_path(spark, "zip-test")).collect()
        assert sum(r["entries"] for r in made) == 60 and {r["archive"] for r in made} == {"s0", "s1", "s2"}
        found = {}
        for r in made:
            store, name = pafs.FileSystem.from_uri(r["path"])
            with store.open_input_stream(name) as source:
                data = source.read()
            assert len(data) == r["bytes"]
            found[r["archive"]] = hashlib.sha256(data).hexdigest()
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                assert z.testzip() is None and z.namelist() == sorted(z.namelist())
                assert {n: z.read(n) for n in z.namelist()} == {p: c or b"" for p, c in rows if p.startswith(r["archive"] + "/")}
        digests.append(found)
    assert digests[0] == digests[1]
    files = spark.createDataFrame(rows, "path string, content binary")
    assert K.zipped(files, "folder", new_path(spark, "zip-test")).count() == 21 and K.zipped(files.limit(0), "file", new_path(spark, "zip-test")).count() == 0


def test_remembered_and_walked(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("a", 4), ("d", None), ("e", 3)], "k string, at long")
    assert [tuple(r) for r in K.remembered(rows.limit(0), rows, ["k"], "at", 3).collect()] == [("a", 4), ("c", 3), ("e", 3)]
    files = spark.createDataFrame([("x/b", "x", "b"), ("x/a", "x", "a"), ("a/z", "a", "z")], "path string, parent string, base string")
    assert [r["path"] for r in S.walked(files).orderBy("place").collect()] == ["a/z", "x/a", "x/b"]


def test_lists_side_by_side(spark):
    items = [("b", k, f"b{k}") for k in range(5)] + [("a", 10 * k, f"a{k}") for k in range(2)] + [("c", 0, "c"), ("d", 1, None)]
    got = J.zip_merge(spark.createDataFrame(items, "list_id string, pos long, value string").repartition(3), "+")
    assert {r["row"]: r["merged"] for r in got.collect()} == {k: f"a{k % 2}+b{k}+c" for k in range(5)}
    assert J.zip_merge(spark.createDataFrame([], "list_id string, pos long, value string")).count() == 0


def test_destinations_are_counted(spark, monkeypatch):
    monkeypatch.setattr(J, "MOST_DESTINATIONS", 2)
    files = spark.createDataFrame([("p", "s", 1)], "path string, sha256 string, bytes long")
    there = spark.createDataFrame([], "repo string, path string, sha256 string")
    two = spark.createDataFrame([("a", ""), ("b", "x")], "repo string, prefix string")
    assert J.plan_uploads(files, two, there, F.lit("skip")).count() == 2
    with pytest.raises(ValueError, match="destinations"):
        J.plan_uploads(files, two.union(two), there, F.lit("skip"))


def test_commits(spark):
    jobs = [("b", "1", "s", 5, "upload"), ("a", "2", "s", 5, "overwrite"), ("a", "3", "s", 5, "upload"), ("a", "4", None, 7, "upload"), ("b", "5", None, 7, "upload"), ("a", "0", "s", 5, "skip")]
    plan = C.commit_plan(spark.createDataFrame(jobs, "repo string, target string, sha256 string, bytes long, action string"))
    assert {(r["repo"], r["target"]): (r["phase"], r["source_repo"], r["source_target"]) for r in plan.collect()} == {("a", "2"): (1, None, None), ("a", "3"): (2, "a", "2"), ("b", "1"): (2, "a", "2"), ("a", "4"): (1, None, None), ("b", "5"): (1, None, None)}
    assert {tuple(r) for r in C.commits(plan).collect()} == {("a", 1, 2, 12), ("a", 2, 1, 0), ("b", 1, 1, 7), ("b", 2, 1, 0)}
    left = {(r["repo"], r["target"]): r["ready"] for r in C.unfinished(plan, spark.createDataFrame([("b", 1)], "repo string, phase int")).collect()}
    assert left == {("a", "2"): True, ("a", "3"): False, ("b", "1"): False, ("a", "4"): True}


def test_rising_progress(spark):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    rows = [("a", 1, 0.0, at(0)), ("a", 2, None, at(1)), ("a", 3, 40.0, at(2)), ("a", 4, 40.0, at(3)), ("a", 5, 30.0, at(4)), ("a", 6, 100.0, at(5)), ("a", 7, 1.0, at(29)), ("b", 8, None, at(0)), ("b", 9, -5.0, at(1))]
    got = U.replayed(spark.createDataFrame(rows, "key string, event_id long, progress double, ts timestamp"), U.rising, "rising-test", least=4)
    assert {tuple(r) for r in got.collect()} == {("a", 1, 0.0), ("a", 3, 40.0), ("a", 6, 100.0), ("a", 7, 1.0), ("b", 8, 0.0)}


def test_balances_limits_and_labels(spark):
    rows = spark.createDataFrame([("k", i, d) for i, d in enumerate([-2, 3, -1, None, -5, 2, -1])], "k string, i int, d int").repartition(2)
    assert [r["balance"] for r in A.balances(rows, ["k"], ["i"], "d").orderBy("i").collect()] == [0, 3, 2, 2, 0, 2, 1]
    n = lambda v: F.lit(v).cast("double")
    cases = [((5, 7, 6, 3, 9, True, 20), 7), ((5, None, 6, 3, 9, True, 20), 6), ((5, None, None, 2.5, 9, False, 20), 3), ((5, None, None, -3.0, 9, False, 20), 0), ((5, None, None, None, 9, True, 20), 9), ((5, None, None, None, 2, False, 20), 20), ((None, None, None, None, None, None, None), 0), ((5.4, None, None, None, None, True, None), 5)]
    got = spark.range(1).select(*[P.effective_limit(*map(n, v[:5]), F.lit(v[5]).cast("boolean"), n(v[6])).alias(f"c{i}") for i, (v, _) in enumerate(cases)]).first()
    assert list(got) == [w for _, w in cases]
    a = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    r = spark.range(1).select(T.sync_changes(a("x", "old", "kept"), a("old", "kept"), a("kept", "new", "x")).alias("t"), T.sync_changes(a(), a(), a()).alias("e")).first()
    assert r["t"] == ["new", "x", "kept"] and r["e"] == []


def test_draws(spark):
    u = [r["u"] for r in spark.range(4000).select(O.seeded(F.col("id"), F.lit(None).cast("string"), seed=3).alias("u")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / 4000 - 0.5) < 0.02 and len(set(u)) == 4000
    one = spark.range(1).select(O.drawn(F.lit(7), F.lit("x"), seed=2).alias("d")).first()["d"]
    assert one == hashlib.md5(b"7|x|2").hexdigest()


def test_text_chunks_beyond_latin(spark):
    from loomline.functions import pixels

    import numpy as np

    png = pixels.encode(np.zeros((1, 1, 1), np.uint8))
    made = M.png_with_text(png, {"a": "é", "b": "日本", "c": None})
    assert M.png_text(made) == {"a": "é", "b": "日本"} and M.png_text(M.png_with_text(made, {"B": "x", "A": None})) == {"B": "x"}


def test_few_archives_are_read_by_many_tasks_in_pieces(spark, tmp_path):
    """A short manifest stands for much work: its archives are dealt over the tasks, and files leave them many at a time."""
    files = spark.range(3000).select(F.format_string("s%d/l/%d", F.col("id") % 4, "id").alias("path"), F.when(F.col("id") % 7 > 0, F.encode(F.repeat(F.col("id").cast("string"), 9), "UTF-8")).alias("content"))
    manifest = K.zipped(files, "source", f"file://{tmp_path}/zips")
    read = K.unzipped(spark, manifest).withColumn("task", F.spark_partition_id())
    assert read.select("task").distinct().count() == 4
    want = files.select("path", F.coalesce("content", F.lit(b"")).alias("content"))
    assert read.count() == 3000 and want.exceptAll(read.select("path", "content")).isEmpty()
    assert sorted((r["archive"], r["entries"]) for r in manifest.collect()) == [(f"s{i}", 750) for i in range(4)]


def test_contents_of_archives_are_not_broadcast(spark, sf, tmp_path):
    """A manifest of a few rows stands for all contents, so what a join would broadcast by its size is far more than that; digests are all that is joined."""
    files = spark.range(400).select(F.format_string("s/%d", "id").alias("path"), F.encode(F.repeat(F.sha2(F.col("id").cast("string"), 256), 99), "UTF-8").alias("content"))
    manifest = K.zipped(files, "source", f"file://{tmp_path}/zips")
    joined = K.unzipped(spark, manifest).withColumn("n", F.octet_length("content")).join(files.select("path", F.lit(1).alias("one")), "path")
    assert manifest.count() == 1 and sorted(r["path"] for r in joined.select("path", "n", "one").where("n = 99 * 64").collect()) == sorted(f"s/{k}" for k in range(400))
    query = Q.zip_archives(spark, sf)
    for rows, least in ((joined, 400), (query, 1)):
        assert len(rows.collect()) >= least
        final = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in final and "Broadcast" not in final
    sorts = [x for x in final.splitlines() if " Sort [" in x or " Exchange " in x]
    assert sorts and not any("content" in x for x in sorts)


def test_trees_are_written_listed_and_read_in_tasks(spark):
    """Empty files, odd names and bytes, hidden ones left out; a short table of one part gives even work, and no step asks for a task per some files."""
    root = new_path(spark, "tree-test")
    rows = [(f"f{k % 3}/é {k}%20.txt", str(k).encode() * k) for k in range(300)] + [("a/.hidden", b"1"), ("a/_hidden", b"1"), (".b/c.txt", b"1"), ("a/_k=1", b"\xff"), ("top.txt", b"t")]
    made = K.write_files(spark.createDataFrame(rows, "path string, content binary").coalesce(1), root)
    assert len(made.inputFiles()) > 1 and made.count() == len(rows)
    want = {p: c for p, c in rows if "hidden" not in p and not p.startswith(".b")}
    found = S.scan(spark, [root])
    below = F.substring_index("path", root.rsplit("/", 1)[-1] + "/", -1)
    assert {r[0]: r[1] for r in found.select(below, "length").collect()} == {p: len(c) for p, c in want.items()}
    assert {r[0]: bytes(r[1]) for r in S.scan(spark, [root], content=True).select(below, "content").collect()} == want
    read = S.texts(spark, [root])
    assert {r[0]: r[1] for r in read.select(below, F.hex("text")).collect()} == {p: c.hex().upper() for p, c in want.items()}
    assert "FileScan text" not in read._jdf.queryExecution().toString() and "FileScan binaryFile" not in found._jdf.queryExecution().toString()
    assert {r["base"] for r in S.scan(spark, [root + "/top.txt", root + "/f?"]).collect()} == {p.rsplit("/", 1)[-1] for p in want if p[0] in "ft" and not p.endswith(" 0%20.txt")}
    with pytest.raises(Exception, match="tree-test"):
        S.scan(spark, [root + "/missing"]).count()
