"""Queries and operators give whole results on tables larger or odder than the samples."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline import queries as Q
from loomline import session
from loomline.operators import joins as J
from loomline.operators import ordering as O
from loomline.sources import files as S

START = datetime(2026, 1, 1)


def _unordered_events(spark, folder, files, rows):
    """Events of three users, dealt over files so that each holds times of the whole span; the last user has over 600 in a window."""
    made = [(i, START + timedelta(minutes=7 * i), i % 2, "view" if i % 5 else "purchase", float(i), "{}") for i in range(rows)]
    made += [(rows + i, START + timedelta(seconds=5 * i), 2, "view", 1.0, "{}") for i in range(700)]
    df = spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.repartition(files, F.xxhash64("event_id")).write.parquet(f"{folder}/events.parquet")
    return made


def test_streams_over_many_unordered_files(spark, tmp_path, equal):
    made = _unordered_events(spark, tmp_path, 350, 4000)
    times = {}
    for _, ts, user, *_ in made:
        times.setdefault(user, []).append(ts)
    want = []
    for i, ts, user, *_ in made:
        used = sum(ts - timedelta(hours=2) < t <= ts for t in times[user])
        want.append((user, i, used, used >= 4))
    assert max(w[2] for w in want) == 700
    assert sorted(map(tuple, Q.QUERIES["stream_quota"](spark, str(tmp_path)).collect())) == sorted(want)
    assert sorted(map(tuple, Q.QUERIES["stream_dedupe"](spark, str(tmp_path)).collect())) == sorted((i, user) for i, _, user, *_ in made)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("stream_jobs", "stream_attempts", "stream_pauses", "stream_progress", "late_flags"):
        equal(Q.QUERIES[name](spark, str(tmp_path)), c.sql(Q.ORACLES[name]))


def test_clusters_of_the_whole_table(spark, sf):
    """The sample's vectors lie within the threshold of each other: one cluster, whatever vec_id leaves by 16."""
    rows = Q.QUERIES["online_clusters"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/embeddings.parquet").count() and {r["cluster"] for r in rows} == {0}


@pytest.mark.parametrize("most", [7, 4096])
def test_clusters_by_rounds(spark, monkeypatch, most):
    monkeypatch.setattr(J, "ROUND_VECTORS", most)
    vectors = np.random.default_rng(5).uniform(0, 4, (150, 2))
    exemplars, want = [], []
    for i, v in enumerate(vectors):
        near = [k for k, e in enumerate(exemplars) if np.linalg.norm(e - v) <= 0.8]
        if not near:
            exemplars.append(v)
        want.append((i, near[0] if near else len(exemplars) - 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = J.online_clusters(df.repartition(3), "vec_id", 0.8)
    assert len(exemplars) > 14 and sorted(map(tuple, got.collect())) == want


def test_places_of_wide_rows(spark):
    """More rows than a range sample holds, with a payload that later plans prune: every place once, in order."""
    n = 150_000
    rows = spark.range(n).select(F.xxhash64("id").alias("k"), "id", F.repeat(F.lit("x"), 40).alias("payload")).repartition(8)
    placed = O.ordinal(rows, [F.col("k"), F.col("id")])
    assert placed.agg(F.count_distinct("place"), F.min("place"), F.max("place")).first() == (n, 0, n - 1)
    wrong = placed.select("k", "place").join(placed.select((F.col("place") + 1).alias("place"), F.col("k").alias("before")), "place").where("before > k").count()
    assert wrong == 0 and placed.where("length(payload) = 40").count() == n


def test_transfer_prefers_the_folder(spark):
    work = spark.createDataFrame([(1, "a", "a", "x"), (2, "a", "a", "z"), (3, "c", "b", "x"), (4, "q", "q", None), (5, "a", "b", "x")], "id long, name string, raw_name string, folder string")
    ref = spark.createDataFrame([("a", "x", 5, "ax5"), ("a", "x", 3, "ax3"), ("a", "y", 1, "ay1"), ("b", "y", 2, "by2")], "name string, folder string, seq long, caption string")
    assert {r["id"]: r["caption"] for r in J.transfer(work, ref).collect()} == {1: "ax3", 2: "ay1", 3: "by2", 4: None, 5: "ax3"}


def test_harvest_of_deep_documents(spark):
    body = '{"id": 0, "a": ' * 12 + "1" + "}" * 12
    rows = spark.createDataFrame([(1, body.replace('"id": 0', '"id": %d') % tuple(range(12))), (2, "no json"), (3, None)], "k long, body string")
    assert sorted((r["k"], r["id"]) for r in S.harvest(rows, "body").collect()) == sorted((1, str(i)) for i in range(12))


def test_validation_draw_ends_after_failures_in_a_row(spark):
    rows = spark.range(40).select(F.lit("g").alias("g"), "id")
    order = [r["id"] for r in O.validation_draw(rows, "g", "id", F.lit(False), 40, seed=1).orderBy(O.drawn(F.col("g"), F.col("id"), seed=1), "id").collect()]
    assert len(order) == 40
    bad = order[3:6]
    for most, want in ((3, order[:3]), (4, order[:3] + order[6:11])):
        got = O.validation_draw(rows, "g", "id", F.col("id").isin(bad), 8, most_failures=most, seed=1)
        assert {r["id"] for r in got.collect()} == set(want)


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        sparkContext = Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_drawn_source_follows_weights(spark):
    rows = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 9.0)], "name string, w double")
    drawn = [O.weighted_choice(rows, "w", ["name"], seed=k).first()["name"] for k in range(40)]
    assert set(drawn) == {"b", "c"} and drawn.count("c") > 25
