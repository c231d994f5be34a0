"""Stateful streams by example: the ways that the registered queries do not take."""

import os
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomline.streaming import usage as U

START = datetime(2024, 1, 1)


def _stream(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return U.events(spark, f"{folder}/events.parquet", None)


def test_late_corrections(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    rows = [
        (1, "counted", 10, None, at(0)),
        (1, "counted", 11, None, at(1)),
        (1, "counted", 11, None, at(2)),  # again: counts once
        (1, "counted", 12, None, at(3)),
        (1, "other", 13, None, at(4)),
        (1, "corrected", 20, 10, at(5)),  # the item it names
        (1, "corrected", 21, 10, at(6)),  # flagged already: the newest
        (1, "corrected", 22, 99, at(7)),  # unknown: the newest left
        (1, "corrected", 23, None, at(8)),  # none is left
        (2, "counted", 30, None, at(0)),
        (2, "counted", None, None, at(1)),
        (2, "corrected", 31, 30, at(24)),  # expired at this very time
        (3, "corrected", 40, None, at(1)),
    ]
    stream = _stream(spark, tmp_path, rows, "key long, kind string, item long, exact long, ts timestamp")
    got = U.run_to_end(U.late_corrections(stream), "late-test").collect()
    assert {tuple(r) for r in got} == {(1, 10, 20), (1, 12, 21), (1, 11, 22)} and len(got) == 3


def test_fetched_once(spark, tmp_path):
    kinds = {"a": ["final", "final", "failed", "final", "saved", "final"], "b": ["saved", "failed", "final", "final"], "c": ["failed"]}
    rows = [(k, kind, 10 * n + i, datetime(2024, 1, 1, 0, i)) for n, (k, own) in enumerate(kinds.items()) for i, kind in enumerate(own)]
    stream = _stream(spark, tmp_path, rows, "key string, kind string, event_id long, ts timestamp")
    got = U.run_to_end(U.fetched_once(stream), "fetch-test").collect()
    assert sorted(tuple(r) for r in got) == [("a", 0), ("a", 3), ("b", 12)]


def test_fetched_once_forgets_inside_a_batch(spark, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    rows = [("a", "final", 1, at(0)), ("a", "saved", 2, at(1)), ("a", "final", 3, at(24)), ("a", "final", 4, at(48)), ("a", "saved", 5, at(49)), ("a", "final", 6, at(73))]
    stream = _stream(spark, tmp_path, rows, "key string, kind string, event_id long, ts timestamp")
    got = U.run_to_end(U.fetched_once(stream), "fetch-forget").collect()
    assert sorted(r["event_id"] for r in got) == [1, 4, 6]  # 3 comes 23 hours after 2; 4 and 6 come a whole day after 3 and 5


# ---- the same events, however they are cut ----


def files_of(folder, rows, count):
    """The rows (dicts in time order) in ``count`` Parquet files whose times of change ascend."""
    os.makedirs(folder)
    table = pa.Table.from_pylist(rows)
    table = table.set_column(table.schema.get_field_index("ts"), "ts", table["ts"].cast(pa.timestamp("us", "UTC")))
    bounds = [round(i * len(rows) / count) for i in range(count + 1)]
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if a < b:
            path = f"{folder}/{i:05d}.parquet"
            pq.write_table(table.slice(a, b - a), path)
            os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return folder


def job_rows(n=900, seed=1):
    rng = random.Random(seed)
    rows, now = [], START
    for k in range(n):
        now += timedelta(seconds=rng.choice([0, 1, 5, 20, 40]), microseconds=k)
        job = rng.randrange(60)
        rows.append({"job": f"j{job}", "media": ["image", "video", None][job % 3], "kind": rng.choice(["started", "progress", "progress", "failed", "completed"]), "ts": now, "progress": rng.choice([None, float(rng.randint(0, 100))])})
    rows.append({"job": "end", "media": "image", "kind": "started", "ts": now + timedelta(hours=3), "progress": None})
    return rows


def settled_by_hand(rows, image_s=120, other_s=360, keep_s=600, delay_s=600):
    """Job by job; the newest event less the delay is as far as time is known to have passed, but for jobs with later events."""
    mark = max(r["ts"] for r in rows) - timedelta(seconds=delay_s)
    out = []
    for job in {r["job"] for r in rows}:
        own = sorted((r for r in rows if r["job"] == job), key=lambda r: (r["ts"], {"completed": 0, "failed": 1}.get(r["kind"], 2)))
        live = settled = None
        for r in [*own, None]:
            now = r["ts"] if r else None
            if live:
                image = live["media"] == "image"
                due = live["start"] + timedelta(seconds=image_s) if image else live["last"] + timedelta(seconds=other_s)
                if (now >= due if image else now > due) if r else due < mark:
                    out.append((job, "assumed" if image else "dropped", live["start"], due, live["progress"]))
                    live, settled = None, (due if image else None)
            if not r:
                break
            if settled and now >= settled + timedelta(seconds=keep_s):
                settled = None
            if settled:
                continue
            live = live or {"start": now, "media": r["media"], "progress": 0.0}
            live["last"], live["progress"] = now, max(live["progress"], r["progress"] or 0.0)
            if r["kind"] in ("completed", "failed"):
                out.append((job, r["kind"], live["start"], now, live["progress"]))
                live, settled = None, now
    return sorted(out)


@pytest.mark.parametrize(("files", "per_trigger"), [(1, None), (7, 1), (300, 30)])
def test_settled_jobs_do_not_depend_on_batches(spark, tmp_path, files, per_trigger):
    rows = job_rows()
    stream = U.events(spark, files_of(f"{tmp_path}/in", rows, files), per_trigger)
    got = U.run_to_end(U.settled_jobs(stream, keep_s=600), "jobs-cut")
    assert sorted(tuple(r) for r in got.collect()) == settled_by_hand(rows)
    assert {r["outcome"] for r in got.collect()} == {"assumed", "dropped", "completed", "failed"}


def test_a_late_completion_finds_its_job_settled(spark, tmp_path):
    """Four events in one batch and in four: job a is done by time, once."""
    at = lambda s: START + timedelta(seconds=s)
    rows = [{"job": j, "media": "image", "kind": k, "ts": at(s), "progress": 1.0} for j, k, s in (("a", "started", 0), ("b", "started", 200), ("a", "completed", 5000), ("c", "started", 9000))]
    for files, per_trigger in ((1, None), (4, 1)):
        stream = U.events(spark, files_of(f"{tmp_path}/in{files}", rows, files), per_trigger)
        got = sorted((r["job"], r["outcome"], r["settled_at"]) for r in U.run_to_end(U.settled_jobs(stream), "late-end").collect())
        assert got == [("a", "assumed", at(120)), ("b", "assumed", at(320))]


@pytest.mark.parametrize(("files", "per_trigger"), [(1, None), (20, 3)])
def test_attempts(spark, tmp_path, files, per_trigger):
    cases = {
        "success": [("clicked", 0), ("busy", 1), ("idle", 1.5), ("completed", 50)],
        "returned": [("clicked", 0), ("busy", 1), ("idle", 1.9), ("busy", 5), ("idle", 6), ("completed", 7)],
        "never": [("clicked", 0), ("idle", 3), ("idle", 14.9), ("idle", 15), ("completed", 16)],
        "timed": [("clicked", 0), ("busy", 5), ("completed", 720)],
        "timer": [("clicked", 0), ("busy", 5)],
        "both": [("clicked", 0), ("busy", 2), ("idle", 20), ("completed", 20)],
        "again": [("idle", 0), ("completed", 1), ("clicked", 2), ("clicked", 3), ("completed", 4), ("clicked", 5), ("idle", 21)],
        "open": [("clicked", 2000)],
        "other": [("clicked", 0), ("seen", 9), ("busy", 10), ("idle", 11)],
        "end": [("seen", 2500)],
    }
    rows = [{"job": j, "kind": k, "ts": START + timedelta(seconds=s)} for j, own in cases.items() for k, s in own]
    stream = U.events(spark, files_of(f"{tmp_path}/in", sorted(rows, key=lambda r: r["ts"]), files), per_trigger)
    got = {(r["job"], r["outcome"], (r["started_at"] - START).total_seconds(), (r["settled_at"] - START).total_seconds()) for r in U.run_to_end(U.attempts(stream), "attempts").collect()}
    assert got == {
        ("success", "success", 0, 50), ("returned", "returned", 0, 6), ("never", "never_accepted", 0, 15), ("timed", "timed_out", 0, 720), ("timer", "timed_out", 0, 720),
        ("both", "success", 0, 20), ("again", "success", 2, 4), ("again", "never_accepted", 5, 21), ("other", "returned", 0, 11),
    }


def pause_rows(seed=2):
    rng = random.Random(seed)
    rows, now = [], START
    for k in range(400):
        now += timedelta(seconds=rng.choice([0, 1, 10, 60]))
        cools = rng.random() < 0.15
        rows.append({"key": rng.randrange(12), "kind": "cooldown" if cools else rng.choice(["request", "request", "other"]), "item": k, "wait_s": rng.choice([None, 0.0, 30.0, 300.5, 3600.0]) if cools else None, "ts": now})
    rows.append({"key": 99, "kind": "other", "item": 400, "wait_s": None, "ts": now + timedelta(hours=5)})
    return rows


def paced_by_hand(rows):
    out = []
    for key in {r["key"] for r in rows}:
        until, held = None, []
        for r in [*sorted((r for r in rows if r["key"] == key), key=lambda r: (r["ts"], r["kind"] != "cooldown", r["item"])), None]:
            if until and (r is None or r["ts"] >= until):
                out += [(key, i, a, until) for i, a in held]
                until, held = None, []
            if r is None:
                break
            if r["kind"] == "cooldown" and r["wait_s"] is not None:
                until = r["ts"] + timedelta(seconds=r["wait_s"])
                if until <= r["ts"]:
                    out += [(key, i, a, until) for i, a in held]
                    until, held = None, []
            elif r["kind"] == "request" and until:
                held.append((r["item"], r["ts"]))
            elif r["kind"] == "request":
                out.append((key, r["item"], r["ts"], r["ts"]))
    return sorted(out)


def test_pauses_hold_over_a_restart(spark, tmp_path):
    """A query that is stopped half way, in the middle of pauses, and started again gives what an uninterrupted one gives."""
    rows = pause_rows()
    whole = U.run_to_end(U.paced(U.events(spark, files_of(f"{tmp_path}/whole", rows, 5), 1)), "paced")
    want = paced_by_hand(rows)
    assert sorted(tuple(r) for r in whole.collect()) == want and any(r[2] < r[3] for r in want)
    out = f"file://{tmp_path}/out"
    for part in (rows[:150], rows[150:160], rows[160:]):
        folder = f"{tmp_path}/parts"
        if not os.path.isdir(folder):
            files_of(folder, part, 1)
        else:
            made = files_of(f"{tmp_path}/more{len(part)}", part, 1)
            os.rename(f"{made}/00000.parquet", f"{folder}/{len(part):05d}.parquet")
        done = U.run_to_end(U.paced(U.events(spark, folder, None)), "paced-parts", out=out)
    assert sorted(tuple(r) for r in done.collect()) == want
    assert len(os.listdir(f"{tmp_path}/out-state/commits")) >= 3


def test_time_slices(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 50 != 7, F.timestamp_seconds(F.col("id") / 10)).alias("ts"), "id")
    parts = U.time_slices(rows, least=3, most=100)
    sizes = [p.count() for p in parts]
    assert len(parts) == 10 and sum(sizes) == 980 and max(sizes) < 130
    edges = [p.agg(F.min("ts"), F.max("ts")).first() for p in parts]
    assert all(a[1] < b[0] for a, b in zip(edges[:-1], edges[1:], strict=True))
    assert sum(p.count() for p in U.time_slices(rows.withColumn("ts", F.timestamp_seconds(F.lit(5))), 3, 100)) == 1000
    assert [p.count() for p in U.time_slices(rows.limit(0))] == [0]


def test_replayed_holds_state_between_slices(spark):
    rows = spark.range(40).select(F.lit(1).cast("long").alias("key"), F.timestamp_seconds(F.col("id") * 60 + 60).alias("ts"), F.col("id").alias("event_id"), F.lit(600).alias("window_s"), F.lit(4).alias("quota"))
    got = U.replayed(rows, U.rolling_quota, "slices", least=4).orderBy("event_id").collect()
    assert [r["used"] for r in got] == [min(i + 1, 10) for i in range(40)]
    assert U.replayed(rows.limit(0), U.rolling_quota, "no-slices").count() == 0


def test_calls_and_state_do_not_grow_with_keys(spark, tmp_path):
    """Many keys share a state; each still has its own results, and whole numbers are exact beside nulls."""
    big = 2**53 + 1
    rows = spark.range(3000).select(F.concat(F.lit("k"), F.col("id") % 1500).alias("key"), F.lit("final").alias("kind"), (F.col("id") + big).alias("event_id"), F.timestamp_seconds(F.col("id") + 100).alias("ts"))
    rows = rows.union(spark.createDataFrame([("k0", "failed", None, START)], "key string, kind string, event_id long, ts timestamp"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = f"file://{tmp_path}/out"
    got = U.run_to_end(U.fetched_once(U.events(spark, f"{tmp_path}/in", None)), "keys", out=out)
    assert sorted(map(tuple, got.collect())) == sorted((f"k{i}", big + i) for i in range(1500))
    assert spark.read.format("statestore").load(out + "-state").count() <= U.GROUPS


def test_slices_grow_with_heavy_keys_alone(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 1000, -1).otherwise(F.col("id")).alias("key"), F.timestamp_seconds(F.col("id")).alias("ts"))
    assert len(U.time_slices(rows.where("key >= 0"), 2, 200, "key")) == 2
    parts = U.time_slices(rows, 2, 200, "key")
    assert len(parts) > 4 and sum(p.count() for p in parts) == 5000
    assert max(p.where("key = -1").count() for p in parts) <= 250
    edges = [p.agg(F.min("ts"), F.max("ts")).first() for p in parts]
    assert all(a[1] < b[0] for a, b in zip(edges[:-1], edges[1:], strict=True))
