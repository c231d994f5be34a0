"""Structured Streaming operators over usage events.

Event time is a timestamp column ``ts``; watermarks bound all state. Each
operator takes and returns a streaming DataFrame (most also run on a batch one).
Spark's first watermark is the start of 1970; events up to then are late.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from loomline.session import new_path

#: A pending image counts as done at this age; another kind is dropped when it was silent for longer than the other.
IMAGE_GRACE_S, OTHER_GRACE_S = 120, 360
#: A request that was never seen busy was not accepted at the first age; any is given up at the second; one that came back earlier than the third may still be going.
ACCEPT_S, GIVE_UP_S, RETURN_S = 15, 720, 2


def events(spark: SparkSession, path: str, per_trigger: int | None = 100) -> DataFrame:
    """A stream of the files of a Parquet event table, ``ts`` as a timestamp (watermarks need one with a zone).

    A batch has ``per_trigger`` files at most, None for all; files must come in time order then, up to the watermark's delay.
    """
    schema = spark.read.parquet(path).schema
    anyhow = f"{path[:-1]}[{path[-1]}]"  # as a pattern, the path may name a folder or a single file
    reader = spark.readStream.schema(schema)
    rows = (reader if per_trigger is None else reader.option("maxFilesPerTrigger", per_trigger)).parquet(anyhow)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


#: Keys are dealt over this many groups, each with one state and one call of Python a batch, so that calls do not grow with the keys.
GROUPS = 512


def _group(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(GROUPS))


def time_slices(rows: DataFrame, least: int = 2, most: int | None = 1_000_000, key: str | None = None) -> list[DataFrame]:
    """The rows in slices by ``ts``, ascending: at least ``least`` of them and about ``most`` rows each (None: as many as fall); rows of one time stay together.

    With a ``key``, only rows of groups of keys that have over ``most`` rows
    count, so that slices grow in number with the heaviest keys alone. Only
    counts and cuts reach the driver. Rows without a time are left out.
    """
    timed = rows.where("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    counted, n = timed, 0
    if most is not None and key is not None:
        heavy = timed.groupBy(_group(key).alias("g")).count().where(F.col("count") > most).collect()
        counted, n = timed.where(_group(key).isin([r["g"] for r in heavy])) if heavy else timed, sum(r["count"] for r in heavy)
    elif most is not None:
        n = timed.count()
    k = max(least, -(-n // (most or 1)))
    at = F.unix_micros("ts")
    cuts = sorted(set(counted.agg(F.percentile_approx(at, [i / k for i in range(1, k)], 10 * k)).first()[0] or []))
    if len(cuts) > 4:  # once by folders, not a scan of all for each
        path = new_path(rows.sparkSession, "slices")
        timed.withColumn("_slice", F.size(F.filter(F.lit(cuts), lambda c: at > c))).write.partitionBy("_slice").parquet(path)
        sliced = rows.sparkSession.read.schema(StructType(timed.schema.fields).add("_slice", "integer")).parquet(path)
        return [sliced.where(F.col("_slice") == i).drop("_slice") for i in range(len(cuts) + 1)]
    edges = [None, *cuts, None]
    return [timed.where((F.lit(True) if a is None else at > a) & (F.lit(True) if b is None else at <= b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def replayed(rows: DataFrame, operator: Callable[[DataFrame], DataFrame], name: str, least: int = 2, most: int | None = 1_000_000, mode: str = "append", key: str | None = None) -> DataFrame:
    """A table through a streaming operator in batches of ascending event time, as a Parquet table of the shared folder.

    A slice is written whole, then the query goes on from its checkpoint and
    takes it as one batch, so batches come in time order on any store and however
    many files a slice has. ``most`` and ``key`` (that of a stateful operator in
    Python) are those of ``time_slices``: a call holds about that many rows.
    """
    spark = rows.sparkSession
    source, out = new_path(spark, f"source-{name}"), new_path(spark, f"stream-{name}")
    for part in time_slices(rows, least, most, key):
        part.write.mode("append").parquet(source)
        done = run_to_end(operator(spark.readStream.schema(part.schema).parquet(source)), name, mode, out)
    return done


def json_events(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Events from JSON text; lines that are no JSON are left out."""
    return lines.select(F.from_json(column, schema).alias("e")).where("e IS NOT NULL").select("e.*")


def run_to_end(stream: DataFrame, name: str, mode: str = "append", out: str | None = None) -> DataFrame:
    """All that is there now through a checkpointed query into a Parquet table of the shared folder, read back.

    With the ``out`` of an earlier run, the query goes on from its checkpoint: its state and what it has read hold over the restart.
    """
    spark = stream.sparkSession
    out = out or new_path(spark, f"stream-{name}")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def deduplicated(stream: DataFrame, key: list[str], delay: str = "1 hour") -> DataFrame:
    """The first event per key; a key is remembered for as long as the watermark's delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def tumbling(stream: DataFrame, key: list[str], width: str, delay: str = "1 hour") -> DataFrame:
    """Count, least, most and delta of value per key and tumbling window; a window is given once the watermark passes it."""
    rows = stream if stream.isStreaming is False else stream.withWatermark("ts", delay)
    grouped = rows.groupBy(*key, F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    return grouped.select(*key, F.col("window.start").alias("start"), "n", "least", "most", F.round(F.col("most") - F.col("least"), 6).alias("delta"))


def rising(stream: DataFrame, keep_s: int = 86_400, delay: str = "1 hour") -> DataFrame:
    """key, event_id, progress of every event (key, event_id, progress, ts) that brings its key further than any before it.

    Repeated and smaller values give nothing, so progress only rises. A key is
    forgotten ``keep_s`` seconds after its newest event, inside a batch too.
    Events without progress count as 0.
    """
    def step(key: str | None, held: tuple | None, rows: _Rows, mark: int) -> tuple:
        if rows is None:
            return None, None, []
        most, last = held or (None, None)
        found = []
        for now, event_id, progress in rows:
            value = 0.0 if _missing(progress) else float(progress)
            if last is not None and now >= last + keep_s * 1_000_000:
                most = None
            last = now
            if most is None or value > most:
                most = value
                found.append((key, event_id, value))
        return (most, last), last + keep_s * 1_000_000, found

    return _keyed(stream, "key", ["event_id", "progress"], _by(1), step, "key string, event_id long, progress double", "most double, last long", delay)


def signed(stream: DataFrame) -> DataFrame:
    """Events (kind counted or retracted) as +1 and -1, to be summed: a retraction takes back what was counted."""
    return stream.withColumn("delta", F.when(F.col("kind") == "retracted", -1).when(F.col("kind") == "counted", 1).otherwise(0))


#: A key's events of a batch, as tuples that begin with their time in microseconds; None once its deadline passed without any.
_Rows = list[tuple] | None
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _by(*places: int) -> Callable[[tuple], tuple]:
    """Rows by time, then by whole numbers at these places, nulls last."""
    return lambda r: (r[0], *((r[i] is None, r[i] or 0) for i in places))


def _missing(value: object) -> bool:
    return value is None or value != value


def _keyed(stream: DataFrame, key: str, columns: list[str], order: Callable[[tuple], tuple], step: Callable[[str | None, tuple | None, _Rows, int], tuple], out: str, fields: str, delay: str) -> DataFrame:
    """``step`` over the events of every key, in order, with what the key held before; many keys share a call and a state.

    It takes the key as text, what was held (the ``fields``, None at first), the
    rows (time, ``columns``) of this batch and the watermark, and gives what is
    held now (None: nothing), the deadline and rows of ``out``, whose first column
    is the key. All times are in microseconds. A key without rows is called
    once the watermark is past its deadline. Whole numbers travel as text, as
    pandas would round those of columns with nulls.
    """
    kinds, target, held_as = {f.name: f.dataType.simpleString() for f in stream.schema}, StructType.fromDDL(out), StructType.fromDDL(fields)
    timed = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if kinds[c].startswith("timestamp") else F.col(c)
    whole = {c: kinds[c] in _WHOLE or kinds[c].startswith("timestamp") for c in columns}
    passed = [timed(c).cast("string").alias(c) if whole[c] else F.col(c) for c in columns]
    names = [f.name for f in target]
    raw = ", ".join(f"{f.name} {'string' if f.name == names[0] else 'long' if f.dataType.simpleString() == 'timestamp' else f.dataType.simpleString()}" for f in target)
    kept = ", ".join(["keys array<string>", "dues array<long>", *(f"{f.name} array<{f.dataType.simpleString()}>" for f in held_as)])

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        held = {k: (due, own) for k, due, *own in zip(*state.get, strict=True)} if state.exists else {}
        rows: dict[str | None, _Rows] = {}
        for batch in () if state.hasTimedOut else batches:
            values = [[None if v is None else int(v) for v in batch[c]] if whole[c] else batch[c].tolist() for c in columns]
            for k, *row in zip(batch["_key"].tolist(), batch["_at"].tolist(), *values, strict=True):
                rows.setdefault(k, []).append(row)
        for k, (due, _own) in held.items():
            if due < mark and k not in rows:
                rows[k] = None
        found = []
        for k, own in rows.items():
            if own is not None:
                own.sort(key=order)
            now, due, made = step(k, held.pop(k)[1] if k in held else None, own, mark * 1000)
            found += made
            if now is not None:
                held[k] = (max(-(-due // 1000), mark + 1), now)
        if held:
            dues = [due for due, _own in held.values()]
            state.update((list(held), dues, *map(list, zip(*(own for _, own in held.values()), strict=True))))
            state.setTimeoutTimestamp(max(min(dues), mark + 1))
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(names, zip(*found, strict=True), strict=True)})

    marked = stream.where("ts IS NOT NULL").withWatermark("ts", delay)
    grouped = marked.select("ts", _group(key).alias("_group"), F.col(key).cast("string").alias("_key"), F.unix_micros("ts").alias("_at"), *passed).groupBy("_group")
    made = grouped.applyInPandasWithState(run, raw, kept, "append", GroupStateTimeout.EventTimeTimeout)
    return made.select(*[(F.timestamp_micros(f.name) if f.dataType.simpleString() == "timestamp" else F.col(f.name).cast(f.dataType)).alias(f.name) for f in target])


_SETTLED = "job string, outcome string, started_at timestamp, settled_at timestamp"


def settled_jobs(stream: DataFrame, image_s: int = IMAGE_GRACE_S, other_s: int = OTHER_GRACE_S, keep_s: int = 86_400, delay: str = "10 minutes") -> DataFrame:
    """job, outcome, started_at, settled_at, progress of each job.

    Events are (job, media, kind, ts, progress) of kind completed, failed or any
    other. Of events at one time a completion comes first, then a failure. An
    image that is pending ``image_s`` seconds after its first event counts as done
    (assumed) at that time; a job of another kind, or of none, is dropped once it
    was silent for over ``other_s`` seconds. A settled job ignores what follows for
    ``keep_s`` seconds; after that, and at once after it was dropped, an event
    begins a new job. progress is the most seen before the job was settled, 0 if
    none. media is that of the first event.

    Deadlines hold inside a batch as between batches, so that the same events,
    in time order, give the same rows however they are cut into batches.
    """

    def step(job: str | None, held: tuple | None, rows: _Rows, mark: int) -> tuple:
        start, last, media, progress, settled = held or (None,) * 5
        found = []

        def settle(outcome: str, at: int) -> None:
            nonlocal start, settled
            found.append((job, outcome, start, at, progress))
            start, settled = None, (None if outcome == "dropped" else at)

        def due() -> int:
            return start + image_s * 1_000_000 if media == "image" else last + other_s * 1_000_000

        def pass_time(now: int) -> None:
            nonlocal settled
            if start is not None and (now >= due() if media == "image" else now > due()):
                settle("assumed" if media == "image" else "dropped", due())
            if settled is not None and now >= settled + keep_s * 1_000_000:
                settled = None

        if rows is None:
            pass_time(mark)
        for now, own_media, kind, seen in rows or ():
            pass_time(now)
            if settled is not None:
                continue
            if start is None:
                start, media, progress = now, own_media, 0.0
            last, progress = now, max(progress, 0.0 if _missing(seen) else float(seen))
            if kind in ("completed", "failed"):
                settle(kind, now)
        if start is None and settled is None:
            return None, None, found
        return (start, last, media, progress, settled), due() if start is not None else settled + keep_s * 1_000_000, found

    rank = {"completed": 0, "failed": 1}
    fields = "start long, last long, media string, progress double, settled long"
    return _keyed(stream, "job", ["media", "kind", "progress"], lambda r: (r[0], rank.get(r[2], 2)), step, f"{_SETTLED}, progress double", fields, delay)


def attempts(stream: DataFrame, accept_s: int = ACCEPT_S, give_up_s: int = GIVE_UP_S, delay: str = "10 minutes") -> DataFrame:
    """job, outcome, started_at, settled_at of each attempt: success, returned, never_accepted or timed_out.

    Events are (job, kind clicked, busy, idle or completed, ts). A click begins
    an attempt unless one is under way. A completion is a success. An idle sight
    after a busy one ends the attempt as returned, from RETURN_S after the click;
    an idle sight without a busy one ends it as never_accepted, from ``accept_s``
    after the click. At ``give_up_s`` after the click it has timed out. Of events
    at one time completions come first, then busy, idle and clicked. Other kinds,
    and events of a job without an attempt, do nothing. Deadlines hold inside a
    batch as between batches.
    """

    def step(job: str | None, held: tuple | None, rows: _Rows, mark: int) -> tuple:
        start, busy = held or (None, False)
        found = []

        def settle(outcome: str, at: int) -> None:
            nonlocal start, busy
            found.append((job, outcome, start, at))
            start, busy = None, False

        def pass_time(now: int) -> None:
            if start is not None and now >= start + give_up_s * 1_000_000:
                settle("timed_out", start + give_up_s * 1_000_000)

        if rows is None:
            pass_time(mark)
        for now, kind in rows or ():
            pass_time(now)
            if kind == "clicked" and start is None:
                start = now
            elif start is not None and kind == "completed":
                settle("success", now)
            elif start is not None and kind == "busy":
                busy = True
            elif start is not None and kind == "idle":
                if busy and now >= start + RETURN_S * 1_000_000:
                    settle("returned", now)
                elif not busy and now >= start + accept_s * 1_000_000:
                    settle("never_accepted", now)
        return (None, None, found) if start is None else ((start, busy), start + give_up_s * 1_000_000, found)

    rank = {"completed": 0, "busy": 1, "idle": 2, "clicked": 3}
    return _keyed(stream, "job", ["kind"], lambda r: (r[0], rank.get(r[1], 4)), step, _SETTLED, "start long, busy boolean", delay)


def paced(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """key, item, asked_at, released_at of each request: at once, or when the pause that it fell into is over.

    Events are (key, kind cooldown or request, item, wait_s, ts). A cooldown
    pauses its key for ``wait_s`` seconds from then on; one that comes during a
    pause sets the end anew, earlier or later. At the end of a pause all that
    waited is released, oldest first. Of events at one time cooldowns come first.
    A cooldown without a wait, and other kinds, do nothing. The pause and what
    waits are state in the checkpoint: a query that is stopped and started again
    goes on as if it had not been stopped, and a key that neither waits nor is
    paused has no state.
    """
    def step(key: str | None, held: tuple | None, rows: _Rows, mark: int) -> tuple:
        until, items, asked = held or (None, [], [])
        found = []

        def pass_time(now: int) -> None:
            nonlocal until, items, asked
            if until is not None and now >= until:
                found.extend((key, i, a, until) for i, a in zip(items, asked, strict=True))
                until, items, asked = None, [], []

        if rows is None:
            pass_time(mark)
        for now, kind, item, wait_s in rows or ():
            pass_time(now)
            if kind == "cooldown" and not _missing(wait_s):
                until = now + int(wait_s * 1_000_000)
                pass_time(now)
            elif kind == "request" and until is None:
                found.append((key, item, now, now))
            elif kind == "request":
                items.append(item)
                asked.append(now)
        return (None, None, found) if until is None else ((until, items, asked), until, found)

    order = lambda r: (r[0], r[1] != "cooldown", r[2] is None, r[2] or 0)
    out = "key long, item long, asked_at timestamp, released_at timestamp"
    return _keyed(stream, "key", ["kind", "item", "wait_s"], order, step, out, "until long, items array<long>, asked array<long>", delay)


def rolling_quota(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """key, ts, event_id, used, limited for every counted event of (key, event_id, ts, window_s, quota).

    An event expires ``window_s`` seconds after it was counted, by the window
    that held then; later changes of the window move only later events. Events
    of a batch are taken in time order. The state holds the expiries that have
    not passed, and goes with the last of them.
    """
    def step(key: str | None, held: tuple | None, rows: _Rows, mark: int) -> tuple:
        if rows is None:
            return None, None, []
        expiries = sorted(held[0]) if held else []
        found = []
        for now, event_id, window_s, quota in rows:
            while expiries and expiries[0] <= now:
                heapq.heappop(expiries)
            heapq.heappush(expiries, now + int(window_s) * 1_000_000)
            found.append((key, now, event_id, len(expiries), len(expiries) >= quota))
        return (expiries,), max(expiries) + 1, found

    out = "key long, ts timestamp, event_id long, used long, limited boolean"
    return _keyed(stream, "key", ["event_id", "window_s", "quota"], _by(1), step, out, "expiries array<long>", delay)


def limit_locks(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """key, reached_at, renew_at of the limit hits that count.

    Events are (key, kind hit or success, ts, renew_at). A hit during a lock is
    ignored unless it brings an exact renewal time, which moves the lock and keeps
    the first time it was reached; a success ends the lock.
    """
    def step(key: str | None, held: tuple | None, rows: _Rows, mark: int) -> tuple:
        if rows is None:
            return None, None, []
        reached, renew = held or (None, None)
        found = []
        for at, kind, renew_at in rows:
            now, exact = at // 1000, None if renew_at is None else renew_at // 1000
            if renew is not None and now >= renew:
                reached = renew = None
            if kind == "success":
                reached = renew = None
            elif kind == "hit" and (renew is None or exact is not None):
                reached, renew = reached if reached is not None else now, exact if exact is not None else now + 3_600_000
                found.append((key, reached * 1000, renew * 1000))
        return (None, None, found) if renew is None else ((reached, renew), renew * 1000, found)

    out = "key long, reached_at timestamp, renew_at timestamp"
    return _keyed(stream, "key", ["kind", "renew_at"], _by(), step, out, "reached long, renew long", delay)


def late_corrections(stream: DataFrame, keep_s: int = 86_400, delay: str = "1 hour") -> DataFrame:
    """key, item, flagged_by of every counted item that a later correction flags.

    Events are (key, kind counted or corrected, item, exact, ts). A correction
    flags the item that ``exact`` names; where that is null, unknown, expired or
    flagged already, the newest unflagged item of its key. An item can be flagged
    for ``keep_s`` seconds; a correction that finds none is lost. Repeated items
    count once, events without an item are left out, other kinds do nothing.
    """
    def step(key: str | None, held: tuple | None, rows: _Rows, mark: int) -> tuple:
        if rows is None:
            return None, None, []
        open_ = dict(zip(*held, strict=True)) if held else {}  # unflagged items, oldest first
        found = []
        for now, kind, item, exact in rows:
            while open_ and open_[oldest := next(iter(open_))] + keep_s * 1_000_000 <= now:
                del open_[oldest]
            if kind == "counted":
                open_.setdefault(item, now)
            elif kind == "corrected" and open_:
                meant = exact if exact in open_ else next(reversed(open_))
                del open_[meant]
                found.append((key, meant, item))
        if not open_:
            return None, None, found
        return (list(open_), list(open_.values())), max(open_.values()) + keep_s * 1_000_000, found

    out = "key long, item long, flagged_by long"
    return _keyed(stream.where("item IS NOT NULL"), "key", ["kind", "item", "exact"], _by(2), step, out, "items array<long>, ats array<long>", delay)


def fetched_once(stream: DataFrame, keep_s: int = 86_400, delay: str = "1 hour") -> DataFrame:
    """key, event_id of every finished event that starts a fetch.

    Events are (key, kind final, saved or failed, event_id, ts); events of
    several shapes meet under one key. A final event starts a fetch unless one of
    its key is under way or was saved. A failure lets the next final event try
    again. A key is forgotten ``keep_s`` seconds after its newest event.
    """
    def step(key: str | None, held: tuple | None, rows: _Rows, mark: int) -> tuple:
        if rows is None:
            return None, None, []
        at, last = held or ("idle", None)
        found = []
        for now, kind, event_id in rows:
            if last is not None and now >= last + keep_s * 1_000_000:
                at = "idle"
            last = now
            if kind == "final" and at == "idle":
                at = "under way"
                found.append((key, event_id))
            elif at == "under way" and kind in ("saved", "failed"):
                at = "saved" if kind == "saved" else "idle"
        return (at, last), last + keep_s * 1_000_000, found

    return _keyed(stream, "key", ["kind", "event_id"], _by(2), step, "key string, event_id long", "at string, last long", delay)


def notifications(rows: DataFrame, key: list[str], message: str, quiet_s: int = 60) -> DataFrame:
    """Messages without exact repeats of the one before within the quiet time."""
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy("ts", message)
    repeat = F.lag(message).over(w).eqNullSafe(F.col(message)) & (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w)) < quiet_s)
    return rows.withColumn("_repeat", F.coalesce(repeat, F.lit(False))).where("NOT _repeat").drop("_repeat")
