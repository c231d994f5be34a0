"""Windows, splits, limits and seeded sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import written


def round_robin(rows: DataFrame, stem: str, parts: int) -> DataFrame:
    """``part`` for every row: distinct stems in order are dealt in turn, rows of a stem stay together.

    Stems get their global place from counts of hash-free range partitions, so no
    task sees all stems.
    """
    ranked = ordinal(rows.select(stem).distinct(), [F.col(stem)], "_place")
    return rows.join(ranked.withColumn("part", F.pmod("_place", F.lit(parts)).cast("int")).drop("_place"), stem)


def ordinal(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """A column with every row's place (from 0) in a total order, over many tasks.

    Rows are range-partitioned and sorted; a place is the row's number inside its
    partition plus the rows of earlier partitions, of which there is one count
    each. The partitioned rows are written once: ranges come from a sample of
    the rows, so a second evaluation could deal them otherwise. The order should
    be total, else equal rows get any of their places.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ordinal")
    placed = placed.withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def chunks(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """``chunk`` for every row: runs of ``size`` rows in order."""
    return ordinal(rows, order).withColumn("chunk", F.floor(F.col("place") / size).cast("long"))


def split_lines(texts: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """id, chunk, text: every text's lines in runs of ``size``; all inside the row."""
    lines = F.split(text_col, "\n")
    starts = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / size).cast("int"))
    return texts.select(id_col, F.posexplode(F.transform(starts, lambda k: F.array_join(F.slice(lines, k * size + 1, size), "\n"))).alias("chunk", "text"))


def greedy_split(lengths: Column, most: int) -> Column:
    """For an array of sizes the chunk number of each: a chunk closes once its sum reaches ``most``."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("sum"))

    def step(s, x):
        full = s["sum"] + x >= most
        return F.struct(F.concat(s["out"], F.array(s["chunk"])).alias("out"), (s["chunk"] + F.when(full, 1).otherwise(0)).alias("chunk"), F.when(full, F.lit(0).cast("long")).otherwise(s["sum"] + x).alias("sum"))

    return F.aggregate(F.transform(lengths, lambda x: x.cast("long")), start, step, lambda s: s["out"])


def with_headers(rows: DataFrame, group: list[str], order: list[str], section: str, name: str = "is_header") -> DataFrame:
    """Whether a row begins a section: its ``section`` differs from the row before."""
    before = F.lag(section).over(Window.partitionBy(*group).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) == 1
    return rows.withColumn(name, first | ~before.eqNullSafe(F.col(section)))


def keep_newest(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def last_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row per key."""
    return keep_newest(rows, key, [c.desc() for c in order], 1)


def rolling_count(rows: DataFrame, key: list[str], at: str, seconds: int) -> DataFrame:
    """``in_window`` for every row: rows of its key in (t - seconds, t]; one exactly ``seconds`` old has expired."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(*key).orderBy(micros).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return rows.withColumn("in_window", F.count(F.lit(1)).over(w))


def drawn(*parts: Column, seed: int = 0) -> Column:
    """Hexadecimal digits drawn from the parts and the seed: the MD5 of their text, joined by bars, so that any engine draws alike."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], F.lit(str(seed))))


def drawn_number(*parts: Column, seed: int = 0, digits: int = 15) -> Column:
    """A whole number of so many hexadecimal digits, 15 at most."""
    return F.conv(F.substring(drawn(*parts, seed=seed), 1, digits), 16, 10).cast("long")


def seeded(*parts: Column, seed: int = 0) -> Column:
    """A uniform number in [0, 1) drawn from the parts and the seed."""
    return drawn_number(*parts, seed=seed, digits=13) / F.lit(float(1 << 52))


def exact_sample(rows: DataFrame, key: list[str], identity: Column, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows per key without replacement, or all where there are fewer; the same rows for the same seed."""
    return keep_newest(rows, key, [drawn(identity, seed=seed), identity], n)


def sample_to_target(rows: DataFrame, order: list[Column], needed: int, seed: int = 0) -> DataFrame:
    """``needed`` draws with replacement, each with a seed of its own for what follows."""
    placed = ordinal(rows, order)
    n = placed.count()
    draws = rows.sparkSession.range(needed).select(F.col("id").alias("draw"), (drawn_number(F.col("id"), seed=seed) % max(n, 1)).alias("place"), drawn_number(F.col("id"), seed=seed + 1).alias("item_seed"))
    return draws.join(placed, "place").drop("place")


def weighted_choice(rows: DataFrame, weight: str, order: list[str], seed: int = 0) -> DataFrame:
    """One row with a chance in proportion to its weight: that with the earliest arrival of a process of its rate.

    The row with the least -ln(u) / weight, u drawn per row, is the one; rows
    without a weight above 0 are never drawn. One partial minimum per task.
    """
    arrival = -F.log(F.lit(1.0) - seeded(*[F.col(c) for c in order], seed=seed)) / F.col(weight)
    return rows.where(F.col(weight) > 0).orderBy(arrival, *order).limit(1)


def first_rows(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows in order, as paged requests with a falling remainder give them; none for a limit of 0 or less."""
    return rows.orderBy(*order).limit(max(limit, 0))


def validation_draw(files: DataFrame, group: str, member: str, blocked: Column, n: int, most_failures: int = 10, seed: int = 0) -> DataFrame:
    """Members to move out of each group: ``n`` drawn in a seeded order, leaving out blocked ones.

    A group ends early once ``most_failures`` blocked members came in a row. A
    blocked member is met once, as drawing it again could not succeed.
    """
    by_draw = Window.partitionBy(group).orderBy(drawn(F.col(group), F.col(member), seed=seed), member)
    rows = files.withColumn("_bad", F.coalesce(blocked, F.lit(False)).cast("int"))
    rows = rows.withColumns({"_place": F.row_number().over(by_draw), "_good": F.sum(1 - F.col("_bad")).over(by_draw)})
    streak = Window.partitionBy(group, "_good").orderBy("_place")
    rows = rows.withColumn("_streak", F.sum("_bad").over(streak))  # blocked ones since the last good one
    ended = F.max((F.col("_streak") >= most_failures).cast("int")).over(by_draw)
    return rows.withColumn("_ended", ended).where((F.col("_bad") == 0) & (F.col("_ended") == 0) & (F.col("_good") <= n)).select(*files.columns)


def bernoulli_words(words: Column, share: float, seed: int = 0) -> Column:
    """The first word always, others with a chance of ``share``."""
    return F.filter(words, lambda w, i: (i == 0) | (seeded(w, i, seed=seed) < share))


def shuffled(rows: DataFrame, identity: Column, seed: int = 0) -> DataFrame:
    """Rows in an order drawn from the seed."""
    return rows.orderBy(drawn(identity, seed=seed), identity)


def rank_key(value: Column, ranks: list[str]) -> Column:
    """Place of a value in a list of preferences; others come last."""
    at = F.array_position(F.array(*[F.lit(r) for r in ranks]), value)
    return F.when(at > 0, at).otherwise(F.lit(len(ranks) + 1))


def reading_order(items: DataFrame, key: list[str], x: str, y: str, tolerance: float, tie: list[str], upwards: bool = False) -> DataFrame:
    """The items with row and place, from 1, in reading order: rows from the top, each from the left; ``upwards`` all the other way round.

    A row goes on as long as the next item in order of height is within the
    tolerance of the one before, so that no fixed band cuts it. Items without a
    place are left out. A key is one page or list, whose items fit a sort.
    """
    turn = (lambda c: F.col(c).desc()) if upwards else (lambda c: F.col(c).asc())
    by_height = Window.partitionBy(*key).orderBy(turn(y), turn(x), *tie)
    gap = F.abs(F.col(y) - F.lag(y).over(by_height)) > tolerance
    rows = items.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.withColumn("row", F.coalesce(gap, F.lit(True)).cast("int"))
    rows = rows.withColumn("row", F.sum("row").over(by_height).cast("int"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("row", turn(x), turn(y), *tie)))


def from_anchor(x: Column, y: Column, at_x: Column, at_y: Column, tolerance: float, upwards: bool = False, included: bool = True) -> Column:
    """Whether an item comes at or after an anchor in reading order, give or take a pixel.

    Upwards, an anchor that is only a boundary (not ``included``) lets in what
    lies left of it alone.
    """
    same = F.abs(y - at_y) <= tolerance
    if not upwards:
        return (y > at_y + tolerance) | (same & (x >= at_x - 1))
    return (y < at_y - tolerance) | (same & (x <= at_x + 1 if included else x < at_x - 1))


def best_with_fallback(rows: DataFrame, key: list[str], wanted: Column, exact: Column, order: list[Column]) -> DataFrame:
    """The best row per key: of the wanted type unless there is none, then of exact size, then the first."""
    return keep_newest(rows, key, [F.coalesce(wanted, F.lit(False)).desc(), F.coalesce(exact, F.lit(False)).desc(), *order], 1)


def combinations(left: DataFrame, right: DataFrame, allowed: Column, n: int, seed: int = 0, most: int = 1_000_000) -> DataFrame:
    """``n`` distinct allowed pairs of two small tables, drawn by the seed; larger tables are refused."""
    size = left.count() * right.count()
    if size > most:
        raise ValueError(f"{size} pairs; at most {most} are listed")
    pairs = left.crossJoin(F.broadcast(right)).where(allowed)
    return pairs.orderBy(drawn(*[F.col(c) for c in pairs.columns], seed=seed), *pairs.columns).limit(n)


def retries(failures: DataFrame, key: list[str], most: int = 3, base_ms: int = 900, step_ms: int = 600) -> DataFrame:
    """key, attempts, wait_ms of failures to try again: at most ``most`` times, each wait ``step_ms`` longer."""
    tried = failures.groupBy(*key).agg(F.count(F.lit(1)).alias("attempts"))
    return tried.where(F.col("attempts") <= most).withColumn("wait_ms", F.lit(base_ms) + F.lit(step_ms) * F.col("attempts"))
