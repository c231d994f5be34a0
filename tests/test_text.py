"""Text expressions that are worked out once, and what they give."""

import random
import time
from functools import reduce

from pyspark.sql import functions as F

from loomline.functions import text as X
from loomline.queries import QUERIES
from loomline.sources import metadata as M


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_split_once(spark):
    body = "p\nNegative prompt: n\nSteps: 1, Size: 2x3, odd, Seed: 4, Size: 5x6"
    rows = spark.createDataFrame([(body,), ("no marker",), (None,)], "body string")
    found = rows.select(X.parse_parameters(F.col("body")).alias("g")).select("g.prompt", F.col("g.params")["Size"].alias("size"), F.map_keys("g.params").alias("keys"))
    assert [tuple(r) for r in found.collect()] == [("p", "5x6", ["Steps", "Seed", "Size"]), (None, None, None), (None, None, None)]
    assert _plan(rows.select(X.parse_parameters(F.col("body")).alias("g"))).count("split(") == 1
    lines = rows.select(M.key_values(F.lit("a=1\nb=2\n a = 3\nnone")).alias("m"), M.key_values(F.col("body")).alias("n"))
    assert lines.first()["m"] == {"b": "2", "a": "3"} and _plan(lines.select("n")).count("split(") == 1


def test_prompts_are_simplified_as_by_the_plain_rules(spark):
    rng = random.Random(5)
    parts = ["(", ")", "[", "]", ":", ",", " ", "  ", "<", ">", "|", "\\(", "\\)", "(:0)", "( :0)", "BREAK", "1.5", "12", "a", "bc", "\n", "\t", "\ue000", "lora"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    plain = reduce(lambda x, p: F.regexp_replace(x, p[0].replace("++", "+").replace("*+", "*"), p[1]), X.SIMPLIFY, F.col("t"))
    assert rows.where(~X.strip(plain).eqNullSafe(X.simplify_prompt(F.col("t")))).count() == 0
    began = time.perf_counter()  # brackets that never close were searched to the end of the text, each
    assert spark.createDataFrame([("(" * 100_000,)], "t string").select(X.simplify_prompt(F.col("t")).alias("t")).first()["t"] == ""
    assert time.perf_counter() - began < 8


def test_text_chunks_of_many_maps_share_a_process(spark, sf):
    from loomline import file_queries  # noqa: F401

    assert _plan(QUERIES["png_text_chunks"](spark, sf)).count("ArrowEvalPython") <= 2
