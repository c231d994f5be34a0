"""Pixel functions on small images."""

import numpy as np
from pyspark.sql import functions as F

from loomline.functions import pixels as P


def image(h=5, w=7, n=3, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, n), dtype=np.uint8)


def frame(spark, *images):
    return spark.createDataFrame([(str(i), None if x is None else P.encode(x) if isinstance(x, np.ndarray) else x) for i, x in enumerate(images)], "path string, content binary")


def test_codec():
    for n in (1, 2, 3, 4):
        assert (P.decode(P.encode(image(n=n))) == image(n=n)).all()
    assert P.decode(b"no image") is None and P.decode(None) is None


def test_changes(spark):
    a = image()
    rows = frame(spark, a, None, b"broken").select(
        P.flip(F.col("content")).alias("f"), P.crop(F.col("content"), 1, 1, 1, 1).alias("c"), P.curve(F.col("content"), [(0, 255), (255, 0)]).alias("i"), P.histogram(F.col("content")).alias("h")
    ).collect()
    assert (P.decode(bytes(rows[0]["f"])) == a[:, ::-1]).all()
    assert (P.decode(bytes(rows[0]["c"])) == a[1:-1, 1:-1]).all()
    assert (P.decode(bytes(rows[0]["i"])) == 255 - a).all()
    assert len(rows[0]["h"]) == 768 and abs(sum(rows[0]["h"]) - 3) < 1e-9
    assert all(x is None for r in rows[1:] for x in r)


def test_grid(spark):
    a = image(6, 8)
    cells = {(r["row"], r["column"]): P.decode(bytes(r["content"])) for r in P.split_grid(frame(spark, a), 3, 2).collect()}
    assert (np.vstack([np.hstack([cells[r, c] for c in range(3)]) for r in range(2)]) == a).all()


def test_overlay(spark):
    a, b = image(4, 4), image(2, 2, 4, seed=1)
    b[:, :, 3] = 255
    rows = frame(spark, a).select(P.overlay(F.col("content"), F.lit(P.encode(b)), 1, 1).alias("o")).first()
    out = P.decode(bytes(rows["o"]))
    assert (out[1:3, 1:3] == b[:, :, :3]).all() and (out[0] == a[0]).all()


def test_changes_of_a_picture_share_a_worker(spark):
    c = F.col("content")
    rows = frame(spark, image(), None).select(P.flip(c).alias("a"), P.flip(P.crop(c, 1, 1, 1, 1), False).alias("b"), P.curve(c, [(0, 255), (255, 0)]).alias("c"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    got = rows.collect()[0]
    assert (P.decode(bytes(got["b"])) == image()[1:-1, 1:-1][::-1]).all()


def test_unfiltered_lines_are_read_at_once():
    p = P.decode(P.encode(image()))
    p[0, 0] = 7  # a picture of its own, not the file's bytes
    assert (p[1:] == image()[1:]).all() and p.dtype == np.uint8


def test_boxes_of_many_images_share_a_call(spark):
    """Images without and with agreement, boxes without numbers, and no Python group for each image."""
    from loomline.functions import boxes as B

    one = [("p", 10.0, 5.0, 20.0, 20.0, 0.9, "a"), ("p", 12.0, 5.0, 20.0, 20.0, 0.7, "b"), ("p", 11.0, 5.0, 20.0, 20.0, None, "c"), ("q", 0.0, 0.0, 5.0, 5.0, 0.5, "a"), (None, 1.0, 1.0, 4.0, 4.0, 0.5, "a"), (None, 1.0, 1.0, 4.0, 6.0, 0.4, "b")]
    rows = spark.createDataFrame(one, "path string, x double, y double, w double, h double, score double, src string")
    got = B.agreement(rows, 0.5, 2)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {("p", 11.0, 5.0, 20.0, 20.0, 3), (None, 1.0, 1.0, 4.0, 5.0, 2)}


def test_distances_of_a_shape_are_kept():
    from loomline.operators import drawing as D

    assert D.distance("star", 24) is D.distance("star", 24)
    assert (D.picture("star", "red", "blue", 60, 90, 24) == np.rot90(D.picture("star", "red", "blue", 60, 0, 24))).all()
