"""Image measures, palettes, recolouring, turns, sizes and augmentation against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions import imaging as I
from loomline.functions import pixels as P
from loomline.operators import augment as A
from loomline.operators import drawing as D


def image(h=9, w=12, n=3, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, n), dtype=np.uint8)


def frame(spark, *images):
    return spark.createDataFrame([(f"d/{i}.png", None if x is None else P.encode(x) if isinstance(x, np.ndarray) else x) for i, x in enumerate(images)], "path string, content binary")


# ---- sharpness ----


def mirrored(i, n):
    while not 0 <= i < n:
        i = -i if i < 0 else 2 * (n - 1) - i
    return i


def laplacian_by_hand(p):
    h, w = p.shape
    at = lambda y, x: p[mirrored(y, h), mirrored(x, w)]
    values = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x) for y in range(h) for x in range(w)]
    mean = sum(values) / len(values)
    return sum((v - mean) ** 2 for v in values) / len(values)


def similarity_by_hand(p):
    """Window by window, with a blur pixel by pixel."""
    h, w = p.shape
    weights = [math.exp(-0.5 * (k / 4.1) ** 2) for k in range(-12, 13)]
    weights = [x / sum(weights) for x in weights]
    down = [[sum(weights[k + 12] * p[mirrored(y + k, h), x] for k in range(-12, 13)) for x in range(w)] for y in range(h)]
    q = np.array([[math.floor(sum(weights[k + 12] * down[y][mirrored(x + k, w)] for k in range(-12, 13)) + 0.5) for x in range(w)] for y in range(h)], float)
    c1, c2 = ((k * (p.max() - p.min())) ** 2 for k in (0.01, 0.03))
    found = []
    for y in range(h - 6):
        for x in range(w - 6):
            a, b = p[y : y + 7, x : x + 7].ravel(), q[y : y + 7, x : x + 7].ravel()
            va, vb, ab = a.var(ddof=1), b.var(ddof=1), np.cov(a, b)[0, 1]
            found.append((2 * a.mean() * b.mean() + c1) * (2 * ab + c2) / ((a.mean() ** 2 + b.mean() ** 2 + c1) * (va + vb + c2)))
    return sum(found) / len(found)


def test_sharpness(spark):
    a, plain, small = image(30, 28), np.full((20, 20, 1), 7, np.uint8), image(3, 3, 1)
    soft = I.whole(I.smoothed(a.astype(float), I.bell(4, 2.0)))
    rows = frame(spark, a, soft, plain, small, None, b"broken").select(I.sharpness(F.col("content")).alias("s"), I.sharpness(F.col("content"), True).alias("m")).collect()
    for r, p in zip(rows, (a, soft, plain, small), strict=False):
        g = I.grey(p)
        assert r["s"]["volume"] == pytest.approx(laplacian_by_hand(g), rel=1e-9)
        assert r["s"]["ssim"] == (pytest.approx(similarity_by_hand(g), rel=1e-9) if min(g.shape) >= 7 and g.max() > g.min() else 1.0 if min(g.shape) >= 7 else None)
    assert rows[1]["s"]["volume"] < rows[0]["s"]["volume"] and rows[1]["s"]["ssim"] > rows[0]["s"]["ssim"]
    assert rows[4]["s"]["volume"] is None and rows[5]["s"]["ssim"] is None
    g = I.grey(a)
    r = int(28 / 3 * 0.71)
    part = np.array([[g[y, x] if (y - 15) ** 2 + (x - 14) ** 2 <= r * r else 0 for x in range(14 - r, 14 + r)] for y in range(15 - r, 15 + r)])
    assert rows[0]["m"]["volume"] == pytest.approx(laplacian_by_hand(part), rel=1e-9)


# ---- palettes ----


def median_cut_by_hand(pixels, k):
    """Lists of single pixels; the fullest box with two colours is cut, the older of equal ones."""
    boxes, age = [(0, pixels)], 0
    while len(boxes) < k:
        open_ = [b for b in boxes if len(set(b[1])) > 1]
        if not open_:
            break
        box = min(open_, key=lambda b: (-len(b[1]), b[0]))
        boxes.remove(box)
        spans = [max(p[c] for p in box[1]) - min(p[c] for p in box[1]) for c in range(3)]
        c = spans.index(max(spans))
        values = sorted({p[c] for p in box[1]})
        cut = next(v for v in values if 2 * sum(p[c] <= v for p in box[1]) >= len(box[1]))
        if cut == values[-1]:
            cut = values[-2]
        boxes += [(age + 1, [p for p in box[1] if p[c] <= cut]), (age + 2, [p for p in box[1] if p[c] > cut])]
        age += 2
    boxes.sort(key=lambda b: (-len(b[1]), b[0]))
    return [(tuple(math.floor(sum(p[c] for p in b) / len(b) + 0.5) for c in range(3)), len(b)) for _, b in boxes]


def test_median_cut():
    rng = random.Random(1)
    for trial in range(120):
        levels = rng.choice([2, 3, 8, 256])
        pixels = [tuple(rng.randrange(levels) * (255 // max(levels - 1, 1)) for _ in range(3)) for _ in range(rng.randint(1, 60))]
        pixels += pixels[:1] * rng.choice([0, 40])
        k = rng.randint(1, 9)
        got = [(tuple(np.floor(m + 0.5).astype(int).tolist()), n) for m, n in I.median_cut(np.array(pixels, np.uint8), k)]
        assert got == median_cut_by_hand(pixels, k), trial


def test_dominant(spark):
    p = np.zeros((4, 5, 4), np.uint8)
    p[:3, :, 0], p[3, :2, 2] = 200, 90
    rows = frame(spark, p, image(2, 2, 1), None).select(I.dominant(F.col("content"), 3).alias("d")).collect()
    assert rows[0]["d"] == ["#c80000", "#000000", "#00005a"] and len(rows[1]["d"]) == 3 and rows[2]["d"] is None


def test_cheapest_assignment():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 7))
        cost = rng.integers(0, 6, (int(rng.integers(1, n + 1)), n)).astype(float)
        sums = {q: sum(cost[i, j] for i, j in enumerate(q)) for q in itertools.permutations(range(n), len(cost))}
        assert tuple(I.cheapest(cost)) == min(sums, key=lambda q: (sums[q], q))


def test_recolour(spark):
    p = image(10, 10, 4, 3)
    colours = ["#102030", "e0d0c0", " #ff0000", "#00ff00"]
    wanted = [(16, 32, 48), (224, 208, 192), (255, 0, 0), (0, 255, 0)]
    row = frame(spark, p).select(I.recolour(F.col("content"), colours, 3, 0.8).alias("r"), I.recolour(F.col("content"), colours, 6, 1.0, 1e-2, False).alias("all"), I.recolour_pairs(F.col("content"), colours, 3).alias("pairs")).first()
    own = I.palette(p, 3)
    best = min(itertools.permutations(range(4), 3), key=lambda q: sum(math.dist(own[i], wanted[j]) for i, j in enumerate(q)))
    assert [(x["source"], x["target"]) for x in row["pairs"]] == [("#%02x%02x%02x" % own[i], "#%02x%02x%02x" % wanted[j]) for i, j in enumerate(best)]
    x = np.hstack([np.array(own, float), np.ones((3, 1))])
    m, *_ = np.linalg.lstsq(np.vstack([x, 0.1 * np.eye(4)]), np.vstack([np.array([wanted[j] for j in best], float), np.zeros((4, 3))]), rcond=None)
    out = P.decode(bytes(row["r"]))
    for y, z in ((0, 0), (4, 7), (9, 9)):
        old = p[y, z, :3].astype(float)
        luma = (0.2126 * old[0] + 0.7152 * old[1] + 0.0722 * old[2]) / 255
        share = 0.8 * min(max((luma - 0.05) / 0.9, 0), 1)
        new = np.clip(old * (1 - share) + (np.r_[old, 1] @ m) * share, 0, 255)
        assert abs(out[y, z, :3] - new).max() <= 1 and out[y, z, 3] == p[y, z, 3]
    assert P.decode(bytes(row["all"])).shape == p.shape
    with pytest.raises(ValueError, match="palette"):
        I.recolour(F.col("content"), [])


# ---- turns and sizes ----


def test_upright(spark):
    a = np.array([[1, 2, 3], [4, 5, 6]], np.uint8)[:, :, None]
    want = {1: [[1, 2, 3], [4, 5, 6]], 2: [[3, 2, 1], [6, 5, 4]], 3: [[6, 5, 4], [3, 2, 1]], 4: [[4, 5, 6], [1, 2, 3]], 5: [[1, 4], [2, 5], [3, 6]], 6: [[4, 1], [5, 2], [6, 3]], 7: [[6, 3], [5, 2], [4, 1]], 8: [[3, 6], [2, 5], [1, 4]]}
    rows = spark.createDataFrame([(k, P.encode(a)) for k in (*want, 0, 9, None)] + [(6, None), (6, b"broken"), (1, b"broken")], "o int, content binary")
    got = [(r["o"], r["u"]) for r in rows.select("o", I.upright(F.col("content"), F.col("o")).alias("u")).collect()]
    for o, u in got[:11]:
        assert P.decode(bytes(u))[:, :, 0].tolist() == want.get(o, want[1])
    assert [u and bytes(u) for _, u in got[11:]] == [None, None, b"broken"]


def test_resized():
    a = np.array([[0, 10, 20], [30, 40, 50]], float)[:, :, None]
    assert I.resized(a, 3, 2)[:, :, 0].tolist() == a[:, :, 0].tolist()
    assert I.resized(a, 1, 1).ravel().tolist() == pytest.approx([25])
    assert I.resized(a, 2, 1).ravel().tolist() == pytest.approx([(0 + 30 + (10 + 40) / 2) / 3, (20 + 50 + (10 + 40) / 2) / 3])  # the middle column is shared
    assert I.resized(a[:1], 6, 1).ravel().tolist() == pytest.approx([0, 2.5, 7.5, 12.5, 17.5, 20])
    big = image(7, 11).astype(float)
    cut = I.resized(big, 4, 3)
    for y, x in itertools.product(range(3), range(4)):
        total = np.zeros(3)
        for j, i in itertools.product(range(7), range(11)):
            total += big[j, i] * max(0, min(j + 1, (y + 1) * 7 / 3) - max(j, y * 7 / 3)) * max(0, min(i + 1, (x + 1) * 11 / 4) - max(i, x * 11 / 4))
        assert cut[y, x] == pytest.approx(total / (7 / 3 * 11 / 4))


def test_downsized(spark):
    rows = frame(spark, image(40, 10, 4), image(6, 6), image(5, 90, 1), image(20, 20), image(4, 21), None, b"x").select(I.downsized(F.col("content"), 20, 8).alias("d")).collect()
    got = [(r["d"]["action"], r["d"]["width"], r["d"]["height"]) for r in rows]
    assert got == [("converted", 10, 40), ("small", 6, 6), ("resized", 20, 1), ("converted", 20, 20), ("converted", 21, 4), ("error", None, None), ("error", None, None)]
    assert P.decode(bytes(rows[2]["d"]["content"])).shape == (1, 20, 3) and rows[5]["d"]["content"] is None


def test_face_crop(spark):
    a = image(20, 30)
    rows = frame(spark, a).select(*[I.face_crop(F.col("content"), F.struct(*[F.lit(v).cast("double").alias(k) for k, v in zip("xywh", box, strict=True)]), least).alias(f"c{i}") for i, (box, least) in enumerate((((2, 3, 6, 4), 4), ((0, 0, 2, 2), 8), ((28, 18, 2, 2), 50), ((None,) * 4, 4)))]).first()
    assert (P.decode(bytes(rows["c0"])) == a[2:8, 2:8]).all()
    assert (P.decode(bytes(rows["c1"])) == a[:8, :8]).all() and (P.decode(bytes(rows["c2"])) == a[:, 10:]).all() and rows["c3"] is None


# ---- augmentation ----


def planned(spark, parts, images=None, needed=60, seed=3, **settings):
    images = images or [image(8, 10, 3, k) for k in range(5)]
    rows = frame(spark, *images).repartition(parts)
    sized = spark.createDataFrame([(f"d/{i}.png", x.shape[1], x.shape[0]) for i, x in enumerate(images)], "path string, width int, height int").repartition(parts)
    plan = A.plan(sized, needed, A.Settings(**settings), seed)
    return plan, A.augmented(plan.repartition(parts), rows)


def test_same_seed_same_bytes(spark):
    every = {k: 0.7 for k in ("crop", "rotate", "flip", "colour", "stretch", "gamma", "blur", "sharpen", "noise")}
    runs = []
    for parts in (1, 5):
        plan, made = planned(spark, parts, **every)
        runs.append((sorted(map(str, plan.collect())), sorted((r["draw"], r["out"], r["width"], r["height"], str(r["steps"]), bytes(r["content"])) for r in made.collect())))
    assert runs[0] == runs[1] and len(runs[0][1]) == 60 == len({r[1] for r in runs[0][1]})
    used = {s["op"] for r in plan.collect() for s in r["steps"]}
    assert used == set(A.STEPS)
    other, _ = planned(spark, 1, seed=4, **every)
    assert sorted(map(str, other.collect())) != runs[0][0]


def test_plan_is_the_log(spark):
    """The chances hold about, values lie in their ranges, and the pixels are the plan's chain alone."""
    images = [image(8, 10, 3, k) for k in range(5)]
    plan, made = planned(spark, 2, images, needed=400)
    rows = plan.collect()
    share = {op: sum(any(s["op"] == op for s in r["steps"]) for r in rows) / 400 for op in A.STEPS}
    assert abs(share["crop"] - 0.95) < 0.05 and abs(share["flip"] - 0.5) < 0.1 and abs(share["noise"] - 0.12) < 0.07 and share["gamma"] == 0
    order = list(A.STEPS)
    for r in rows:
        assert [order.index(s["op"]) for s in r["steps"]] == sorted(order.index(s["op"]) for s in r["steps"])
        for s in r["steps"]:
            if s["op"] == "crop":
                assert 0.78 <= s["values"][0] <= 1 and all(abs(v) <= 0.06 for v in s["values"][1:])
            if s["op"] == "rotate":
                assert abs(s["values"][0]) <= 4 and all(0.5 < v <= 1 for v in s["values"][1:])
    for r in made.limit(40).collect():
        own = images[int(r["path"][2])]
        assert (P.decode(bytes(r["content"])) == A.through(own, [(s["op"], s["values"]) for s in r["steps"]])).all() and (r["width"], r["height"]) == (10, 8)


def test_steps():
    p = image(8, 10).astype(float)
    assert (A.STEPS["crop"](p, 1.0, 0.3, -0.3) == p).all() and A.STEPS["crop"](p, 0.5, 1.0, 1.0) == pytest.approx(I.resized(p[4:, 5:], 10, 8))
    assert A.STEPS["rotate"](p, 0.0, 1.0, 1.0) == pytest.approx(p)
    square = image(6, 6).astype(float)
    assert A.STEPS["rotate"](square, 90.0, 1.0, 1.0) == pytest.approx(np.rot90(square, -1)) or A.STEPS["rotate"](square, 90.0, 1.0, 1.0) == pytest.approx(np.rot90(square))
    assert A.STEPS["colour"](p, 1.0, 1.0, 1.0) == pytest.approx(p) and (np.ptp(A.STEPS["colour"](p, 1.0, 1.0, 0.0), axis=2) < 1e-9).all()
    assert A.STEPS["gamma"](p, 1.0) == pytest.approx(p) and A.STEPS["stretch"](p).min() == 0 and A.STEPS["stretch"](np.full((2, 2, 3), 9.0)).max() == 9
    flat = np.full((5, 5, 3), 80.0)
    assert A.STEPS["blur"](flat, 0.5) == pytest.approx(flat) and (A.STEPS["sharpen"](flat, 100) == flat).all()
    assert (A.STEPS["noise"](p, 3.0, 7.0) == A.STEPS["noise"](p, 3.0, 7.0)).all() and A.STEPS["noise"](p, 0.0, 7.0) == pytest.approx(p)


def test_augment_odd_images(spark):
    sized = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", None, None), ("none", 5, 5)], "path string, width int, height int")
    contents = spark.createDataFrame([("a", P.encode(image(1, 1))), ("b", P.encode(image(1, 2, 4))), ("c", b"broken")], "path string, content binary")
    got = A.augmented(A.plan(sized, 50, A.Settings(rotate=1.0, blur=1.0, sharpen=1.0), 1), contents).collect()
    assert {r["path"]: (r["width"], r["height"], r["content"] is None) for r in got} == {"a": (1, 1, False), "b": (2, 1, False), "c": (None, None, True), "none": (None, None, True)}
    assert A.plan(sized.limit(0), 5).count() == 0


# ---- shapes, overlays, backgrounds ----


def test_shapes(spark):
    for shape in D.SHAPES:
        far = D.distance(shape, 40)
        assert far.min() < 0.03 and far[0, 0] > 0.1 and far.shape == (40, 40)
    square = D.picture("square", "red", "white", 100, 0, 40)
    assert square[4, 20].tolist() == [255, 0, 0] and square[20, 20].tolist() == [255, 255, 255] == square[0, 0].tolist()
    lines = [D.picture("parallel lines", "black", "gray", 60, r, 60) for r in (0, 90, 180)]
    assert (lines[1] == np.rot90(lines[0])).all() and (lines[2] == lines[0][::-1, ::-1]).all() and lines[0][20, 30].tolist() == [0, 0, 0] == lines[1][30, 20].tolist()
    circle = (D.picture("circle", "black", "white", 20, 0, 200)[:, :, 0] < 128).mean()
    assert circle == pytest.approx(2 * np.pi * 0.4 * 0.02, rel=0.05)
    rows = spark.range(300).repartition(3)
    one, two = (sorted(map(tuple, D.drawn_shapes(D.shape_plan(rows.repartition(k), F.col("id"), 1), 8).collect())) for k in (1, 4))
    assert one == two and {r[1] for r in one} == set(D.SHAPES) and all(r[2] != r[3] for r in one)


def test_composites(spark):
    base, top = image(4, 6, 3, 1), image(2, 3, 4, 2)
    row = frame(spark, base).select(I.covered(F.col("content"), F.lit(P.encode(top))).alias("c"), I.covered(F.lit(b"x"), F.col("content")).alias("n")).first()
    big = I.whole(I.resized(top, 6, 4)).astype(float)
    alpha = big[:, :, 3:] / 255
    assert (P.decode(bytes(row["c"])) == np.floor(base * (1 - alpha) + big[:, :, :3] * alpha + 0.5)).all() and row["n"] is None
    clear, half = image(3, 3, 4, 3), image(3, 3, 4, 4)
    clear[:, :, 3] = 0
    assert (I.composite(half, clear)[:, :, 3] == half[:, :, 3]).all() and (I.composite(clear, half)[half[:, :, 3] > 0] == half[half[:, :, 3] > 0]).all()
    cut = image(4, 4, 4, 5)
    cut[:, :, 3] = np.where(np.arange(16).reshape(4, 4) % 2, 255, 0)
    wide = image(8, 16, 3, 6)
    for x, y, left in ((0.0, 0.0, 0), (0.25, 0.9, 1), (9.0, 0.0, 4), (-0.2, -0.2, 0)):
        out = frame(spark, cut).select(I.on_background(F.col("content"), F.lit(P.encode(wide)), F.lit(x), F.lit(y)).alias("o")).first()["o"]
        under = I.whole(I.resized(wide, 8, 4))[:, left : left + 4]
        assert (P.decode(bytes(out)) == np.where(cut[:, :, 3:] == 255, cut[:, :, :3], under)).all()


def test_tints(spark):
    import colorsys

    assert len(I.TINTS) == 18
    p = image(5, 4, 3, 8).astype(float) / 255
    b, c, d = np.array([0.2, 0.5, 0.9]), np.array([0.8, 0.1, 0.3]), np.array([0.1, 0.1, 0.4])
    made = {mode: f(p, b, c, d) for mode, f in I.TINTS.items()}
    assert all(x.shape == p.shape for x in made.values())
    assert I.from_lab(I.to_lab(p)) == pytest.approx(p, abs=1e-6)
    assert I.to_lab(np.array([[[1.0, 1.0, 1.0]], [[1.0, 0.0, 0.0]]]))[:, 0] == pytest.approx(np.array([[100, 0, 0], [53.24, 80.09, 67.2]]), abs=0.02)
    assert I.to_lab(np.clip(made["luminosity"], 0, 1)).shape == p.shape
    for y, x in np.ndindex(5, 4):
        _, s, v = colorsys.rgb_to_hsv(*p[y, x])
        assert made["hue"][y, x] == pytest.approx(colorsys.hsv_to_rgb(colorsys.rgb_to_hsv(*b)[0], s, v))
        grey = p[y, x] @ np.array([0.299, 0.587, 0.114])
        assert made["grayscale"][y, x] == pytest.approx([grey] * 3) and made["dual_tone"][y, x] == pytest.approx((c + grey) / 2)
    low = made["gradient_light"]
    assert low[0] == pytest.approx(p[0] * b) and low[4] == pytest.approx(p[4] * (b + (c - b) * 0.8))
    row = frame(spark, image(3, 3, 4), None).select(I.tinted(F.col("content"), "tri_color", "#ff0000", "#00ff00", "#0000ff").alias("t")).collect()
    assert P.decode(bytes(row[0]["t"])).shape == (3, 3, 3) and row[1]["t"] is None
    with pytest.raises(ValueError, match="colours"):
        I.tinted(F.col("content"), "dual_tone", "#ffffff")
