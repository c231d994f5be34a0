"""Examples worked out by hand, and properties."""

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.functions import boxes as B
from loomline.functions import tags as T
from loomline.functions import text as X
from loomline.operators import filters as P
from loomline.operators import generator as G
from loomline.operators import ordering as O
from loomline.plans import moves
from loomline.sources import files, metadata


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(value):
    return F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)


def test_tags(spark):
    assert one(spark, T.parse(lit(" A, b,,c ,B"))) == ["a", "b", "c", "b"]
    assert one(spark, T.parse_keep_case(lit("A, b,, A"))) == ["A", "b"]
    assert one(spark, T.replace(lit(["a", "b", "c"]), "b", "a")) == ["a", "c"]
    assert one(spark, T.remove(T.parse(lit("red_hat, blue")), ["red hat"])) == ["blue"]
    assert one(spark, T.keep_only(lit(["a", "b", "c"]), ["c", "a"])) == ["a", "c"]
    assert one(spark, T.add_at(lit(["a", "b"]), "t", 9, 9)) == ["a", "b", "t"]
    assert one(spark, T.add_missing(lit(["a", "b"]), ["b", "c"], 1)) == ["a", "c", "b"]
    for bad in ("-a", "a_", "a--b", ""):
        assert not one(spark, T.is_valid(lit(bad)))


def test_text(spark):
    assert one(spark, X.shift_chars(lit("az Z9!"))) == "ba A0!"
    assert one(spark, X.clean_basename(lit("x (copy 2).png"))) == "x"
    got = one(spark, X.parse_parameters(lit("cat\nNegative prompt: dog\nSteps: 20, Seed: 5, Size: 512x768")))
    assert (got["prompt"], got["negative_prompt"], got["params"]) == ("cat", "dog", {"Steps": "20", "Seed": "5", "Size": "512x768"})
    assert one(spark, X.parse_parameters(lit("cat, Steps: 2"))) is None
    first = one(spark, X.parse_parameters_first(lit(",cat\nNegative prompt: dog,\nSteps: 20, Sampler: E a, Guidance scale: 7, Seed: 5")))
    assert tuple(first) == ("cat", "dog", "20", "E a", "7", "5")
    assert tuple(one(spark, X.seed_size_multiplier(lit("Seed: 5, Size: 512x768, Hires upscale: 1.5")))) == (5, 512, 768, 1.5)
    assert one(spark, X.aspect_folder(lit(1920), lit(1080))) == "00016x00009"
    assert [one(spark, X.extension(lit(n))) for n in ("a.tar.gz", ".bashrc", "x.JPG", "plain")] == [".tar.gz", "", ".jpg", ""]
    assert one(spark, X.cooldown_ms(lit("wait 1 hour and 30 minutes"))) == 2_700_000
    assert one(spark, X.human_bytes(lit("10kb"))) == 10240
    assert one(spark, X.price(lit("1.5k"))) == 1500
    assert one(spark, X.url_without_param(lit("http://a/b?x=1&extra=2#z"), "extra")) == "http://a/b?x=1"
    assert one(spark, X.sidecar_caption(X.sidecar_from_json(lit('{"taken_at": "2024-01-02T03:04:05+0000"}')))) == "photograph taken on 2024.01.02"
    side = '{"name": "n", "tags": ["a", "b"], "watermark": true, "user": {"fullname": " F "}, "camera": "c", "taken_at": "bad"}'
    assert one(spark, X.sidecar_caption(X.sidecar_from_json(lit(side)))) == "photography by F, n, a, b, watermark, camera c"
    assert one(spark, X.strip_components(lit("a/b/c"), 1)) == "b/c"
    assert one(spark, X.sanitise_path(lit("..x/.y/z"), [(r"^\.+", "")])) == "x/y/z"
    assert tuple(one(spark, X.image_line(lit("https://media.x/1 http://p Alt: a b")))) == ("https://media.x/1", "http://p", "a b")


@pytest.mark.parametrize(
    ("prompt", "simple"),
    [("(cat:1.2), <lora:x:1>dog", "cat, dog"), ("[a|b|c], d", "a, b, c, d"), ("x \\(y\\) BREAK z", "x (y) z"), ("(a:b:1.1)", "a, b"), ("((x))y", "x,y")],
)
def test_simplify(spark, prompt, simple):
    assert one(spark, X.simplify_prompt(lit(prompt))).replace(" ", "") == simple.replace(" ", "")


def test_filters(spark):
    assert one(spark, P.size_error(lit(100), lit(100), 100, 1000)) is None
    assert one(spark, P.size_error(lit(100), lit(100), 101, 1000)) == "below minimum"
    assert one(spark, P.small_or(lit(600), lit(500), 576)) and not one(spark, P.small_and(lit(600), lit(500), 576))
    none = F.lit(None).cast("double")
    assert one(spark, P.purge(lit(5), none, none, none, 1, 9, None, None))
    assert one(spark, P.purge(lit(5), none, none, none, 0, 9, None, None))  # a bound of 0 is a bound
    unknown = F.lit(None).cast("int")
    assert not one(spark, P.limited(lit(True), unknown, lit(1))) and one(spark, P.usable_now(lit(True), unknown, lit(1)))
    assert one(spark, P.limited(lit(True), lit(0), lit(1)))


def test_boxes(spark):
    box = lambda x, y, w, h, s=0.0: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(s).alias("score"))
    assert one(spark, B.iou(box(0, 0, 2, 2), box(1, 1, 2, 2))) == pytest.approx(1 / 7)
    kept = one(spark, B.suppressed(F.array(box(0, 0, 10, 10, 0.5), box(1, 1, 10, 10, 0.9), box(50, 50, 5, 5, 0.1)), 0.4))
    assert [(b["x"], b["score"]) for b in kept] == [(1, 0.9), (50, 0.1)]
    rows = spark.createDataFrame([("p", 0.0, 0.0, 10.0, 10.0, 0.9, "a"), ("p", 1.0, 0.0, 10.0, 10.0, 0.8, "b"), ("p", 90.0, 0.0, 5.0, 5.0, 0.7, "a")], "path string, x double, y double, w double, h double, score double, src string")
    assert [r["votes"] for r in B.agreement(rows, 0.5, 2).collect()] == [2]
    assert one(spark, B.fnv1a(lit("a"))) == "e40c292c"


def test_generator():
    assert G.expand("<loop_2>x</loop>") == "x\nx\n"
    assert G.expand("<sum_inc interval=0.5 upper=2>a:0 b:0</sum_inc>").split("\n") == ["a:0.0 b:0.0", "a:0.5 b:0.5", "a:1.0 b:1.0"]
    assert G.expand("<sum_inc count=5 lower=0 upper=1>a:0 b:0</sum_inc>").split("\n") == ["a:0.00 b:0.00", "a:0.13 b:0.12", "a:0.25 b:0.25", "a:0.38 b:0.37", "a:0.50 b:0.50"]
    lists = "<list>a\nb\nc</list><list>1\n2</list></merge>"
    assert G.expand("<merge sep=->" + lists).split("\n") == ["a-1", "b-2", "c-1"]
    assert G.expand("<merge sep=- mode=reverse>" + lists).split("\n") == ["a-2", "b-1", "c-2"]
    assert "error" in G.expand("<sum_inc count=0 lower=0 upper=1>a:0</sum_inc>")
    assert 1 <= int(G.expand("<rand_int_9_1>", seed=4)) <= 9


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.text("abcXYZ", min_size=1, max_size=8), st.text(max_size=30).map(lambda s: s.replace("\0", "").encode("latin-1", "ignore").decode("latin-1")), max_size=5))
def test_png_round_trip(values):
    values = {k: v for k, v in values.items()}
    if len({k.lower() for k in values}) < len(values):
        return
    chunk = lambda kind, content: len(content).to_bytes(4, "big") + kind + content + zlib.crc32(kind + content).to_bytes(4, "big")
    image = metadata.PNG + chunk(b"IHDR", bytes(13)) + chunk(b"tEXt", b"old\0x") + chunk(b"IEND", b"")
    made = metadata.png_with_text(image, {**values, "OLD": None})
    assert metadata.png_text(made) == values
    assert metadata.size_of(made)[0] == "PNG"


def test_metadata(spark):
    assert metadata.user_comment(b"UNICODE\0" + "hé".encode("utf-16le") + b"a\0b\0") == "héab"
    assert metadata.user_comment(b"ASCII\0\0\0plain\0") == "plain"
    head = b'{"__metadata__":{"a":"1"},"t":{"dtype":"F32","shape":[1],"data_offsets":[0,4]}}'
    tensor = len(head).to_bytes(8, "little") + head + b"BODY"
    got = one(spark, metadata.tensors(F.lit(tensor)))
    assert got["metadata"] == {"a": "1"} and got["tensors"]["t"]["dtype"] == "F32"
    stripped = metadata.tensor_with_metadata(tensor, {})
    assert stripped.endswith(b"BODY") and "__metadata__" not in metadata.tensor_header(stripped)
    assert metadata.tensor_header(b"broken") is None and metadata.png_text(b"broken") == {}


def test_ordering(spark):
    assert one(spark, O.greedy_split(lit([4, 4, 4, 9, 1]), 8)) == [0, 0, 1, 1, 2]
    rows = spark.range(100).repartition(7)
    placed = O.ordinal(rows, [F.col("id")]).collect()
    assert all(r["id"] == r["place"] for r in placed)
    assert O.exact_sample(rows.withColumn("g", F.col("id") % 3), ["g"], F.col("id"), 5, 1).count() == 15
    assert O.sample_to_target(rows, [F.col("id")], 250).count() == 250


def test_moves(spark):
    plan = spark.createDataFrame([("a/1.png", "d/x.png", "move"), ("b/1.png", "d/x.png", "move")], "src string, dst string, action string")
    assert [r["dst"] for r in moves.numbered(plan).orderBy("src").collect()] == ["d/x.png", "d/x_1.png"]
    taken = spark.createDataFrame([("d/x.png",)], "path string")
    assert [r["dst"] for r in moves.numbered(plan, taken).orderBy("src").collect()] == ["d/x_1.png", "d/x_2.png"]
    assert len({r["dst"] for r in moves.hashed(plan).collect()}) == 2
    assert [r["action"] for r in moves.overwriting(plan).orderBy("src").collect()] == ["replaced", "move"]


def test_file_scan(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for name in ("a.PNG", "b.Jpg", ".hidden.png", "s/c.txt"):
        (tmp_path / name).write_text("x, y\nz")
    found = files.scan(spark, [str(tmp_path)])
    assert {r["base"] for r in files.images(found).collect()} >= {"a.PNG", "b.Jpg"}
    assert {r["base"] for r in files.visible(files.images(found, exact_case=True)).collect()} == {"a.PNG"}
    picked = files.match_globs(found, str(tmp_path), includes=["*.txt", "*.PNG"], excludes=["s/*"])
    assert {r["base"] for r in picked.collect()} == {"a.PNG"}


def test_harvest_and_srcset(spark):
    body = '{"a": {"id": "1", "b": [{"id": "2"}, {"id": "1"}]}, "c": 3}'
    rows = spark.createDataFrame([(0, body), (1, "no json")], "k long, body string")
    assert sorted(r["id"] for r in files.harvest(rows, "body").collect()) == ["1", "2"]
    pages = spark.createDataFrame([(0, "a.jpg 100w, b.jpg 300w, c.jpg 200w")], "page_id long, srcset string")
    assert files.srcset_best(pages).first()["best"] == "b.jpg"


def test_jpeg_comment():
    plain = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x07\x08\x00\x05\x00\x06\xff\xda\x00\x02data\xff\xd9"
    made = metadata.jpeg_with_comment(plain, "cat é\nSteps: 20", "maker 1")
    assert metadata.exif_text(made) == {"parameters": "cat é\nSteps: 20", "Software": "maker 1"}
    assert metadata.size_of(made) == ("JPEG", 6, 5)
    assert metadata.jpeg_with_comment(made, None) == plain
    assert metadata.exif_text(metadata.jpeg_with_comment(made, "x")) == {"parameters": "x"}


def test_entries_and_draws(spark):
    got = one(spark, X.entry_caption(lit(["Ann B"]), lit(["Red", "Tall"]), lit(["Chan"]), "extra_tag"))
    assert got == 'ann b, red, tall, extra tag, watermark "chan"'
    a, b = spark.range(5).withColumnRenamed("id", "a"), spark.range(5).withColumnRenamed("id", "b")
    pairs = [tuple(r) for r in O.combinations(a, b, F.col("a") != F.col("b"), 8, seed=1).collect()]
    assert len(set(pairs)) == 8 and all(x != y for x, y in pairs)
    rows = spark.createDataFrame([("x",), ("x",), ("y",), *[("z",)] * 4], "k string")
    assert {tuple(r) for r in O.retries(rows, ["k"]).collect()} == {("x", 2, 2100), ("y", 1, 1500)}
