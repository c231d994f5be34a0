"""EXIF blocks: round trips through built files, every other field byte for byte, damaged blocks flagged."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions import pixels as P
from loomline.sources import exif as E
from loomline.sources import metadata as M


def block(order="<", comment=b"ASCII\0\0\0a cat, a dog", extra=True):
    """A block built by hand: first, EXIF, GPS and thumbnail directories, values between them."""
    mark = b"II" if order == "<" else b"MM"
    pack = lambda f, *v: struct.pack(order + f, *v)
    maker, gps = b"some maker\0", pack("IIIIII", 1, 2, 3, 4, 5, 6)
    at = {"first": 8}
    at["maker"] = at["first"] + 2 + 12 * 4 + 4
    at["exif"] = at["maker"] + len(maker) + 1
    at["comment"] = at["exif"] + 2 + 12 * 2 + 4
    at["gps"] = at["comment"] + len(comment) + len(comment) % 2
    at["gpsval"] = at["gps"] + 2 + 12 + 4
    at["thumb"] = at["gpsval"] + len(gps)
    out = mark + pack("HI", 42, 8)
    out += pack("H", 4) + pack("HHII", 0x010F, 2, len(maker), at["maker"]) + pack("HHIHH", 0x0112, 3, 1, 6, 0) + pack("HHII", 0x8769, 4, 1, at["exif"]) + pack("HHII", 0x8825, 4, 1, at["gps"]) + pack("I", at["thumb"] if extra else 0)
    out += maker + b"\0"
    out += pack("H", 2) + pack("HHIHH", 0x9207, 3, 1, 5, 0) + pack("HHII", 0x9286, 7, len(comment), at["comment"]) + pack("I", 0)
    out += comment + b"\0" * (len(comment) % 2)
    out += pack("H", 1) + pack("HHII", 2, 5, 3, at["gpsval"]) + pack("I", 0) + gps
    return out + (pack("H", 1) + pack("HHIHH", 0x0103, 3, 1, 6, 0) + pack("I", 0) if extra else b"")


def jpeg(tiff=None, tail=b"\xff\xda\0\x02pixels\xff\xd9"):
    head = b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0"
    return head + (b"" if tiff is None else b"\xff\xe1" + (len(tiff) + 8).to_bytes(2, "big") + b"Exif\0\0" + tiff) + b"\xff\xfe\0\6note" + tail


def png(tiff=None):
    whole = P.encode(np.full((2, 2, 3), 9, np.uint8))
    part = b"" if tiff is None else len(tiff).to_bytes(4, "big") + b"eXIf" + tiff + zlib.crc32(b"eXIf" + tiff).to_bytes(4, "big")
    return whole[:33] + part + whole[33:]


def values_of(data):
    found = E.located(data)
    return {(d.name, e.tag): (e.kind, e.count, e.value) for d in E.directories(found[2])[1].values() for e in d.entries if e.tag not in E.POINTERS} if found and found[2] else {}


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("wrap", [jpeg, png])
def test_other_fields_stay(order, wrap):
    data = wrap(block(order))
    before = values_of(data)
    assert len(before) == 6 and E.field_text(data, "UserComment") == "a cat, a dog" and E.orientation_of(data) == 6
    for name, text in (("UserComment", "x"), ("UserComment", "é 日 " * 30), ("UserComment", ""), ("ImageDescription", "new field"), ("Software", "ab"), ("Artist", None), ("UserComment", None)):
        made = E.with_field(data, name, text)
        where, tag = E.FIELDS[name]
        after = values_of(made)
        assert E.field_text(made, name) == text
        assert {k: v for k, v in after.items() if k != (where, tag)} == {k: v for k, v in before.items() if k != (where, tag)}
        assert E.located(data)[2][8:40] == E.located(made)[2][8:40] or name != "UserComment" or text is None  # the first directory does not move
        assert made.endswith(data[-20:]) and E.without_exif(made) == wrap()
    assert M.exif_text(E.with_field(jpeg(block(order)), "UserComment", "ünï")) == {"parameters": "ünï"}


def test_many_changes_in_a_row():
    rng = random.Random(1)
    for wrap in (jpeg, png):
        data, want = wrap(), {}
        for _ in range(60):
            name, text = rng.choice(list(E.FIELDS)), rng.choice([None, "", "a", "abc", "long " * 20, "ß日", "日本語テスト"])
            data = E.with_field(data, name, text)
            want[name] = text
            assert {n: E.field_text(data, n) for n in want} == want and E.state(data) in ("sound", "none")
    assert E.with_field(jpeg(), "Software", None) == jpeg() and E.with_field(b"GIF89a", "Software", "x") == b"GIF89a"
    assert E.with_field(jpeg(), "Software", "x" * 70_000) == jpeg()  # no segment holds it


def test_damage_is_flagged():
    good = block()
    bad = {
        "order": b"XX" + good[2:],
        "number": good[:2] + b"\0\0" + good[4:],
        "first offset": good[:4] + struct.pack("<I", 9999) + good[8:],
        "entries": good[:8] + struct.pack("<H", 900) + good[10:],
        "value": good[:18] + struct.pack("<I", 9999) + good[22:],
        "loop": good[:8 + 2 + 24 + 8] + struct.pack("<I", 8) + good[8 + 2 + 24 + 12 :],
        "short": good[:20],
        "nothing": b"II*\0",
    }
    for name, tiff in bad.items():
        data = jpeg(tiff)
        assert E.state(data) == "damaged", name
        assert E.field_text(data, "UserComment") is None and E.with_field(data, "Software", "x") == data and E.orientation_of(data) is None
        assert E.without_exif(data) == jpeg()
    assert [E.state(x) for x in (jpeg(good), png(good), jpeg(), png(), b"", b"text", jpeg()[:12])] == ["sound", "sound", "none", "none", "unknown", "unknown", "damaged"]
    broken = bytearray(png(good))
    broken[60] ^= 1
    assert E.state(bytes(broken)) == "damaged"
    rng = random.Random(2)
    for _ in range(500):  # whatever is hit, nothing raises
        hurt = bytearray(jpeg(good))
        for _ in range(rng.randint(1, 6)):
            hurt[rng.randrange(len(hurt))] = rng.randrange(256)
        hurt = bytes(hurt[: rng.randint(1, len(hurt))])
        assert E.state(hurt) in ("sound", "none", "damaged", "unknown")
        E.with_field(hurt, "UserComment", "new"), E.without_exif(hurt), E.field_text(hurt, "Software"), E.orientation_of(hurt)


def test_columns(spark):
    rows = [("a", jpeg(block()), {"Software": "s", "Other": "o"}), ("b", png(block(">")), {"UserComment": ""}), ("c", jpeg(b"XX"), {"Software": "s"}), ("d", None, None), ("e", jpeg(), None)]
    df = spark.createDataFrame(rows, "k string, content binary, wanted map<string, string>").repartition(2)
    c = F.col("content")
    got = {r["k"]: r for r in df.select("k", E.exif_state(c).alias("s"), E.exif_field(c, "UserComment").alias("f"), E.orientation(c).alias("o"), E.with_exif(c, F.col("wanted")).alias("w"), E.replace_in_field(c, "UserComment", "cat", "cow").alias("r"), E.cleaned(c).alias("x")).collect()}
    assert [(got[k]["s"], got[k]["f"], got[k]["o"]) for k in "abcde"] == [("sound", "a cat, a dog", 6), ("sound", "a cat, a dog", 6), ("damaged", None, None), (None, None, None), ("none", None, None)]
    assert E.field_text(bytes(got["a"]["r"]), "UserComment") == "a cow, a dog" and E.field_text(bytes(got["a"]["w"]), "Software") == "s"
    assert E.field_text(bytes(got["b"]["w"]), "UserComment") is None and bytes(got["e"]["r"]) == jpeg() and bytes(got["c"]["w"]) == jpeg(b"XX")
    assert bytes(got["c"]["x"]) == jpeg() and bytes(got["a"]["x"]) == jpeg(block()) and got["d"]["w"] is None


def test_edits_in_one_worker(spark):
    """Several edits of a file give what one after the other gives, over more rows than a piece, in one Python node."""
    from pyspark.sql import functions as F

    from loomline.functions.imaging import from_values
    from loomline.sources import exif

    n = F.col("id")
    rows = spark.range(1203).coalesce(1).select("id", F.when(n % 50 > 0, from_values(F.array(n % 256, n % 7, n % 5, n % 3), 2)).alias("content"))
    rows = rows.withColumn("a", F.create_map(F.lit("UserComment"), F.concat(F.lit("the "), n.cast("string")), F.lit("Artist"), F.lit("me"))).withColumn("b", F.when(n % 3 == 0, F.create_map(F.lit("UserComment"), F.lit(""))))
    got = rows.select("id", exif.edited(F.col("content"), [F.col("a"), ("UserComment", "the", "THE"), F.col("b")], ["UserComment", "Artist"]).alias("f"))
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2  # the pictures, the edits
    steps = exif.with_exif(exif.replace_in_field(exif.with_exif(F.col("content"), F.col("a")), "UserComment", "the", "THE"), F.col("b"))
    want = {r["id"]: (r["u"], r["m"]) for r in rows.select("id", steps.alias("c")).select("id", exif.exif_field(F.col("c"), "UserComment").alias("u"), exif.exif_field(F.col("c"), "Artist").alias("m")).collect()}
    assert {r["id"]: tuple(r["f"]) for r in got.collect()} == want
    assert want[1] == ("THE 1", "me") and want[3] == (None, "me") and want[50] == (None, None)
