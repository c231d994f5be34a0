"""Registered queries over images: grey pictures of eight by eight pixels made from the embedding table."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import imaging as I
from loomline.operators import augment, drawing
from loomline.operators import joins as J
from loomline.operators import ordering as O
from loomline.queries import query
from loomline.sources import exif

#: Each picture in SQL, v from 0 to 63.
_V = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: greatest(least(floor((x::DOUBLE + 4) * 32), 255), 0)::INT) AS v FROM embeddings)"


def _pictures(t):
    values = F.transform("embedding", lambda x: F.greatest(F.least(F.floor((x.cast("double") + 4) * 32), F.lit(255)), F.lit(0)).cast("int"))
    return t("embeddings").select("vec_id", "label", I.from_values(values, 8).alias("content"))


def _shown(content):
    return F.array_join(I.to_values(content), " ")


@query(f"""{_V}, e AS (SELECT vec_id, list_transform(range(64), lambda i: v[i + 1] * -4 + v[1 + (i // 8) * 8 + abs(i % 8 - 1)] + v[1 + (i // 8) * 8 + CASE WHEN i % 8 = 7 THEN 6 ELSE i % 8 + 1 END]
  + v[1 + abs(i // 8 - 1) * 8 + i % 8] + v[1 + CASE WHEN i // 8 = 7 THEN 6 ELSE i // 8 + 1 END * 8 + i % 8]) AS e FROM v)
SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x))::DOUBLE / 64 - (list_sum(e)::DOUBLE / 64) * (list_sum(e)::DOUBLE / 64), 3) AS volume FROM e""")
def image_edge_variance(t):
    return _pictures(t).select("vec_id", F.round(I.sharpness(F.col("content"))["volume"], 3).alias("volume"))


@query(f"""{_V} SELECT vec_id, array_to_string(flatten(list_transform(range(16), lambda k: list_transform(range(3), lambda c:
  floor((v[1 + (k // 4) * 16 + k % 4 * 2] + v[2 + (k // 4) * 16 + k % 4 * 2] + v[9 + (k // 4) * 16 + k % 4 * 2] + v[10 + (k // 4) * 16 + k % 4 * 2]) / 4.0 + 0.5)::INT))), ' ') AS pixels FROM v""")
def image_downsize(t):
    small = I.downsized(F.col("content"), 4, 1)
    return _pictures(t).select("vec_id", small.alias("d")).select("vec_id", _shown(F.col("d.content")).alias("pixels"))


@query(f"""{_V}, o AS (SELECT vec_id, v, 1 + vec_id % 9 AS o FROM v)
SELECT vec_id, o::INT AS orientation, array_to_string(list_transform(range(64), lambda i: v[1 + CASE o WHEN 2 THEN i // 8 * 8 + 7 - i % 8 WHEN 3 THEN 63 - i WHEN 4 THEN (7 - i // 8) * 8 + i % 8
  WHEN 5 THEN i % 8 * 8 + i // 8 WHEN 6 THEN (7 - i % 8) * 8 + i // 8 WHEN 7 THEN (7 - i % 8) * 8 + 7 - i // 8 WHEN 8 THEN i % 8 * 8 + 7 - i // 8 ELSE i END]), ' ') AS pixels FROM o""")
def image_upright(t):
    rows = _pictures(t).withColumn("orientation", (F.col("vec_id") % 9 + 1).cast("int"))
    return rows.select("vec_id", "orientation", _shown(I.upright(F.col("content"), F.col("orientation"))).alias("pixels"))


_CUT = f"""{_V}, p AS (SELECT vec_id, unnest(v) AS x FROM v),
n AS (SELECT vec_id, x, sum(count(*)) OVER (PARTITION BY vec_id ORDER BY x) AS upto, max(x) OVER (PARTITION BY vec_id) AS top FROM p GROUP BY vec_id, x),
c AS (SELECT vec_id, coalesce(min(x) FILTER (2 * upto >= 64 AND x < top), max(x) FILTER (x < top)) AS cut FROM n GROUP BY vec_id),
b AS (SELECT vec_id, coalesce(x > cut, false) AS upper, floor(avg(x) + 0.5)::INT AS m, count(*) AS k FROM p JOIN c USING (vec_id) GROUP BY 1, 2),
d AS (SELECT vec_id, list(m ORDER BY k DESC, upper) AS m FROM b GROUP BY vec_id)"""


@query(f"{_CUT} SELECT vec_id, array_to_string(list_transform(m, lambda x: format('#{{0:02x}}{{0:02x}}{{0:02x}}', x)), ' ') AS colours FROM d")
def image_dominant(t):
    return _pictures(t).select("vec_id", F.array_join(I.dominant(F.col("content"), 2), " ").alias("colours"))


@query(f"""{_CUT}, w AS (SELECT vec_id, m, list_transform(m, lambda x: [sqrt(x * x + (x - 64) * (x - 64) + (x - 128) * (x - 128)), sqrt((x - 200) * (x - 200) + (x - 180) * (x - 180) + (x - 160) * (x - 160)), sqrt(3 * (x - 90) * (x - 90))]) AS c FROM d),
q AS (SELECT vec_id, m, unnest(CASE WHEN len(m) = 2 THEN [[1, 2], [1, 3], [2, 1], [2, 3], [3, 1], [3, 2]] ELSE [[1], [2], [3]] END) AS q, c FROM w),
s AS (SELECT vec_id, m, q, row_number() OVER (PARTITION BY vec_id ORDER BY CASE WHEN len(q) = 2 THEN c[1][q[1]] + c[2][q[2]] ELSE c[1][q[1]] END, q) AS k FROM q)
SELECT vec_id, array_to_string(list_transform(m, lambda x, i: format('#{{0:02x}}{{0:02x}}{{0:02x}}', x) || '=' || ['#004080', '#c8b4a0', '#5a5a5a'][q[i]]), ' ') AS pairs FROM s WHERE k = 1""")
def image_recolour_pairs(t):
    pairs = F.transform(I.recolour_pairs(F.col("content"), ["#004080", "#c8b4a0", "#5a5a5a"], 2), lambda p: F.concat(p["source"], F.lit("="), p["target"]))
    return _pictures(t).select("vec_id", F.array_join(pairs, " ").alias("pairs"))


_CHANCES = {"crop": 0.95, "rotate": 0.4, "flip": 0.5, "colour": 0.55, "stretch": 0.0, "gamma": 0.0, "blur": 0.12, "sharpen": 0.18, "noise": 0.12}
_U = "('0x' || md5(item_seed || '|{0}|11')[1:13])::BIGINT / 4503599627370496.0"


@query(f"""WITH p AS (SELECT 'pictures/' || vec_id AS stem, 'pictures/' || vec_id || '.png' AS path, row_number() OVER (ORDER BY 'pictures/' || vec_id || '.png') - 1 AS place, count(*) OVER () AS n FROM embeddings),
d AS (SELECT i AS draw, path, stem, ('0x' || md5(i || '|12')[1:15])::BIGINT AS item_seed FROM (SELECT unnest(range(2 * (SELECT count(*) FROM embeddings))) AS i) JOIN p ON place = ('0x' || md5(i || '|11')[1:15])::BIGINT % n)
SELECT draw, path, item_seed, stem[10:] || '__aug_' || lpad((draw + 1)::VARCHAR, 8, '0') || '_' || right(lpad(lower(to_hex(item_seed)), 16, '0'), 8) || '.png' AS out,
  array_to_string(list_filter([{", ".join(f"CASE WHEN {_U.format(op + '?')} < {chance} THEN '{op}' END" for op, chance in _CHANCES.items())}], lambda x: x IS NOT NULL), ' ') AS ops,
  CASE WHEN {_U.format('crop?')} < 0.95 THEN round({_U.format('scale')} * (1.0 - 0.78) + 0.78, 9) END AS scale FROM d""")
def augmentation_plan(t):
    """Two draws for every picture on average, and the steps that each goes through."""
    sized = _pictures(t).select(F.format_string("pictures/%d.png", "vec_id").alias("path"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    rows = augment.plan(sized, 2 * t("embeddings").count(), seed=11)
    crop = F.get(F.filter("steps", lambda s: s["op"] == "crop"), F.lit(0))
    return rows.select("draw", "path", "item_seed", "out", F.array_join(F.transform("steps", lambda s: s["op"]), " ").alias("ops"), F.round(F.get(crop["values"], F.lit(0)), 9).alias("scale"))


@query()
def augmentation_log(t):
    """Two draws for every picture on average, and what was done to each."""
    pictures = _pictures(t).select(F.format_string("pictures/%d.png", "vec_id").alias("path"), "content")
    sized = pictures.select("path", F.lit(8).alias("width"), F.lit(8).alias("height"))
    made = augment.augmented(augment.plan(sized, 2 * t("embeddings").count(), seed=11), pictures)
    steps = F.array_join(F.transform("steps", lambda s: F.concat(s["op"], F.lit("("), F.array_join(s["values"].cast("array<string>"), ","), F.lit(")"))), " ")
    return made.select("draw", "path", "out", "width", "height", steps.alias("steps"), F.sha2("content", 256).alias("sha256"))


@query("SELECT doc_id, length(t) AS n_chars, sha256(t) AS sha256 FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'none' WHEN text LIKE '%the%' THEN replace(text, 'the', 'THE') ELSE text END AS t FROM documents WHERE doc_id % 4 = 0 OR text <> '')")
def exif_replaced(t):
    """Whole texts as user comments of PNGs, a word replaced in them, read back; each fourth comment is taken out and another field set."""
    picture = I.from_values(F.array(*[(F.col("doc_id") * k % 256).cast("int") for k in range(1, 5)]), 2)
    first = F.create_map(F.lit("UserComment"), F.col("text"), F.lit("Artist"), F.lit("none"))
    fields = F.when(F.col("doc_id") % 4 == 0, F.create_map(F.lit("UserComment"), F.lit(""))).otherwise(F.create_map(F.lit("Artist"), F.lit("")))
    rows = t("documents").select("doc_id", exif.edited(picture, [first, ("UserComment", "the", "THE"), fields], ["UserComment", "Artist"]).alias("f"))
    text = F.coalesce("f.UserComment", "f.Artist")
    return rows.select("doc_id", text.alias("t")).where("t IS NOT NULL").select("doc_id", F.char_length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("sha256"))


@query(f"""{_V} SELECT vec_id, array_to_string(flatten(list_transform(range(64), lambda i: list_transform(range(3), lambda c: floor(v[1 + i] * (1 - ((i // 8 // 4 * 2 + i % 8 // 4) * 60) / 255.0::DOUBLE) + (c * 100) * ((i // 8 // 4 * 2 + i % 8 // 4) * 60) / 255.0::DOUBLE + 0.5)::INT))), ' ') AS pixels FROM v""")
def image_overlays(t):
    """One overlay of two by two pixels, of growing density, over every picture."""
    corners = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.array(F.lit(0), F.lit(100), F.lit(200), k * 60)))
    overlay = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.slice(corners, ((F.floor(i / 32) * 2 + F.floor(i % 8 / 4)) * 4 + 1).cast("int"), 4)))
    return _pictures(t).select("vec_id", _shown(I.covered(F.col("content"), I.from_values(overlay, 8, 4))).alias("pixels"))


@query(f"""{_V}, b AS (SELECT vec_id, v AS q, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS n FROM v),
d AS (SELECT v.vec_id AS id, v, d::INT AS draw, q, b.vec_id AS background FROM v, range(2) r(d) JOIN b ON place = ('0x' || md5(v.vec_id || '|' || d || '|6')[1:15])::BIGINT % n)
SELECT id, draw, background, array_to_string(flatten(list_transform(range(32), lambda i: list_transform(range(3), lambda c: CASE WHEN v[2 * i + 2] >= 128 THEN v[2 * i + 1] ELSE q[1 + i // 4 * 8 + i % 4 + draw] END))), ' ') AS pixels FROM d""")
def image_backgrounds(t):
    """Every picture as a narrow cut-out (grey and an alpha that is all or nothing) over two drawn pictures, the second one moved by a quarter."""
    alpha = F.transform(I.to_values(F.col("content")), lambda v, i: F.when(i % 2 == 1, F.when(v >= 128, 255).otherwise(0)).otherwise(v))
    subjects = _pictures(t).select(F.col("vec_id").alias("id"), I.from_values(alpha, 4, 2).alias("content"))
    backgrounds = O.ordinal(_pictures(t).select(F.col("vec_id").alias("background"), F.col("content").alias("below")), [F.col("background")])
    drawn = J.with_backgrounds(subjects, backgrounds, 2, seed=6)
    made = I.on_background(F.col("content"), F.col("below"), F.col("draw") * 0.25, F.lit(-0.1))
    return drawn.select("id", "draw", "background", _shown(made).alias("pixels"))


_PICK = "('0x' || md5(p_partkey || '|{0}|8')[1:15])::BIGINT % {1}"
_INK = _PICK.format("colour", 6)


@query(f"""WITH d AS (SELECT p_partkey, ['square', 'triangle', 'circle', 'parallel lines', 'rectangle', 'pentagon', 'star'][1 + {_PICK.format('shape', 7)}] AS shape, {_INK} AS ink,
  ({_INK} + 1 + {_PICK.format('background', 5)}) % 6 AS paper, (20 + {_PICK.format('width', 131)})::INT AS width, ({_PICK.format('rotation', 4)} * 90)::INT AS rotation FROM part),
n AS (SELECT *, ['white', 'black', 'red', 'green', 'blue', 'gray'] AS names, ['#FFFFFF', '#000000', '#FF0000', '#00FF00', '#0000FF', '#808080'] AS hex FROM d)
SELECT p_partkey, names[1 + ink] || ' ' || shape || ', ' || CASE WHEN width <= 55 THEN 'thin' WHEN width <= 90 THEN 'normal' ELSE 'thick' END || ' line, ' || names[1 + paper] || ' background, ' || hex[1 + paper] || ' background' AS caption,
  width, rotation, ('0x' || hex[1 + paper][2:3])::INT AS corner FROM n""")
def drawn_shapes(t):
    """A shape for every part, its caption, and the red of a corner of the picture, which no shape reaches."""
    made = drawing.drawn_shapes(drawing.shape_plan(t("part").select("p_partkey"), F.col("p_partkey"), seed=8), 24)
    return made.select("p_partkey", "caption", "width", "rotation", I.to_values(F.col("content"))[0].alias("corner"))


_TINT = """CASE m WHEN 0 THEN (a + b) / 2 WHEN 1 THEN a * b WHEN 2 THEN 1 - (1 - a) * (1 - b) WHEN 3 THEN abs(a - b)
  WHEN 4 THEN CASE WHEN a < 0.5 THEN 2 * a * b ELSE 1 - 2 * (1 - a) * (1 - b) END WHEN 5 THEN (1 - a) * a * b + a * (1 - (1 - a) * (1 - b)) WHEN 6 THEN a * (b + (c - b) * (y / 8.0)) ELSE (1 - (1 - a * b) * (1 - b) + a) / 2 END"""


@query(f"""{_V}, x AS (SELECT vec_id, vec_id % 8 AS m, i, k, v[1 + i] / 255.0::DOUBLE AS a, i // 8 AS y, [32, 96, 200][1 + k] / 255.0::DOUBLE AS b, [255, 0, 64][1 + k] / 255.0::DOUBLE AS c FROM v, range(64) r(i), range(3) s(k))
SELECT vec_id, array_to_string(list(least(greatest(floor(round(({_TINT}) * 255, 6) + 0.5), 0), 255)::INT ORDER BY i, k), ' ') AS pixels FROM x GROUP BY vec_id""")
def image_tints(t):
    """Eight of the tints, each on an eighth of the pictures."""
    modes = ("multiply", "color_burn", "screen", "difference", "overlay", "soft_light", "gradient_light", "light_multiply_screen")
    out = None
    for k, mode in enumerate(modes):
        rows = _pictures(t).where(F.col("vec_id") % 8 == k).select("vec_id", _shown(I.tinted(F.col("content"), mode, "#2060C8", "#FF0040")).alias("pixels"))
        out = rows if out is None else out.union(rows)
    return out
