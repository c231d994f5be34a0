"""Registered queries over files: rows of the test tables are written as files in the shared folder, then scanned, read or packed."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from loomline.functions import boxes as B
from loomline.functions import geometry as G
from loomline.functions import pixels as P
from loomline.functions import text as X
from loomline.media_queries import _V, _pictures, _shown
from loomline.queries import ORACLES, QUERIES, query, table
from loomline.session import new_path, written
from loomline.sources import files as S
from loomline.sources import metadata as M
from loomline.sources import sinks as K
from loomline.streaming import usage as U

cat = F.concat


def files_query(sql: str):
    """Register a function of (spark, sf_dir)."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# ---- scans ----

#: Each document as a file: a folder of its source and language, a kind by its id.
_TREE = """(SELECT source || '/' || lang || '/' || CASE doc_id % 6 WHEN 0 THEN 'a' WHEN 1 THEN '.h' ELSE 'b' END || doc_id || CASE doc_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.Webp' ELSE '.txt' END AS path, text, doc_id, source, lang FROM documents)"""


def _tree(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The root of the files of ``_TREE`` and, cut off, what a path has before it."""
    n, i = F.col("doc_id"), F.col("doc_id").cast("string")
    lead = F.when(n % 6 == 0, "a").when(n % 6 == 1, ".h").otherwise("b")
    kind = F.when(n % 4 == 0, ".png").when(n % 4 == 1, ".JPG").when(n % 4 == 2, ".Webp").otherwise(".txt")
    root = new_path(spark, "tree")
    path = cat("source", F.lit("/"), "lang", F.lit("/"), lead, i, kind)
    K.write_files(table(spark, sf_dir, "documents").select(path.alias("path"), F.encode("text", "UTF-8").alias("content")), root)
    return root, root.split("://")[-1]


def _below(root: str, column: str = "path") -> Column:
    return F.regexp_replace(column, r"^.*\Q" + root.rsplit("/", 1)[-1] + r"\E/", "")


@files_query(f"""SELECT path, strlen(text) AS length, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, lower(regexp_extract(path, '([^.]*)$', 1)) AS ext FROM {_TREE} WHERE NOT contains(path, '/.')""")
def scanned_files(spark: SparkSession, sf_dir: str):
    """A whole tree; Spark's listing leaves hidden files out."""
    root, _ = _tree(spark, sf_dir)
    return S.scan(spark, [root]).select(_below(root).alias("path"), "length", "stem", "ext")


@files_query(f"SELECT path, regexp_matches(path, '\\.(png|JPG)$') AS exact FROM {_TREE} WHERE NOT contains(path, '/.') AND NOT path LIKE '%.txt'")
def scanned_images(spark: SparkSession, sf_dir: str):
    """Images by extension in any case, and whether all lower or all upper would do."""
    root, _ = _tree(spark, sf_dir)
    files = S.scan(spark, [root])
    exact = S.images(files, exact_case=True).select("path", F.lit(True).alias("exact"))
    return S.images(files).select("path").join(exact, "path", "left").select(_below(root).alias("path"), F.coalesce("exact", F.lit(False)).alias("exact"))


@files_query(f"SELECT DISTINCT source || '/' || lang AS folder, false AS direct FROM {_TREE} WHERE NOT contains(path, '/.') UNION ALL SELECT DISTINCT source, true FROM {_TREE} WHERE NOT contains(path, '/.')")
def scanned_folders(spark: SparkSession, sf_dir: str):
    root, bare = _tree(spark, sf_dir)
    files = S.scan(spark, [root]).withColumn("parent", F.regexp_replace("parent", "^file:/*", "/"))
    every = S.subfolders(files, bare).select(_below(root, "folder").alias("folder"), F.lit(False).alias("direct"))
    return every.union(S.subfolders(files, bare, direct=True).select("folder", F.lit(True)))


@files_query(f"SELECT source, count(*) AS n, sum(strlen(text))::BIGINT AS length FROM {_TREE} WHERE NOT contains(path, '/.') GROUP BY source")
def scanned_roots(spark: SparkSession, sf_dir: str):
    """Every source as a root of its own, and one that is not there."""
    root, _ = _tree(spark, sf_dir)
    sources = [r[0] for r in table(spark, sf_dir, "documents").select("source").distinct().collect()]
    files = S.scan_present(spark, [f"{root}/{s}" for s in sources] + [f"{root}/missing"])
    return files.groupBy(F.split_part(_below(root), F.lit("/"), F.lit(1)).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"))


@files_query(f"SELECT path, row_number() OVER (ORDER BY source || '/' || lang, regexp_extract(path, '([^/]*)$', 1)) - 1 AS place FROM {_TREE} WHERE NOT contains(path, '/.')")
def walked_files(spark: SparkSession, sf_dir: str):
    root, _ = _tree(spark, sf_dir)
    return S.walked(S.scan(spark, [root])).select(_below(root).alias("path"), "place")


@files_query(f"SELECT path, sha256(text) AS sha256 FROM {_TREE} WHERE path LIKE '%.txt' AND NOT contains(path, '/.')")
def read_captions(spark: SparkSession, sf_dir: str):
    """Whole caption files."""
    root, _ = _tree(spark, sf_dir)
    rows = S.texts(spark, [root]).where("path LIKE '%.txt'")
    return rows.select(_below(root).alias("path"), F.sha2("text", 256).alias("sha256"))


@files_query("SELECT trim(line) AS line, count(*) AS n FROM (SELECT unnest(string_split(CASE WHEN doc_id % 3 = 0 THEN '#' ELSE '' END || replace(text, chr(13), ' '), chr(10))) AS line FROM documents) WHERE trim(line) <> '' AND trim(line) NOT LIKE '#%' GROUP BY 1")
def read_lines(spark: SparkSession, sf_dir: str):
    """Lines of text files without blank ones and comments."""
    root = new_path(spark, "lines")
    text = cat(F.when(F.col("doc_id") % 3 == 0, "#").otherwise(""), F.translate("text", "\r", " "))
    table(spark, sf_dir, "documents").select(text).write.text(root)
    return S.lines(spark, [root]).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@files_query("SELECT p_name AS name, p_size::BIGINT AS size, [p_brand, p_type]::VARCHAR AS tags FROM part WHERE p_partkey % 5 <> 0")
def read_json_files(spark: SparkSession, sf_dir: str):
    """JSON files of one record each, in a thousand folders; each fifth is cut short."""
    root, part = new_path(spark, "json"), table(spark, sf_dir, "part")
    body = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.array("p_brand", "p_type").alias("tags")))
    rows = part.select(cat((F.col("p_partkey") % 1000).cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".json")).alias("path"), body.alias("body"), "p_partkey")
    cut = F.when(F.col("p_partkey") % 5 == 0, F.expr("substring(body, 1, 3)")).otherwise(F.col("body"))
    K.write_files(rows.select("path", F.encode(cut, "UTF-8").alias("content")), root)
    found = S.json_records(spark, [root], "name string, size long, tags array<string>").select("record.*")
    return found.select("name", "size", cat(F.lit("["), F.array_join("tags", ", "), F.lit("]")).alias("tags"))


# ---- sinks, read back ----


def _lines(spark: SparkSession, path: str):
    return spark.read.text(path).select(F.col("value").alias("line"))


@files_query("SELECT event_type || ': ' || count(*) AS line FROM events GROUP BY event_type")
def text_report(spark: SparkSession, sf_dir: str):
    path = new_path(spark, "report")
    K.text_report(table(spark, sf_dir, "events").groupBy("event_type").count(), "event_type", "count", path)
    return _lines(spark, path)


@files_query("SELECT p_partkey, p_name, p_brand || ',\"' || p_type AS odd FROM part")
def csv_report(spark: SparkSession, sf_dir: str):
    """Commas and quotes survive the way through the file."""
    path = new_path(spark, "csv")
    K.csv_report(table(spark, sf_dir, "part").select("p_partkey", "p_name", cat("p_brand", F.lit(',"'), "p_type").alias("odd")), path)
    return spark.read.option("header", True).option("escape", "\\").schema("p_partkey long, p_name string, odd string").csv(path)


@files_query("SELECT user_id, event_id, value FROM events")
def json_lines_report(spark: SparkSession, sf_dir: str):
    path = new_path(spark, "json-lines")
    K.json_lines(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), path)
    return spark.read.schema("user_id long, event_id long, value double").json(path)


@query("SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS json FROM nation GROUP BY n_regionkey")
def json_maps(t):
    return K.json_map(t("nation"), "n_regionkey", "n_name", "n_nationkey")


@query("""SELECT folder, '[[datasets.subsets]]' || chr(10) || 'image_dir = "' || folder || '"' || chr(10) || 'num_repeats = ' || repeats || chr(10) || 'shuffle = True' || chr(10) || 'ext = ".txt"' || chr(10) || 'rate = 0.5' AS toml
FROM (SELECT p_brand AS folder, count(*) AS repeats FROM part GROUP BY p_brand)""")
def dataset_toml(t):
    return K.dataset_toml(t("part").groupBy(F.col("p_brand").alias("folder")).agg(F.count(F.lit(1)).alias("repeats")), {"shuffle": True, "ext": ".txt", "rate": 0.5})


@query("""WITH f AS (SELECT p_brand AS folder, p_brand || '/' || p_partkey || '.txt' AS path FROM part),
l AS (SELECT folder, path, 'rm ' || path AS line, row_number() OVER (PARTITION BY folder ORDER BY path) AS k FROM f)
SELECT folder, path, (CASE WHEN k = 1 THEN 1 ELSE 0 END)::INT AS part, line FROM l UNION ALL SELECT folder, path, 0, '# ' || folder FROM l WHERE k = 1""")
def script_lines(t):
    path = cat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".txt"))
    return K.script_lines(t("part").select(path.alias("path")), cat(F.lit("rm "), "path"))


@files_query("SELECT 'source' AS mode, source AS archive, count(*) AS entries, sum(strlen(text))::BIGINT AS length FROM documents GROUP BY source UNION ALL SELECT 'folder', source || '/' || lang, count(*), sum(strlen(text))::BIGINT FROM documents GROUP BY 2 UNION ALL SELECT 'file', source || '/' || lang || '/' || doc_id, 1, strlen(text) FROM documents")
def zip_archives(spark: SparkSession, sf_dir: str):
    """The documents packed in all three ways and unpacked again."""
    path = cat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    files = table(spark, sf_dir, "documents").select(path.alias("path"), F.encode("text", "UTF-8").alias("content"))
    out = None
    for mode in K.ZIP_MODES:
        read = K.unzipped(spark, K.zipped(files, mode, new_path(spark, f"zip-{mode}")))
        read = read.select("archive", "path", F.sha2("content", 256).alias("found"), F.octet_length("content").cast("long").alias("length"))
        whole = read.join(files.select("path", F.sha2("content", 256).alias("own")), "path").where("found = own")
        rows = whole.groupBy(F.lit(mode).alias("mode"), "archive").agg(F.count(F.lit(1)).alias("entries"), F.sum("length").alias("length"))
        out = rows if out is None else out.union(rows)
    return out


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0")
def insert_or_ignore(t):
    old = t("customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    new = t("customer").where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("c_name"))
    return K.insert_or_ignore(old, new.union(new), ["c_custkey"])


@files_query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def partitioned_sink(spark: SparkSession, sf_dir: str):
    path = new_path(spark, "partitioned")
    K.partitioned(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), path, "status")
    return spark.read.parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, seen_at FROM (SELECT user_id, max(ts) AS seen_at FROM events GROUP BY user_id ORDER BY seen_at DESC, user_id LIMIT 40)")
def bounded_seen_set(t):
    """The forty users seen last, from a set remembered before and new events."""
    rows = t("events").select("user_id", F.col("ts").alias("seen_at"))
    before = K.remembered(rows.limit(0), rows.where("event_id % 2 = 0"), ["user_id"], "seen_at", 1 << 30)
    return K.remembered(before, rows.where("event_id % 2 = 1"), ["user_id"], "seen_at", 40)


# ---- metadata in files ----


@query("SELECT vec_id, 'é ' || label AS parameters, '日 ' || vec_id AS note, CASE WHEN vec_id % 2 = 0 THEN 'kept' END AS other FROM embeddings")
def png_text_chunks(t):
    """Text chunks set, set anew and taken out, Latin and not."""
    first = F.create_map(F.lit("Parameters"), F.lit("old"), F.lit("other"), F.lit("kept"))
    more = F.create_map(F.lit("parameters"), cat(F.lit("é "), F.col("label").cast("string")), F.lit("note"), cat(F.lit("日 "), F.col("vec_id").cast("string")), F.lit("other"), F.when(F.col("vec_id") % 2 == 0, "kept").otherwise(""))
    rows = _pictures(t).withColumn("content", M.with_text(F.col("content"), first, more)).withColumn("m", M.text_map(F.col("content")))
    return rows.select("vec_id", F.col("m")["parameters"].alias("parameters"), F.col("m")["note"].alias("note"), F.col("m")["other"].alias("other"))


@query("SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 'PNG' END AS format, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 8 END::INT AS width, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 8 END::INT AS height, vec_id % 5 <> 0 AS valid FROM embeddings")
def image_headers(t):
    """Sizes and validity; each fifth file is cut before its header ends."""
    rows = _pictures(t).withColumn("content", F.when(F.col("vec_id") % 5 == 0, F.substring("content", 1, 20)).otherwise(F.col("content")))
    rows = rows.select("vec_id", M.dimensions(F.col("content")).alias("d"))
    return rows.select("vec_id", "d.*", F.coalesce(F.col("d.format").isin("PNG", "JPEG", "WEBP"), F.lit(False)).alias("valid"))


def _tensor_file(name: Column, size: Column, note: Column) -> Column:
    """A tensor file of one tensor of ``size`` bytes."""
    head = cat(F.lit('{"__metadata__":{"note":"'), note, F.lit('"},"'), name, F.lit('":{"dtype":"U8","shape":['), size.cast("string"), F.lit('],"data_offsets":[0,'), size.cast("string"), F.lit("]}}"))
    n = F.octet_length(head)
    length = F.unhex(cat(*[F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)], F.lit("00000000")))
    return F.concat(length, F.encode(head, "UTF-8"), F.encode(F.repeat(F.lit("x"), size), "UTF-8"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS note, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END::BIGINT AS shape, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS changed, sha256(repeat('x', p_size)) AS body FROM part")
def tensor_headers(t):
    """Headers of tensor files, read, given other metadata and read again; the tensors stay byte for byte. Each seventh file is cut short."""
    content = _tensor_file(F.lit("w"), F.col("p_size"), F.col("p_brand"))
    rows = t("part").withColumn("whole", content).withColumn("content", F.when(F.col("p_partkey") % 7 == 0, F.substring("whole", 1, 30)).otherwise(F.col("whole")))
    rows = written(rows.select("p_partkey", "p_size", "p_type", "whole", "content"), "tensors")
    rows = rows.withColumn("new", M.with_tensor_metadata(F.col("whole"), F.create_map(F.lit("note"), F.col("p_type"))))
    rows = rows.select("p_partkey", "p_size", M.tensors(F.col("content")).alias("a"), M.tensors(F.col("new")).alias("b"), F.expr("substring(new, length(new) - p_size + 1, p_size)").alias("body"))
    good = F.col("a.metadata").isNotNull()
    return rows.select("p_partkey", F.col("a.metadata")["note"].alias("note"), F.col("a.tensors")["w"]["shape"][0].alias("shape"), F.when(good, F.col("b.metadata")["note"]).alias("changed"), F.sha2("body", 256).alias("body"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'new' END AS segment, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name FROM customer")
def merged_metadata(t):
    """New values over old ones; an empty value deletes its key."""
    old = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"))
    new = F.create_map(F.lit("segment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("new"), F.lit("name"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")))
    return t("customer").select("c_custkey", M.merge_metadata(old, new).alias("m")).select("c_custkey", F.col("m")["segment"].alias("segment"), F.col("m")["name"].alias("name"))


@query("SELECT c_custkey, c_name AS a, '{\"n\": ' || c_nationkey || '}' AS b, 'last=1' AS c FROM customer")
def key_value_lines(t):
    text = cat(F.lit("a=first\n no pair \n a = "), "c_name", F.lit('\nb={"n": '), F.col("c_nationkey").cast("string"), F.lit("}\nc=last=1"))
    return t("customer").select("c_custkey", M.key_values(text).alias("m")).select("c_custkey", *[F.col("m")[k].alias(k) for k in "abc"])


@query("SELECT p_partkey, replace(replace(p_name, 'steel', 'iron'), 'Brand', 'make') AS name, 'iron IRON' AS other FROM (SELECT p_partkey, regexp_replace(p_name, 'steel', 'iron', 'gi') AS p_name FROM part)")
def replaced_in_map(t):
    m = F.create_map(F.lit("name"), F.col("p_name"), F.lit("other"), F.lit("STEEL IRON"))
    return t("part").select("p_partkey", X.replace_in_map(m, [("steel", "iron")]).alias("m")).select("p_partkey", F.col("m")["name"].alias("name"), F.col("m")["other"].alias("other"))


@query("SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END, ''), CASE WHEN p_size % 3 = 0 THEN p_brand END, p_type) AS identity, coalesce(try_cast(regexp_extract(p_name || p_size || 'x' || p_partkey, '[0-9]+') AS BIGINT), 0) AS episode FROM part")
def record_identity(t):
    key = X.first_filled(F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name")), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")), F.col("p_type"))
    name = cat("p_name", F.col("p_size").cast("string"), F.lit("x"), F.col("p_partkey").cast("string"))
    return t("part").select("p_partkey", key.alias("identity"), X.episode_number(name).alias("episode"))


# ---- geometry and boxes ----


@query("""SELECT l_orderkey, l_linenumber, round(least(greatest(1.0, 20.0 / least(w, h)), 90.0 / greatest(w, h)), 6) AS scale, round(greatest(0.0, least(1.0, (w - 10.0) / 30.0)), 6) AS place
FROM (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS w, (l_linenumber * 10)::DOUBLE AS h FROM lineitem) WHERE 20.0 / least(w, h) <= 90.0 / greatest(w, h)""")
def scale_limits(t):
    w, h = F.col("l_quantity").cast("double"), (F.col("l_linenumber") * 10).cast("double")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.round(G.scale_within(w, h, 20, 90), 6).alias("scale"), F.round(G.linear(w, 10.0, 40.0), 6).alias("place"))
    return rows.where("scale IS NOT NULL")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, (l_quantity + 10)::DOUBLE AS w, (l_linenumber * 7 + 3)::DOUBLE AS h, abs(sin(radians((l_orderkey % 37 + 1)::DOUBLE))) AS s, abs(cos(radians((l_orderkey % 37 + 1)::DOUBLE))) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN least(w, h) <= 2 * s * c * greatest(w, h) THEN CASE WHEN w >= h THEN 0.5 * h / s ELSE 0.5 * w / c END ELSE (w * c - h * s) / (c * c - s * s) END, 4) AS width,
round(CASE WHEN least(w, h) <= 2 * s * c * greatest(w, h) THEN CASE WHEN w >= h THEN 0.5 * h / c ELSE 0.5 * w / s END ELSE (h * c - w * s) / (c * c - s * s) END, 4) AS height FROM a""")
def rotated_rectangles(t):
    got = G.largest_in_rotated((F.col("l_quantity") + 10).cast("double"), (F.col("l_linenumber") * 7 + 3).cast("double"), (F.col("l_orderkey") % 37 + 1).cast("double"))
    return t("lineitem").select("l_orderkey", "l_linenumber", got.alias("g")).select("l_orderkey", "l_linenumber", F.round("g.width", 4).alias("width"), F.round("g.height", 4).alias("height"))


@query("""WITH b AS (SELECT l_orderkey, max(struct_pack(score := l_extendedprice, w := l_quantity, k := l_linenumber)) AS b FROM lineitem WHERE l_quantity * 20.0 >= 0.05 * 100 * 100 AND l_quantity / 20.0 BETWEEN 0.5 AND 2.0 GROUP BY l_orderkey)
SELECT l_orderkey, b.w AS w FROM b""")
def best_faces(t):
    """The best box of enough area and a sound aspect per order; boxes of a row share a corner, so the best suppresses what it overlaps."""
    box = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("l_quantity").alias("w"), F.lit(20.0).alias("h"), F.col("l_extendedprice").alias("score"))
    rows = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(box).alias("boxes"))
    got = B.faces("boxes", F.lit(100.0), F.lit(100.0), 0.05, (0.5, 2.0), 0.3, 1)
    return rows.select("l_orderkey", F.get(got, F.lit(0))["w"].alias("w")).where("w IS NOT NULL")


@query("""WITH r AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 3 END AS votes FROM part)
SELECT p_partkey::VARCHAR AS path, CASE WHEN votes = 2 THEN 10.5 ELSE 11.0 END::DOUBLE AS x, votes::BIGINT AS votes FROM r""")
def agreed_boxes(t):
    """Boxes of up to three detectors around one place, and one far away that none confirms."""
    def one(x: float, score: float, src: str) -> Column:
        return F.struct(F.lit(x).alias("x"), F.lit(5.0).alias("y"), F.lit(20.0).alias("w"), F.lit(20.0).alias("h"), F.lit(score).alias("score"), F.lit(src).alias("src"))

    three = F.when(F.col("p_partkey") % 3 == 0, F.array(one(10.0, 0.9, "a"), one(11.0, 0.8, "b"), one(80.0, 0.99, "c"))).otherwise(F.array(one(10.0, 0.9, "a"), one(11.0, 0.8, "b"), one(12.0, 0.7, "c")))
    rows = t("part").select(F.col("p_partkey").cast("string").alias("path"), F.explode(three).alias("b")).select("path", "b.*")
    return B.agreement(rows, 0.5, 2).select("path", "x", "votes")


# ---- pixels ----


@query(f"""{_V} SELECT vec_id, array_to_string(list_transform(range(64), lambda i: v[1 + i // 8 * 8 + 7 - i % 8]), ' ') AS across, array_to_string(list_transform(range(64), lambda i: v[1 + (7 - i // 8) * 8 + i % 8]), ' ') AS down,
array_to_string(list_transform(range(20), lambda i: v[1 + (i // 4 + 1) * 8 + i % 4 + 3]), ' ') AS cut, array_to_string(list_transform(v, lambda x: 255 - x), ' ') AS inverted FROM v""")
def image_changes(t):
    """Flips, a crop by pixels and a falling curve."""
    c = F.col("content")
    return _pictures(t).select("vec_id", _shown(P.flip(c)).alias("across"), _shown(P.flip(c, False)).alias("down"), _shown(P.crop(c, 3, 1, 1, 2)).alias("cut"), _shown(P.curve(c, [(0, 255), (255, 0)])).alias("inverted"))


@query(f"""{_V} SELECT 'p/' || vec_id AS path, (k // 4)::INT AS row, (k % 4)::INT AS "column", array_to_string(list_transform(range(8), lambda i: v[1 + (k // 4 * 4 + i // 2) * 8 + k % 4 * 2 + i % 2]), ' ') AS pixels
FROM (SELECT *, unnest(range(8)) AS k FROM v)""")
def image_grid(t):
    rows = _pictures(t).select(cat(F.lit("p/"), F.col("vec_id").cast("string")).alias("path"), "content")
    return P.split_grid(rows, 4, 2).select("path", "row", "column", _shown(F.col("content")).alias("pixels"))


@query(f"""{_V} SELECT vec_id, array_to_string(list_transform(range(768), lambda i: (len(list_filter(v, lambda x: x = i % 256)) * 1000000 // 64)::BIGINT), ' ') AS shares FROM v""")
def image_histogram(t):
    shares = F.transform(P.histogram(F.col("content")), lambda x: F.floor(x * 1_000_000))
    return _pictures(t).select("vec_id", F.array_join(shares, " ").alias("shares"))


# ---- order, streams ----


@query("SELECT doc_id, row_number() OVER (ORDER BY n DESC, length(text), lang DESC, doc_id) - 1 AS place FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n FROM documents)")
def ranked_files(t):
    """Copies first, then short ones, later languages, ids: an order by four keys, numbered by ranges."""
    from loomline.operators.ordering import ordinal

    docs = t("documents").select("doc_id", "lang", F.md5("text").alias("m"), F.char_length("text").alias("n_text"))
    rows = docs.join(docs.groupBy("m").agg(F.count(F.lit(1)).alias("n")), "m")
    return ordinal(rows, [F.col("n").desc(), F.col("n_text"), F.col("lang").desc(), F.col("doc_id")]).select("doc_id", "place")


@files_query("SELECT user_id AS key, event_id, used FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS used FROM events)")
def stream_resumed(spark: SparkSession, sf_dir: str):
    """A counting stream that is stopped and started again from its checkpoint after every third of the events."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id", F.lit(10**8).alias("window_s"), F.lit(4).alias("quota"))
    source, out = new_path(spark, "resumed-source"), new_path(spark, "resumed")
    for part in U.time_slices(rows, 3, key="key"):
        part.write.mode("append").parquet(source)
        done = U.run_to_end(U.rolling_quota(spark.readStream.schema(part.schema).parquet(source)), "resumed", out=out)
    return done.select("key", "event_id", "used")
