"""Further registered queries: functions and operators whose inputs are made from columns of the test tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomline.functions import boxes as B
from loomline.functions import tags as T
from loomline.functions import text as X
from loomline.operators import accounts
from loomline.operators import aggregates as A
from loomline.operators import filters as P
from loomline.operators import joins as J
from loomline.operators import ordering as O
from loomline.plans import commits as C
from loomline.plans import moves as M
from loomline.queries import ORACLES, QUERIES, query, table
from loomline.sources import files as S
from loomline.streaming import usage as U

cat = F.concat

# ---- numbering and order ----


@query("SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax) - 1 AS place FROM lineitem")
def numbered_rows(t):
    return O.ordinal(t("lineitem"), [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax")])


@query("SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_type LIKE 'S%' THEN 1 WHEN p_type LIKE 'P%' THEN 2 ELSE 3 END, p_partkey) AS k FROM part")
def rank_by_preference(t):
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy(O.rank_key(F.substring("p_type", 1, 1), ["S", "P"]), "p_partkey")
    return t("part").select("p_partkey", "p_type", F.row_number().over(w).alias("k"))


@query("SELECT l_partkey, count(*) AS attempts, 900 + 600 * count(*) AS wait_ms FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey HAVING count(*) <= 12")
def retry_waits(t):
    return O.retries(t("lineitem").where("l_returnflag = 'R'"), ["l_partkey"], most=12)


@query("""SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag = 'A' DESC, l_quantity = 50 DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1""")
def best_candidate(t):
    rows = O.best_with_fallback(t("lineitem"), ["l_partkey"], F.col("l_returnflag") == "A", F.col("l_quantity") == 50, [F.col("l_orderkey"), F.col("l_linenumber")])
    return rows.select("l_partkey", "l_orderkey", "l_linenumber")


@query("""WITH i AS (SELECT *, p_partkey % 97 AS x FROM part), g AS (SELECT *, CASE WHEN p_retailprice - lag(p_retailprice) OVER h <= 3.0 THEN 0 ELSE 1 END AS new FROM i WINDOW h AS (PARTITION BY p_brand ORDER BY p_retailprice, x, p_partkey)),
r AS (SELECT *, sum(new) OVER (PARTITION BY p_brand ORDER BY p_retailprice, x, p_partkey)::INT AS row FROM g)
SELECT p_brand, p_partkey, row, row_number() OVER (PARTITION BY p_brand ORDER BY row, x, p_retailprice, p_partkey)::INT AS place FROM r""")
def reading_places(t):
    rows = t("part").withColumn("x", F.col("p_partkey") % 97)
    return O.reading_order(rows, ["p_brand"], "x", "p_retailprice", 3.0, ["p_partkey"]).select("p_brand", "p_partkey", "row", "place")


@query("""WITH i AS (SELECT *, p_partkey % 97 AS x FROM part), a AS (SELECT p_brand, median(p_retailprice) AS ay, 48 AS ax FROM i GROUP BY p_brand),
k AS (SELECT i.* FROM i JOIN a USING (p_brand) WHERE p_retailprice < ay - 30.0 OR (abs(p_retailprice - ay) <= 30.0 AND x < ax - 1)),
g AS (SELECT *, CASE WHEN lag(p_retailprice) OVER h - p_retailprice <= 3.0 THEN 0 ELSE 1 END AS new FROM k WINDOW h AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, x DESC, p_partkey)),
r AS (SELECT *, sum(new) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, x DESC, p_partkey)::INT AS row FROM g)
SELECT p_brand, p_partkey, row, row_number() OVER (PARTITION BY p_brand ORDER BY row, x DESC, p_retailprice DESC, p_partkey)::INT AS place FROM r""")
def reading_places_from_anchor(t):
    """Upwards from a boundary in the middle of each page."""
    rows = t("part").withColumn("x", F.col("p_partkey") % 97)
    anchors = rows.groupBy("p_brand").agg(F.percentile("p_retailprice", 0.5).alias("ay"))
    rows = rows.join(anchors, "p_brand").where(O.from_anchor(F.col("x"), F.col("p_retailprice"), F.lit(48), F.col("ay"), 30.0, upwards=True, included=False))
    return O.reading_order(rows, ["p_brand"], "x", "p_retailprice", 3.0, ["p_partkey"], upwards=True).select("p_brand", "p_partkey", "row", "place")


_ACCOUNT_IDS = """SELECT c_custkey AS record, 'cookie' AS kind, CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE (c_custkey // 3)::VARCHAR END AS value FROM customer
  UNION ALL SELECT c_custkey, 'page', CASE WHEN c_custkey % 7 = 1 THEN ((c_custkey * 13) % 401)::VARCHAR END FROM customer
  UNION ALL SELECT c_custkey, 'login', CASE WHEN c_nationkey = 3 THEN ' hot ' WHEN c_custkey % 11 = 2 THEN '' ELSE c_custkey::VARCHAR END FROM customer"""


def _account_records(t):
    key = F.col("c_custkey")
    cookie = F.when(key % 5 == 0, "unknown").otherwise(F.expr("c_custkey div 3").cast("string"))
    page = F.when(key % 7 == 1, (key * 13 % 401).cast("string"))
    login = F.when(F.col("c_nationkey") == 3, " hot ").when(key % 11 == 2, "").otherwise(key.cast("string"))
    return t("customer").select(key.alias("record"), cookie.alias("cookie"), page.alias("page"), login.alias("login"))


_REACHED = f"""WITH RECURSIVE i AS (SELECT record, kind, trim(value) AS value FROM ({_ACCOUNT_IDS}) WHERE coalesce(lower(trim(value)), '') NOT IN ('', 'unknown')),
reach AS (SELECT c_custkey AS a, c_custkey AS b FROM customer UNION SELECT reach.a, y.record FROM reach JOIN i x ON x.record = reach.b JOIN i y ON y.kind = x.kind AND y.value = x.value),
g AS (SELECT a AS record, min(b) AS account FROM reach GROUP BY a)"""


@query(f"{_REACHED} SELECT record, account FROM g")
def account_groups(t):
    return accounts.account_groups(_account_records(t), "record", ["cookie", "page", "login"])


@query(f"{_REACHED} SELECT DISTINCT account, kind, value FROM i JOIN g USING (record)")
def known_accounts(t):
    return accounts.known_accounts(_account_records(t), "record", ["cookie", "page", "login"])


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 500")
def remaining_limit(t):
    return O.first_rows(t("events"), [F.col("ts"), F.col("event_id")], 500).select("event_id", "ts")


@query("SELECT source, least(count(*) FILTER (WHERE lang <> 'en'), 4) AS moved, bool_and(lang IS NOT NULL) AS sound FROM documents GROUP BY source HAVING count(*) FILTER (WHERE lang <> 'en') > 0")
def validation_draw_sizes(t):
    """How many each source gives, with a failure cap that is never reached: which ones is drawn."""
    moved = O.validation_draw(t("documents").select("doc_id", "source", "lang"), "source", "doc_id", F.col("lang") == "en", 4, most_failures=1 << 40, seed=5)
    return moved.groupBy("source").agg(F.count_distinct("doc_id").alias("moved"), F.bool_and(F.col("lang") != "en").alias("sound"))


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, (coalesce(lang = 'en', false))::INT AS bad, row_number() OVER (PARTITION BY source ORDER BY md5(source || '|' || doc_id || '|5'), doc_id) AS k FROM documents),
s AS (SELECT DISTINCT source, 0::BIGINT AS k, NULL::BIGINT AS doc_id, 0::BIGINT AS good, 0::BIGINT AS streak, false AS taken FROM o
  UNION ALL SELECT o.source, o.k, o.doc_id, s.good + 1 - o.bad, CASE WHEN o.bad = 1 THEN s.streak + 1 ELSE 0 END, o.bad = 0 FROM s JOIN o ON o.source = s.source AND o.k = s.k + 1 WHERE s.streak < 2 AND s.good < 4)
SELECT source, doc_id FROM s WHERE taken""")
def validation_draws(t):
    """Up to four documents of each source in another language than English, until two English ones came in a row."""
    return O.validation_draw(t("documents").select("source", "doc_id", "lang"), "source", "doc_id", F.col("lang") == "en", 4, most_failures=2, seed=5).select("source", "doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|9'), doc_id) - 1 AS place FROM documents")
def shuffled_places(t):
    return O.ordinal(t("documents").select("doc_id"), [O.drawn(F.col("doc_id"), seed=9), F.col("doc_id")])


@query("SELECT n_name, r_name FROM nation, region WHERE n_regionkey <> r_regionkey ORDER BY md5(n_name || '|' || r_name || '|4'), n_name, r_name LIMIT 30")
def drawn_pairs(t):
    pairs = t("nation").select("n_name", "n_regionkey"), t("region").select("r_name", "r_regionkey")
    regions = {r["n_name"]: r["n_regionkey"] for r in pairs[0].collect()} | {r["r_name"]: r["r_regionkey"] for r in pairs[1].collect()}
    key = F.create_map(*[F.lit(x) for kv in regions.items() for x in kv])
    return O.combinations(pairs[0].select("n_name"), pairs[1].select("r_name"), key[F.col("n_name")] != key[F.col("r_name")], 30, seed=4)


@query("SELECT source, least(count(*), 5) AS n, least(count(*), 5) AS n_distinct FROM documents GROUP BY source")
def exact_sample_sizes(t):
    rows = O.exact_sample(t("documents").select("doc_id", "source"), ["source"], F.col("doc_id"), 5, seed=3)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_distinct"))


@query("SELECT 500 AS draws, true AS within, 500 AS places FROM (SELECT count(*) AS n FROM documents) WHERE n > 0")
def replacement_sample_size(t):
    docs = t("documents").select("doc_id")
    drawn = O.sample_to_target(docs, [F.col("doc_id")], 500, seed=3)
    known = drawn.join(docs.distinct(), "doc_id", "left_semi")
    return known.agg(F.count(F.lit(1)).cast("int").alias("draws"), F.bool_and(F.col("item_seed").isNotNull()).alias("within"), F.count_distinct("draw").cast("int").alias("places"))


@query("SELECT c_custkey AS id, 3 AS n, true AS known FROM customer")
def background_draw_sizes(t):
    backgrounds = O.ordinal(t("supplier").select(F.col("s_suppkey").alias("path")), [F.col("path")])
    drawn = J.with_backgrounds(t("customer").select(F.col("c_custkey").alias("id")), backgrounds, 3, seed=2)
    return drawn.groupBy("id").agg(F.count_distinct("draw").cast("int").alias("n"), F.bool_and(F.col("path").isNotNull()).alias("known"))


# ---- generation texts ----

_GENERATION = "p_name || chr(10) || 'Negative prompt: ' || p_brand || chr(10) || 'Steps: ' || p_size || ', Sampler: ' || p_type || ', Seed: ' || p_partkey || ', Size: ' || (p_size * 8) || 'x512, Hires upscale: 1.5'"


def _generation():
    n = lambda c: F.col(c).cast("string")
    return cat("p_name", F.lit("\nNegative prompt: "), "p_brand", F.lit("\nSteps: "), n("p_size"), F.lit(", Sampler: "), "p_type", F.lit(", Seed: "), n("p_partkey"), F.lit(", Size: "), (F.col("p_size") * 8).cast("string"), F.lit("x512, Hires upscale: 1.5"))


@query(f"""SELECT p_partkey, trim(string_split(x, 'Negative prompt:')[1], ' ' || chr(10)) AS prompt, trim(regexp_extract(x, 'Negative prompt:(.*)Steps:', 1, 's'), ' ' || chr(10)) AS negative,
regexp_extract(x, 'Sampler: ([^,]*)', 1) AS sampler, regexp_extract(x, 'Size: ([^,]*)', 1) AS size FROM (SELECT p_partkey, {_GENERATION} AS x FROM part)""")
def generation_parameters(t):
    got = t("part").select("p_partkey", X.parse_parameters(_generation()).alias("g"))
    return got.select("p_partkey", "g.prompt", F.col("g.negative_prompt").alias("negative"), F.col("g.params")["Sampler"].alias("sampler"), F.col("g.params")["Size"].alias("size"))


@query(f"""SELECT p_partkey, trim(string_split(x, 'Negative prompt:')[1], ' ' || chr(10)) AS prompt, regexp_extract(x, 'Steps: ([0-9]+)', 1) AS steps, regexp_extract(x, 'Seed: ([0-9]+)', 1) AS seed FROM (SELECT p_partkey, {_GENERATION} AS x FROM part)""")
def generation_parameters_first(t):
    got = t("part").select("p_partkey", X.parse_parameters_first(_generation()).alias("g"))
    return got.select("p_partkey", "g.prompt", "g.steps", "g.seed")


@query(f"""SELECT p_partkey, regexp_extract(x, 'Seed: ([0-9]+)', 1)::BIGINT AS seed, regexp_extract(x, 'Size: ([0-9]+)', 1)::INT AS width, 512 AS height, 1.5::DOUBLE AS multiplier FROM (SELECT p_partkey, {_GENERATION} AS x FROM part)""")
def generation_size(t):
    return t("part").select("p_partkey", X.seed_size_multiplier(_generation()).alias("g")).select("p_partkey", "g.*")


@query(f"SELECT p_partkey, trim(string_split(x, 'Negative prompt:')[1], ' ' || chr(10)) AS original, md5(x) AS whole FROM (SELECT p_partkey, {_GENERATION} AS x FROM part)")
def prompt_modes(t):
    return t("part").select("p_partkey", X.extract_prompt(_generation()).alias("original"), F.md5(X.extract_prompt(_generation(), "all")).alias("whole"))


# ---- captions from records ----


@query("""SELECT c_custkey, concat_ws(', ', 'photography by ' || c_name, c_mktsegment, CASE WHEN c_acctbal > 0 THEN 'watermark' END, 'camera ' || c_nationkey, 'photograph taken on 2024.01.02') AS caption FROM customer""")
def sidecar_captions(t):
    user = F.struct(F.col("c_name").alias("fullname"))
    record = F.to_json(F.struct(F.col("c_mktsegment").alias("name"), user.alias("user"), (F.col("c_acctbal") > 0).alias("watermark"), F.col("c_nationkey").cast("string").alias("camera"), F.lit("2024-01-02T03:04:05+0000").alias("taken_at")))
    return t("customer").select("c_custkey", X.sidecar_caption(X.sidecar_from_json(record)).alias("caption"))


@query("SELECT p_partkey, lower(concat_ws(', ', p_name, p_brand, p_type, 'new tag', 'watermark \"' || p_brand || '\"')) AS caption FROM part")
def entry_captions(t):
    caption = X.entry_caption(F.array("p_name"), F.array("p_brand", "p_type"), F.array("p_brand"), "new_tag")
    return t("part").select("p_partkey", caption.alias("caption"))


@query("SELECT page_id, 'https://media.x/' || page_id AS image, url, 'page ' || page_id AS alt FROM pages")
def image_lines(t):
    i = F.col("page_id").cast("string")
    line = cat(F.lit("https://media.x/"), i, F.lit(" "), "url", F.lit(" Alt: page "), i)
    return t("pages").select("page_id", X.image_line(line).alias("x")).select("page_id", "x.*")


@query(f"""SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(list_transform(string_split(lower(text), ','), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), lambda x: x <> ''), lambda x: replace(x, '_', ' ')), lambda x: x NOT IN ('de')), ', ') AS caption FROM documents""")
def tag_remove_words(t):
    return t("documents").select("doc_id", T.join(T.remove(T.parse(F.col("text")), ["de"])).alias("caption"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{3}|ing\\b')")
def caption_regex_search(t):
    found = P.regex_search(F.col("text"), r"[0-9]{3}|ing\b") & ~P.regex_search(F.col("text"), "") & ~P.regex_search(F.col("text"), "(")
    return t("documents").where(found).select("doc_id")


# ---- names and paths ----


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '-') || '.jpg' ELSE replace(p_name, ' ', '-') || '_x2.txt' END AS clean, regexp_replace(p_name, ' [0-9]+$', '') AS plain, p_size || '_' || p_brand AS folder FROM part")
def cleaned_names(t):
    name = F.translate("p_name", " ", "-")
    whole = F.when(F.col("p_size") % 2 == 0, cat(name, F.lit("_x2.jpg"))).otherwise(cat(name, F.lit("_x2.txt")))
    numbered = cat("p_name", F.lit(".png"))
    folder = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(cat(F.lit("12_"), "p_brand"))
    return t("part").select("p_partkey", X.without_postfix(whole, "_x2").alias("clean"), X.without_number(numbered).alias("plain"), X.with_repeats(folder, F.col("p_size")).alias("folder"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '.tar.gz' WHEN 1 THEN '' WHEN 2 THEN '.jpg' ELSE '.txt' END AS ext, CASE p_size % 4 WHEN 0 THEN 'x.tar' WHEN 1 THEN '' WHEN 2 THEN p_brand ELSE 'a.b' END AS base FROM part")
def file_extensions(t):
    k = F.col("p_size") % 4
    name = F.when(k == 0, "d/x.TAR.gz").when(k == 1, "d/.bashrc").when(k == 2, cat(F.lit("d/"), "p_brand", F.lit(" (copy 2).JPG"))).otherwise("a.b.txt")
    base = F.when(k == 3, "a.b.txt").when(k == 2, cat("p_brand", F.lit(" (copy 2).JPG"))).when(k == 1, ".bashrc").otherwise("x.tar.gz")
    return t("part").select("p_partkey", X.extension(name).alias("ext"), X.clean_basename(base).alias("base"))


_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(f"""SELECT page_id, array_to_string(list_transform(list_filter(string_split(p, '/'), lambda x: x NOT IN ('', '.')), lambda x: CASE WHEN regexp_replace(x, '[0-9]+', '', 'g') IN ('', '.', '..') THEN '_' ELSE regexp_replace(x, '[0-9]+', '', 'g') END), '/') AS clean,
array_to_string(list_filter(string_split(p, '/'), lambda x: x NOT IN ('', '.'))[2:], '/') AS inner_path, trim(regexp_replace(regexp_replace(p, '[\\\\/]', '_', 'g'), '_{{2,}}', '_', 'g'), '_') AS flat,
regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\\.[^.]*$', '') || '_' || md5(p)[1:8] || regexp_extract(p, '(\\.[^./]*)$', 1) AS named FROM (SELECT page_id, {_PATH} AS p FROM pages)""")
def path_names(t):
    p = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return t("pages").select("page_id", X.sanitise_path(p, [("[0-9]+", "")]).alias("clean"), X.strip_components(p, 1).alias("inner_path"), X.flat_prefix(p).alias("flat"), X.name_with_digest(p).alias("named"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])page=[^&]*&?', '\\1'), '[?&]$', '') AS bare FROM pages")
def url_without_page(t):
    return t("pages").select("page_id", X.url_without_param(F.col("url"), "page").alias("bare"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size * 1024 WHEN 1 THEN p_size * 1048576 ELSE p_size END::BIGINT AS bytes, CASE p_size % 3 WHEN 0 THEN p_size * 1000.0 WHEN 1 THEN p_size * 1000000.0 ELSE p_size END::DOUBLE AS price FROM part")
def human_sizes(t):
    k, n = F.col("p_size") % 3, F.col("p_size").cast("string")
    size = cat(n, F.when(k == 0, "kb").when(k == 1, "mb").otherwise(""))
    cost = cat(n, F.when(k == 0, "k").when(k == 1, "M").otherwise(""))
    return t("part").select("p_partkey", X.human_bytes(size).cast("long").alias("bytes"), X.price(cost).cast("double").alias("price"))


@query("""SELECT o_orderkey, CASE WHEN x >= 1000000 THEN regexp_replace(printf('%.1f', round(x / 1000000.0, 1)), '\\.0$', '') || 'M' WHEN x >= 1000 THEN regexp_replace(printf('%.1f', round(x / 1000.0, 1)), '\\.0$', '') || 'k' ELSE x::VARCHAR END AS short
FROM (SELECT o_orderkey, o_orderkey * 250 AS x FROM orders)""")
def compact_numbers(t):
    return t("orders").select("o_orderkey", X.compact_number(F.col("o_orderkey") * 250).alias("short"))


@query("SELECT l_orderkey, l_linenumber, 'L' || l_orderkey || '-' || l_linenumber || '.' || l_returnflag AS name FROM lineitem")
def templated_names(t):
    name = X.name_template("L{order}-{line}.{flag}", order=F.col("l_orderkey"), line=F.col("l_linenumber"), flag=F.col("l_returnflag"))
    return t("lineitem").select("l_orderkey", "l_linenumber", name.alias("name"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN l_linenumber * 1800000 + l_orderkey % 60 * 30000 ELSE NULL END AS wait FROM lineitem")
def cooldown_waits(t):
    n = lambda c: c.cast("long").cast("string")
    text = F.when(F.col("l_quantity") > 25, cat(F.lit("Please wait "), n(F.col("l_linenumber")), F.lit(" Hours and "), n(F.col("l_orderkey") % 60), F.lit(" minutes"))).otherwise("done")
    return t("lineitem").select("l_orderkey", "l_linenumber", X.cooldown_ms(text).alias("wait"))


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 'policy' WHEN 'click' THEN 'cooldown' ELSE 'none' END AS kind FROM events")
def reply_classes(t):
    e = F.col("event_type")
    text = F.when(e == "purchase", "Slow down: this breaks our Content Policy").when(e == "click", "You used too quickly. Try again later").otherwise(e)
    return t("events").select("event_id", P.cooldown_class(text).alias("kind"))


# ---- predicates ----


@query("SELECT l_orderkey, l_linenumber, coalesce(l_quantity / 100 < 0.2, false) OR (l_discount + 1) / 2 > 0.54 OR l_tax > 0.07 AS blurry FROM lineitem")
def blur_predicate(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", P.blurry(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), 0.2, 0.54, 0.07).alias("blurry"))


@query("""WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: length(x) >= 4 AND length(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= 2 AND length(x) % 7 * 16 >= 60) AS g FROM documents)
SELECT doc_id, (len(g) >= 2 AND coalesce(list_sum(list_transform(g, lambda x: length(x))), 0) >= 7) OR len(list_filter(g, lambda x: length(x) >= 7 AND length(x) % 7 * 16 >= 90)) > 0 AS large FROM w""")
def large_text_words(t):
    words = F.transform(F.split("text", " "), lambda x: F.struct(x.alias("text"), (F.length(x) % 7 * 16).cast("double").alias("conf"), F.lit(10).alias("h")))
    return t("documents").select("doc_id", P.large_text(words, F.lit(100), 60, 4, 0.05).alias("large"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN y > 0.66 THEN 'BOTTOM' WHEN y < 0.33 THEN 'TOP' ELSE 'MIDDLE' END || ' ' || CASE WHEN l < 0.1 AND r < 0.1 THEN 'CENTER' WHEN abs(l - r) < 0.1 THEN 'CENTER' WHEN l > r THEN 'RIGHT' ELSE 'LEFT' END AS place
FROM (SELECT l_orderkey, l_linenumber, l_quantity / 100 AS l, (100 - l_quantity - 30) / 100 AS r, (l_linenumber * 10 + 5) / 80.0 AS y FROM lineitem)""")
def text_places(t):
    box = F.struct(F.col("l_quantity").alias("x"), (F.col("l_linenumber") * 10.0).alias("y"), F.lit(30.0).alias("w"), F.lit(10.0).alias("h"), F.lit(1.0).alias("conf"))
    small = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(3.0).alias("w"), F.lit(3.0).alias("h"), F.lit(1.0).alias("conf"))
    return t("lineitem").select("l_orderkey", "l_linenumber", P.text_position(F.array(small, box), F.lit(100.0), F.lit(80.0)).alias("place"))


@query("SELECT p_partkey, p_size BETWEEN 10 AND 30 AS training, p_size % 2 = 0 AND p_brand <> '' AS image FROM part")
def file_predicates(t):
    path = cat(F.lit("m/tr_"), F.when(F.col("p_size").between(10, 30), cat(F.lit("0"), F.col("p_size").cast("string"))).otherwise("1"), F.lit("/a.safetensors"))
    name = cat("p_brand", F.when(F.col("p_size") % 2 == 0, ".PNG").otherwise(".txt"))
    return t("part").select("p_partkey", P.training_file(path).alias("training"), P.is_image(name, F.lit("image/png"), ["png"]).alias("image"))


@query("SELECT l_orderkey, l_linenumber, l_discount > 0 AND (l_returnflag = 'A' OR l_linestatus = 'O') AS sale FROM lineitem")
def sale_predicate(t):
    external = F.when(F.col("l_returnflag") == "A", "model-sale-1").otherwise("other")
    text = F.when(F.col("l_linestatus") == "O", "A Sale of Model 7").otherwise("fee")
    return t("lineitem").select("l_orderkey", "l_linenumber", P.model_sale(F.col("l_discount"), external, text, "model-sale", "sale of model").alias("sale"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN false WHEN event_type = 'click' THEN true ELSE value < 20 END AS hit, CASE WHEN event_type = 'view' THEN true WHEN event_type = 'click' THEN false ELSE value >= 20 END AS usable FROM events")
def quota_state(t):
    e = F.col("event_type")
    left = F.when(~e.isin("view", "click"), F.col("value"))
    return t("events").select("event_id", P.limited(e == "view", left, F.lit(20)).alias("hit"), P.usable_now(e == "view", left, F.lit(20)).alias("usable"))


@query("SELECT page_id, regexp_matches(url, '^https?://[^/]*example\\.net') AS media FROM pages")
def media_urls(t):
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    url = F.when(host.endswith("example.net"), F.regexp_replace("url", r"^https?://[^/]*", "https://media.host")).otherwise(cat(F.lit("data:"), "url"))
    return t("pages").select("page_id", P.media_url(url, ["media.host"]).alias("media"))


@query("SELECT doc_id, length(text) % 2 = 0 AND strlen(text) < 4096 AS is_binary FROM documents")
def binary_sniff(t):
    content = F.encode(F.when(F.length("text") % 2 == 0, cat("text", F.lit("\0"))).otherwise(F.col("text")), "UTF-8")
    return t("documents").select("doc_id", P.looks_binary(content).alias("is_binary"))


@query("SELECT event_id, event_type = 'click' AS flagged FROM events")
def moderated_bodies(t):
    k = F.get_json_object("props", "$.k")
    yes = cat(F.lit('{"a": [{"b": {"moderated" : true}}], "k": '), k, F.lit("}"))
    no = cat(F.lit('{"text": "\\"moderated\\": true", "moderated": false, "k": '), k, F.lit("}"))
    body = F.when(F.col("event_type") == "click", yes).when(F.col("event_type") == "view", no).otherwise('"moderated": true')
    return t("events").select("event_id", P.moderated(body).alias("flagged"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'video720p' WHEN 'view' THEN 'imageEdit' WHEN 'purchase' THEN 'imagePro' WHEN 'error' THEN 'image' END AS service,
CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN greatest(k, 1) WHEN 'purchase' THEN 4 WHEN 'error' THEN 1 END::INT AS amount FROM (SELECT *, CAST(props->>'k' AS INT) AS k FROM events)""")
def generation_requests(t):
    e, k = F.col("event_type"), F.get_json_object("props", "$.k")
    body = (
        F.when(e == "click", '{"modelName": "m", "toolOverrides": {"videoGen": {"resolutionName": "720P"}}}')
        .when(e == "view", cat(F.lit('{"modelName": "Imagine-Image-Edit", "imageCount": '), k, F.lit("}")))
        .when(e == "purchase", '{"modelName": "gen-pro"}')
        .when(e == "error", '{"modelName": "fast"}')
        .otherwise("no JSON")
    )
    got = P.generation_request(F.lit("https://h/rest/new"), F.lit("post"), body, "/rest/", F.lit(True))
    return t("events").select("event_id", got.alias("r")).select("event_id", "r.service", "r.amount")


# ---- text sources ----


@query("SELECT doc_id, string_split(text, chr(10))[1] AS text FROM documents")
def first_lines(t):
    return S.first_lines(t("documents").select("doc_id", "text"))


@query("""SELECT CASE WHEN contains(url, '?') THEN string_split(url, '?')[1] ELSE url END AS url, CASE WHEN contains(url, '?') THEN substring(url, instr(url, '?') + 1) END AS text FROM pages""")
def delimited_lines(t):
    return S.delimited(t("pages").select(F.col("url").alias("line")), "?")


@query("SELECT user_id, event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def json_line_records(t):
    body = F.when(F.col("event_type") == "click", cat(F.lit("["), "props", F.lit("]"))).otherwise(cat("props", F.lit("\nnot json\n")))
    rows = S.json_lines(t("events").select("user_id", "event_id", body.alias("body")), "body", "struct<k: long>")
    return rows.select("user_id", "event_id", "record.k")


@query("SELECT event_id, 'e' || event_id AS id FROM events UNION ALL SELECT event_id, 'u' || user_id FROM events UNION ALL SELECT event_id, 'deep' FROM events")
def harvested_objects(t):
    n = lambda c: F.col(c).cast("string")
    deep = '[[[{"x": {"y": [{"z": {"id": "deep"}}]}}]]]'
    body = cat(F.lit('{"id": "e'), n("event_id"), F.lit('", "by": {"who": [{"id": "u'), n("user_id"), F.lit(f'"}}]}}, "more": {deep}}}'))
    return S.harvest(t("events").select("event_id", body.alias("body")), "body").select("event_id", "id")


@query("""WITH h AS (SELECT page_id, list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: x NOT LIKE '%,') AS h FROM pages), c AS (SELECT page_id, unnest(h) AS x, generate_subscripts(h, 1) AS k, page_id % 3 = 0 AS wide FROM h)
SELECT page_id, regexp_extract(trim(x), '^(\\S+)', 1) AS best FROM c QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN wide THEN (length(x) * 37 % 1000)::DOUBLE WHEN k % 2 = 0 THEN (length(x) % 5)::DOUBLE ELSE 1.0 END DESC, k) = 1""")
def srcset_candidates(t):
    """The links of every page that end in no comma as a srcset: widths on each third page, densities, on every second link, on the others."""
    links = F.filter(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), lambda h: ~h.endswith(","))
    size = lambda h, k: F.when(F.col("page_id") % 3 == 0, cat((F.length(h) * 37 % 1000).cast("string"), F.lit("w"))).when(k % 2 == 1, cat((F.length(h) % 5).cast("string"), F.lit("x"))).otherwise("")
    rows = t("pages").select("page_id", F.array_join(F.transform(links, lambda h, k: cat(h, F.lit(" "), size(h, k))), ", ").alias("srcset"))
    return S.srcset_best(rows)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN -1 WHEN 'error' THEN -2 WHEN 'click' THEN 1 ELSE 0 END AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
b AS (SELECT user_id, event_id, k, greatest(d, 0)::BIGINT AS balance FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, greatest(b.balance + e.d, 0) FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1)
SELECT user_id, event_id, balance FROM b""")
def rolled_back_counts(t):
    """Clicks count, views take one back and errors two, never below nothing."""
    delta = F.when(F.col("event_type") == "view", -1).when(F.col("event_type") == "error", -2).when(F.col("event_type") == "click", 1).otherwise(0)
    return A.balances(t("events").withColumn("d", delta), ["user_id"], ["ts", "event_id"], "d").select("user_id", "event_id", "balance")


@query("""WITH u AS (SELECT user_id, user_id % 40 AS base, max(value) FILTER (event_type = 'purchase' AND value > 190) AS live, max(value) FILTER (event_type = 'signup' AND value > 180) AS reached,
  max(value) FILTER (event_type = 'view' AND value > 180) AS reported, min(value) FILTER (event_type = 'click') AS floor, user_id % 3 = 0 AS exact, max(value) FILTER (event_type = 'error') AS history FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN live IS NOT NULL THEN live WHEN reached IS NOT NULL THEN reached WHEN reported IS NOT NULL THEN floor(reported + 0.5)
  WHEN exact THEN floor(greatest(base::DOUBLE, coalesce(floor, base)) + 0.5) ELSE floor(greatest(base::DOUBLE, coalesce(floor, base), coalesce(history, base)) + 0.5) END::DOUBLE AS effective FROM u""")
def effective_limits(t):
    """A limit per user by all six sources of it."""
    most = lambda kind, least=0: F.max(F.when((F.col("event_type") == kind) & (F.col("value") > least), F.col("value")))
    users = t("events").groupBy("user_id").agg(most("purchase", 190).alias("live"), most("signup", 180).alias("reached"), most("view", 180).alias("reported"), F.min(F.when(F.col("event_type") == "click", F.col("value"))).alias("floor"), most("error", -1e9).alias("history"))
    limit = P.effective_limit(F.col("user_id") % 40, F.col("live"), F.col("reached"), F.col("reported"), F.col("floor"), F.col("user_id") % 3 == 0, F.col("history"))
    return users.select("user_id", limit.alias("effective"))


@query("SELECT i AS doc_id, quality FROM (SELECT unnest(range(0, (SELECT max(doc_id) + 1 FROM labels))) AS i) LEFT JOIN labels ON doc_id = i")
def id_range_lookup(t):
    labels = t("labels").select("doc_id", "quality")
    return S.id_range(labels.sparkSession, 0, labels.agg(F.max("doc_id")).first()[0], labels, "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resumable_sync(t):
    return S.not_yet(t("documents").select("doc_id"), t("labels"), ["doc_id"])


@query(f"SELECT regexp_extract(p, '([^/]*)$', 1) AS base, count(*) AS n, min(p) AS first_path FROM (SELECT {_PATH} AS p FROM pages) GROUP BY ALL")
def ambiguous_basenames(t):
    p = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return S.by_basename(t("pages").select(p.alias("path"), F.regexp_extract(p, "([^/]*)$", 1).alias("base")))


@query("SELECT DISTINCT p_brand AS parent FROM part WHERE p_size % 2 = 0")
def folders_with_images(t):
    base = F.when(F.col("p_size") % 2 == 0, "x.png").when(F.col("p_size") % 3 == 0, "x.PNG").otherwise("x.txt")
    return S.folders_with_images(t("part").select(F.col("p_brand").alias("parent"), base.alias("base")))


@query("SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND p_size % 3 <> 0")
def glob_patterns(t):
    base = cat(F.when(F.col("p_size") % 3 == 0, "skip_").otherwise("keep_"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, ".png").otherwise(".txt"))
    files = t("part").select("p_partkey", cat(F.lit("/root/a/"), base).alias("path"), base.alias("base"), F.when(F.col("p_size") % 2 == 0, "png").otherwise("txt").alias("ext"))
    return S.visible(S.match_globs(files, "/root", includes=["a/*.png"], excludes=["skip_*"])).select("p_partkey")


# ---- plans ----


def _plan(t):
    return t("documents").select(cat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("src"), cat(F.lit("to/"), "source", F.lit("/x.txt")).alias("dst"), F.lit("move").alias("action"))


_PLAN = "SELECT 'd/' || doc_id || '.txt' AS src, 'to/' || source || '/x.txt' AS dst, 'move' AS action FROM documents"


@query(f"SELECT src, CASE WHEN count(*) OVER (PARTITION BY dst) = 1 THEN dst ELSE regexp_replace(dst, '\\.txt$', '') || '_' || md5(src)[1:8] || '.txt' END AS dst, action FROM ({_PLAN})")
def hashed_names(t):
    return M.hashed(_plan(t))


@query(f"SELECT src, dst, CASE WHEN row_number() OVER (PARTITION BY dst ORDER BY src DESC) = 1 THEN 'move' ELSE 'replaced' END AS action FROM ({_PLAN})")
def overwriting_plan(t):
    return M.overwriting(_plan(t))


@query(f"SELECT src, src || '.bak' AS dst, 'backup' AS action FROM ({_PLAN}) WHERE src || '.bak' NOT IN (SELECT 'd/' || doc_id || '.txt.bak' FROM labels) UNION ALL SELECT * FROM ({_PLAN})")
def backup_plan(t):
    kept = t("labels").select(cat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt.bak")).alias("path"))
    return M.with_backup(_plan(t), existing=kept)


@query(f"SELECT dst AS src, src AS dst, action FROM ({_PLAN})")
def undo_plan(t):
    return M.undo(_plan(t))


@query("SELECT 'd/' || doc_id AS src, source || '/' || doc_id AS dst, 'copy' AS action FROM documents")
def routed_files(t):
    files = t("documents").select(cat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), "source")
    return M.route(files, F.col("source"), "copy")


@query("""SELECT l_orderkey || '/' || l_linenumber AS src, 'remove' AS action FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey || '/' || l_linenumber) AS k FROM lineitem) WHERE k > 5 AND l_returnflag = 'A'""")
def retention_plan(t):
    rows = t("lineitem").select(cat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("path"), F.col("l_suppkey").alias("parent"), F.col("l_shipdate").alias("modificationTime"), "l_returnflag")
    return M.retention(rows, 5, F.col("l_returnflag") == "A").select("src", "action")


@query("SELECT doc_id, lower(text) AS new FROM documents WHERE lower(text) <> text")
def changed_captions(t):
    return M.changed(t("documents").select("doc_id", F.col("text").alias("old"), F.lower("text").alias("new")), "old", "new").select("doc_id", "new")


@query("""SELECT count(*) FILTER (WHERE a <> 'skip') AS files_planned, count(*) FILTER (WHERE a = 'upload') AS uploads_planned, count(*) FILTER (WHERE a = 'copy') AS copies_planned, count(*) FILTER (WHERE a = 'skip') AS skipped_planned,
coalesce(sum(n_chars) FILTER (WHERE a = 'upload'), 0)::BIGINT AS bytes_planned, coalesce(sum(n_chars) FILTER (WHERE a = 'copy'), 0)::BIGINT AS copy_bytes_planned FROM (SELECT n_chars, CASE lang WHEN 'en' THEN 'upload' WHEN 'de' THEN 'copy' ELSE 'skip' END AS a FROM documents)""")
def planned_totals(t):
    action = F.when(F.col("lang") == "en", "upload").when(F.col("lang") == "de", "copy").otherwise("skip")
    return A.planned_totals(t("documents").select(action.alias("action"), F.col("n_chars").alias("bytes")))


# ---- joins and aggregates ----


@query("""SELECT model_id, model_name, bucket, max(c) - min(c) AS downloads FROM (SELECT user_id AS model_id, event_type AS model_name, (floor(epoch(ts) / 86400) * 86400)::BIGINT AS bucket, CAST(props->>'k' AS BIGINT) AS c FROM events)
WHERE model_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY ALL""")
def model_downloads(t):
    rows = t("events").select(F.col("user_id").alias("model_id"), F.col("event_type").alias("model_name"), F.get_json_object("props", "$.k").cast("long").alias("download_count"), F.col("ts").alias("timestamp"))
    models = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("username"))
    return J.downloads_by_model(rows, models, F.col("username") == "BUILDING", 86400)


@query("SELECT o_orderkey, o_custkey, p.price FROM orders LEFT JOIN (SELECT user_id, arg_max(value, struct_pack(a := ts, b := event_id)) AS price FROM events WHERE value IS NOT NULL GROUP BY user_id) p ON p.user_id = o_custkey")
def prices_by_key(t):
    buttons = t("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("key"))
    values = t("events").select(F.col("user_id").cast("string").alias("key"), F.col("value").alias("price"), "ts", "event_id")
    return J.last_value_by_key(buttons, values, "key", "price", ["ts", "event_id"]).select("o_orderkey", F.col("key").cast("long").alias("o_custkey"), "price")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(l.q, d.q) AS q FROM (SELECT doc_id, length(text)::INT AS q FROM documents) d FULL JOIN (SELECT doc_id, quality AS q FROM labels) l ON d.doc_id = l.doc_id")
def right_wins_merge(t):
    return J.merge_right_wins(t("documents").select("doc_id", F.length("text").alias("q")), t("labels").select("doc_id", F.col("quality").alias("q")), ["doc_id"])


@query(f"""WITH f AS (SELECT string_split(p, '/') AS x, contains(url, 'page=') AS c FROM (SELECT url, {_PATH} AS p FROM pages)), g AS (SELECT array_to_string(x[1:least(len(x) - 1, 2)], '/') AS folder, count(*) FILTER (WHERE c) AS n, max(least(len(x) - 1, 2)) AS l FROM f GROUP BY ALL)
SELECT folder, n FROM g WHERE l = 2 OR n > 0""")
def folder_counts_with_zeros(t):
    p = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return A.folder_counts(t("pages").select(p.alias("path"), "url"), 2, F.col("url").contains("page="))


@query("SELECT stem, doc_id, n FROM (SELECT md5(text) AS stem, doc_id, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents) WHERE n > 1")
def duplicate_member_list(t):
    return A.duplicate_members(t("documents").select(F.md5("text").alias("stem"), "doc_id"), ["stem"], "doc_id")


@query("SELECT c_custkey, sha256(c_name || '|' || c_mktsegment || '|' || c_nationkey) AS print FROM customer")
def record_fingerprint(t):
    return t("customer").select("c_custkey", A.fingerprint(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")).alias("print"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER w)) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type))
WHERE NOT coalesce(before = event_type AND gap < 43200, false)""")
def usage_notifications(t):
    """Messages of a user without exact repeats of the one before within twelve hours."""
    return U.notifications(t("events").withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "event_type", 43_200).select("user_id", "event_id", "event_type")


@query("SELECT user_id, sum(CASE event_type WHEN 'view' THEN -1 WHEN 'click' THEN 1 ELSE 0 END)::BIGINT AS balance FROM events GROUP BY user_id")
def retracted_counts(t):
    kind = F.when(F.col("event_type") == "view", "retracted").when(F.col("event_type") == "click", "counted").otherwise("other")
    return U.signed(t("events").withColumn("kind", kind)).groupBy("user_id").agg(F.sum("delta").alias("balance"))


@query("""SELECT l_orderkey, max(l_quantity) AS w FROM lineitem GROUP BY l_orderkey""")
def top_box(t):
    box = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("l_quantity").alias("w"), F.lit(1.0).alias("h"), F.col("l_quantity").alias("score"))
    rows = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(box).alias("boxes"))
    return rows.select("l_orderkey", F.get(B.top("boxes", 1), F.lit(0))["w"].alias("w"))


# ---- streams ----


def _streamed(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@_streamed("""WITH w AS (SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS n, min(value) AS least, max(value) AS most, round(max(value) - min(value), 6) AS delta FROM events GROUP BY ALL)
SELECT * FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def tumbling_stream(spark: SparkSession, sf_dir: str):
    """Daily windows through a stream: those that the watermark has passed."""
    rows = U.replayed(table(spark, sf_dir, "events"), lambda stream: U.tumbling(stream, ["event_type"], "1 day"), "tumbling", most=None)
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@_streamed("""WITH h AS (SELECT user_id AS key, date_trunc('milliseconds', ts) AS t FROM events WHERE event_type = 'click'), o AS (SELECT key, t, row_number() OVER (PARTITION BY key ORDER BY t) AS k FROM h),
c AS (SELECT key, min(t) AS t FROM h GROUP BY key)
SELECT key, t AS reached_at, t + INTERVAL 1 HOUR AS renew_at FROM c""")
def first_limit_locks(spark: SparkSession, sf_dir: str):
    """The first lock of every user whose clicks are limit hits without a stated renewal."""
    rows = table(spark, sf_dir, "events").where("event_type = 'click'")
    rows = rows.select(F.col("user_id").alias("key"), F.lit("hit").alias("kind"), "ts", F.lit(None).cast("timestamp").alias("renew_at"))
    locks = U.replayed(rows, U.limit_locks, "locks", key="key")
    first = locks.groupBy("key").agg(F.min(F.struct("reached_at", "renew_at")).alias("l"))
    return first.select("key", F.col("l.reached_at").cast("timestamp_ntz").alias("reached_at"), F.col("l.renew_at").cast("timestamp_ntz").alias("renew_at"))


@_streamed("""WITH e AS (SELECT user_id AS key, event_id, ts, event_type = 'purchase' AS fix FROM events),
b AS (SELECT *, sum(CASE WHEN fix THEN -1 ELSE 1 END) OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS b FROM e),
m AS (SELECT *, min(b) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM b),
l AS (SELECT *, lag(event_id) OVER level AS item, lag(ts) OVER level AS since FROM m WHERE NOT fix OR b >= least(coalesce(low, 0), 0)
  WINDOW level AS (PARTITION BY key, CASE WHEN fix THEN b + 1 ELSE b END ORDER BY ts, event_id))
SELECT key, item, event_id AS flagged_by FROM l WHERE fix AND ts < since + INTERVAL 1 DAY""")
def late_flags(spark: SparkSession, sf_dir: str):
    """Purchases correct the newest open event of their user of the day before them."""
    rows = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "corrected").otherwise("counted")
    rows = rows.select(F.col("user_id").alias("key"), kind.alias("kind"), F.col("event_id").alias("item"), F.lit(None).cast("long").alias("exact"), "ts")
    return U.replayed(rows, U.late_corrections, "late", key="key")


@_streamed("""WITH e AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS key, ts, event_id, CASE event_type WHEN 'purchase' THEN 'saved' WHEN 'view' THEN 'failed' ELSE 'final' END AS kind FROM events),
f AS (SELECT *, lag(kind) OVER (PARTITION BY key ORDER BY ts, event_id) AS before FROM e),
g AS (SELECT *, count(*) FILTER (kind = 'saved' AND before = 'final') OVER (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS saved FROM f)
SELECT key, event_id FROM g WHERE kind = 'final' AND before IS DISTINCT FROM 'final' AND saved = 0""")
def started_fetches(spark: SparkSession, sf_dir: str):
    """Fetches of a user and day: views fail them, purchases save them, other events are final."""
    rows = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "saved").when(F.col("event_type") == "view", "failed").otherwise("final")
    rows = rows.select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("key"), kind.alias("kind"), "event_id", "ts")
    return U.replayed(rows, U.fetched_once, "fetches", key="key")


@_streamed("""WITH RECURSIVE e AS (
  SELECT user_id AS key, epoch_us(ts) // 1000 AS t, event_type = 'purchase' AS good, CASE WHEN event_id % 5 = 0 THEN epoch_us(ts) // 1000 + 7200000 * (1 + event_id % 3) END AS exact, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k
  FROM events WHERE event_type IN ('click', 'error', 'purchase')),
s AS (
  SELECT DISTINCT key, 0::BIGINT AS k, NULL::BIGINT AS reached, NULL::BIGINT AS renew, false AS counts FROM e
  UNION ALL
  SELECT key, k, CASE WHEN good THEN NULL WHEN counts THEN coalesce(reached1, t) ELSE reached1 END, CASE WHEN good THEN NULL WHEN counts THEN coalesce(exact, t + 3600000) ELSE renew1 END, counts
  FROM (SELECT *, NOT good AND (renew1 IS NULL OR exact IS NOT NULL) AS counts FROM (
    SELECT e.*, CASE WHEN e.t >= s.renew THEN NULL ELSE s.reached END AS reached1, CASE WHEN e.t >= s.renew THEN NULL ELSE s.renew END AS renew1 FROM s JOIN e ON e.key = s.key AND e.k = s.k + 1)))
SELECT key, make_timestamp(reached * 1000) AS reached_at, make_timestamp(renew * 1000) AS renew_at FROM s WHERE counts""")
def limit_lock_history(spark: SparkSession, sf_dir: str):
    """All locks of every user: clicks and errors are hits, each fifth with a stated renewal, purchases are successes."""
    rows = table(spark, sf_dir, "events").where("event_type IN ('click', 'error', 'purchase')")
    exact = F.when(F.col("event_id") % 5 == 0, F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")) + 7_200_000 * (1 + F.col("event_id") % 3)))
    rows = rows.select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "purchase", "success").otherwise("hit").alias("kind"), "ts", exact.alias("renew_at"))
    locks = U.replayed(rows, U.limit_locks, "lock-history", key="key")
    return locks.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("reached_at", "renew_at")})


@_streamed("""WITH e AS (SELECT user_id::VARCHAR AS key, event_id, value AS progress, ts, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(CASE WHEN ts >= before + INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, event_id) AS life FROM e)
SELECT key, event_id, progress FROM (SELECT *, max(progress) OVER (PARTITION BY key, life ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM g) WHERE most IS NULL OR progress > most""")
def stream_progress(spark: SparkSession, sf_dir: str):
    """Values of a user that rise above all before them, of which a day without events is the end."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", F.col("value").alias("progress"), "ts")
    return U.replayed(rows, U.rising, "progress", key="key")


@query("""SELECT doc_id, md5(regexp_replace(text, 'th(e|a)', '\\1x', 'g')) AS whole_regex, md5(replace(text, 'the', 'a, b')) AS whole_plain,
array_to_string(list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i), ', ') AS tags_plain
FROM (SELECT doc_id, text, flatten(list_transform(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), lambda x: x <> ''),
  lambda x: list_transform(string_split(replace(x, 'the', 'a, b'), ','), lambda y: trim(y, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))))) AS l FROM documents)""")
def search_replace_modes(t):
    """The other three of the four ways to search and replace."""
    c = F.col("text")
    return t("documents").select("doc_id", F.md5(T.search_replace(c, "th(e|a)", "$1x", True, False)).alias("whole_regex"), F.md5(T.search_replace(c, "the", "a, b", False, False)).alias("whole_plain"), T.search_replace(c, "the", "a, b", False, True).alias("tags_plain"))


@query("""WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS t, CASE WHEN p_size % 2 = 0 THEN ['a', p_brand, 'gone'] ELSE ['gone'] END || string_split(p_name, ' ')[1:1] AS before, ['a', p_brand, 'b'] AS now FROM part),
k AS (SELECT *, list_filter(t, lambda x: NOT (list_contains(before, x) AND NOT list_contains(now, x))) AS kept FROM p)
SELECT p_partkey, array_to_string(list_filter(now, lambda x: NOT list_contains(before, x) AND NOT list_contains(kept, x)) || list_filter(kept, lambda x, i: list_position(kept, x) = i), ',') AS tags FROM k""")
def label_changes(t):
    tags = F.split("p_name", " ")
    state = F.concat(F.when(F.col("p_size") % 2 == 0, F.array(F.lit("a"), "p_brand", F.lit("gone"))).otherwise(F.array(F.lit("gone"))), F.slice(tags, 1, 1))
    return t("part").select("p_partkey", F.array_join(T.sync_changes(tags, state, F.array(F.lit("a"), "p_brand", F.lit("b"))), ",").alias("tags"))


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS p, substr(md5(url), 1, 8) || '-' || substr(md5(url), 9, 4) || '-' || substr(md5(url), 13, 4) || '-' || substr(md5(url), 17, 4) || '-' || substr(md5(url), 21, 12) AS u FROM pages),
o AS (SELECT page_id AS a, page_id AS id, array_to_string(string_split(p, '/')[-2:], '/') AS tail, u FROM p),
c AS (SELECT page_id AS b, CASE WHEN page_id % 4 = 0 THEN page_id END AS id, CASE WHEN page_id % 4 = 1 THEN array_to_string(string_split(p, '/')[-2:], '/') END AS tail, CASE WHEN page_id % 4 = 2 THEN u END AS u FROM p)
SELECT a, b FROM o JOIN c ON o.id = c.id OR o.tail = c.tail OR o.u = c.u""")
def clone_matches(t):
    """Uploads and what they are clones of: by id, by the end of the path or by an embedded identifier."""
    p = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    m = F.md5("url")
    uuid = F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    tail = lambda x: F.array_join(F.slice(F.reverse(F.slice(F.reverse(F.split(x, "/")), 1, 2)), 1, 2), "/")
    pages = t("pages").select("page_id", p.alias("p"), uuid.alias("u"))
    left = pages.select(F.col("page_id").alias("a"), F.col("page_id").alias("id"), tail(F.col("p")).alias("tail"), F.col("u").alias("uuid"))
    k = F.col("page_id") % 4
    path = F.when(k == 1, cat(F.lit("other/"), "p")).when(k == 2, cat(F.lit("m/"), F.upper("u"), F.lit(".jpg")))
    right = pages.select(F.col("page_id").alias("b"), F.when(k == 0, F.col("page_id")).alias("id"), F.when(k == 1, tail(path)).alias("tail"), F.get(X.uuids(path), F.lit(0)).alias("uuid"))
    return J.any_equal(left, right, ["id", "tail", "uuid"], "a", "b")


_JOBS = """(SELECT 'repo' || r AS repo, source || '/' || doc_id || '.txt' AS target, md5(text) AS sha256, strlen(text) AS bytes, CASE WHEN doc_id % 5 = 0 THEN 'same' WHEN doc_id % 5 = 1 THEN 'overwrite' ELSE 'upload' END AS action
FROM documents, range(3) x(r) WHERE doc_id % 3 = 0 OR doc_id % 3 = r)"""
_COMMITS = f"""WITH j AS (SELECT * FROM {_JOBS} WHERE action <> 'same'), k AS (SELECT *, row_number() OVER w AS k, first_value(repo) OVER w AS r1, first_value(target) OVER w AS t1 FROM j WINDOW w AS (PARTITION BY sha256 ORDER BY repo, target)),
p AS (SELECT repo, target, sha256, bytes, CASE WHEN k = 1 THEN 1 ELSE 2 END::INT AS phase, CASE WHEN k > 1 THEN r1 END AS source_repo, CASE WHEN k > 1 THEN t1 END AS source_target FROM k)"""


def _upload_jobs(t):
    n = F.col("doc_id")
    repos = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda r: (n % 3 == 0) | (n % 3 == r)), lambda r: cat(F.lit("repo"), r.cast("string")))
    action = F.when(n % 5 == 0, "same").when(n % 5 == 1, "overwrite").otherwise("upload")
    target = cat("source", F.lit("/"), n.cast("string"), F.lit(".txt"))
    return t("documents").select(F.explode(repos).alias("repo"), target.alias("target"), F.md5("text").alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), action.alias("action"))


@query(f"{_COMMITS} SELECT * FROM p")
def commit_plan(t):
    return C.commit_plan(_upload_jobs(t))


@query(f"{_COMMITS} SELECT repo, phase, count(*) AS files, sum(CASE WHEN phase = 1 THEN bytes ELSE 0 END)::BIGINT AS bytes FROM p GROUP BY repo, phase")
def commit_totals(t):
    return C.commits(C.commit_plan(_upload_jobs(t)))


@query(f"{_COMMITS} SELECT p.*, phase = 1 OR source_repo = 'repo0' AS ready FROM p WHERE NOT (repo = 'repo0' AND phase = 1)")
def unfinished_commits(t):
    """What is left once the first repository's uploads are done."""
    planned = C.commit_plan(_upload_jobs(t))
    done = planned.where("repo = 'repo0' AND phase = 1").select("repo", "phase").distinct()
    return C.unfinished(planned, done)


# ---- further cases of operators above ----


@query(r"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '([A-Z])([a-z]{2,4})', 2), lambda x: x), '|') AS tails FROM documents WHERE regexp_matches(text, '[A-Z][a-z]{2,4}')")
def regex_groups(t):
    """The second group of every match."""
    tails = F.regexp_extract_all("text", F.lit(r"([A-Z])([a-z]{2,4})"), F.lit(2))
    return t("documents").where(F.col("text").rlike(r"[A-Z][a-z]{2,4}")).select("doc_id", F.array_join(tails, "|").alias("tails"))


@query("""WITH d AS (SELECT p_brand AS grp, CASE WHEN p_size = 7 THEN 'x' || p_partkey ELSE p_partkey::VARCHAR END AS member, CASE WHEN p_brand LIKE '%1' THEN p_size % 4 ELSE 0 END AS n, p_partkey % 9 = 5 AS original, p_partkey AS pos FROM part),
r AS (SELECT *, count(*) OVER w AS size, bool_or(NOT regexp_full_match(member, '[0-9]+')) OVER w AS blocked,
  row_number() OVER (PARTITION BY grp ORDER BY n DESC, CASE WHEN n > 0 THEN false ELSE original END DESC, pos, member) AS k FROM d WINDOW w AS (PARTITION BY grp))
SELECT grp, member, CASE WHEN k = 1 THEN 'keep' WHEN blocked THEN 'blocked' ELSE 'remove' END AS action FROM r WHERE size >= 2""")
def cleanup_with_originals(t):
    """Groups without tags keep an original; groups with a member that is no number remove nothing."""
    member = F.when(F.col("p_size") == 7, cat(F.lit("x"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string"))
    tags = F.when(F.col("p_brand").endswith("1"), F.slice(F.split("p_name", ""), F.lit(1), F.col("p_size") % 4)).otherwise(F.array().cast("array<string>"))
    rows = t("part").select(F.col("p_brand").alias("grp"), member.alias("member"), tags.alias("tags"), (F.col("p_partkey") % 9 == 5).alias("original"), F.col("p_partkey").alias("pos"))
    return A.cleanup_plan(rows, "grp", "member", "tags", F.col("original"), "pos")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN abs(x) < 0.05 THEN 0 ELSE abs(x) END) AS e FROM embeddings), n AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS e FROM v),
p AS (SELECT vec_id, e, (SELECT e FROM n WHERE vec_id = 0) AS r FROM n)
SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN e[i] + r[i] <> 0 THEN (e[i] - r[i]) ** 2 / (e[i] + r[i]) ELSE 0 END)) / 2, 6) AS chi,
  round((list_sum(list_transform(range(1, 65), lambda i: e[i] * r[i])) - list_sum(e) * list_sum(r) / 64) / sqrt((list_sum(list_transform(e, lambda x: x * x)) - list_sum(e) ** 2 / 64) * (list_sum(list_transform(r, lambda x: x * x)) - list_sum(r) ** 2 / 64)), 6) AS correlation FROM p""")
def histogram_metrics(t):
    """Chi-squared distance and correlation of normalised histograms to the first one."""
    from loomline.functions import vectors as V

    shares = V.normalise(F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x) < 0.05, 0.0).otherwise(F.abs(x))))
    rows = t("embeddings").select("vec_id", shares.alias("e"))
    both = rows.join(F.broadcast(rows.where("vec_id = 0").select(F.col("e").alias("r")).limit(1)))
    return both.select("vec_id", F.round(V.chi_squared(F.col("e"), F.col("r")), 6).alias("chi"), F.round(V.correlation(F.col("e"), F.col("r")), 6).alias("correlation"))
