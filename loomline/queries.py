"""Registered queries over the test tables, each with the SQL that says what it should give where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import tags as T
from loomline.functions import text as X
from loomline.operators import aggregates as A
from loomline.operators import joins as J
from loomline.operators import ordering as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of (table getter) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_TAGS = f"list_filter(list_transform(string_split(lower(text), ','), lambda x: trim(x, {_BLANK})), lambda x: x <> '')"
_CASED = f"list_filter(list_transform(string_split(text, ','), lambda x: trim(x, {_BLANK})), lambda x: x <> '')"
_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"

# ---- tags ----


@query(f"SELECT tag, count(*) AS n FROM (SELECT unnest({_TAGS}) AS tag FROM documents) GROUP BY tag")
def tag_frequency(t):
    return A.tag_frequency(t("documents"))


@query(f"SELECT tag, count(*) AS n FROM (SELECT {_TAGS}[1] AS tag FROM documents) WHERE tag IS NOT NULL GROUP BY tag")
def first_tag_frequency(t):
    return A.first_tag_frequency(t("documents"))


@query(f"SELECT tag, count(*) AS n FROM (SELECT unnest(list_transform(string_split(string_split(text, chr(10))[1], ','), lambda x: trim(x, {_BLANK}))) AS tag FROM documents) GROUP BY tag")
def first_line_tag_frequency(t):
    return A.first_line_tag_frequency(t("documents"))


@query(f"SELECT doc_id FROM documents WHERE list_contains({_TAGS}, 'the')")
def tag_search(t):
    return t("documents").where(T.contains(T.parse(F.col("text")), "the")).select("doc_id")


@query(f"SELECT doc_id, len({_TAGS}) AS n_tags, len({_TAGS}) < 10 AS too_few FROM documents")
def caption_min_tags(t):
    n = F.size(T.parse(F.col("text"))).cast("long")
    return t("documents").select("doc_id", n.alias("n_tags"), (n < 10).alias("too_few"))


@query(f"SELECT tag, count(*) AS n, regexp_matches(tag, '^$|^[-_]|[-_]$|--|__') = false AS valid FROM (SELECT unnest({_TAGS}) AS tag FROM documents) GROUP BY tag")
def tag_validity(t):
    return A.tag_frequency(t("documents")).withColumn("valid", T.is_valid(F.col("tag")))


def _caption(column):
    return lambda t: t("documents").select("doc_id", column.alias("caption"))


@query(f"SELECT doc_id, array_to_string({_DISTINCT.format(f'list_transform({_TAGS}, lambda y: CASE WHEN y = {chr(39)}the{chr(39)} THEN {chr(39)}of{chr(39)} ELSE y END)')}, ', ') AS caption FROM documents")
def tag_replace(t):
    return t("documents").select("doc_id", T.join(T.replace(T.parse(F.col("text")), "the", "of")).alias("caption"))


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform({_TAGS}, lambda x: replace(x, '_', ' ')), lambda x: x NOT IN ('the', 'of the')), ', ') AS caption FROM documents")
def tag_remove(t):
    return t("documents").select("doc_id", T.join(T.remove(T.parse(F.col("text")), ["the", "of_the", "-bad"])).alias("caption"))


@query(f"SELECT doc_id, array_to_string(list_filter({_DISTINCT.format(_TAGS)}, lambda x: x IN ('the', 'de', 'of', 'in')), ', ') AS caption FROM documents")
def tag_keep_only(t):
    return t("documents").select("doc_id", T.join(T.keep_only(T.parse(F.col("text")), ["the", "de", "of", "in"])).alias("caption"))


@query(f"SELECT doc_id, array_to_string(CASE WHEN list_contains(d, 'the') THEN d ELSE list_concat(['the'], d) END, ', ') AS caption FROM (SELECT doc_id, {_DISTINCT.format(_TAGS)} AS d FROM documents)")
def tag_add_front(t):
    return t("documents").select("doc_id", T.join(T.add_at(T.parse(F.col("text")), "the")).alias("caption"))


@query(f"SELECT doc_id, array_to_string(list_concat(list_concat(g[1:2], list_filter(['the', 'new tag'], lambda x: NOT list_contains(g, x))), g[3:]), ', ') AS caption FROM (SELECT doc_id, {_TAGS} AS g FROM documents)")
def tag_add_missing(t):
    return t("documents").select("doc_id", T.join(T.add_missing(T.parse(F.col("text")), ["the", "new tag"], 2)).alias("caption"))


@query(f"""SELECT doc_id, CASE WHEN len(c) <> len(r) OR contains(text, chr(10)) THEN array_to_string(c, ', ') ELSE text END AS caption
FROM (SELECT doc_id, text, r, list_filter(list_transform(r, lambda x: trim(x, {_BLANK})), lambda x: x <> '') AS c FROM (SELECT doc_id, text, string_split(replace(text, chr(10), ','), ',') AS r FROM documents))""")
def tags_normalise_newlines(t):
    return t("documents").select("doc_id", T.normalise_newlines(F.col("text")).alias("caption"))


@query(f"SELECT doc_id, array_to_string({_DISTINCT.format(_CASED)}, ', ') AS caption FROM documents")
def tags_keep_case(t):
    return t("documents").select("doc_id", T.join(T.parse_keep_case(F.col("text"))).alias("caption"))


@query(f"SELECT doc_id, array_to_string({_DISTINCT.format(f'list_filter(list_transform({_CASED}, lambda y: regexp_replace(y, {chr(39)}th(e|a){chr(39)}, {chr(39)}\\1x{chr(39)}, {chr(39)}g{chr(39)})), lambda z: z <> {chr(39)}{chr(39)})')}, ', ') AS caption FROM documents")
def tag_search_replace(t):
    return t("documents").select("doc_id", T.search_replace(F.col("text"), "th(e|a)", "$1x", regex=True, per_tag=True).alias("caption"))


@query(f"SELECT doc_id, array_to_string(list_concat(list_filter(['lab'], lambda x: NOT list_contains(k, x)), k), ', ') AS caption FROM (SELECT doc_id, list_filter({_TAGS}, lambda x: x <> 'the') AS k FROM documents)")
def label_sync(t):
    return t("documents").select("doc_id", T.join(T.sync_labels(T.parse(F.col("text")), ["lab"], ["the"])).alias("caption"))


@query("SELECT doc_id, concat_ws(', ', nullif(replace(source, '_', ' '), ''), nullif(text, '')) AS by_folder, concat_ws(', ', nullif(text, ''), 'doc ' || doc_id) AS by_file FROM documents")
def caption_from_path(t):
    stem = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return t("documents").select("doc_id", T.from_folder(F.col("text"), F.col("source")).alias("by_folder"), T.from_file_name(F.col("text"), stem).alias("by_file"))


# ---- text ----


@query(f"SELECT doc_id, translate(text, '{X._SHIFT_FROM}', '{X._SHIFT_TO}') AS shifted FROM documents")
def char_shift(t):
    return t("documents").select("doc_id", X.shift_chars(F.col("text")).alias("shifted"))


@query("SELECT doc_id, length(regexp_replace(text, '[^\\x20-\\x7e\\t\\n\\r\\x0b\\x0c]', '', 'g'))::INT AS n FROM documents")
def printable_filter(t):
    return t("documents").select("doc_id", F.length(X.printable(F.col("text"))).alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+'))::INT AS n FROM documents WHERE regexp_matches(text, '[0-9]+')")
def regex_count(t):
    n = F.regexp_count(F.col("text"), F.lit("[0-9]+"))
    return t("documents").select("doc_id", n.alias("n")).where("n > 0")


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '([a-z]+)@([a-z]+)', 2), '|') AS hosts FROM documents WHERE regexp_matches(text, '[a-z]@[a-z]')")
def regex_extract_all(t):
    hosts = F.regexp_extract_all("text", F.lit("([a-z]+)@([a-z]+)"), F.lit(2))
    return t("documents").where(F.col("text").rlike("[a-z]@[a-z]")).select("doc_id", F.array_join(hosts, "|").alias("hosts"))


@query("SELECT doc_id, md5(regexp_replace(text, '([a-z])(ing)', '\\2\\1', 'g')) AS digest, len(regexp_extract_all(text, '[a-z]ing'))::INT AS n FROM documents")
def regex_replace_count(t):
    text, n = X.replace_count(F.col("text"), "([a-z])(ing)", "$2$1")
    return t("documents").select("doc_id", F.md5(text).alias("digest"), n.alias("n"))


@query("SELECT doc_id, md5(replace(replace(text, 'the', 'of'), 'of', 'a')) AS digest FROM documents")
def literal_pairs(t):
    return t("documents").select("doc_id", F.md5(X.replace_pairs(F.col("text"), [("the", "of"), ("of", "a")])).alias("digest"))


@query("SELECT c_custkey, CASE WHEN contains(c_mktsegment, ' ') THEN replace(c_mktsegment, ' ', '( :0)') ELSE regexp_replace(c_mktsegment, '^(.*)(.)$', '\\1(:0)\\2') END AS hidden FROM customer")
def obfuscated_name(t):
    return t("customer").select("c_custkey", X.obfuscate_name(F.col("c_mktsegment")).alias("hidden"))


@query("SELECT page_id, regexp_replace(url, '[?#].*$', '') AS bare, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, regexp_extract(url, '/([0-9]+)', 1) AS number FROM pages")
def url_normalise(t):
    u = F.col("url")
    return t("pages").select("page_id", X.url_without_query(u).alias("bare"), X.url_param(u, "page").alias("page"), F.regexp_extract(u, "/([0-9]+)", 1).alias("number"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(t):
    return t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def json_props(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT p_partkey, CASE WHEN p_retailprice <= 950 THEN 'low' WHEN p_retailprice >= 1500 THEN 'high' ELSE 'middle' END AS band FROM part")
def band_label(t):
    return t("part").select("p_partkey", X.band(F.col("p_retailprice"), 950, 1500).alias("band"))


@query("SELECT l_orderkey, l_linenumber, printf('%05dx%05d', coalesce((w / nullif(gcd(w, h), 0))::INT, 0), coalesce((h / nullif(gcd(w, h), 0))::INT, 0)) AS folder FROM (SELECT l_orderkey, l_linenumber, l_partkey AS w, l_suppkey AS h FROM lineitem)")
def aspect_ratio_folder(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", X.aspect_folder(F.col("l_partkey"), F.col("l_suppkey")).alias("folder"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def content_hash(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("SELECT o_orderkey, date_trunc('week', o_orderdate)::DATE AS week_start, date_trunc('month', o_orderdate)::DATE AS month_start, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def calendar_bounds(t):
    d = F.col("o_orderdate")
    return t("orders").select("o_orderkey", F.date_trunc("week", d).cast("date").alias("week_start"), F.date_trunc("month", d).cast("date").alias("month_start"), F.date_format(d, "yyyy-MM-dd").alias("day"))


# ---- joins ----


@query("SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS paired FROM documents d LEFT JOIN labels l USING (doc_id)")
def pair_left(t):
    labels = t("labels").select("doc_id", "quality", F.lit(True).alias("p"))
    return t("documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", "quality", F.coalesce("p", F.lit(False)).alias("paired"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def captions_without_pair(t):
    return J.without_partner(t("documents").select("doc_id"), t("labels"), ["doc_id"])


@query("""WITH i AS (SELECT l_orderkey AS stem_path, CASE l_returnflag WHEN 'A' THEN 'png' WHEN 'N' THEN 'jpg' ELSE 'webp' END AS ext, l_orderkey || '/' || l_linenumber AS path FROM lineitem WHERE l_quantity > 40)
SELECT o_orderkey AS stem_path, b.path AS image_path, b.path IS NOT NULL AS paired FROM orders LEFT JOIN
(SELECT stem_path, arg_min(path, struct_pack(r := list_position(['jpg', 'png', 'webp'], ext), p := path)) AS path FROM i GROUP BY stem_path) b ON b.stem_path = o_orderkey""")
def pair_first_extension(t):
    ext = F.when(F.col("l_returnflag") == "A", "png").when(F.col("l_returnflag") == "N", "jpg").otherwise("webp")
    images = t("lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("stem_path"), ext.alias("ext"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("path"))
    return J.pair_captions(t("orders").select(F.col("o_orderkey").alias("stem_path")), images, ["jpg", "png", "webp"])


@query("""WITH w AS (SELECT c_custkey AS id, c_mktsegment AS name, c_nationkey AS folder, c_name AS caption FROM customer),
same AS (SELECT name, folder, arg_min(caption, id) AS c FROM w GROUP BY ALL), anywhere AS (SELECT name, arg_min(caption, id) AS c FROM w GROUP BY ALL)
SELECT w.id, w.name, w.folder, coalesce(same.c, anywhere.c) AS caption FROM w LEFT JOIN same USING (name, folder) LEFT JOIN anywhere USING (name)""")
def transfer_preferred(t):
    c = t("customer")
    work = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.col("c_name").alias("raw_name"), F.col("c_nationkey").alias("folder"))
    ref = c.select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("folder"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("caption"))
    return J.transfer(work, ref).select("id", "name", "folder", "caption")


@query("""WITH l AS (SELECT p_partkey || '/' || p_size AS path, p_size || '' AS base FROM part), r AS (SELECT l_partkey || '/' || l_quantity::INT AS path, l_quantity::INT || '' AS base FROM lineitem),
a AS (SELECT DISTINCT l.path FROM l JOIN r USING (path)), s AS (SELECT base FROM l GROUP BY base HAVING count(*) = 1), o AS (SELECT DISTINCT base FROM r WHERE path NOT IN (SELECT path FROM a))
SELECT l.path, l.base, CASE WHEN a.path IS NOT NULL THEN 'path' WHEN l.base IN (SELECT base FROM s) AND l.base IN (SELECT base FROM o) THEN 'base' END AS chosen FROM l LEFT JOIN a USING (path)""")
def reconcile_refs(t):
    row = lambda df, key, size: df.select(F.concat_ws("/", key, F.col(size).cast("int")).alias("path"), F.col(size).cast("int").cast("string").alias("base"))
    return J.reconcile(row(t("lineitem"), "l_partkey", "l_quantity"), row(t("part"), "p_partkey", "p_size"))


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def local_vs_manifest_semi(t):
    return t("part").select("p_partkey").join(t("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def local_vs_manifest_anti(t):
    return t("part").select("p_partkey").join(t("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("""SELECT p_partkey AS sha, coalesce(m.location, 'NOT FOUND') AS location FROM part LEFT JOIN (
SELECT l_partkey, arg_min(l_suppkey || '/' || l_orderkey, struct_pack(a := l_suppkey, b := l_orderkey, c := l_linenumber)) AS location FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey) m ON m.l_partkey = p_partkey""")
def local_vs_manifest_first_location(t):
    m = t("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("sha"), F.col("l_suppkey").alias("repo"), F.col("l_orderkey").alias("path"), "l_linenumber")
    return J.locate(t("part").select(F.col("p_partkey").alias("sha")), m, "sha", [F.col("repo"), F.col("path"), F.col("l_linenumber")])


@query("""WITH a AS (SELECT user_id, date_trunc('day', ts)::DATE AS day, max(value) AS used, min(value) AS low, max(event_id) AS last_id FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL),
b AS (SELECT user_id, date_trunc('day', ts)::DATE AS day, max(value) AS used, min(value) AS low, max(event_id) AS last_id FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY ALL)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.day, b.day) AS day, greatest(a.used, b.used) AS used, least(a.low, b.low) AS low, coalesce(b.last_id, a.last_id) AS last_id FROM a FULL JOIN b ON a.user_id = b.user_id AND a.day = b.day""")
def history_merge(t):
    passive = F.col("event_type").isin("click", "view")
    state = lambda side: t("events").where(side).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("used"), F.min("value").alias("low"), F.max("event_id").alias("last_id"))
    return J.merge_history(state(passive), state(~passive), ["user_id", "day"], ["used"], ["low"], [], ["last_id"])


@query("""SELECT s.s_suppkey AS path, n.n_nationkey AS repo, CASE WHEN c.c_custkey IS NULL THEN 'upload' WHEN c.c_nationkey = s.s_nationkey THEN 'same' ELSE 'skip' END AS action
FROM supplier s CROSS JOIN nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_custkey = s.s_suppkey""")
def upload_plan(t):
    files = t("supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.col("s_nationkey").alias("sha256"))
    places = t("nation").select(F.col("n_nationkey").alias("repo"), F.lit("").alias("prefix"))
    there = t("customer").select(F.col("c_nationkey").alias("repo"), F.col("c_custkey").cast("string").alias("path"), F.col("c_nationkey").alias("sha256"))
    return J.plan_uploads(files, places, there, F.lit("skip")).select(F.col("path").cast("long").alias("path"), "repo", "action")


@query("""WITH l AS (SELECT c_mktsegment AS list_id, list(c_name ORDER BY c_custkey) AS v FROM customer GROUP BY 1 UNION ALL SELECT 'A nation', list(n_name ORDER BY n_nationkey) FROM nation),
n AS (SELECT max(len(v)) AS n FROM l) SELECT r AS row, string_agg(v[(r % len(v)) + 1], '-' ORDER BY list_id) AS merged FROM l, (SELECT unnest(range(n)) AS r FROM n) GROUP BY r""")
def merge_lists(t):
    """The customers of every segment and the nations, side by side."""
    rows = t("customer").select(F.col("c_mktsegment").alias("list_id"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("value"))
    nations = t("nation").select(F.lit("A nation").alias("list_id"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("value"))
    return J.zip_merge(rows.union(nations), "-")


@query("SELECT s_suppkey AS a, c_custkey AS b FROM supplier, customer WHERE s_suppkey = c_custkey OR s_acctbal = c_acctbal")
def any_key_join(t):
    left = t("supplier").select(F.col("s_suppkey").alias("a"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("m"))
    right = t("customer").select(F.col("c_custkey").alias("b"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("m"))
    return J.any_equal(left, right, ["k", "m"], "a", "b")


# ---- aggregates ----


@query("SELECT user_id, (floor(epoch(ts) / 3600) * 3600)::BIGINT AS bucket, max(value) - min(value) AS delta FROM events GROUP BY ALL")
def bucket_delta(t):
    return A.bucket_delta(t("events"), ["user_id"], 3600)


@query("SELECT event_type, date_trunc('week', ts)::DATE AS period, count(DISTINCT coalesce(CAST(user_id AS VARCHAR), '')) AS n FROM events GROUP BY ALL")
def distinct_per_period(t):
    return A.distinct_per_period(t("events"), "ts", "week", F.coalesce(F.col("user_id").cast("string"), F.lit("")), ["event_type"])


@query("SELECT user_id, event_type, date_trunc('day', ts)::DATE AS day, count(*) AS used FROM events GROUP BY ALL")
def daily_usage(t):
    return t("events").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("used"))


@query("""SELECT user_id, count(*) AS samples, min(v) AS least, max(v) AS most, arg_max(v, struct_pack(ts := ts, e := event_id)) FILTER (WHERE v IS NOT NULL) AS last_known
FROM (SELECT *, CASE WHEN event_id % 4 <> 0 THEN value END AS v FROM events) GROUP BY user_id""")
def gauge_min_max_last(t):
    rows = t("events").withColumn("v", F.when(F.col("event_id") % 4 != 0, F.col("value")))
    return A.gauge(rows, ["user_id"], "ts", "v", ["event_id"])


@query("""SELECT lang, source, n, combined, round(100 * n / sum(n) OVER (PARTITION BY combined, lang), 4) AS percent FROM (
SELECT lang, source, count(*) AS n, grouping(lang)::INT AS combined FROM documents GROUP BY GROUPING SETS ((lang, source), (source)))""")
def type_rollup_percent(t):
    return A.share_rollup(t("documents"), "lang", "source")


@query("SELECT p_brand, round(avg(p_retailprice), 6) AS mean, round(median(p_retailprice), 6) AS median FROM part GROUP BY p_brand")
def mean_median_by_group(t):
    return A.mean_median(t("part"), ["p_brand"], "p_retailprice")


@query("SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_member, max(doc_id) AS last_member FROM documents GROUP BY sha HAVING count(*) > 1")
def duplicate_groups(t):
    return A.duplicates(t("documents").select("doc_id", F.sha2("text", 256).alias("sha")), ["sha"], "doc_id")


@query(f"""WITH d AS (SELECT sha256(text) AS grp, doc_id, len({_TAGS}) AS n FROM documents), r AS (
SELECT *, count(*) OVER (PARTITION BY grp) AS size, row_number() OVER (PARTITION BY grp ORDER BY n DESC, doc_id) AS k FROM d)
SELECT grp, doc_id, CASE WHEN k = 1 THEN 'keep' ELSE 'remove' END AS action FROM r WHERE size >= 2""")
def duplicate_cleanup_plan(t):
    rows = t("documents").select(F.sha2("text", 256).alias("grp"), "doc_id", T.parse(F.col("text")).alias("tags"), F.col("doc_id").alias("at"))
    return A.cleanup_plan(rows, "grp", "doc_id", "tags", F.lit(False), "at")


@query("""SELECT o_orderpriority, o_orderstatus, n FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_orderstatus) AS k FROM (
SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)) WHERE k = 1""")
def mode_per_group(t):
    return A.most_common(t("orders"), ["o_orderpriority"], "o_orderstatus")


@query("SELECT p_size AS w, length(p_name) AS h, count(*) AS n FROM part GROUP BY ALL")
def resolution_histogram(t):
    return t("part").groupBy(F.col("p_size").alias("w"), F.length("p_name").cast("long").alias("h")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT array_to_string(string_split(p, '/')[1:least(len(string_split(p, '/')) - 1, 4)], '/') AS folder, count(*) AS n FROM (SELECT regexp_replace(url, '[?#].*$', '') AS p FROM pages) GROUP BY ALL")
def depth_counts(t):
    return A.depth_counts(t("pages").select(X.url_without_query(F.col("url")).alias("path")), 4)


@query("SELECT l_orderkey AS repo, count(*) AS planned, count(*) FILTER (WHERE l_returnflag = 'A') AS succeeded, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, count(*) > 0 AND count(*) FILTER (WHERE l_returnflag = 'A') = 0 AND count(*) FILTER (WHERE l_returnflag = 'R') > 0 AS failed_everywhere FROM lineitem GROUP BY l_orderkey")
def job_tally(t):
    status = F.when(F.col("l_returnflag") == "A", "ok").when(F.col("l_returnflag") == "R", "failed").otherwise("open")
    return A.tally(t("lineitem").select(F.col("l_orderkey").alias("repo"), status.alias("status")), ["repo"])


@query("SELECT p_partkey, greatest(ceil(10 * (p_size / 40.0)), 1)::BIGINT AS repeats FROM part")
def repeat_counts(t):
    return t("part").select("p_partkey", A.repeats(10, F.col("p_size") / F.lit(40.0)).alias("repeats"))


@query("""SELECT l_partkey, arg_max(a, struct_pack(s := s, v := a)) FILTER (WHERE a IS NOT NULL) AS a, arg_max(b, struct_pack(s := s, v := b)) FILTER (WHERE b IS NOT NULL) AS b FROM (
SELECT l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS a, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS b, l_orderkey * 10 + l_linenumber AS s FROM lineitem) GROUP BY l_partkey""")
def merged_fields(t):
    rows = t("lineitem").selectExpr("l_partkey", "CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS a", "CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS b", "l_orderkey * 10 + l_linenumber AS s")
    return A.merged_records(rows, ["l_partkey"], ["a", "b"], "s")


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN 'passive' ELSE 'active' END AS class, count(*) FILTER (WHERE value > 50) AS big, count(*) AS total FROM events GROUP BY ALL")
def usage_by_class(t):
    kind = F.when(F.col("event_type").isin("click", "view"), "passive").otherwise("active")
    return t("events").groupBy(kind.alias("class")).agg(F.count_if(F.col("value") > 50).alias("big"), F.count(F.lit(1)).alias("total"))


# ---- order, windows, sampling ----


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rolling_window_count(t):
    return O.rolling_count(t("events"), ["user_id"], "ts", 7200).select("user_id", "event_id", "in_window")


@query("SELECT doc_id, k AS chunk, array_to_string(ls[k * 5 + 1:k * 5 + 5], chr(10)) AS text FROM (SELECT doc_id, ls, unnest(range(0, (len(ls) - 1) // 5 + 1))::INT AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))")
def split_by_lines(t):
    return O.split_lines(t("documents"), 5, "doc_id", "text")


@query("SELECT doc_id, ((dense_rank() OVER (ORDER BY source, lang) - 1) % 3)::INT AS part FROM documents")
def round_robin_split(t):
    rows = t("documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("stem"))
    return O.round_robin(rows, "stem", 3).select("doc_id", "part")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 100 AS chunk FROM orders")
def chunked_rows(t):
    return O.chunks(t("orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], 100).select("o_orderkey", "chunk")


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 8)::INT AS stride FROM orders")
def strided_partition(t):
    return O.ordinal(t("orders").select("o_orderkey"), [F.col("o_orderkey")]).select("o_orderkey", F.pmod("place", F.lit(8)).cast("int").alias("stride"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 3")
def keep_newest_n(t):
    return O.keep_newest(t("orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 3).select("o_custkey", "o_orderkey")


@query("SELECT conv_id, role, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) AS k FROM conversations) WHERE k = 1")
def conversation_merge_last_wins(t):
    return O.last_wins(t("conversations"), ["conv_id", "role"], [F.col("turn"), F.col("text")]).select("conv_id", "role", "turn", "text")


@query("SELECT conv_id, turn, role, text, coalesce(lag(role) OVER w IS DISTINCT FROM role, true) OR row_number() OVER w = 1 AS is_header FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)")
def turn_header_on_change(t):
    return O.with_headers(t("conversations"), ["conv_id"], ["turn", "role", "text"], "role")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '|3'), doc_id) <= 5")
def exact_sample_per_group(t):
    return O.exact_sample(t("documents").select("doc_id", "source"), ["source"], F.col("doc_id"), 5, seed=3)


@query("""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents)
SELECT i AS draw, ('0x' || md5(i || '|4')[1:15])::BIGINT AS item_seed, doc_id FROM range(500) r(i) JOIN d ON place = ('0x' || md5(i || '|3')[1:15])::BIGINT % n""")
def sample_with_replacement(t):
    return O.sample_to_target(t("documents").select("doc_id"), [F.col("doc_id")], 500, seed=3)


@query("""SELECT doc_id, len(list_filter(string_split(text, ' '), lambda x, i: i = 1 OR ('0x' || md5(x || '|' || (i - 1) || '|0')[1:13])::BIGINT / 4503599627370496.0 < 0.3))::INT AS n FROM documents""")
def bernoulli_word_sample(t):
    return t("documents").select("doc_id", F.size(O.bernoulli_words(F.split("text", " "), 0.3)).alias("n"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY -ln(1.0 - ('0x' || md5(source || '|1')[1:13])::BIGINT / 4503599627370496.0) / count(*), source LIMIT 1")
def weighted_source(t):
    return O.weighted_choice(t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")), "n", ["source"], seed=1)


@query("""SELECT doc_id, list_reduce(list_prepend({'c': 0::BIGINT, 's': 0::BIGINT, 'm': 0::BIGINT}, list_transform(string_split(text, chr(10)), lambda x: {'c': 0::BIGINT, 's': strlen(x) + 1, 'm': 0::BIGINT})),
lambda a, b: {'c': a.c + CASE WHEN a.s + b.s >= 1000 THEN 1 ELSE 0 END, 's': CASE WHEN a.s + b.s >= 1000 THEN 0 ELSE a.s + b.s END, 'm': a.c}).m::INT AS last_chunk FROM documents""")
def greedy_size_split(t):
    lengths = F.transform(F.split("text", "\n"), lambda x: F.octet_length(x) + 1)
    return t("documents").select("doc_id", F.array_max(O.greedy_split(lengths, 1000)).alias("last_chunk"))


# ---- sets ----


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def union_distinct(t):
    return t("supplier").select(F.col("s_nationkey").alias("k")).union(t("customer").select("c_nationkey")).distinct()


@query("SELECT s_nationkey AS k FROM supplier INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey < 3")
def intersect_sets(t):
    return t("supplier").select(F.col("s_nationkey").alias("k")).intersect(t("nation").where("n_regionkey < 3").select("n_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def except_sets(t):
    return t("nation").select(F.col("n_nationkey").alias("k")).exceptAll(t("supplier").where("s_acctbal > 9000").select("s_nationkey").distinct()).distinct()


@query("""WITH k AS (SELECT event_id, ts, user_id, value::INT AS v, ts >= TIMESTAMP '2024-01-15' AS later FROM events)
SELECT user_id, v, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, v ORDER BY ts, event_id) AS n FROM k WHERE later) x
WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM k s WHERE NOT s.later AND s.user_id = x.user_id AND s.v = x.v)""")
def seen_set(t):
    rows = t("events").select("event_id", "ts", "user_id", F.bround("value").cast("int").alias("v"), (F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).alias("later"))
    first = O.keep_newest(rows.where("later"), ["user_id", "v"], [F.col("ts"), F.col("event_id")], 1)
    return J.without_partner(first, rows.where("NOT later"), ["user_id", "v"]).select("user_id", "v", "event_id")


# ---- vectors ----


@query("""WITH k AS (SELECT 'v' || label AS name, label AS seq, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY label)
SELECT v.vec_id, arg_min(k.name, k.seq) AS name, round(arg_min(d, k.seq), 6) AS distance FROM (SELECT vec_id FROM embeddings) v LEFT JOIN (
SELECT a.vec_id, k.name, k.seq, sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - k.e[i]::DOUBLE) ** 2))) AS d FROM embeddings a, k) k ON k.vec_id = v.vec_id AND d <= 1.2 GROUP BY v.vec_id""")
def theta_first_match(t):
    vectors = t("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    known = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(F.concat(F.lit("v"), F.col("label")).alias("name"), "embedding", F.col("label").alias("seq"))
    return J.theta_first_match(vectors.drop("label"), known, 1.2)


@query("""SELECT vec_id, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: abs(e[i] - r[i]))), 6) AS l1, round(sqrt(list_sum(list_transform(range(1, len(e) + 1), lambda i: (e[i] - r[i]) ** 2))), 6) AS l2,
round(list_sum(list_transform(range(1, len(e) + 1), lambda i: least(e[i], r[i]))), 6) AS intersection
FROM (SELECT vec_id, embedding::DOUBLE[] AS e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS r FROM embeddings)""")
def vector_metrics(t):
    from loomline.functions import vectors as V

    rows = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    one = rows.where("vec_id = 0").select(F.col("e").alias("r"))
    both = rows.join(F.broadcast(one.limit(1)))
    e, r = F.col("e"), F.col("r")
    return both.select("vec_id", F.round(V.l1(e, r), 6).alias("l1"), F.round(V.l2(e, r), 6).alias("l2"), F.round(V.intersection(e, r), 6).alias("intersection"))


# ---- predicates ----


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'video' WHEN event_type = 'click' THEN 'image' ELSE 'other' END AS service, CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'click' THEN 4 ELSE 1 END AS amount FROM events")
def request_classifier(t):
    kind = F.col("event_type")
    return t("events").select("event_id", F.when(kind == "purchase", "video").when(kind == "click", "image").otherwise("other").alias("service"), F.when(kind == "purchase", 1).when(kind == "click", 4).otherwise(1).alias("amount"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey BETWEEN 0 AND 50) OR (l_suppkey <= 10 AND l_quantity <= 20 AND l_discount = 0)")
def purge_predicate(t):
    from loomline.operators import filters as P

    rows = t("lineitem").withColumn("multiplier", F.when(F.col("l_discount") != 0, F.col("l_discount")))
    return rows.where(P.purge(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"), F.col("multiplier"), 0, 50, 10, 20)).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_size < 20 OR length(p_name) < 12 AS small_or_sides, p_size < 15 OR length(p_name) < 15 AS small_or, p_size < 20 AND length(p_name) < 20 AND p_size * length(p_name) < 400 AS small_and, p_size * length(p_name) >= 100 AND p_size * length(p_name) <= 900 AS in_bounds FROM part")
def size_predicates(t):
    from loomline.operators import filters as P

    w, h = F.col("p_size"), F.length("p_name")
    return t("part").select("p_partkey", ((w < 20) | (h < 12)).alias("small_or_sides"), P.small_or(w, h, 15).alias("small_or"), P.small_and(w, h, 20).alias("small_and"), (P.size_error(w, h, 10, 30).isNull()).alias("in_bounds"))


@query("""SELECT user_id, coalesce(arg_max(v, struct_pack(t := ts, e := event_id)) FILTER (WHERE event_type = 'purchase' AND v IS NOT NULL), max(v) FILTER (WHERE event_type = 'click'), min(v), 0) AS effective FROM (SELECT *, CASE WHEN value > 50 THEN value END AS v FROM events) GROUP BY user_id""")
def limit_precedence(t):
    v = F.when(F.col("value") > 50, F.col("value"))
    rows = t("events").withColumn("v", v)
    live = F.max_by("v", F.when((F.col("event_type") == "purchase") & F.col("v").isNotNull(), F.struct("ts", "event_id")))
    return rows.groupBy("user_id").agg(F.coalesce(live, F.max(F.when(F.col("event_type") == "click", F.col("v"))), F.min("v"), F.lit(0.0)).alias("effective"))


@query("SELECT doc_id FROM documents WHERE contains(lower(source || ' ' || text), 'the and')")
def substring_search(t):
    return t("documents").where(F.lower(F.concat_ws(" ", "source", "text")).contains("the and")).select("doc_id")


# ---- plans, boxes, generator, streams ----


@query("""SELECT src, CASE WHEN k = 0 THEN dst ELSE dst || '_' || k END AS dst, 'move' AS action FROM (
SELECT 'd/' || doc_id AS src, 'sorted/' || source || '/x' AS dst, row_number() OVER (PARTITION BY source ORDER BY 'd/' || doc_id) - 1 AS k FROM documents)""")
def move_plan(t):
    from loomline.plans import moves

    plan = t("documents").select(F.concat(F.lit("d/"), F.col("doc_id")).alias("src"), F.concat(F.lit("sorted/"), F.col("source"), F.lit("/x")).alias("dst"), F.lit("move").alias("action"))
    return moves.numbered(plan)


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN u > 0 THEN i / u ELSE 0 END, 6) AS iou FROM (SELECT *, a * b + 900 - i AS u FROM (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_linenumber * 10.0 AS b, greatest(least(l_quantity + 5, 40) - 10, 0) * greatest(least(l_linenumber * 10.0, 35) - 5, 0) AS i FROM lineitem))")
def box_iou(t):
    from loomline.functions.boxes import iou

    box = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    a = box(F.lit(5.0), F.lit(0.0), F.col("l_quantity"), F.col("l_linenumber") * F.lit(10.0))
    b = box(F.lit(10.0), F.lit(5.0), F.lit(30.0), F.lit(30.0))
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(iou(a, b), 6).alias("iou"))


@query()
def sum_inc_rows(t):
    from loomline.operators import generator

    rows = t("part").select(F.col("p_partkey").alias("id"), F.format_string("<sum_inc count=5 lower=0 upper=%d>a:0 b:0</sum_inc>", "p_size").alias("template"))
    return generator.rows(rows)


@query()
def simplified_prompts(t):
    return t("documents").select("doc_id", X.simplify_prompt(F.col("text")).alias("prompt"))


@query("""SELECT p_partkey, lpad(lower(to_hex(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(1, length(p_name) + 1), lambda i: ord(p_name[i])::UBIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296::UBIGINT))), 8, '0') AS h FROM part""")
def fnv_hash(t):
    from loomline.functions.boxes import fnv1a

    return t("part").select("p_partkey", fnv1a(F.col("p_name")).alias("h"))


@query("SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS n, min(value) AS least, max(value) AS most, round(max(value) - min(value), 6) AS delta FROM events GROUP BY ALL")
def tumbling_batch(t):
    from loomline.streaming import usage

    rows = usage.tumbling(t("events").withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"], "1 day")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


def _streamed(name):
    def add(f):
        QUERIES[name] = f
        return f

    return add


@_streamed("stream_dedupe")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a deduplicating stream."""
    from loomline.streaming import usage

    return usage.replayed(table(spark, sf_dir, "events"), lambda rows: usage.deduplicated(rows, ["event_id"], "60 days").select("event_id", "user_id"), "dedupe", most=None)


ORACLES["stream_dedupe"] = "SELECT DISTINCT event_id, user_id FROM events"


@_streamed("stream_quota")
def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling two-hour use per user, as a stateful stream."""
    from loomline.streaming import usage

    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id", F.lit(7200).alias("window_s"), F.lit(4).alias("quota"))
    return usage.replayed(rows, usage.rolling_quota, "quota", key="key").select("key", "event_id", "used", "limited")


ORACLES["stream_quota"] = """SELECT key, event_id, used, used >= 4 AS limited FROM (
SELECT user_id AS key, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
 - (SELECT count(*) FROM events o WHERE o.user_id = e.user_id AND epoch_us(o.ts) + 7200000000 <= epoch_us(e.ts)) AS used FROM events e)"""


@_streamed("stream_jobs")
def stream_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of a user settled by purchases, errors or time: six hours after they began (images) or after twelve hours of silence."""
    from loomline.streaming import usage

    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("progress")
    media = F.when(F.col("user_id") % 2 == 0, "image").otherwise("video")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job"), media.alias("media"), kind.alias("kind"), "ts", F.col("value").alias("progress"))
    found = usage.replayed(rows, lambda stream: usage.settled_jobs(stream, 6 * 3600, 12 * 3600, 86_400), "jobs", key="job")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "settled_at")})


_MARK = "(SELECT epoch_us(max(ts)) // 1000 - 600000 FROM events)"

ORACLES["stream_jobs"] = f"""WITH RECURSIVE e AS (
  SELECT *, row_number() OVER (PARTITION BY job ORDER BY t, r, event_id) AS k FROM (
    SELECT user_id AS job, user_id % 2 = 0 AS image, epoch_us(ts) AS t, value AS p, CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS r, event_id FROM events)),
s AS (
  SELECT DISTINCT job, image, 0::BIGINT AS k, NULL::BIGINT AS start, NULL::BIGINT AS last, 0::DOUBLE AS progress, NULL::BIGINT AS settled, [NULL::STRUCT(outcome VARCHAR, a BIGINT, b BIGINT, progress DOUBLE)] AS found FROM e
  UNION ALL
  SELECT job, image, k, CASE WHEN done THEN NULL ELSE start2 END, CASE WHEN skip THEN last ELSE t END, progress2, CASE WHEN done THEN t ELSE settled2 END,
    [CASE WHEN fired THEN struct_pack(outcome := CASE WHEN image THEN 'assumed' ELSE 'dropped' END, a := start, b := due, progress := progress) END,
     CASE WHEN done THEN struct_pack(outcome := CASE r WHEN 0 THEN 'completed' ELSE 'failed' END, a := start2, b := t, progress := progress2) END]
  FROM (
    SELECT *, NOT skip AND r < 2 AS done, CASE WHEN skip THEN NULL ELSE coalesce(start1, t) END AS start2, CASE WHEN skip THEN progress ELSE greatest(CASE WHEN start1 IS NULL THEN 0 ELSE progress END, p) END AS progress2 FROM (
      SELECT *, settled2 IS NOT NULL AS skip FROM (
        SELECT *, CASE WHEN t >= settled1 + 86400000000 THEN NULL ELSE settled1 END AS settled2 FROM (
          SELECT *, CASE WHEN fired THEN CASE WHEN image THEN due END ELSE settled END AS settled1, CASE WHEN fired THEN NULL ELSE start END AS start1 FROM (
            SELECT *, coalesce(CASE WHEN image THEN t >= due ELSE t > due END, false) AS fired FROM (
              SELECT s.job, s.image, e.k, s.start, s.last, s.progress, s.settled, e.t, e.p, e.r, CASE WHEN s.start IS NULL THEN NULL WHEN s.image THEN s.start + 21600000000 ELSE s.last + 43200000000 END AS due
              FROM s JOIN e ON e.job = s.job AND e.k = s.k + 1))))))),
o AS (
  SELECT job, unnest(found) AS x FROM s
  UNION ALL SELECT job, struct_pack(outcome := CASE WHEN image THEN 'assumed' ELSE 'dropped' END, a := start, b := due, progress := progress) FROM (
    SELECT *, CASE WHEN image THEN start + 21600000000 ELSE last + 43200000000 END AS due FROM s WHERE k = (SELECT max(k) FROM e WHERE e.job = s.job) AND start IS NOT NULL) WHERE ceil(due / 1000.0) < {_MARK})
SELECT job::VARCHAR AS job, x.outcome AS outcome, make_timestamp(x.a) AS started_at, make_timestamp(x.b) AS settled_at, x.progress AS progress FROM o WHERE x IS NOT NULL"""


@_streamed("stream_attempts")
def stream_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of a user: signups click, views see it busy, clicks see it idle, purchases complete it."""
    from loomline.streaming import usage

    kind = F.when(F.col("event_type") == "signup", "clicked").when(F.col("event_type") == "view", "busy").when(F.col("event_type") == "click", "idle").when(F.col("event_type") == "purchase", "completed").otherwise("other")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job"), kind.alias("kind"), "ts")
    found = usage.replayed(rows, lambda stream: usage.attempts(stream, 6 * 3600, 86_400), "attempts", key="job")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "settled_at")})


ORACLES["stream_attempts"] = f"""WITH RECURSIVE e AS (
  SELECT *, row_number() OVER (PARTITION BY job ORDER BY t, r, event_id) AS k FROM (
    SELECT user_id AS job, epoch_us(ts) AS t, CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS r, event_id FROM events)),
s AS (
  SELECT DISTINCT job, 0::BIGINT AS k, NULL::BIGINT AS start, false AS busy, NULL::BIGINT AS late, NULL::VARCHAR AS outcome, NULL::BIGINT AS a, NULL::BIGINT AS b FROM e
  UNION ALL
  SELECT job, k, CASE WHEN outcome IS NOT NULL THEN NULL WHEN start1 IS NULL AND r = 3 THEN t ELSE start1 END, outcome IS NULL AND start1 IS NOT NULL AND (busy1 OR r = 1),
    CASE WHEN fired THEN start END, outcome, start1, t
  FROM (
    SELECT *, CASE WHEN start1 IS NULL THEN NULL WHEN r = 0 THEN 'success' WHEN r = 2 AND busy1 AND t >= start1 + 2000000 THEN 'returned' WHEN r = 2 AND NOT busy1 AND t >= start1 + 21600000000 THEN 'never_accepted' END AS outcome FROM (
      SELECT *, CASE WHEN fired THEN NULL ELSE start END AS start1, busy AND NOT fired AS busy1 FROM (
        SELECT s.job, e.k, s.start, s.busy, e.t, e.r, coalesce(e.t >= s.start + 86400000000, false) AS fired FROM s JOIN e ON e.job = s.job AND e.k = s.k + 1)))),
o AS (
  SELECT job, outcome, a, b FROM s WHERE outcome IS NOT NULL
  UNION ALL SELECT job, 'timed_out', late, late + 86400000000 FROM s WHERE late IS NOT NULL
  UNION ALL SELECT job, 'timed_out', start, start + 86400000000 FROM s WHERE k = (SELECT max(k) FROM e WHERE e.job = s.job) AND ceil((start + 86400000000) / 1000.0) < {_MARK})
SELECT job::VARCHAR AS job, outcome, make_timestamp(a) AS started_at, make_timestamp(b) AS settled_at FROM o"""


@_streamed("stream_pauses")
def stream_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a user held back by purchases, which pause it for four or for twelve hours from then on."""
    from loomline.streaming import usage

    buys = F.col("event_type") == "purchase"
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.when(buys, "cooldown").otherwise("request").alias("kind"), F.col("event_id").alias("item"), F.when(F.col("event_id") % 2 == 0, 4 * 3600).otherwise(12 * 3600).alias("wait_s"), "ts")
    return usage.replayed(rows, usage.paced, "pauses", key="key").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("asked_at", "released_at")})


ORACLES["stream_pauses"] = f"""WITH e AS (SELECT user_id AS key, event_id AS item, epoch_us(ts) AS t, event_type = 'purchase' AS pause, CASE WHEN event_id % 2 = 0 THEN 14400000000 ELSE 43200000000 END AS w, max(epoch_us(ts)) OVER (PARTITION BY user_id) AS newest FROM events),
c AS (SELECT *, lead(t) OVER (PARTITION BY key ORDER BY t, item) AS next FROM e WHERE pause),
p AS (SELECT *, min(CASE WHEN next IS NULL OR t + w <= next THEN t + w END) OVER (PARTITION BY key ORDER BY t, item ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS over FROM c),
r AS (SELECT e.key, e.item, e.t, e.newest, CASE WHEN p.t + p.w > e.t THEN p.over ELSE e.t END AS freed FROM e ASOF LEFT JOIN p ON p.key = e.key AND p.t <= e.t WHERE NOT e.pause)
SELECT key, item, make_timestamp(t) AS asked_at, make_timestamp(freed) AS released_at FROM r WHERE freed <= newest OR ceil(freed / 1000.0) < {_MARK}"""


# ---- geometry, further joins ----


@query("SELECT p_partkey, list_transform(range(1, 5), lambda k: (p_size // 4 + CASE WHEN k <= p_size % 4 THEN 1 ELSE 0 END))::VARCHAR AS parts FROM part")
def even_distribution(t):
    from loomline.functions import geometry as G

    parts = F.transform(G.distribute(F.col("p_size"), 4), lambda x: x.cast("string"))
    return t("part").select("p_partkey", F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]")).alias("parts"))


@query("SELECT l_orderkey, l_linenumber, round_even(w * (512.0::DOUBLE / greatest(w, h)), 0)::INT AS width, round_even(h * (512.0::DOUBLE / greatest(w, h)), 0)::INT AS height FROM (SELECT l_orderkey, l_linenumber, l_partkey + 1 AS w, l_suppkey + 1 AS h FROM lineitem)")
def long_side_resize(t):
    from loomline.functions import geometry as G

    size = G.long_side(F.col("l_partkey") + 1, F.col("l_suppkey") + 1, 512)
    return t("lineitem").select("l_orderkey", "l_linenumber", size.alias("s")).select("l_orderkey", "l_linenumber", "s.width", "s.height")


@query("""WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') AS path FROM pages) SELECT path FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE starts_with(q.path, p.path || '/'))""")
def most_specific_paths(t):
    paths = t("pages").select(F.regexp_replace(X.url_without_query(F.col("url")), "/$", "").alias("path")).distinct()
    return J.most_specific(paths)


@query("SELECT event_id FROM events WHERE user_id = 7")
def filter_if_known(t):
    return J.filter_if_known(t("events").select("event_id", "user_id"), "user_id", F.col("user_id") == 7).select("event_id")


@query("SELECT c_custkey, least(coalesce(a, b), coalesce(b, a)) IS NOT NULL AS any_match, coalesce(a, b) AS entry FROM customer LEFT JOIN (SELECT s_acctbal AS f, min(s_suppkey) AS a FROM supplier GROUP BY f) x ON f = c_acctbal LEFT JOIN (SELECT s_nationkey AS n, min(s_suppkey) AS b FROM supplier GROUP BY n) y ON n = c_nationkey")
def handled_entries(t):
    records = t("customer").select("c_custkey", F.col("c_acctbal").alias("fingerprint"), F.col("c_nationkey").alias("original_id"))
    entries = t("supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_acctbal").alias("fingerprint"), F.col("s_nationkey").alias("original_id"))
    return J.handled(records, entries).select("c_custkey", F.col("entry").isNotNull().alias("any_match"), "entry")


@query("""WITH RECURSIVE o AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY vec_id, embedding) AS k FROM embeddings),
s AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS vec_id, NULL::BIGINT AS cluster, []::DOUBLE[][] AS x
  UNION ALL SELECT k, vec_id, coalesce(hit, len(x)), CASE WHEN hit IS NULL THEN list_append(x, e) ELSE x END
  FROM (SELECT o.k, o.vec_id, o.e, s.x, list_position(list_transform(s.x, lambda c: list_distance(c, o.e) <= 4.0), true) - 1 AS hit FROM s JOIN o ON o.k = s.k + 1))
SELECT vec_id, cluster FROM s WHERE k > 0""")
def online_clusters(t):
    return J.online_clusters(t("embeddings"), "vec_id", 4.0)


@query("""WITH b AS (SELECT s_suppkey AS path, row_number() OVER (ORDER BY s_suppkey) - 1 AS place, count(*) OVER () AS n FROM supplier)
SELECT c_custkey AS id, d::INT AS draw, path FROM customer, range(3) r(d) JOIN b ON place = ('0x' || md5(c_custkey || '|' || d || '|2')[1:15])::BIGINT % n""")
def background_draws(t):
    backgrounds = O.ordinal(t("supplier").select(F.col("s_suppkey").alias("path")), [F.col("path")])
    return J.with_backgrounds(t("customer").select(F.col("c_custkey").alias("id")), backgrounds, 3, seed=2).select("id", "draw", "path")


@query("SELECT event_id, CASE WHEN contains(props, '1') THEN 'limit' ELSE 'ok' END AS outcome FROM events")
def response_outcomes(t):
    from loomline.operators import filters as P

    message = F.when(F.col("props").contains("1"), "Rate limit reached").otherwise("done")
    return t("events").select("event_id", P.outcome(F.lit(200), message).alias("outcome"))


from loomline import file_queries, media_queries, more_queries  # noqa: E402, F401  (register the rest)
