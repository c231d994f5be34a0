"""URL block and allow lists by hashed host-suffix and path-prefix expressions.

Each distinct URL is expanded into the expressions that a rule could state for
it. Expressions meet the rules in an equi-join on a short hash prefix; the full
digest then confirms, and the longest rule decides. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of the hash prefix on which expressions and rules meet (32 bits).
SHORT_HEX = 8
#: Rule tables of up to this many rows are broadcast.
BROADCAST_RULES = 100_000

#: The rules (verdict, host, path) of the default list.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The rules as a table; made of literals, so no Python runs on executors."""
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The input's columns with _host, _path, _rule, _verdict.

    A rule fits its host and all subdomains where the path starts with the
    rule's; of fitting rules the longest (host and path together) decides, and of
    equally long ones a block before an allow, then the smaller text. Without a
    fitting rule the verdict is ``default`` and the rule null. A null URL, or one
    without ``://``, has an empty host and path. Distinct host and path pairs
    alone are expanded, so repeated URLs cost one expansion; only pairs that a
    rule fits come back into the join with the pages.
    """
    expression = lambda host, path: F.sha2(F.concat(host, F.lit("\n"), path), 256)
    listed = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        F.col("verdict").alias("r_verdict"), F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")
    )
    # which label counts and path lengths occur in rules: at most one row each, whatever the number of rules
    shape = listed.agg(F.collect_set("labels").alias("labels"), F.collect_set("chars").alias("chars"), F.count(F.lit(1)).alias("n")).first()
    digests = listed.withColumn("digest", expression(F.col("r_host"), F.col("r_path"))).withColumn("short", F.substring("digest", 1, SHORT_HEX))
    if shape["n"] <= BROADCAST_RULES:
        digests = F.broadcast(digests)

    judged = pages.withColumns({"_host": host_of(F.col(url_col)), "_path": path_of(F.col(url_col))})
    distinct = judged.where("_host <> ''").select("_host", "_path").distinct()
    parts = F.split("_host", r"\.")
    numbers = lambda x: F.array(*[F.lit(i) for i in sorted(x)]).cast("array<int>")
    expanded = (
        distinct.withColumn("parts", parts)
        .withColumn("k", F.explode(F.filter(numbers(shape["labels"]), lambda k: k <= F.size("parts"))))
        .withColumn("suffix", F.array_join(F.slice("parts", F.size("parts") - F.col("k") + 1, F.col("k")), "."))
        .withColumn("c", F.explode(F.filter(numbers(shape["chars"]), lambda c: c <= F.length("_path"))))
        .select("_host", "_path", expression(F.col("suffix"), F.expr("substring(_path, 1, c)")).alias("full"))
        .withColumn("short", F.substring("full", 1, SHORT_HEX))
    )
    hits = expanded.join(digests, "short").where(F.col("full") == F.col("digest"))
    rank = F.struct(F.length(F.concat("r_host", "r_path")).alias("len"), F.when(F.col("r_verdict") == "block", 1).otherwise(0).alias("block"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = hits.groupBy("_host", "_path").agg(F.max(rank).alias("_best"))
    return judged.join(best, ["_host", "_path"], "left").withColumns({"_rule": F.col("_best.rule"), "_verdict": F.coalesce(F.col("_best.verdict"), F.lit(default))}).drop("_best")


def url_filter(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page, by the rules of ``judge``.

    A null url, or one without ``://``, has an empty host and path and the
    default verdict; whole urls are judged, however long; repeated rows give
    repeated results; an empty table gives no rows. Rules with a null part fit
    nothing; without rules all is allowed. Other columns are not read.
    """
    judged = judge(pages.select("page_id", "url"), rules)
    return judged.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


ORACLE = """
WITH rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
p AS (
  SELECT row_number() OVER () AS u, page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
hits AS (
  SELECT p.u, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) AS best
  FROM p JOIN rules r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.u)
SELECT p.page_id, p.host, p.path, h.best.rule AS rule, coalesce(h.best.verdict, 'allow') AS verdict
FROM p LEFT JOIN hits h USING (u)
"""
