"""Quality rules as a short-circuit cascade of native expressions.

Every document gets its base counts. A verdict is the conjunction of rules;
their order is found on a bounded sample, by rejection per cost, so that later
rules run on few documents. The order changes the time taken, never a verdict.
DataFrame functions only.
"""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sample on which rule costs and selectivities are estimated: so many rows, of texts of up to so many bytes, judged so often for a timing.
SAMPLE_ROWS, SAMPLE_TEXT_BYTES, REPEATS = 300, 1 << 15, 4
_SPACE, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
_SPACES = " \t\n\u000b\u000c\r"


class Rule(NamedTuple):
    """A document is rejected where ``rejects`` (SQL over the base columns and text) holds."""

    name: str
    rejects: str


#: The production rules. Each looks at one trait of junk and leaves clean prose alone.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_words", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * size(filter(split(text, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]'))"),
    Rule("word_length", "word_chars > 20 * n_words OR word_chars < 2 * n_words"),
    Rule("shouting", "2 * length(regexp_replace(text, '[^A-Z]+', '')) > word_chars"),
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(words: Column) -> Column:
    """Words of a text that lie in a 3-word window found twice or more.

    Windows are sorted by (hash, position); equal neighbours mark both
    positions, and the marked positions then cover three words each, overlaps
    once. All inside the row: nothing is shuffled, and the work for a text of n
    words grows as n log n.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def marked(found: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(found, a)["h"] == F.get(found, b)["h"], F.lit(False))
        hit = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.sort_array(F.transform(hit, lambda j: F.get(found, j)["i"]))

    def length(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last"))
        step = lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(3), i - acc["last"])).alias("sum"), i.alias("last"))
        return F.aggregate(at, start, step, lambda acc: acc["sum"])

    def covered(h: Column) -> Column:
        windows = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(_let(F.sort_array(windows), marked), length))

    return F.when(F.size(words) < 4, 0).otherwise(_let(hashes, covered)).cast("long")


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Words are runs of other characters than space and U+0009 to U+000D. A null
    text has none and all counts 0. Input columns of these names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    packed = F.translate(text, _SPACES, "")
    cheap = {
        "n_words": F.regexp_count(text, F.lit(_WORD)).cast("long"),
        "word_chars": F.length(packed).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
    }
    others = [F.col(f"`{c}`") for c in docs.columns if c not in cheap]
    # a generator's columns are worked out once, however many rules read them
    counted = docs.select(*others, F.inline(F.array(F.struct(*[v.alias(k) for k, v in cheap.items()]))))
    counted = counted.withColumns({"n_repeat_words": _let(words, _covered), "n_dup_lines": _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))})
    return counted.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` texts of a few partitions, each of at most SAMPLE_TEXT_BYTES: what the driver holds is bounded by both.

    ``take`` reads one partition and, only while rows are missing, some more, so
    the work does not follow the number of rows or partitions.
    """
    texts = docs.select("text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_TEXT_BYTES)
    return docs.sparkSession.createDataFrame(texts.take(rows), "text string").coalesce(1)


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost on a sample of at most ``sample_rows`` rows.

    A rule's cost is the time of a plan that judges the sample REPEATS times by
    it, with the counts that it needs (the others are pruned), less that of the
    same plan without a rule, which covers starting up. The next rule is always the one that rejects most
    per cost of what the rules before it leave. The sample decides the order
    alone, and the order decides no verdict. With an empty sample the rules keep
    their order.
    """
    sample = sample_of(docs, sample_rows).cache()
    often = with_counts(sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("_time")).drop("_time"))
    rejects = [F.coalesce(F.expr(rule.rejects), F.lit(False)) for rule in rules]

    def seconds(column: Column) -> float:
        began = time.perf_counter()
        often.agg(F.count_if(column)).first()
        return time.perf_counter() - began

    try:
        left = with_counts(sample).select(*[c.alias(f"r{k}") for k, c in enumerate(rejects)]).collect() if rules else []
        if not left:
            return list(rules)
        idle = seconds(F.col("text").isNull())
        cost = [max(seconds(c) - idle, 1e-3) for c in rejects]
    finally:
        sample.unpersist()
    order, open_ = [], list(range(len(rules)))
    while open_:
        best = max(open_, key=lambda k: (sum(row[k] for row in left) / cost[k], -cost[k]))
        order.append(rules[best])
        open_.remove(best)
        left = [row for row in left if not row[best]]
    return order


def cascade(rules: list[Rule] | tuple[Rule, ...]) -> Column:
    """The first rule, in this order, that rejects the row; null where none does. Later rules are not evaluated."""
    chain = F
    for rule in rules:
        chain = chain.when(F.coalesce(F.expr(rule.rejects), F.lit(False)), rule.name)
    return chain.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A document is kept where the base does not fail and no rule of the cascade
    rejects it. One row per input row, repeated rows included; a null text fails
    the base. No shuffle.
    """
    order = ordered_rules(docs, rules)
    judged = with_counts(docs.select("doc_id", "text"))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order).isNull())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def keep_clean(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input rows and columns of documents that the cascade keeps; the base rules are its members.

    Null and empty texts have too few words and go; of repeated rows all stay or
    none; an empty table stays empty; extra columns pass through, whatever their
    names. The dear counts are columns that only the filter reads, so each is worked out
    where a rule asks for it, and not for rows that an earlier rule rejects.
    """
    order, names = ordered_rules(docs, rules), docs.columns
    own = [F.col(f"`{c}`").alias(f"_own_{k}") for k, c in enumerate(names)]
    counted = with_counts(docs.select(F.col("text"), *own))
    return counted.where(cascade(order).isNull()).select(*[F.col(f"_own_{k}").alias(c) for k, c in enumerate(names)])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT u, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
tri AS (SELECT u, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT u, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 4)),
rep AS (SELECT u, i FROM (SELECT u, i, count(*) OVER (PARTITION BY u, g) AS n FROM tri) WHERE n >= 2),
cov AS (SELECT u, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY u),
lin AS (SELECT u, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
c AS (
  SELECT d.u, d.doc_id, d.text, len(w.ws)::BIGINT AS n_words,
    length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(d.text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lin.ls) - len(list_distinct(lin.ls)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(lin.ls) AS n_lines
  FROM d JOIN w USING (u) JOIN lin USING (u) LEFT JOIN cov USING (u)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines OR word_chars > 20 * n_words OR word_chars < 2 * n_words
    OR 2 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > word_chars) AS kept
FROM b
"""
