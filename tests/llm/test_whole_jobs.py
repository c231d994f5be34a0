"""Operators that used to do less than the whole job."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.llm import html_extract, license_scan, suffix_dedup


@pytest.mark.parametrize("odd", ["<![foo[ x ]>", "<![foo[ x ]]>", "<![0 ]>", "<![ CDATA[ x ]]>", "<![>", "<i>&#" + "9" * 5000 + ";</i>", "<i>&#" + "0" * 5000 + "65;</i>"])
def test_html_text_behind_odd_markup(odd):
    nodes = html_extract._nodes(html_extract.parse(f"<p>a</p>{odd}<p>b &lt;</p>"))
    texts = [n.text for n in nodes if n.text is not None]
    assert (texts[0], texts[-1]) == ("a", "b <") and texts[1:-1] in ([], ["\ufffd"], ["A"])


def test_whole_licenses(spark):
    files = license_scan.files(license_scan.__package__).joinpath("licenses")
    named = {n: files.joinpath(f"{n}.txt").read_text() for n in ("Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0")} | license_scan.TEXTS
    named["Apache-2.0"] = named["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2021 Someone")
    docs = spark.createDataFrame([*named.items(), ("none", named["GPL-3.0"] + " And more.")], "doc_id string, text string")
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(docs, license_scan.known(spark)).collect()}
    assert got == {n: n for n in named} | {"none": None}
    assert set(license_scan.NAMES) - set(named) == {"CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0"}


def test_suffix_arrays_of_one_text(spark, monkeypatch):
    """Rows without an id, some of them copies of each other: no array holds more than one text's rows, and the result is that of unique ids."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    shared = word(260)
    texts = [word(300) + shared + word(300) for _ in range(30)] + [word(400)] * 5
    largest = []

    def by_text(rows, *args, plain=suffix_dedup._by_text):
        out = plain(rows, *args)
        largest.append(out.agg(F.max(F.size("rows"))).first()[0] or 0)
        return out

    monkeypatch.setattr(suffix_dedup, "_by_text", by_text)
    results = []
    for ids in (range(len(texts)), [None] * len(texts)):
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        results.append(sorted(tuple(r)[1:] for r in suffix_dedup.removal(docs).collect()))
        results.append(max(largest))
        largest.clear()
    assert results[2] == results[0] and results[3] <= results[1]
    assert any(0 < r[1] < r[0] for r in results[0])


def test_whole_licenses_against_sql(spark, equal):
    """Every known whole text, in other case, with copyright lines and more white space, and texts beside them: the SQL gives what the query gives."""
    import duckdb
    import pandas as pd

    rows = []
    for k, (name, text) in enumerate(license_scan.whole_texts()):
        rows += [(10 * k, text), (10 * k + 1, "Copyright (c) 2020 A. Person\n" + text.upper().replace(" ", "  ")), (10 * k + 2, text + " One more."), (10 * k + 3, text[: len(text) // 2]), (10 * k + 4, f"Licensed under the {name} License.\n" + text[:50])]
    rows += [(9000, None), (9001, ""), (9000, license_scan.TEXTS["MIT"]), (None, license_scan.TEXTS["MIT"])]
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = license_scan.scan(docs, license_scan.known(spark))
    equal(got, c.sql(license_scan.oracle()))
    assert got.where("license IS NOT NULL").count() == 2 * len(license_scan.whole_texts()) + 2
