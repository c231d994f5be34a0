"""URL rules, licences and the pipeline's stages on empty tables, nulls and clashing columns."""

from loomline.llm import license_scan, url_filter


def test_urls_of_empty_and_long_tables(spark):
    rules = url_filter.rule_table(spark, url_filter.RULES)
    pages = spark.createDataFrame([(1, "http://a.com/en/" + "x" * 200_000, "r"), (2, None, "s")], "page_id long, url string, rule string")
    got = {r["page_id"]: r for r in url_filter.url_filter(pages, rules).collect()}
    assert got[1]["verdict"] == "block" and len(got[1]["path"]) == 200_004 and (got[2]["host"], got[2]["verdict"]) == ("", "allow")
    assert url_filter.url_filter(pages.limit(0), rules).count() == 0
    holes = rules.selectExpr("verdict", "CASE WHEN path = '/en/' THEN NULL ELSE host END AS host", "path")
    assert url_filter.url_filter(pages, holes).where("verdict = 'allow'").count() == 2


def test_known_licences_named_twice(spark):
    known = license_scan.known(spark)
    docs = spark.createDataFrame([(1, license_scan.TEXTS["MIT"], "x"), (1, license_scan.TEXTS["MIT"], "x")], "doc_id long, text string, digest string")
    twice = known.unionByName(known.withColumnRenamed("license", "l").selectExpr("kind", "digest", "chars", "concat('z', l) AS license"))
    assert [r["license"] for r in license_scan.scan(docs, twice).collect()] == ["MIT", "MIT"]


def test_stages_on_odd_documents(spark, sf):
    import corpus_pipeline as P

    schema = "doc_id long, text string, lang string, source string, n_chars long, class string, _class int, _spans string"
    word = " ".join(f"word{k}" for k in range(120))
    rows = [(None, word, "en", "s", len(word), "c", 1, "p"), (1, None, "en", None, None, None, None, None), (2, "", "en", "s", 0, "c", 1, "p"), (3, word, None, "s", len(word), "c", 1, "p")]
    odd = spark.createDataFrame(rows, schema)
    for name, stage in P.STAGES:
        for docs in (odd, odd.limit(0)):
            out = P.written(stage(spark, docs, sf), f"odd-{name}")
            assert name == "byte_bpe" or out.columns == docs.columns
            assert out.count() <= docs.count()
    assert {r["doc_id"] for r in P.near_duplicates(spark, odd, sf).collect()} == {1, 2, 3}
