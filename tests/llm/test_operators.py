"""The operators against SQL, brute force or an exact round trip, and on odd input."""

import collections
import hashlib
import io
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomline.llm import arrow_text, byte_bpe, components, decontaminate, html_extract, license_scan, ngram_jaccard, quality_rules, suffix_dedup, token_records, url_filter, warc
from loomline.llm import queries as Q
from loomline.llm.html_samples import sample_page

WORD, BYTE = Q.tokenizer_file("word_bpe_49k.json"), Q.tokenizer_file("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n\n", "a", "the cat", "é\u00a0ß \x1c x", "x" * 3000, "日本語 テスト。", "😀 don't STOP.  now\t\n", "<|endoftext|>", "İstanbul Σας", "a" + " b" * 40]


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "clash", 1, "e") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, class string, n_words int, id string").repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, [*ODD, *ODD[:3], "x" * 3000])


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_against_sql(name, spark, sf, duck, equal):
    equal(Q.QUERIES[name](spark, sf), duck.sql(Q.ORACLES[name]))


# ---- suffix dedup ----


def spans_by_force(texts, length=200):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        starts = [i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1]
        kept, removed, runs = suffix_dedup.kept_parts(t, [(i, i + length) for i in starts])
        out.append((len(t), removed, runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_starts():
    rng = random.Random(1)
    for trial in range(80):
        length = rng.choice([2, 3, 5, 10])
        rows = [bytes(rng.choices(b"ab" if trial % 2 else b"abcd", k=rng.randint(1, 40))) for _ in range(rng.randint(1, 6))]
        rows += rows[:1] * (trial % 3 == 0)
        symbols = np.concatenate([x for r in rows for x in (np.frombuffer(r, np.uint8).astype(np.int64) + 1, [0])])
        where = collections.defaultdict(list)
        at = 0
        for r in rows:
            for i in range(len(r) - length + 1):
                where[r[i : i + length]].append(at + i)
            at += len(r) + 1
        assert set(suffix_dedup.repeated_starts(symbols, length).tolist()) == {x for v in where.values() if len(v) > 1 for x in v}


@pytest.mark.parametrize("most", [4096, 1])
def test_suffix_dedup(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_WINDOWS", most)
    rng = random.Random(2)
    make = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    passage = make(260)
    texts = [make(400) + passage[k % 50 :] + make(300) for k in range(6)] + [passage * 3, "ab" * 400, "ab" * 150, make(100), make(199), passage[:200], None, ""]
    texts += [texts[0]]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.removal(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == spans_by_force([(t or "").encode() for t in texts])


def test_suffix_dedup_odd(spark, odd, empty):
    assert suffix_dedup.removal(empty).count() == 0
    same_id = docs_of(spark, ["p" * 150 + "q" * 400, "p" * 150 + "r" * 10, None], ids=[7, 7, None])
    got = sorted(suffix_dedup.removal(same_id).collect(), key=lambda r: r["n_bytes"])
    assert [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got] == [(None, 0, 0), (7, 160, 0), (7, 550, 400)]
    cut = suffix_dedup.without_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert cut.where("text IS NULL").count() == 2
    assert {r["text"] for r in cut.where("length(text) >= 3000 OR text = ''").collect()} == {""}


# ---- URL rules ----


def test_url_filter_odd(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x", "ftp://com/en/", "x://a.b.c.net/de/8", "http://example.net/de/8#", "http://notexample.com/en/7", "http://u://v/en/", "http://org/es/\n/x"]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[4]])], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.url_filter(rows, url_filter.rule_table(spark, url_filter.RULES)).collect()}
    assert len(got) == len(urls) + 1
    assert got[0] == got[1] == got[2] == ("", "", None, "allow") and got[3] == ("", "", None, "allow")
    assert got[4] == ("a.example.com", "/en/7", "example.com/en/7", "allow") == got[11]
    assert got[5][2:] == ("com/en/", "block") and got[6][2:] == ("net/de/", "allow") and got[7][2:] == ("example.net/de/8", "block")
    assert got[8][2:] == ("com/en/", "block") and got[9][:2] == ("u:", "//v/en/") and got[10][2:] == ("org/es/", "block")
    none = url_filter.rule_table(spark, url_filter.RULES).limit(0)
    assert url_filter.url_filter(rows, none).where("verdict = 'allow' AND rule IS NULL").count() == len(urls) + 1


# ---- token records ----


def test_word_encoder():
    whole = Tokenizer.from_file(WORD)
    rng = random.Random(3)
    marks = ["a <|endoftext|> b", "<|startoftext|>", "x<|ENDOFTEXT|>y <|endoftext|>", "<|endoftext|", "<|end<|endoftext|>oftext|> s", "é\t<|endoftext|>\n <|endoftext|>"]
    texts = [t for t in ODD if t] + marks + ["".join(rng.choices("aéİ .,'%$#sT1½\t\u0301日-", k=rng.randint(1, 60))) for _ in range(400)]
    coder = token_records.WordEncoder(WORD, 2)
    for t in texts:
        assert np.frombuffer(coder(t.encode()), "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_token_records(spark, sf, odd, empty):
    assert token_records.token_records(empty, WORD).count() == 0
    for docs in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        got = sorted(token_records.token_records(docs, WORD).collect(), key=lambda r: r["start"])
        texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        assert [r["doc_id"] for r in got] == sorted(i for i, _ in texts)
        coder, start = Tokenizer.from_file(WORD), 0
        ids = collections.defaultdict(list)
        for i, t in texts:
            ids[i].append(zlib.crc32(np.array([*coder.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()))
        for r in got:
            assert r["start"] == start and r["ids_crc32"] in ids[r["doc_id"]]
            start += r["n_tokens"]


def test_record_frames(spark, odd):
    data = token_records.frame(b"\1\0\2\0") + token_records.frame(b"")
    source = io.BytesIO(data)
    assert token_records.read_frame(source, 2).tolist() == [1, 2] and token_records.read_frame(source, 2).tolist() == []
    assert token_records.read_frame(source, 2) is None
    for at in range(len(token_records.frame(b"\1\0\2\0"))):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            token_records.read_frame(io.BytesIO(bytes(broken)), 2)
    manifest = token_records.write_records(odd, token_records.new_path(spark, "t"), WORD).collect()
    files, path = token_records.pafs.FileSystem.from_uri(manifest[0]["index_path"])
    for row in token_records.read_index(files, path)[::-1]:  # a shuffled read by the index
        assert len(token_records.fetch(manifest[0]["path"], int(row["offset"]), 2)) == row["tokens"]


# ---- quality ----


def test_quality_odd(spark, odd, empty):
    assert quality_rules.quality(empty).count() == 0
    got = {r["doc_id"]: r for r in quality_rules.quality(odd).collect()}
    assert got[0]["n_words"] == 0 and got[0]["base_failed"] and not got[0]["kept"]
    assert got[12]["n_words"] == 41 and got[12]["n_repeat_words"] == 40
    kept = quality_rules.keep_clean(odd)
    assert kept.columns == odd.columns and kept.count() == 0


def test_quality_order_changes_no_verdict(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counted = quality_rules.with_counts(docs)
    one, other = quality_rules.cascade(quality_rules.RULES).isNull(), quality_rules.cascade(quality_rules.RULES[::-1]).isNull()
    assert counted.where(one != other).count() == 0
    assert {r.name for r in quality_rules.ordered_rules(docs)} == {r.name for r in quality_rules.RULES}
    assert counted.where(one).count() == Q.QUERIES["op4_quality_rules"](spark, sf).where("kept").count()


# ---- WARC ----


def test_warc_round_trip(spark):
    long = "p" * 200
    rows = [(3, "u3", long), (1, "u1", long), (2, None, long), (4, "u4", "short"), (5, "u5", "short"), (6, "u\n6", None), (7, "", ""), (None, "n", long), (1, "u1", long)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    got = collections.Counter(tuple(r) for r in warc.round_trip(pages).collect())
    want = collections.Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == long and i != 1
        want[(i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None)] += 1
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_salvage():
    blocks = [f"payload {i} ".encode() * 50 + b"WARC/1.1\r\n" * (i % 2) for i in range(12)]
    for packed in (True, False):
        parts = [warc.record("response", f"urn:page:{i}", "u", b, hashlib.sha256(b).hexdigest()) for i, b in enumerate(blocks)]
        parts = [warc.member(p) if packed else p for p in parts]
        assert [type(x).__name__ for x in warc.salvage(io.BytesIO(b"".join(parts)))] == ["Record"] * 12
        rng = random.Random(4)
        for hit in ([3], [0], [11], [4, 5], [2, 8]):
            broken = [bytearray(p) for p in parts]
            for k in hit:
                broken[k][len(broken[k]) // 2] ^= 0xFF
            data = b"junk" * rng.randint(0, 3) + b"".join(broken)
            found = list(warc.salvage(io.BytesIO(data)))
            ids = [int(x.headers["warc-record-id"].strip("<>").split(":")[-1]) for x in found if isinstance(x, warc.Record)]
            assert ids == [i for i in range(12) if i not in hit]
            gaps = [x for x in found if isinstance(x, warc.Gap)]
            assert sum(g.end - g.offset for g in gaps) >= sum(len(parts[k]) for k in hit)
        cut = b"".join(parts)[:-20]
        assert sum(isinstance(x, warc.Record) for x in warc.salvage(io.BytesIO(cut))) == 11


# ---- HTML ----


@pytest.fixture(scope="module")
def trees(spark):
    return html_extract.fit(spark)


def test_html_held_out(trees):
    exact = 0
    for seed in range(200):
        page = sample_page(seed)
        nodes = html_extract._nodes(html_extract.parse(page))
        x, y = html_extract.labelled(page)
        want = "\n".join(n.text for n in nodes if n.text is not None and y[n.index])
        exact += html_extract.decode(nodes, html_extract.log_odds(trees, x)) == want
    assert exact >= 190


def test_html_odd(spark, trees):
    page = "<html><body><nav><a href=/>Menu</a></nav><article><h1>A  title</h1><p>One &amp; two&nbsp;<b>bold<br>line<p>Next   para &lt;tag&gt;</p><script>x</script><div class=ad>Buy it</div></article><footer>&copy; me</footer>"
    rows = [(0, "u", page), (1, None, None), (2, "u", ""), (3, "u", "<p"), (4, "u", "<!DOCTYPE html><![CDATA[x"), (5, "u", "<div>" * 500 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extract.extract(pages, trees).collect()}
    assert got[0]["text"] == "A title\nOne & two bold line\nNext para <tag>"
    assert all(got[i]["text"] == "" and got[i]["n_chars"] == 0 for i in (1, 2, 3)) and len(got) == 6


def test_html_pages(spark, sf):
    got = html_extract.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert len(got) == 50 or len(got) > 0
    for r in got:
        assert r["text"] and r["n_chars"] == len(r["text"]) and "©" not in r["text"].split("\n")[-1]


def test_decode_is_best():
    """The labelling is the likeliest of all that keep ancestors of kept nodes."""
    rng = random.Random(5)
    for _ in range(60):
        nodes = [html_extract.Node("div", None)]
        for _ in range(rng.randint(1, 7)):
            parent = rng.choice([n for n in nodes if n.text is None])
            nodes.append(html_extract.Node("#text" if rng.random() < 0.5 else "p", parent, text=None))
            if nodes[-1].tag == "#text":
                nodes[-1].text = str(len(nodes))
            parent.children.append(nodes[-1])
        nodes = html_extract._nodes(nodes[0])
        odds = np.array([rng.gauss(0, 2) for _ in nodes])
        best, kept = max(
            ((sum(o if k else 0.0 for o, k in zip(odds, ks, strict=True)), ks) for ks in itertools.product([0, 1], repeat=len(nodes)) if all(not ks[n.index] or n.parent is None or ks[n.parent.index] for n in nodes)),
            key=lambda x: x[0],
        )
        assert html_extract.decode(nodes, odds) == "\n".join(n.text for n in nodes if n.text and kept[n.index])


# ---- licences ----


def test_license_odd(spark, odd, empty):
    known = license_scan.known(spark)
    assert license_scan.scan(empty, known).count() == 0
    assert license_scan.scan(odd, known).count() == odd.count()
    mit = license_scan.TEXTS["MIT"].replace("<year> <copyright holders>", "2020 Someone")
    texts = [mit, mit.upper().replace("LICENSE", "LICENCE").replace("\n\n", "\r\n\r\n"), "x " + mit, "Hello.\n  licensed under the  APACHE LICENCE, version 2.0!\nReleased under MIT license\n"]
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(spark, texts), known).collect()}
    assert [got[i]["license"] for i in range(4)] == ["MIT", "MIT", None, None]
    assert got[3]["notices"] == "Apache-2.0,MIT" and got[3]["n_notices"] == 2


# ---- Jaccard ----


def jaccard_by_force(texts, ids):
    sets = []
    for t in texts:
        ws = [w for w in arrow_words((t or "").translate({i: i + 32 for i in range(65, 91)}))]
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    links = {(i, j) for i in range(len(texts)) for j in range(len(texts)) if i != j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    least = lambda i: min((ids[j] for j in range(len(texts)) if root[j] == root[i] and ids[j] is not None), default=None)
    return collections.Counter((ids[i], len(sets[i]), least(i), sum(a == i for a, _ in links)) for i in range(len(texts)))


def arrow_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text)


@pytest.mark.parametrize("chunk", [2_000_000, 400])
def test_jaccard(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_jaccard, "CHUNK_SHINGLES", chunk)
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    texts = [None, "", "one two", "ONE two", "one  two\n", "a b c d e", "a b c d e f"]
    for size in (6, 12, 40, 60, 90, 130, 170, 400):
        base = rng.choices(vocabulary, k=size)
        for edits in (0, 0, 1, 1, 2, 3, size // 20, size // 12):
            ws = list(base)
            for _ in range(edits):
                ws[rng.randrange(size)] = rng.choice(vocabulary)
            texts.append(" ".join(ws[: size - rng.randint(0, size // 10)]))
        texts.append(" ".join(base + rng.choices(vocabulary, k=size // 3)))
    ids = list(range(len(texts)))
    ids[1], ids[9] = None, None
    got = collections.Counter(tuple(r) for r in ngram_jaccard.jaccard_join(docs_of(spark, texts, ids)).collect())
    assert got == jaccard_by_force(texts, ids)


def test_jaccard_search():
    rng = random.Random(7)
    sets = [np.unique(np.array(rng.choices(range(60), k=rng.randint(1, 50)), np.uint64)) for _ in range(120)]
    for q, found in ngram_jaccard.search(sets, sets):
        want = [r for r, s in enumerate(sets) if 175 * len(np.intersect1d(s, sets[q])) >= 75 * (len(s) + len(sets[q]))]
        assert found.tolist() == want
    asked = [q for q, _ in ngram_jaccard.search(sets, sets)]
    assert asked == list(range(120))


def test_jaccard_odd(spark, odd, empty):
    assert ngram_jaccard.jaccard_join(empty).count() == 0
    kept = ngram_jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {0, 1, 2, 3, 13, 14, 15} <= set(ids) and (7 in ids) and (16 not in ids) and len(ids) == len(set(ids))


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5)]
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


# ---- decontamination ----


def test_wand_is_exact(duck):
    index = decontaminate.build(duck.sql("SELECT item_id, text FROM benchmark ORDER BY 1").fetchall())
    rng = random.Random(9)
    for _ in range(150):
        place = rng.randrange(len(index.items))
        own = [t for t in range(len(index.vocabulary)) if place in index.owner[index.starts[t] : index.starts[t + 1]]]
        terms = np.unique(rng.sample(range(len(index.vocabulary)), 40) + rng.sample(own, int(len(own) * rng.random()))).astype(int)
        score = np.zeros(len(index.items))
        for t in terms:
            span = slice(index.starts[t], index.starts[t + 1])
            score[index.owner[span]] += index.impact[span]
        want = {int(k): pytest.approx(score[k]) for k in np.flatnonzero(score >= decontaminate.THRESHOLD - 1e-9)}
        assert dict(decontaminate.wand(index, terms)) == want


def test_decontaminate(spark, sf, duck):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {tuple(r) for r in duck.sql("SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)").fetchall()}
    left = decontaminate.without_benchmark(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - len({d for d, _ in got})


def test_decontaminate_variants(spark, odd, empty, monkeypatch):
    item = "What is the tallest mountain of the northern island and who climbed it first? The answer is mount example climbed by nobody."
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "unrelated words about rivers and lakes in the far south of somewhere")], "item_id long, text string")
    filler = " ".join(f"filler{k}" for k in range(300))
    texts = [f"{filler} {item.upper()} {filler}", f"{filler} {item.replace(' ', chr(10))}", f"{filler} {item[:60]}", filler, None, item]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_of(spark, texts), items).collect()}
    assert got == {(0, 1), (1, 1), (5, 1)}
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 80)
    again = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_of(spark, texts), items).collect()}
    assert again == got
    assert decontaminate.contaminated(odd, items).count() == 0 and decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.without_benchmark(odd, items.limit(0)).count() == odd.count()


# ---- byte BPE ----


def test_bpe_pieces(monkeypatch):
    whole = byte_bpe.encoding(BYTE, Q.bpe_pattern())
    monkeypatch.setattr(byte_bpe, "PIECE_CHARS", 20)
    rng = random.Random(10)
    for _ in range(300):
        text = "".join(rng.choices("ab'sé1 \n\t\u00a0.日😀", k=rng.randint(0, 200)))
        assert byte_bpe.encode(text, BYTE, Q.bpe_pattern()) == whole.encode_ordinary(text)


def test_bpe_round_trip(spark, odd, empty):
    assert byte_bpe.round_trip(empty, BYTE, Q.bpe_pattern()).count() == 0
    whole = byte_bpe.encoding(BYTE, Q.bpe_pattern())
    want = collections.Counter()
    for r in odd.collect():
        ids = whole.encode_ordinary(r["text"] or "")
        want[(r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in byte_bpe.round_trip(odd, BYTE, Q.bpe_pattern()).collect()) == want
    ids = byte_bpe.encode_column(odd, BYTE, Q.bpe_pattern())
    raw = {r["id"]: bytes(r["bytes"]).decode() for r in byte_bpe.decode_column(ids, BYTE, Q.bpe_pattern()).collect()}
    assert raw == {r["doc_id"]: r["text"] or "" for r in odd.collect()}


def test_shingle_slices():
    import pyarrow as pa

    texts = ["a b c d e f", None, "", "A b  c", "x"]
    whole = [s for _, _, d, o in arrow_text.slices(pa.array(texts)) for s in arrow_text.shingle_sets(d, o)]
    each = [next(iter(arrow_text.shingle_sets(*arrow_text.buffer_of(pa.array([t], pa.string()))))) for t in texts]
    assert [w.tolist() for w in whole] == [e.tolist() for e in each] and [len(w) for w in whole] == [2, 0, 0, 1, 1]


# ---- pipeline ----


def test_pipeline(spark, sf, duck):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in Q.QUERIES["op4_quality_rules"](spark, sf).where("kept").collect()}
    one = P.written(P.STAGES[0][1](spark, docs, sf), "t")
    assert {r["doc_id"] for r in one.collect()} == kept and one.columns == docs.columns
    two = P.written(P.STAGES[1][1](spark, one, sf), "t")
    texts = [(r["doc_id"], r["text"]) for r in one.collect()]
    forced = jaccard_by_force([t for _, t in texts], [i for i, _ in texts])
    assert {r["doc_id"] for r in two.collect()} == {i for i, _, c, _ in forced if i == c}
    three = P.written(P.STAGES[2][1](spark, two, sf), "t")
    rows = [(r["doc_id"], r["text"].encode()) for r in two.collect()]
    want = dict(zip((i for i, _ in rows), spans_by_force([t for _, t in rows]), strict=True))
    cut = {r["doc_id"]: r for r in three.collect()}
    assert cut.keys() == want.keys() and all(len(cut[i]["text"].encode()) <= n - removed for i, (n, removed, _, _) in want.items())
    assert all(r["n_chars"] == len(r["text"]) for r in cut.values()) and three.columns == docs.columns
    four = P.written(P.STAGES[3][1](spark, three, sf), "t")
    last = P.STAGES[4][1](spark, four, sf)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, P.run(spark, sf).collect()))
    assert {r["doc_id"] for r in four.collect()} == {r["doc_id"] for r in last.collect()}
    assert last.select(F.min("n_tokens")).first()[0] >= 0
