"""Benchmark decontamination against brute force, over several parts of the index, and on altered copies."""

import collections
import math
import random
import re

import numpy as np
import pytest

from loomline.llm import decontaminate as D


def _words(text):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def _grams(ws, n):
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def by_force(docs, items):
    """Scores of all passages for all items, straight from the definitions."""
    own = {i: _words(t) for i, t in items if t and _words(t)}
    df = collections.Counter(w for ws in own.values() for w in set(ws))
    mean, most = sum(map(len, own.values())) / len(own), max(map(len, own.values()))
    text = dict(items)

    def score(i, present):
        tf = collections.Counter(own[i])
        return sum(math.log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5)) * c * (D.K1 + 1) / (c + D.K1 * (1 - D.B + D.B * len(own[i]) / mean)) for w, c in tf.items() if w in present)

    out = {}
    for d, t in docs:
        ws = _words(t or "")
        starts = range(0, max(1, -(-len(ws) // most) - 1) * most if ws else 0, most)
        for p in (ws[s : s + 2 * most] for s in starts):
            for i in own:
                share = score(i, set(p)) / score(i, set(own[i]))
                parts = []
                for side, least in zip(D.split_item(text[i]), D.LEAST_GRAM, strict=True):
                    sw = _words(side)
                    n = min(D.GRAM, max(least, len(sw) // 4), len(sw))
                    wanted = _grams(sw, n) if n else set()
                    parts.append(len(wanted & _grams(p, n)) / len(wanted) if wanted else 1.0)
                if share >= D.THRESHOLD and parts[0] >= D.QUESTION and parts[1] >= D.ANSWER:
                    old = out.get((d, i), (0.0, 0.0, 0.0, 0))
                    out[d, i] = (max(old[0], share), max(old[1], parts[0]), max(old[2], parts[1]), old[3] + 1)
    return out


@pytest.fixture(scope="module")
def made():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(400)]
    sentence = lambda n: " ".join(rng.choices(vocabulary, k=n)).capitalize() + "."
    items = [(k, sentence(rng.randint(8, 25)) + rng.choice([" ", "\n"]) + sentence(rng.randint(1, 12))) for k in range(30)] + [(30, sentence(18)), (31, None), (32, "..."), (33, "x")]
    docs = []
    for k in range(120):
        parts = [sentence(rng.randint(5, 60)) for _ in range(rng.randint(0, 5))]
        if k % 2:
            ws = items[rng.randrange(31)][1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 3, len(ws)])):
                ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
            parts.insert(rng.randint(0, len(parts)), rng.choice([str.upper, str])(" ".join(ws)))
        docs.append((k, " ".join(parts)))
    return [*docs, (120, None), (121, ""), (122, " ".join(t for _, t in docs))], items


@pytest.mark.parametrize("part_bytes", [16 << 20, 300])
def test_every_column_against_brute_force(spark, monkeypatch, made, part_bytes):
    docs, items = made
    monkeypatch.setattr(D, "INDEX_BYTES", part_bytes)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert (len(D.write_index(benchmark)) > 5) == (part_bytes == 300)
    rows = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), benchmark).collect()
    got = {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in rows}
    want = by_force(docs, items)
    assert len(rows) == len(got) and got.keys() == want.keys() and len(want) > 20
    for k, x in want.items():
        assert got[k] == (pytest.approx(x[0], abs=1e-8), pytest.approx(x[1]), pytest.approx(x[2]), x[3])


def test_recall_of_altered_copies(spark, sf):
    """One word in each item is another one: at least nine of ten are found."""
    rng = random.Random(13)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = []
    for i, text in items:
        ws = text.split(" ")
        ws[rng.randrange(len(ws))] = "altered"
        docs.append((i, " ".join(f"filler{k % 97}" for k in range(200)) + " " + " ".join(ws)))
    found = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).where("doc_id = item_id").count()
    assert found >= 0.9 * len(items)


def test_text_ids_and_extra_columns(spark):
    text = "one two three four five six seven. eight nine ten eleven."
    items = spark.createDataFrame([("a", text, 1), (None, "alpha beta gamma delta epsilon zeta. eta theta iota.", 2), ("a", text, 3)], "item_id string, text string, score int")
    docs = spark.createDataFrame([(1, "x " + text, 5, "p"), (2, "alpha beta gamma delta epsilon zeta. eta theta iota.", 6, "q"), (3, None, 7, None)], "doc_id long, text string, item_id int, u string")
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, items).collect()}
    assert got == {(1, "a"), (2, None)}
    left = D.without_benchmark(docs, items)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(3, None, 7, None)]


@pytest.mark.parametrize("part_bytes", [16 << 20, 200])
def test_items_of_common_words_alone(spark, monkeypatch, part_bytes):
    """Items all of whose words are in many items are found like others, and do not send every passage to the full search."""
    rng = random.Random(14)
    few = ["the", "of", "and", "to", "in", "is", "that", "it"]
    rare = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    items = [(k, " ".join(rng.choices(few, k=12)) + ". " + " ".join(rng.choices(few, k=4))) for k in range(25)]
    items += [(100 + k, " ".join(rng.choices(few + rare, k=14)) + ". " + " ".join(rng.choices(rare, k=3))) for k in range(60)]
    docs = [(k, " ".join(rng.choices(rare, k=60) + ([items[k % 85][1]] if k % 4 == 0 else []) + rng.choices(rare + few[:1], k=40))) for k in range(160)]
    monkeypatch.setattr(D, "INDEX_BYTES", part_bytes)
    searched = []
    monkeypatch.setattr(D, "wand", lambda index, terms, plain=D.wand: searched.append(1) or plain(index, terms))
    index = D.build(items)
    assert (index.item_rest < D.THRESHOLD).all()
    data = [t.encode() for _, t in docs]
    hits = D.matches(index, np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    want = by_force(docs, items)
    assert {(docs[r][0], items[i][0]) for r, i in hits} == want.keys() and len(want) >= 40
    passages = sum(max(1, -(-len(_words(t)) // index.most) - 1) for _, t in docs)
    assert len(searched) < passages / 3
    rows = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["score"], 6) for r in rows} == {k: round(x[0], 6) for k, x in want.items()}


def test_parts_that_are_kept(spark, monkeypatch):
    items = spark.createDataFrame([(k, f"item number {k} has words{k} of its own{k}. and an answer{k}.") for k in range(40)], "item_id long, text string")
    monkeypatch.setattr(D, "INDEX_BYTES", 300)
    paths = D.write_index(items)
    assert len(paths) > 4
    one = D.load(paths[0])
    size = D._held[paths[0]][1]
    monkeypatch.setattr(D, "HELD_BYTES", 3 * size)
    for path in paths:
        D.load(path)
        assert sum(n for _, n in D._held.values()) <= 3 * size or len(D._held) == 1
    monkeypatch.setattr(D, "HELD_BYTES", 0)
    again = D.load(paths[0])
    assert list(D._held) == [paths[0]] and (again.vocabulary == one.vocabulary).all()
