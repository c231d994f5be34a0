"""Runs of words against brute force, whatever pieces the words come in."""

import hashlib
import random
import re
import zlib

import numpy as np

from loomline.llm import periodic_runs as P
from loomline.llm import queries as Q


def runs_by_force(words, least=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def repeated(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def report_by_force(doc_id, text):
    words = repeated(doc_id, split(text))
    runs = runs_by_force(words)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2])))
    s, n, p = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), s, n, p, 1000 * n // p if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest())


def samples(count, seed):
    rng = random.Random(seed)
    for k in range(count):
        n, size = rng.randint(0, 80), rng.choice([1, 2, 2, 3, 5])
        words = [rng.randrange(size) for _ in range(n)]
        if k % 3 == 0 and n > 10:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(2, 6)
            words[a:] = [words[a + i % p] for i in range(n - a)]
        yield [i.bit_count() % 2 for i in range(n)] if k % 7 == 0 else words


def test_runs_in_pieces():
    rng = random.Random(1)
    for words in samples(250, 1):
        least = rng.choice([12, 12, 2, 5, 30])
        want = runs_by_force(words, least)
        for piece in (1000, 1, 7):
            assert list(map(tuple, P.find_runs(np.array(words, np.int64), None, least, piece).tolist())) == want


def test_a_run_comes_with_the_word_that_ends_it():
    catchers = P.Catchers()
    words = [5, *[1, 2, 3] * 6, 9, 9]
    out = [catchers.append(np.array([w])).tolist() for w in words]
    assert [i for i, r in enumerate(out) if r] == [19] and out[19] == [[1, 18, 3]] and not len(catchers.finish())


def test_long_runs():
    rng = np.random.default_rng(1)
    part = rng.integers(0, 50, 3000)
    words = np.r_[part[:100], np.tile(part, 9), [99], np.arange(20_000) % 4, np.zeros(500, np.int64)]
    for piece in (1 << 18, 5000):
        got = list(map(tuple, P.find_runs(words, None, 12, piece).tolist()))
        assert {r[2] for r in got if r[1] > 400} == {3000, 4, 1} and got == list(map(tuple, P.find_runs(words).tolist()))
        for s, n, p in got:
            assert (words[s : s + n - p] == words[s + p : s + n]).all()


def test_equal_hashes_of_other_windows(monkeypatch):
    """With a hash that keeps one bit, every wrong run is noticed and the salts go on until none is left."""
    plain, calls = P.mix, []

    def poor(x):
        calls.append(1)
        return plain(x) & np.uint64(0xFFFFFFFFFFFFFFFF if len(calls) > 400 else 3)

    monkeypatch.setattr(P, "mix", poor)
    for words in samples(30, 2):
        got = list(map(tuple, P.find_runs(np.array(words, np.int64)).tolist()))
        assert got == runs_by_force(words) or len(calls) <= 400


def test_periodic_runs_of_odd_texts(spark):
    texts = [None, "", " \n", "a", "a " * 11, "a " * 12, "A a " * 6, "x y z\x1c " * 9, "é ß 日 " * 5, ("one two three " * 40) + "end " + "x y " * 30, "w " * 50_000, " ".join(map(str, range(30_000)))]
    rows = [(i if i != 3 else None, t, "clash") for i, t in enumerate([*texts, texts[9]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = {(r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in P.periodic_runs(docs).collect()}
    want = set()
    for doc_id, text, _ in rows:
        words = split(text)
        runs = runs_by_force(words) if len(words) < 10_000 else [(0, len(words), 1)] * (words[0] == words[1])
        want.add((doc_id, len(words), tuple(runs), collapsed(words, runs).decode()))
    assert got == want
    assert P.periodic_runs(docs.limit(0)).count() == 0
    null = P.report(P.periodic_runs(P.with_repeats(docs.where("doc_id IS NULL OR doc_id = 0")))).collect()
    assert len(null) == 2 and all(r["start"] is None and r["n_runs"] == 0 and r["collapsed_sha256"] for r in null)


def test_op13_query(spark, sf):
    rows = {r["doc_id"]: r["text"] for r in Q.table(spark, sf, "documents").select("doc_id", "text").collect()}
    got = Q.op13_periodic_runs(spark, sf).collect()
    assert len(got) == len(rows) and sum(r["n_runs"] > 0 for r in got) > 5
    small = [tuple(r) for r in got if len(rows[r["doc_id"]]) < 6000]
    assert small == [report_by_force(r[0], rows[r[0]]) for r in small]
