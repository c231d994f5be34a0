"""SimHash fingerprints, the pigeonring filter and the components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from loomline.llm import queries as Q
from loomline.llm import simhash_dedup as S


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_force(prints, ids):
    root = list(range(len(prints)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(prints)):
        own = ids[i]
        held = least.get(top(i))
        least[top(i)] = own if held is None else held if own is None else min(own, held)
    return [least[top(i)] for i in range(len(prints))]


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, "clash") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fp int, root string").repartition(3)


def test_majority():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 64, 200_000, np.uint64, endpoint=False)
    sizes = [0, 1, 2, 3, 70_000, 0, 129_000, 10]
    bounds = np.r_[0, np.cumsum(sizes)]
    for i, got in enumerate(S.majority(hashes, bounds).tolist()):
        bits = np.unpackbits(hashes[bounds[i] : bounds[i + 1]].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        assert got == int("".join("1" if 2 * b > sizes[i] else "0" for b in bits), 2)


def test_every_close_pair_has_a_fitting_chain():
    """Every difference of up to two bits fits from some start whose exact segments agree; no other one fits."""
    bits = [0] + [1 << a | 1 << b for a in range(64) for b in range(64)]
    for x in bits:
        starts = [s for s in range(S.SEGMENTS) if len(S.chains_fit(np.array([x], np.uint64), np.array([s])))]
        assert starts
        for s in starts:
            turned = (x << s * S.WIDTH | x >> 64 - s * S.WIDTH) & (1 << 64) - 1 if s else x
            assert turned >> 64 - S.WIDTH * S.EXACT == 0
    rng = random.Random(2)
    for _ in range(300):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(3, 8)))
        assert not any(len(S.chains_fit(np.array([x], np.uint64), np.array([s]))) for s in range(S.SEGMENTS))


@pytest.mark.parametrize("most", [S.MOST_IN_KEY, 2, 0])
def test_links_of_fingerprints(spark, most):
    """Close fingerprints in chains and clusters, whatever is compared pair by pair."""
    rng = random.Random(3)
    prints = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 40)):
            prints.append(x)
            for _ in range(rng.choice([1, 2, 2, 3])):
                x ^= 1 << rng.randrange(64)
    prints += [0, (1 << 64) - 1, 1 << 63, 1 << 63 | 1]
    prints = sorted(set(prints))
    signed = [x - (1 << 64) * (x >> 63) for x in prints]
    found = S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), most).collect()
    place = {x: i for i, x in enumerate(signed)}
    a, b = (np.array([place[r[k]] for r in found], np.int64) for k in (0, 1))
    assert S._roots(len(prints), a, b).tolist() == components_by_force(prints, list(range(len(prints))))
    assert len(found) <= len(prints) * 65 and (most == 0 or all(x != y for x, y in zip(a, b, strict=True)))


def test_simhash_of_odd_texts(spark):
    rng = random.Random(4)
    base = [rng.choice("the of and in to Word bé ßx".split()) + str(rng.randint(0, 99)) for _ in range(400)]
    texts = [None, "", " \n\t", "a", "A", "a b", "a\tB", "a b c", "x" * 5000, "a b c\x1cd", "日本 語 です", " ".join(base), " ".join(base).upper()]
    for _ in range(12):
        own = list(base)
        own[rng.randrange(400)] = "changed"
        texts.append("\n".join(own))
    texts += [("w%d " * 90_000) % tuple(range(90_000)), "same words again " * 30_000]
    ids = [None if i in (3, 20) else 1000 - i for i in range(len(texts))]
    prints = [fingerprint(t) for t in texts]
    got = sorted(map(tuple, S.report(S.near_duplicates(docs_of(spark, texts, ids))).collect()), key=str)
    want = sorted(zip(ids, [f"{p:016x}" for p in prints], components_by_force(prints, ids), strict=True), key=str)
    assert got == want
    assert S.near_duplicates(docs_of(spark, [])).count() == 0


def test_op12_query(spark, sf):
    rows = Q.table(spark, sf, "documents").select("doc_id", "text").collect()
    prints = [fingerprint(r["text"]) for r in rows]
    ids = [r["doc_id"] for r in rows]
    want = sorted(zip(ids, [f"{p:016x}" for p in prints], components_by_force(prints, ids), strict=True))
    assert sorted(map(tuple, Q.op12_simhash_dedup(spark, sf).collect())) == want
