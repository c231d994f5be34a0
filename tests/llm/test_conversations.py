"""The prefix trie against its SQL and against a plain trie, on odd tables."""

import hashlib
import math
import random
import zlib

import pytest

from loomline.llm import conversation_trie as C
from loomline.llm import queries as Q

SCHEMA = "conv_id long, turn long, role string, text string, path string, n_convs long"


def nodes_by_force(rows, rebuild=True):
    """Nodes of (conv_id, turn, role, text) rows."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, convs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        kids = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(x[: len(q)] == q and len(x) == len(q) + 1 for x in under)]
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)


def shown(nodes):
    return sorted((tuple(r) for r in nodes.collect()), key=str)


def sample(seed, convs, texts, most):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        rows += [(c, k, rng.choice(["user", "assistant", None]), rng.choice(texts)) for k in range(rng.randint(1, most))]
    rng.shuffle(rows)
    return rows


ODD = [
    *sample(1, 60, ["a", "b", None, "", "é😀"], 6),
    *((1000 + c, k, "user", "same") for c in range(40) for k in range(5)),  # many copies
    *((2000 + c % 100, k, "u", "x" * (c % 3)) for c in range(3) for k in (None, None, 3, 3, -1)),  # null, equal and negative turns
    (None, 1, "u", "of no conversation"),
    (-7, 0, "u", "negative"),
    (5000, 0, "u", "long " * 50_000),
    *((5100, k, "u", "deep") for k in range(70)),
    *((5101, k, "u", "deep") for k in range(70)),
    (5200, 1, "1:a", "b"),
    (5300, 1, "1", ":ab"),
]


@pytest.mark.parametrize("chunk", [10_000, 4])
def test_trie_of_odd_tables(spark, monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    monkeypatch.setattr(C, "SMALL", 20_000 if chunk > 4 else 1)
    got = C.trie(C.rebuilt(C.sequences(table_of(spark, ODD))))
    assert [f.simpleString() for f in got.schema][:3] == ["conv_id:bigint", "depth:bigint", "parent_conv_id:bigint"]
    assert shown(got) == nodes_by_force(ODD)


def test_trie_as_it_is(spark, monkeypatch):
    """Without the rebuilding step, on repeated rows, and of no conversations at all."""
    rows = sample(2, 150, ["a", "b", "c"], 5)
    rows += rows[:50]
    assert shown(C.trie(C.sequences(table_of(spark, rows)))) == nodes_by_force(rows, False)
    assert C.trie(C.rebuilt(C.sequences(table_of(spark, [])))).count() == 0
    turnless = [(0, 0, "u", "x"), (1, 0, "u", "y")] + [(c, 0, "u", "z") for c in range(201, 209)]
    got = shown(C.trie(C.rebuilt(C.sequences(table_of(spark, turnless)))))
    assert got == nodes_by_force(turnless) and any(r[1] == 0 and r[7] != C.NO_ENDS for r in got)


def test_many_copies_are_packed(spark, monkeypatch):
    monkeypatch.setattr(C, "PACK", 7)
    rows = [(c, k, "u", "t" * k) for c in range(100) for k in range(3)]
    assert shown(C.trie(C.sequences(table_of(spark, rows)))) == nodes_by_force(rows, False)


def test_trie_against_sql_on_odd_rows(spark, duck, equal):
    import pandas as pd

    rows = [r for r in ODD if r[0] not in (5100, 5101)]
    c = duck.cursor()
    c.register("odd_rows", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    c.execute("CREATE OR REPLACE TEMP VIEW conversations AS SELECT * FROM odd_rows")
    equal(C.trie(C.rebuilt(C.sequences(table_of(spark, rows)))), c.sql(C.ORACLE))


def test_op11_query(spark, sf):
    rows = [tuple(r) for r in Q.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert shown(Q.op11_conversation_trie(spark, sf)) == nodes_by_force(rows)
