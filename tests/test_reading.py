"""Reading order, anchors and accounts by example and by force."""

import random

from pyspark.sql import functions as F

from loomline.operators import accounts as A
from loomline.operators import ordering as O


def test_rows_grow_over_band_edges(spark):
    items = [("p", 1, 50.0, 11.9), ("p", 2, 10.0, 12.1), ("p", 3, 30.0, 20.0), ("p", 4, 5.0, 45.0), ("p", 5, None, 3.0), ("q", 6, 1.0, 1.0), ("q", 7, 0.0, 1.0), ("q", 8, 1.0, 1.0)]
    rows = spark.createDataFrame(items, "page string, id long, x double, y double").repartition(3)
    down = {r["id"]: (r["row"], r["place"]) for r in O.reading_order(rows, ["page"], "x", "y", 12, ["id"]).collect()}
    assert down == {2: (1, 1), 3: (1, 2), 1: (1, 3), 4: (2, 4), 7: (1, 1), 6: (1, 2), 8: (1, 3)}
    up = {r["id"]: (r["row"], r["place"]) for r in O.reading_order(rows, ["page"], "x", "y", 12, ["id"], upwards=True).collect()}
    assert up == {4: (1, 1), 1: (2, 2), 3: (2, 3), 2: (2, 4), 6: (1, 1), 8: (1, 2), 7: (1, 3)}
    assert O.reading_order(rows.limit(0), ["page"], "x", "y", 12, ["id"]).count() == 0


def test_anchor(spark):
    items = [(k, x, y) for k, (x, y) in enumerate([(10, 10), (9, 10), (8.9, 10), (500, 22), (8, 22), (0, 22.1), (11, 10), (11.1, 10), (500, -2), (500, -2.1)])]
    rows = spark.createDataFrame([(k, float(x), float(y)) for k, x, y in items], "id long, x double, y double")
    kept = lambda **how: {r["id"] for r in rows.where(O.from_anchor(F.col("x"), F.col("y"), F.lit(10.0), F.lit(10.0), 12, **how)).collect()}
    assert kept() == {0, 1, 3, 5, 6, 7, 8}
    assert kept(upwards=True) == {0, 1, 2, 4, 6, 9} and kept(upwards=True, included=False) == {2, 4, 9}


def test_accounts(spark):
    rng = random.Random(1)
    rows = [(i, f"c{i}", f"c{i + 1}", None) for i in range(40)]  # a chain through two kinds that never meets
    rows += [(100 + i, f"k{i // 2}", None, f"m{(i + 1) // 2}") for i in range(61)]  # a chain
    rows += [(300 + i, rng.choice(["hot", "", "Unknown", None]), rng.choice([None, f"p{rng.randrange(30)}"]), " ") for i in range(120)]
    rows += [(None, "hot", None, None), (500, None, None, None), (300, "hot", "p1", None)]
    df = spark.createDataFrame(rows, "record long, cookie string, page string, login string").repartition(3)
    kinds = ["cookie", "page", "login"]
    own = {}
    for r, *ids in rows:
        if r is not None:
            own.setdefault(r, set()).update((k, v.strip()) for k, v in zip(kinds, ids, strict=True) if v and v.strip() and v.strip().lower() != "unknown")
    root = {r: r for r in own}
    changed = True
    while changed:
        changed = False
        by = {}
        for r, ids in own.items():
            for i in ids:
                by[i] = min(by.get(i, r), root[r])
        for r, ids in own.items():
            least = min([root[r], *(by[i] for i in ids)])
            changed |= least < root[r]
            root[r] = least
    got = A.account_groups(df, "record", kinds).collect()
    assert {(r["record"], r["account"]) for r in got} == set(root.items()) and len(got) == len(root)
    known = A.known_accounts(df, "record", kinds).collect()
    assert {tuple(r) for r in known} == {(root[r], *i) for r, ids in own.items() for i in ids} and len(known) == len(set(map(tuple, known)))
    assert root[160] == 100 and A.account_groups(df.limit(0), "record", kinds).count() == 0
