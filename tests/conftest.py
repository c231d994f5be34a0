import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from loomline.session import local_session

    session = local_session(4, memory="6g", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _shown(x):
    return "null" if x is None else f"{x:.6g}" if isinstance(x, float) else repr(x)


def same(df, relation) -> None:
    """Equal columns and rows, whatever their order."""
    assert sorted(df.columns) == sorted(relation.columns)
    sort = lambda names, rows: sorted(tuple(_shown(x) for _, x in sorted(zip(names, r))) for r in rows)
    assert sort(df.columns, [tuple(r) for r in df.collect()]) == sort(relation.columns, relation.fetchall())


@pytest.fixture(scope="session")
def equal():
    return same
