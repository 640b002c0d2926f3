import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from raysheaf.session import make_session

    session = make_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__showConsoleProgress="false"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def same_rows(a, b):
    """Whether two pandas frames hold the same rows in any order, columns by name."""
    import pandas as pd

    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    show = lambda v: "" if pd.isna(v) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    rows = lambda x: sorted(tuple(show(v.item() if hasattr(v, "item") else v) for v in r) for r in x[columns].itertuples(index=False))
    return rows(a) == rows(b)
