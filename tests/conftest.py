import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from fieldlead.session import local_session

    session = local_session("tests", 4, 4, "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as a sorted list of tuples."""

    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return collect


@pytest.fixture(scope="session")
def compare(spark):
    """Run a query and its SQL twin on the smallest tables; both as sorted rows."""
    import glob
    import math
    import os

    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
        return float(v) if hasattr(v, "quantize") else v

    def run(query, sql):
        df = query(spark, folder)
        names = sorted(df.columns)
        left = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
        rel = con.sql(sql)
        assert sorted(rel.columns) == names
        at = [rel.columns.index(c) for c in names]
        right = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
        return left, right

    return run
