import glob
import os

import pytest

from tessella.session import build_session

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """A value as text that Spark and DuckDB agree on."""
    if value is None or str(value) in ("nan", "NaT", "<NA>"):
        return "null"
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return str(value)


@pytest.fixture(scope="session")
def same():
    """Compares two pandas frames as bags of rows, columns by name."""

    def check(left, right):
        columns = sorted(left.columns)
        assert columns == sorted(right.columns)
        a, b = ([tuple(map(plain, row)) for row in f[columns].astype(object).itertuples(index=False)] for f in (left, right))
        assert sorted(a) == sorted(b)

    return check
