import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tilewright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", "4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def grid_of(spark):
    """A list of rows (None is nodata) to a cell table."""

    def build(rows, tile="t", name="v"):
        data = [(tile, r, c, None if v is None else float(v)) for r, row in enumerate(rows) for c, v in enumerate(row)]
        return spark.createDataFrame(data, f"tile_id string, row_no int, col_no int, {name} double")

    return build


@pytest.fixture()
def array_of():
    """A cell table back to a dictionary of (row, column)."""

    def build(df, name="v"):
        return {(r["row_no"], r["col_no"]): r[name] for r in df.collect()}

    return build
