import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lumora.session import session, ship

    made = session(
        "tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    made.sparkContext.setLogLevel("ERROR")
    ship(made)
    yield made
    made.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    made = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        made.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return made


@pytest.fixture(scope="session")
def same():
    """Compares a DataFrame and a DuckDB relation as bags of rows, columns by name."""

    def compare(found, wanted):
        a, b = found.toArrow(), wanted.arrow()
        b = b.read_all() if hasattr(b, "read_all") else b
        columns = sorted(b.column_names)
        assert sorted(a.column_names) == columns
        rows = lambda t: sorted(map(repr, zip(*[t.column(c).to_pylist() for c in columns], strict=True)))
        assert rows(a) == rows(b)

    return compare
