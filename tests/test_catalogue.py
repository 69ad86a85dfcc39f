"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import pandas as pd
import pytest

from tessella.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    rows = [tuple(None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in frame.to_numpy(dtype=object).tolist()]
    return sorted(rows, key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    out = catalogue.QUERIES[name](spark, DATA)
    got = out.toPandas()
    if name not in catalogue.ORACLES:
        assert len(got) > 0 or name in ("segment_logprob_min", "fragment_shuffle")
        return
    wanted = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    left, right = plain(got), plain(wanted)
    assert len(left) == len(right)
    for a, b in zip(left, right, strict=True):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(x, float) for x in a) else all(
            x == (pytest.approx(y, abs=2e-6) if isinstance(y, float) else y) for x, y in zip(a, b, strict=True)
        )
