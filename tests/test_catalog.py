import datetime
import math
from pathlib import Path

import duckdb
import pytest

from tagwright.plans import catalog
from tests.conftest import SMALL


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.4f}"
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{v:.4f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    df = catalog.queries()[name](spark, SMALL)
    got = table_of(df.columns, df.collect())
    cur = duck.execute(catalog.oracle_sql()[name])
    want = table_of([c[0] for c in cur.description], cur.fetchall())
    assert got == want
    assert got[1] or name in ("set_difference", "orphans", "known_flag")
