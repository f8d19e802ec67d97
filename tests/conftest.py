import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lexiquarry.session import build_session, findable  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", 4, "4g")
    findable(s)
    return s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")

    def run(sql):
        got = con.execute(sql)
        names = [c[0] for c in got.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted(names), sorted((tuple(r[k] for k in order) for r in got.fetchall()), key=str)

    return run


@pytest.fixture(scope="session")
def same(duck):
    def check(frame, sql):
        names = sorted(frame.columns)
        rows = sorted((tuple(r) for r in frame.select(*(f"`{n}`" for n in names)).collect()), key=str)
        assert (names, rows) == duck(sql)
        return rows

    return check
