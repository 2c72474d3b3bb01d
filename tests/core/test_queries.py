"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from docmill.plans import queries as core

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query(spark, db, tmp_path, name):
    core.QUERIES[name](spark, DATA).write.parquet(str(tmp_path / "o"))
    got = db.execute(f"SELECT * FROM '{tmp_path}/o/*.parquet'")
    columns = sorted(x[0] for x in got.description)
    if name in core.SQL:
        db.execute(f"CREATE OR REPLACE TEMP TABLE o AS {core.SQL[name]}")
        listed = ", ".join(f'"{c}"' for c in columns)
        assert sorted(x[0] for x in db.execute("SELECT * FROM o").description) == columns
        here, there = f"SELECT {listed} FROM '{tmp_path}/o/*.parquet'", f"SELECT {listed} FROM o"
        assert db.execute(f"({here}) EXCEPT ALL ({there})").fetchall() == []
        assert db.execute(f"({there}) EXCEPT ALL ({here})").fetchall() == []
