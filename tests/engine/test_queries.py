"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import pytest

from tarnlake.plans import catalog, catalog_tables  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    import duckdb

    df = catalog.QUERIES[name](spark, SF)
    got = sorted((tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    out = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted((tuple(norm(r[i]) for i in order) for r in out.fetchall()), key=repr)
    assert got == want
