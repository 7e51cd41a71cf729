"""The entry point: every oracle belongs to a query, and rows agree on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from storyloom.plans import script_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def test_keys():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(script_queries.queries()))
def test_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = script_queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(([plain(x) for x in r] for r in df.select(*cols).collect()), key=repr)
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = sorted(([plain(x) for x in r] for r in con.execute(f"select {quoted} from ({script_queries.oracle_sql()[name]})").fetchall()), key=repr)
    assert len(got) == len(want)
    assert [[str(x) for x in r] for r in got] == [[str(x) for x in r] for r in want]
