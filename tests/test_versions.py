"""Several writers of one table: nothing is lost, conflicts are refused, readers see whole versions."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from storyloom.sources.versions import Conflict, Versions

SCHEMA = "book_id long, id long, status string, n long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    return Versions(spark, f"file://{tmp_path}/t", ("book_id", "id"), SCHEMA)


def some(spark, *found):
    return spark.createDataFrame(found, SCHEMA)


def test_versions(spark, table):
    assert table.version() == 0 and rows(table.read()) == []
    assert table.commit(some(spark, (1, 0, "pending", 0), (None, 1, "pending", 0)), 0) == 1
    assert table.commit(some(spark, (1, 0, "done", 1)), 1) == 2
    assert rows(table.read(1)) == [(1, 0, "pending", 0), (None, 1, "pending", 0)]
    assert rows(table.read()) == [(1, 0, "done", 1), (None, 1, "pending", 0)]
    # Made from version 1, whose row 0 changed since; null keys are keys.
    with pytest.raises(Conflict):
        table.commit(some(spark, (1, 0, "error", 5)), 1)
    assert table.commit(some(spark, (None, 1, "done", 2)), 1) == 3
    with pytest.raises(Conflict):
        table.commit(some(spark, (None, 1, "done", 3)), 2)
    before = rows(table.read())
    assert table.merge() == 4 and rows(table.read()) == before and len(table.log()) == 1
    assert table.commit(some(spark, (7, 7, "new", 0)), 3) == 5
    with pytest.raises(Conflict, match="merged away"):
        table.commit(some(spark, (8, 8, "new", 0)), 1)
    assert rows(table.read()) == sorted([*before, (7, 7, "new", 0)], key=repr)


def test_one_of_two_writers_creates_a_version(table):
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda i: table._create(1, {"number": 1, "table": f"t{i}", "merged": False}), range(16)))
    assert sum(made) == 1


def test_two_sessions_lose_nothing(spark, table):
    table.commit(some(spark, (1, 0, "s", 0), (1, 1, "s", 0)), 0)

    def work(who):
        own = Versions(spark.newSession(), table.path, table.keys, table.schema)
        for _ in range(3):
            own.change(lambda now: now.filter("id = 0").withColumn("n", F.col("n") + 1))
            own.change(lambda now: own.spark.createDataFrame([(2, who, "mine", 1)], SCHEMA))
        own.merge()

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(work, (10, 11)))
    assert rows(table.read()) == [(1, 0, "s", 6), (1, 1, "s", 0), (2, 10, "mine", 1), (2, 11, "mine", 1)]
