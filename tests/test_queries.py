import os

import duckdb
import pytest

import __spark_entry__ as entry_point

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return connection


def spark_type(field):
    names = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}
    return names[field.dataType.simpleString()]


@pytest.mark.parametrize("name", entry_point.queries())
def test_query(spark, duck, name):
    df = entry_point.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert got
    if name in entry_point.oracle_sql():
        relation = duck.sql(entry_point.oracle_sql()[name])
        types = dict(zip(relation.columns, map(str, relation.types)))
        assert types == {f.name: spark_type(f) for f in df.schema}
        expected = sorted(relation.project(", ".join(columns)).fetchall(), key=repr)
        assert len(got) == len(expected)
        assert got == expected


def test_every_query_of_lines_has_sql():
    names = {query.__name__ for query in entry_point._QUERIES}
    assert names <= set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert sorted(df.columns) == ["num", "position", "text"] and df.count() == 200
