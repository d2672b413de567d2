"""Every query of the driver entry runs, and agrees with its SQL where it has one, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings fasta fai fastq gff bed bedpe raw_records benchmark lang_samples".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, list):
        return "[" + ",".join(map(norm, v)) + "]"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(map(norm, r)) for r in zip(*(table.column(n).to_pylist() for n in names)))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    got = rows(entry.queries()[name](spark, DATA).toArrow())
    sql = entry.oracle_sql().get(name)
    if sql:
        assert got == rows(db.sql(sql).to_arrow_table())
