import duckdb
import pytest

import __spark_entry__ as entry_module
from slatework import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(rows):
    return sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "p_partkey" in df.columns


def test_every_query_has_sql_or_is_known_without():
    assert set(core.QUERIES) == set(core.ORACLE_SQL)
    assert set(core.QUERIES) <= set(entry_module.queries())


@pytest.mark.parametrize("name", list(core.ORACLE_SQL))
def test_against_duckdb(spark, con, sf, name):
    df = core.QUERIES[name](spark, sf)
    want = con.sql(core.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert norm(df.select(*sorted(df.columns)).collect() if len(set(df.columns)) == len(df.columns) else df.collect()) == norm(con.sql(f"SELECT {', '.join(sorted(want.columns))} FROM ({core.ORACLE_SQL[name]})").fetchall())


@pytest.fixture(scope="module")
def larger_part(con, tmp_path_factory):
    """A folder with part repeated to 12,600 rows, a few of them without brand or size."""
    folder = tmp_path_factory.mktemp("larger")
    some = "CASE WHEN (p_partkey + k) % {} <> 0 THEN {} END AS {}"
    columns = f"p_partkey + k * 1000000 AS p_partkey, {some.format(7, 'p_brand', 'p_brand')}, {some.format(11, 'p_size', 'p_size')}"
    con.execute(f"COPY (SELECT {columns} FROM part, range(CAST(ceil(12600 / (SELECT count(*) FROM part)) AS BIGINT)) r(k)) TO '{folder}/part.parquet' (FORMAT parquet)")
    return str(folder)


def against_part(spark, folder, name):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
        assert sorted(map(tuple, core.QUERIES[name](spark, folder).collect())) == sorted(con.execute(core.ORACLE_SQL[name]).fetchall())


def test_brand_histogram_of_a_larger_table(spark, larger_part):
    against_part(spark, larger_part, "stat_histogram_p_brand")


def test_size_histogram_of_a_larger_table(spark, larger_part):
    against_part(spark, larger_part, "stat_histogram_p_size")
