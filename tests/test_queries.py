"""Every registered query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from phrasemine.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, float):
        return "None" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_agrees(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([shown(v) for v in r] for r in df.select(*cols).collect())
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == cols
    assert got == sorted([shown(v) for v in r] for r in want.select(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_entry_and_names():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_csv_export_beyond_its_limit(spark, tmp_path):
    """Which rows are the first shows only where there are more than the limit."""
    spark.range(200_500).selectExpr("id as p_partkey", "concat('n ', id) as p_name", "'Brand#11' as p_brand", "'T' as p_type", "1 as p_size", "1.0D as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["s12_csv_export"](spark, str(tmp_path)).collect())
    want = con.sql(ORACLE["s12_csv_export"]).fetchall()
    assert len(want) == 100_000 and got == sorted(want)
