"""Every query runs, and gives the rows of its SQL."""

import duckdb
import pytest

from heatgraph import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(str(r[i]) for i in order) for r in records)


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, sf, sql, name):
    df = catalog.QUERIES[name](spark, sf)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in catalog.ORACLE_SQL:
        want = sql.execute(catalog.ORACLE_SQL[name])
        assert found == rows([c[0] for c in want.description], want.fetchall())
    else:
        assert found[1]


def test_wanted_ids_have_no_cap(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    far = docs.withColumn("doc_id", docs["doc_id"] + 2_000_000)
    docs.unionByName(far).unionByName(far.limit(50)).write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.QUERIES["get_chunks_ordered"](spark, str(tmp_path))
    want = duckdb.sql(catalog.ORACLE_SQL["get_chunks_ordered"].replace("documents", f"'{tmp_path}/documents.parquet/*.parquet'"))
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
