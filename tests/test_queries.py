import duckdb
import pytest

from quoin.plans import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DIR)
    r = con.execute(queries.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(repr([_plain(row[names.index(c)]) for c in got.columns]) for row in r.fetchall())
    assert sorted(repr([_plain(v) for v in row]) for row in got.collect()) == want


def test_empty_query_set_gives_no_neighbours(spark):
    from quoin.operators.retrieval import knn

    e = spark.read.parquet(f"{DIR}/embeddings.parquet")
    assert knn(e.where("false"), e, 3).count() == 0
