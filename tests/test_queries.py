import pytest
from oracle import assert_same, by_sql

from muster import queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_matches_sql(spark, small, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    want = by_sql(queries.SQL[name], small)
    assert len(got)
    assert_same(got, want)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name, reader, mark", [("soap_workers", "workers", "<wd:Worker>"), ("rest_employees", "employees", '"id":')])
def test_pages_do_not_grow_with_the_table(spark, monkeypatch, name, reader, mark):
    seen, read = [], getattr(queries, reader)
    monkeypatch.setattr(queries, reader, lambda pages: seen.append(pages) or read(pages))
    queries.QUERIES[name](spark, "/root/testdata/sf0.1")
    sizes = [r.body.count(mark) for r in seen[0].select("body").collect()]
    assert sum(sizes) == spark.read.parquet("/root/testdata/sf0.1/customer.parquet").count() and max(sizes) <= 200
