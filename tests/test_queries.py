import pytest

from cinesieve.plans import registry
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    assert oracle.spark_rows(registry.QUERIES[name](spark, SF)) == oracle.sql_rows(con, registry.ORACLE_SQL[name])


def test_entry_counts_every_frame(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert sum(r.total_raw_frames for r in rows) == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert all(r.total_raw_frames == r.removed_blurry + r.removed_duplicate + r.final_unique_frames for r in rows)


def test_every_oracle_has_its_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
