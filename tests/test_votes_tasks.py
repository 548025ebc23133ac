"""Tasks of the votes stay as large however many lines there are."""

from tests.conftest import SF
from wavecrate.plans import catalog_queries as Q


def test_tasks_grow_with_the_lines(spark, monkeypatch):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    whole = sorted(map(tuple, Q.style_votes(spark, SF).collect()))
    monkeypatch.setattr(Q, "LINES_A_TASK", 1_000)
    votes = Q.style_votes(spark, SF)
    assert votes.rdd.getNumPartitions() == -(-lines // 1_000)
    assert sorted(map(tuple, votes.collect())) == whole
