"""Queries that once covered part of their tables, against plain versions over every row."""

from fractions import Fraction

from tests.conftest import SF
from wavecrate.plans import catalog_queries, event_queries


def test_every_match_is_shown_in_order(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").collect()
    want = sorted((r.p_type.lower(), r.p_partkey) for r in part if "1" in f"{r.p_brand} {r.p_type}".lower())
    assert [(r.p_type.lower(), r.p_partkey) for r in catalog_queries.text_filter_sort(spark, SF).collect()] == want


def test_ranges_cover_every_event(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").collect()
    end = max(r.event_id for r in events) + 1
    got, fed = {r.range_id: (r.n, r["mean"]) for r in event_queries.range_feed(spark, SF).collect()}, set()
    for number, (start, stop) in enumerate(((0, end // 2), (end // 4, end * 3 // 4), (end * 2 // 5, end))):
        rows = [r for r in events if start <= r.event_id < stop]
        fed |= {r.event_id for r in rows}
        values = [Fraction(round(r.value * 100), 100) for r in rows if r.value is not None]
        assert got[number][0] == len(rows) and abs(got[number][1] - float(sum(values) / len(values))) < 1e-9
    assert fed == {r.event_id for r in events}
