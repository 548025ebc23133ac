"""Every registered query of the library against its DuckDB SQL, or for rows, at the smallest scale."""

from collections import Counter

import pandas as pd
import pytest

from tests.conftest import SF
from wavecrate import registry


def canon(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(map(canon, value))
    return None if value is None or value is pd.NA or value is pd.NaT or value != value else value


def bag(frame, columns):
    return Counter(tuple(map(canon, row)) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    result = registry.queries()[name](spark, SF)
    rows = result.toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(rows)
    else:
        want = duck.sql(sql).df()
        assert sorted(want.columns) == sorted(rows.columns)
        assert bag(rows, list(rows.columns)) == bag(want, list(rows.columns))


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert registry.FLAGSHIP in entry.queries()
