"""Queries of the engine against their SQL twins on the smallest tables."""

import pandas as pd
import pytest

from setloom.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = list(registry.oracle_sql())


def rows(frame):
    columns = sorted(frame.columns)
    out = []
    for r in frame[columns].astype(object).itertuples(index=False, name=None):
        out.append(tuple(None if x is None or (pd.api.types.is_scalar(x) and pd.isna(x)) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) if not isinstance(x, bool) else x for x in r))
    return columns, sorted(out, key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_twin(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
