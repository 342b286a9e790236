import pytest

import __spark_entry__
from millrace.plans import catalogue

from .conftest import SF, rows


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_match():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.queries()[name](spark, SF).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
