"""Every registered query of the core library against its oracle; those without one must run and have rows."""

import pytest

from corpusloom import catalog
from tests.compare import oracle, spark_rows

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, name):
    got = spark_rows(catalog.queries()[name](spark, sf))
    if name in SQL:
        assert got == oracle(SQL[name], sf)
    else:
        assert got[1]
