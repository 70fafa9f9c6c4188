"""Every query of the engine against the SQL that states its result."""

import pytest

from tests.conftest import SMALL, same_rows
from vahi.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, duck):
    same_rows(catalogue.QUERIES[name](spark, SMALL), duck, catalogue.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "client_id"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
