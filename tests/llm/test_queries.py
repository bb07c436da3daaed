"""The queries of the training-data operators against their SQL."""

import pytest

from palinode.llm.sql import oracle_sql
from tests.test_entry import DATA, agrees


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_against_sql(spark, name):
    assert agrees(spark, name)
