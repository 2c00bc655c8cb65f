"""The corpus queries that SQL can express, against that SQL."""

from __future__ import annotations

import pytest

from gridloom.llm import queries as llm

from ..sqlcheck import connect, same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    same_rows(llm.queries()[name](spark, SF), connect(SF).sql(llm.oracle_sql()[name]))
