from __future__ import annotations

import pytest

from fieldweave.llm import queries

from ..conftest import DATA
from ..oracle import compare

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    compare(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)
