from __future__ import annotations

import pytest

from fieldweave.plans import registry

from .conftest import DATA
from .oracle import compare

#: The smallest table in which the network has edges.
LINKED = f"{DATA}/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    compare(registry.queries()[name](spark, LINKED), registry.oracle_sql()[name], LINKED)


#: Checked by a test of its own (test_inference).
ELSEWHERE = {"louvain"}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - ELSEWHERE))
def test_runs(spark, name):
    assert registry.queries()[name](spark, LINKED).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 15 and max(r["degree"] for r in rows) > 0
