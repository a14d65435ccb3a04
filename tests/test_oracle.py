from __future__ import annotations

import pytest

from codelode.plans import registry
from tests.oracle import DATA, compare

QUERIES = {n: q for m in registry.MODULES for n, q in m.QUERIES.items()}
ORACLE = {n: q for m in registry.MODULES for n, q in m.ORACLE.items()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, name):
    compare(spark, QUERIES[name], ORACLE[name])


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
