"""Every panel query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import difference

from tidemark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_same_rows(spark, sf_dir, name):
    assert difference(spark, catalog.queries()[name], catalog.oracles()[name], sf_dir) == ""


def test_every_oracle_has_a_query():
    assert set(catalog.oracles()) <= set(catalog.queries())
