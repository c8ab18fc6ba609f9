"""Every query of the library equals its SQL on the smallest data."""

from __future__ import annotations

import os

import pytest

import oracle_check
from lattica import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name, monkeypatch):
    monkeypatch.setattr(oracle_check.entry, "queries", catalog.queries)
    monkeypatch.setattr(oracle_check.entry, "oracle_sql", catalog.oracle_sql)
    assert oracle_check.compare(spark, SF, name) == ""


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()
