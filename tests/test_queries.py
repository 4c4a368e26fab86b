"""Every registered query of the mirror against its SQL."""

from __future__ import annotations

import pytest
from compare import connect, same_rows

from tablemirror.plans import loads  # noqa: F401
from tablemirror.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    same_rows(QUERIES[name](spark, SF), con, SQL[name])
