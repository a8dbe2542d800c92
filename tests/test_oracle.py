"""Every query that SQL can express returns the same rows in DuckDB."""

import pytest

from conftest import DATA
from quern.plans import catalog, oracle


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_rows(name, same_rows):
    same_rows(catalog.QUERIES[name], oracle.SQL[name], DATA / "sf0.001")
