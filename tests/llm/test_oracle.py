"""The training-data queries that SQL can express, against DuckDB."""

import pytest

from driftlens.llm.oracle import ORACLE
from driftlens.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.test_oracle import compare, duck  # noqa: F401


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, key):  # noqa: F811
    compare(QUERIES[key](spark, SF_SMALL), duck, ORACLE[key])
