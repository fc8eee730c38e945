import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracles import same  # noqa: E402

from fathom.llm.registry import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])
