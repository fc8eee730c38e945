import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from oracles import same  # noqa: E402

from fathom.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", ["bm25_topk", "bool_nested", "bool_implicit_andnot", "phrase_match", "eval_report", "funnel", "listwise_samples", "rerank_evaluation", "embedding_store", "embedding_post_process"])
def test_query_against_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])
