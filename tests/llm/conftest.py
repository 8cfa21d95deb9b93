from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) pairs; the columns of the operators' own tables stand beside them."""

    def make(pairs, extra: bool = False):
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in pairs], DOCS)
        if extra:  # columns whose names the operators use inside
            for name in ("id", "n", "part", "row", "node", "score", "tokens", "label"):
                docs = docs.selectExpr("*", f"'x' AS {name}")
        return docs

    return make
