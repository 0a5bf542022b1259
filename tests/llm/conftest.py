import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts; ids count up, unless rows are (id, text)."""
    def make(texts, extra=False):
        rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:  # columns that clash with names the operators use inside
            df = df.selectExpr("doc_id", "text", "'x' as id", "1 as digest", "2 as row", "'y' as words",
                               "3 as key", "4 as score", "'n' as new", "5 as doc", "6 as `spans`")
        return df
    return make
