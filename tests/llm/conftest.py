import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows (doc_id, text[, lang[, source]]) as documents."""

    def make(rows, extra=None):
        full = [(*r, *([None] * (4 - len(r))), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name, value in (extra or {}).items():
            df = df.selectExpr("*", f"{value} AS {name}")
        return df

    return make
