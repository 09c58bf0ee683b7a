import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Makes a table of documents from (doc_id, text) pairs, and languages by doc_id."""

    def make(rows, langs=None):
        full = [(i, t, (langs or {}).get(i, "en"), "s", len(t) if t is not None else None) for i, t in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make
