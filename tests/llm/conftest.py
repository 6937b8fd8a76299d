import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import ODD_TEXTS  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, or from (id, text) pairs."""

    def make(texts, extra=None, schema=DOC):
        rows = []
        for i, text in enumerate(texts):
            key, text = text if isinstance(text, tuple) else (i, text)
            rows.append((key, text, "en", f"src{i % 3}", None if text is None else len(text)))
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture
def odd(docs_of):
    """Null ids, repeated rows, odd texts."""
    rows = [*enumerate(ODD_TEXTS), (None, "no id"), (None, None), (3, "é"), (3, "é"), (3, "other text under one id")]
    return docs_of(rows)
