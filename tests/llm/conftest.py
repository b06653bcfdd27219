import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents-like rows out of texts (or (doc_id, text, source) tuples), with an extra column of any name."""

    def make(rows, extra="extra"):
        full = [(i, r, "en", "s0", 1, "x") if not isinstance(r, tuple) else (r[0], r[1], "en", r[2], 1, "x") for i, r in enumerate(rows)]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {extra} string")

    return make
