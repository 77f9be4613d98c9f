from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table of (doc_id, text) pairs."""

    def build(*rows, extra=""):
        return spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")

    return build
