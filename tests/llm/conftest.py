import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from edge_rows import EDGE, SF  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows with null and clashing columns; one partition a few rows."""
    rows = [(d, t, None, None, 5, "x", 3.5, [1]) for d, t in EDGE]
    from chainloom.llm.common import written

    return written(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, size double, words array<int>").repartition(3))


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def plain(docs):
    return [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
