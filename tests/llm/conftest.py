import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text[, lang[, source]]) tuples, with columns whose names clash with internal ones."""

    def docs(rows, extra=True):
        full = [(r + (None,) * (4 - len(r))) for r in rows]
        frame = spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in full], SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            for name in ("row_id", "n", "term", "k", "score", "part", "line", "label", "component"):
                frame = frame.withColumn(name, F.lit("clash"))
        return frame

    return docs
