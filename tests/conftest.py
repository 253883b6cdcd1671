import os
import re
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


def own_jobs(names):
    """The library's own jobs: without the corpus operators, which tests/llm covers."""
    return {k: v for k, v in names.items() if not re.match(r"op\d+_|pipeline$", k)}


@pytest.fixture(scope="session")
def spark():
    from devicelens.session import get_session

    s = get_session("local[4]", shuffle_partitions=4, app_name="devicelens-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def driver_t(spark):
    from devicelens.sources import driver_tables

    return driver_tables(spark, SF_SMALL)


def tables(spark, **frames):
    """Tables from hand-made frames; event codes default to the fixture list."""
    from devicelens.sources import Tables
    from devicelens.sources.driver import event_codes

    loaders = {"event_codes": lambda: event_codes(spark)}
    for name, df in frames.items():
        loaders[name] = (lambda d=df: d)
    return Tables(spark, loaders)
