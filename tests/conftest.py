import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from marketlens.session import build_session

    s = build_session("local[4]", "marketlens-tests", **{"spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small(spark):
    """Cleaned marketplace derived from the sf0.001 star schema."""
    from marketlens.plans.registry import marketplace

    return marketplace(spark, SF_SMALL)
