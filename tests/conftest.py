import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dealsight.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "dealsight-tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(spark):
    from dealsight.adapters.tpch import Tables

    return Tables(spark, SMALL)
