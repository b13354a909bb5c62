import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.session import local_session
from ledgerlens.tables import Tables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("4", shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SMALL)
