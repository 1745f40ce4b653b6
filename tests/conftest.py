import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tendril.session import local_session

    s = local_session(cores=8, shuffle_partitions=8, app="tendril-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def demo(spark):
    from tendril.sources.demo import demo_tables

    return demo_tables(spark)


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="tendril-test-")
