import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from joblake.session import local_session
    s = local_session("*", shuffle_partitions=8, app="joblake-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def entry():
    import __spark_entry__ as e
    return e
