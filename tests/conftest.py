import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridwatch.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="*", shuffle_partitions=8, app="gridwatch-tests")
    yield s


@pytest.fixture
def scratch(spark, tmp_path):
    # test-only local folder; library code uses the session's checkpoint dir
    return str(tmp_path)
