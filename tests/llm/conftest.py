import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from fleetkit.session import local_session
    yield local_session(cores=4, shuffle_partitions=8, app="fleetkit-tests")
