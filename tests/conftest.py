import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

FIXTURES = os.path.join(ROOT, "tests", "fixtures")
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from featurelens.session import get_session

    # the checkpoint folder comes from the session's configuration; get_session
    # registers a private one only when none is configured
    s = get_session("local[*]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    yield s
    s.stop()
