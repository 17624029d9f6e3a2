import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from embra.session import get_spark
    ck = tempfile.mkdtemp(prefix="embra-test-ckpt-")
    s = get_spark("local[4]", app="embra-tests", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": ck})
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF
