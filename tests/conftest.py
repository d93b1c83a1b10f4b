import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from evalspark.session import get_spark
    s = get_spark("local[4]", app="evalspark-tests", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def duck_small():
    from tests.oracle_compare import duck
    return duck(SF_SMALL)


def local_path(uri: str) -> str:
    """Checkpoint-folder URIs (file:/...) as plain paths for Python file calls."""
    return uri[len("file:"):] if uri.startswith("file:") else uri
