import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from wellspark.checks.adapters import Given  # noqa: E402
from wellspark.session import local_session  # noqa: E402

SMALL = os.environ.get("WELLSPARK_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.cpu_count() or 4, partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def given(spark):
    return Given(spark, SMALL)


@pytest.fixture(scope="session")
def folder():
    return SMALL
