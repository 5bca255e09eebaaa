import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quantora.session import build_session  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", 4, spark__driver__memory="4g", spark__sql__adaptive__coalescePartitions__parallelismFirst="false")


@pytest.fixture(scope="session")
def small_data():
    return f"{DATA}/sf0.001"
