import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from worklore import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session.local_session(8, "worklore-tests")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield spark
    spark.stop()
