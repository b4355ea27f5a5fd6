import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("LOGSTRATA_DRIVER_MEMORY", "4g")
    from logstrata.session import get_spark, ship

    s = get_spark("tests", 4)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s
