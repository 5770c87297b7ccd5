import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("BRINEWELL_DRIVER_MEMORY", "3g")


@pytest.fixture(scope="session")
def spark():
    from brinewell.session import drop_cut_tables, spark_session

    s = spark_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    drop_cut_tables(s)
    s.stop()
