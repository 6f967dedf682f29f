import os
import sys
from pathlib import Path

os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import pytest
from pyspark.sql import SparkSession

from caseloom.session import configured


@pytest.fixture(scope="session")
def spark():
    s = configured(SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def folder():
    if not SF.exists():
        pytest.skip("the test tables are not here")
    return str(SF)
