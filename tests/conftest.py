import pathlib
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[8]").appName("fabsight-tests").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="fabsight-tests-")).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from fabsight.session import prepare
    yield prepare(s)
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
