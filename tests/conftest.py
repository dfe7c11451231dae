import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from lodestone.runtime import ship_package

    scratch = tempfile.mkdtemp(prefix="spark-tests-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[8]").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8").config("spark.local.dir", scratch).config("spark.sql.warehouse.dir", f"{scratch}/warehouse").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()
