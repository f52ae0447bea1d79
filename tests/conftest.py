import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    home = tmp_path_factory.mktemp("spark")
    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": str(home / "shared"), "spark.sql.warehouse.dir": str(home / "warehouse")}
    out = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()
