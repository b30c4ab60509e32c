import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config(
            map={
                "spark.sql.shuffle.partitions": "4",
                "spark.driver.memory": "4g",
                "spark.sql.session.timeZone": "UTC",
                "spark.ui.enabled": "false",
                "spark.ui.showConsoleProgress": "false",
                "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}",
                "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            }
        )
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
