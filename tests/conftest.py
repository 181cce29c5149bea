import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("suffixloom-tests")
               .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
               .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_partitions(spark):
    """So few rows per partition that groups and runs cross partition borders."""
    def use(rows):
        spark.conf.set("spark.suffixloom.rowsPerPartition", str(rows))
    yield use
    spark.conf.unset("spark.suffixloom.rowsPerPartition")


@pytest.fixture
def collection(spark):
    return lambda docs: spark.createDataFrame(
        list(enumerate(docs)), f"doc long, text {'binary' if docs and isinstance(docs[0], bytes) else 'string'}")


@pytest.fixture
def base(spark):
    return lambda text: spark.createDataFrame([(text,)], "text string")
