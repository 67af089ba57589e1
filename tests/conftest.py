import tempfile

import pytest
from pyspark.sql import SparkSession

from configsieve.session import configure


def session() -> SparkSession:
    builder = SparkSession.builder.master("local[8]").appName("configsieve")
    builder = builder.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    return session()
