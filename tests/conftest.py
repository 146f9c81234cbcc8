from __future__ import annotations

import os

import pytest
from pyspark.sql import SparkSession

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
SMALL_DIR = os.environ.get("SMALL_DIR", "/root/testdata/sf0.001")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("idscreen-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    return session()
