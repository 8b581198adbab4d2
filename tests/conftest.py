import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def cement():
    # Nine rows of a public data set, to be matched with R's results on them.
    return {
        "x1": [7, 1, 11, 1, 2, 21, 1, 11, 10],
        "x2": [26, 29, 56, 31, 54, 47, 40, 66, 68],
        "x3": [6, 15, 8, 22, 18, 4, 23, 9, 8],
        "x4": [60, 52, 6, 44, 22, 26, 34, 12, 12],
        "y": [78.5, 74.3, 104.3, 72.5, 93.1, 115.9, 83.8, 113.3, 109.4],
    }


@pytest.fixture(scope="session")
def cement_frame(spark, cement):
    names = list(cement)
    rows = [tuple(float(cement[n][i]) for n in names) for i in range(9)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))


def packed(spark, columns: dict, start: int = 0):
    rows = [(n, start + i, [float(x) for x in v]) for i, (n, v) in enumerate(columns.items())]
    return spark.createDataFrame(rows, "name string, pos int, values array<double>")
