import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("nightledger-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_frames(spark):
    """Frames from dicts; everything not given is NULL."""
    from nightledger.schema import FRAME_SCHEMA

    def make(*rows):
        names = FRAME_SCHEMA.fieldNames()
        data = []
        for i, r in enumerate(rows):
            full = {n: None for n in names}
            full.update({"id": i + 1, "imagetyp": "Light Frame", **r})
            data.append(tuple(full[n] for n in names))
        return spark.createDataFrame(data, FRAME_SCHEMA)

    return make


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())
