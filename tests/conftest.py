import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def harbour(spark):
    """Five short documents with title, body and url."""
    rows = [
        ("h1", "Tide Tables", "Low tide is at noon. Boats wait outside the lock, and the lock keeper opens the gate when the tide turns."),
        ("h2", "Lock Keeper", "The keeper greets every boat. Brass lamps burn along the gate."),
        ("h3", "Night Ferry Lamps", "A ferry with green lamps crosses the bay. Green water, green sky, and a slow bell."),
        ("h4", "Market Day", "Fresh herring, mussels and bread are sold from boats near the lock gate."),
        ("h5", "Bay Tide Walk", "Walk the bay when the tide is low; mussels cling to rocks."),
    ]
    return spark.createDataFrame([(i, f"http://harbour.example/{i}", t, b) for i, t, b in rows], "doc_id string, url string, title string, body string")
