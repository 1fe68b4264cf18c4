import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("netstate-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def network(spark):
    from tests.fixture_network import frames

    return frames(spark)


@pytest.fixture(scope="session")
def net(spark, network):
    from netstate.plans import NetState

    return NetState(spark, frames=network)


def rows(df, *cols):
    """Sorted tuples of a frame."""
    names = cols or df.columns

    def plain(v):
        return tuple(v) if isinstance(v, list) else v

    return sorted(
        (tuple(plain(r[c]) for c in names) for r in df.select(*names).collect()), key=str)
