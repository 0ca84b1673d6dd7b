import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from tillwise.session import build_session, send_code_to_workers  # noqa: E402

DATA = pathlib.Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    send_code_to_workers()
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            # small tables would end up in one partition and hide what crosses partitions
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def orders(spark):
    return spark.read.parquet(str(DATA / "sf0.001" / "orders.parquet"))


def values(df, *columns):
    """Rows as plain tuples, in the order of the first columns."""
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]
