import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gatecast.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "gatecast-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "3",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("gatecast.folder", str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


def rows(df, *order):
    """Collected rows as tuples, sorted by some columns."""
    return [tuple(r) for r in df.orderBy(*order).collect()]
