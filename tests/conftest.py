from __future__ import annotations

import pytest

from watchloom.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.log.level": "ERROR",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluates an expression over one row of text columns."""

    def run(column, **values):
        schema = ", ".join(f"{k} string" for k in values) or "x string"
        row = tuple(values.values()) or (None,)
        return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]

    return run
