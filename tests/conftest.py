import os

import pytest

from grainfold.session import build_session

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = build_session("tests", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": f"{folder}/warehouse"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER
