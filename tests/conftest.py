from __future__ import annotations

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tremora.session import local_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tremora-tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(data_dir):
    con = duckdb.connect()
    for file in sorted(os.listdir(data_dir)):
        if file.endswith(".parquet"):
            name = file.removesuffix(".parquet")
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data_dir}/{file}'")
    yield con
    con.close()
