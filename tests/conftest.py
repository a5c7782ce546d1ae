from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from larkspan.session import clean_up, local_session  # noqa: E402

SF_DIR = os.environ.get("LARKSPAN_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "larkspan-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    clean_up(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    from tests.oracle import connect

    return connect(sf_dir)
