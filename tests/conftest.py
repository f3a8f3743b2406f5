import os
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if REPO not in sys.path:
    sys.path.insert(0, REPO)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from markhive.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="markhive-tests")
    yield s


@pytest.fixture(scope="session")
def links01(spark):
    from markhive.sources.fixtures import links_fixture

    return links_fixture(spark.read.parquet(f"{SF01}/pages.parquet")).cache()


@pytest.fixture
def tmp_dir(tmp_path):
    return str(tmp_path)
