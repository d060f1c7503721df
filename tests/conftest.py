import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests import fixtures  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from outlog.session import local_session

    s = local_session(cpus="*", shuffle_partitions=8, driver_memory="8g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tmp_root(tmp_path_factory):
    return tmp_path_factory.mktemp("outlog")


@pytest.fixture(scope="session")
def log_tree(tmp_root):
    """30 folders x 10 common-log lines plus the 512-line order log (812 lines)."""
    return fixtures.write_log_tree(str(tmp_root / "logs"))


@pytest.fixture(scope="session")
def hadoop_json(tmp_root):
    """2,000 JSON log records from 141 templates, as one JSON array."""
    return fixtures.write_hadoop_json(str(tmp_root / "hadoop_2k.json"))


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"
