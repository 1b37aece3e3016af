import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tabforge.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=4, driver_memory="4g")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir(spark):
    """A fresh folder under the session's checkpoint directory."""
    import uuid
    from tabforge.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
