import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ratelens.session import get_session
    warehouse = tempfile.mkdtemp(prefix="ratelens-wh-")
    s = get_session("local[4]", shuffle_partitions=8,
                    extra={"spark.sql.warehouse.dir": warehouse})
    # Tests set a checkpoint folder only when the session has none.
    from ratelens.session import checkpoint_root
    checkpoint_root(s)
    yield s


@pytest.fixture(scope="session")
def enc_small(spark):
    from ratelens.plans.catalog import enc
    return enc(spark, SF_SMALL).cache()
