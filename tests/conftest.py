import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from given_tables import SF_ORACLE  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    import tempfile
    from prefline.session import checkpoint_root, local_session
    s = local_session("*", shuffle_partitions=8,
                      extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="prefline-wh-")})
    checkpoint_root(s)  # tests: a private folder, only because none is configured
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from prefline.plans.compare import duckdb_connection
    return duckdb_connection(SF_ORACLE)
