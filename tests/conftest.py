import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from clinic_constants import AS_OF, SF001  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from odonto.session import build_session
    s = build_session("local[4]", 8, app_name="odonto-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="odonto-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def seed(spark):
    from odonto.sources.tables import Clinic
    return Clinic.seed(spark, AS_OF)


@pytest.fixture(scope="session")
def driver_t(spark):
    from odonto.sources.tables import Clinic
    return Clinic.from_driver(spark, SF001)
