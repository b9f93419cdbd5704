import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quarry.session import get_session
    s = get_session("local[4]", app_name="quarry-tests", shuffle_partitions=8,
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="quarry-test-ckpt-")})
    yield s
    s.stop()


def one(spark, expr, value, ddl="x string"):
    """Evaluate a column expression built from column ``x`` on one value."""
    df = spark.createDataFrame([(value,)], ddl)
    return df.select(expr.alias("r")).collect()[0]["r"]
