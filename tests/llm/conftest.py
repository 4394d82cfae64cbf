import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def docs(spark):
    import fixtures

    return spark.createDataFrame(fixtures.documents(), fixtures.SCHEMA).repartition(3)
