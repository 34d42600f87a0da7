import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from gradeflow.session import get_session

    session = get_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def partitions(spark):
    """Run a function under several shuffle partition counts and compare the results."""
    def run(fn):
        usual = spark.conf.get("spark.sql.shuffle.partitions")
        results = []
        try:
            for n in ("1", "4", "32"):
                spark.conf.set("spark.sql.shuffle.partitions", n)
                results.append(sorted(map(tuple, fn().collect()), key=str))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", usual)
        assert results[0] == results[1] == results[2]
        return results[0]

    return run
