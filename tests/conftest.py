import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def same(spark, sf_dir):
    """Compares a registered query with its SQL on the same tables."""
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def normal(frame):
        columns = sorted(frame.columns)
        return columns, sorted(map(repr, ([list(v) if hasattr(v, "__iter__") and not isinstance(v, (str, bytes)) else v for v in row] for row in frame[columns].itertuples(index=False, name=None))))

    def check(query, sql):
        ours, theirs = query(spark, sf_dir).toPandas(), con.execute(sql).df()
        assert normal(ours) == normal(theirs)
        return ours

    return check
