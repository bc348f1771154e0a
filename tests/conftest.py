import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {
        "spark.master": "local[4]", "spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def same_value(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(same_value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def oracle():
    """Rows of an SQL query over given tables (name -> parquet path, or a pandas frame)."""
    import duckdb

    def run(sql, tables=None):
        c = duckdb.connect()
        for name in TABLES:
            if not tables or name not in tables:
                c.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
        for name, frame in (tables or {}).items():
            c.register(name, frame)
        out = c.sql(sql)
        return sorted(out.columns), rows_of(out.columns, out.fetchall())

    return run
