import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", folder)
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .config("spark.checkpoint.dir", f"{folder}/checkpoint")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(v):
    """A value that compares equal across engines."""
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, dict):
        return [plain(x) for x in v.values()]
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def same_rows(spark, query, sql, sf_dir):
    """Rows of a query and of its SQL on the same tables."""
    import glob

    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(str([plain(r[n]) for n in names]) for r in df.collect())
    cur = con.sql(sql)
    order = sorted(cur.columns)
    want = sorted(str([plain(r[cur.columns.index(n)]) for n in order]) for r in cur.fetchall())
    assert names == order
    assert got == want
