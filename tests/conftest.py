import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare():
    """Runs a query and its SQL over a folder; the two lists of rows, columns by name."""
    import duckdb
    import pandas as pd

    def rows(df):
        df = df[sorted(df.columns)]
        plain = lambda x: "" if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else f"{x:.6f}" if isinstance(x, float) else str(x)
        return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))

    def run(spark, query, sql, folder):
        con = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        got, want = query(spark, str(folder)).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        return rows(got), rows(want)

    return run
