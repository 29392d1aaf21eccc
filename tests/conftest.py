import pytest

from corpusloom.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Values of one expression over a list of strings."""
    from pyspark.sql import functions as F

    def run(expression, values):
        rows = spark.createDataFrame(list(enumerate(values)), "i int, c string")
        found = rows.select("i", expression(F.col("c")).alias("x")).collect()
        return [r.x for r in sorted(found, key=lambda r: r.i)]

    return run
