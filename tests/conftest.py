import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[*]").appName("lexsieve-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g"))
    session = builder.getOrCreate()
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


#: Rows of each reporting day, the days three apart: rows 32 and 36 of 40, where train and val end, both fall inside a day.
DAY_SIZES = (4, 1, 5, 2, 6, 3, 4, 3, 6, 4, 2)


@pytest.fixture(scope="session")
def tiny_corpus(spark):
    """40 rows on eleven days: 34 for training, 4 for validation, 2 for the test. Every eighth row and the last is positive."""
    day = [k for k, n in enumerate(DAY_SIZES) for _ in range(n)]
    frame = spark.createDataFrame(list(enumerate(day)), "n int, day int")
    from lexsieve.sources.corpus import with_label

    return with_label(frame.selectExpr(
        "concat('manchete ', n) as title", "concat('corpo da notícia ', n) as text",
        "cast(date_add(date'2021-03-01', 3 * day) as timestamp_ntz) as date",
        "case when n % 8 = 3 or n = 39 then 'mercado' when n % 3 = 0 then 'cultura' else 'cidades' end as category",
        "format_string('%02d-%02d', day, n) as link"))
