import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, id int, key string, line string, `count` int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text, lang, source), with further columns whose names operators use themselves."""

    def make(rows):
        full = [(*row, *[None] * (4 - len(row)), len(row[1] or ""), "x", 1, "k", "l", 0) for row in rows]
        return spark.createDataFrame(full, DOCS)

    return make
