"""Every source is raked, as the SQL and explicit targets say, on the driver and as a table."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing

rng = random.Random(9)
MANY = [(k, "word " * rng.randint(1, 60), rng.choice(["en", "de"]), f"site{k % 300}") for k in range(1200)]


@pytest.mark.parametrize("cells", [50_000, 0])
def test_300_sources_against_the_sql(spark, docs_of, cells, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "DRIVER_CELLS", cells)
    docs = docs_of(MANY)
    docs.select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r for r in connection.execute(f"SELECT doc_id, weight, probability, sampled FROM ({mixing.OP5_SQL})").fetchall()}
    got = mixing.op5_mixing(spark, str(tmp_path)).select("doc_id", "weight", "probability", "sampled").collect()
    assert len(got) == len(want)
    assert all(tuple(r)[1:3] == pytest.approx(want[r.doc_id][1:3], abs=2e-8) and r.sampled == want[r.doc_id][3] for r in got)


def test_a_target_beyond_the_most_is_kept(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "MOST", {"source": 2, "lang": 2, "topic": 16})
    rows = mixing.mix(docs_of(MANY), targets={"source": {"site7": 1.0}}).filter(F.col("source") == "site7").collect()
    assert len(rows) == 4 and all(r.weight > 0 and r.probability > 0 for r in rows)
