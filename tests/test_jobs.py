"""Sealed results, pages, the job catalogue, the command line and streams."""

import io
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace import cli, operators, results, streaming
from millrace.errors import CapacityExhausted, CorruptResult, IdentityReuse, InvalidTopology, InvalidTransition, LimitExceeded, ManifestMismatch, MissingField, NotFound, PageTooSmall, ResultUnavailable, SkippedRequest, StaleRequest
from millrace.functions import text
from millrace.jobs import Catalogue
from millrace.limits import Limits
from millrace.plans import planner, spec
from millrace.queries import JOB, graph
from millrace.sources import range_rows, register_corpus, table_lines, table_values
from millrace.store import Store
from millrace.streaming import progress
from tests.oracle import evaluate

CLIENT = bytes(range(1, 17))
WORDS = graph("word-count", ("lines", 2, {"corpus": "gettysburg"}), ("split_words", 2, {}), ("min_length", 2, {"length": 4}), ("collect", 2, {}))
OVERFLOW = graph("overflow", ("range", 1, {"start": 1, "end_exclusive": 4}), ("multiply", 1, {"factor": 1 << 62}), ("collect", 1, {}))
NUMBERS = graph("numbers", ("range", 2, {"start": 1, "end_exclusive": 7}), ("multiply", 2, {"factor": 3}), ("collect", 2, {}), edges=[(1, 2, "shuffle"), (2, 3, "field_hash")])


def sealed(spark, g, folder, **more):
    return results.seal(planner.compile_graph(spark, g, JOB), str(folder), g.sink.parallelism, **more)


# ----------------------------------------------------------------------------------------------------------- operators


def test_text_functions(spark):
    cases = ["Four score, and SEVEN years-ago; 1863!", "", "  ", "a b c　d\u0085e", "x​y", "ΟΔΟΣ", "İstanbul ÉTÉ", "1 2 3"]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, line string")
    got = {}
    for r in operators.split_words(rows).collect():
        got.setdefault(r.k, []).append((r["_ordinal"], r.word))
    words = {k: [w for _, w in sorted(v)] for k, v in got.items()}
    assert words == {0: ["four", "score", "and", "seven", "yearsago"], 3: ["a", "b", "c", "d", "e"], 4: ["xy"], 5: ["οδοσ"], 6: ["istanbul", "été"]}


def test_split_bound(spark):
    rows = spark.createDataFrame([(" ".join("abcdefghijklmnopq"),)], "line string")
    with pytest.raises(PySparkException):
        operators.split_words(rows).count()
    assert operators.split_words(spark.createDataFrame([(" ".join("abcdefghijklmnop 1 2 3"),)], "line string").selectExpr("regexp_replace(line, ' +', ' ') as line")).count() == 16


def test_min_length_counts_code_points(spark):
    rows = spark.createDataFrame([("été",), ("ab",), ("🙂🙂🙂",)], "word string")
    assert {r.word for r in operators.min_length(rows, 3).collect()} == {"été", "🙂🙂🙂"}
    assert operators.min_length(rows, 0).count() == operators.min_length(rows, -(1 << 63)).count() == 3


def test_table_sources(spark):
    rows = spark.createDataFrame([(1, " ".join(map(str, range(33)))), (2, ""), (3, "one"), (4, None)], "id long, text string")
    got = [(r.id, r.ordinal, len(r.line.split())) for r in table_lines(rows, "text", "id").orderBy("id", "ordinal").collect()]
    assert got == [(1, 0, 16), (1, 1, 16), (1, 2, 1), (3, 0, 1)]
    assert [r.value for r in table_values(rows, "id").orderBy("value").collect()] == [1, 2, 3, 4]
    with pytest.raises(PySparkException):
        table_values(spark.createDataFrame([(1,), (None,)], "id long"), "id").collect()


def test_range_dealing(spark):
    got = sorted((r["_src_partition"], r["_src_seq"], r.value) for r in range_rows(spark, 1, 7, 2).collect())
    assert got == [(0, 1, 1), (0, 2, 3), (0, 3, 5), (1, 1, 2), (1, 2, 4), (1, 3, 6)]
    with pytest.raises(LimitExceeded):
        range_rows(spark, 0, 256_000_001)


def test_own_corpus(spark):
    register_corpus("own", "x " * 40)
    g = graph("own", ("lines", 2, {"corpus": "own"}), ("collect", 1, {}))
    assert g.eofs == (2, 1) and len(evaluate(g, JOB)) == planner.compile_graph(spark, g, JOB).count() == 3


def test_lower_each_is_by_character(spark):
    row = spark.createDataFrame([("ΣΑΣ İI",)], "t string").select(text.lower_each(F.col("t"))).first()
    assert row[0] == "σασ ii"


# ------------------------------------------------------------------------------------------------------------- results


def test_pages(spark, tmp_path):
    own = sealed(spark, WORDS, tmp_path / "r")
    want = evaluate(WORDS, JOB)
    order = sorted((p, s, path, f) for f, p, s, path, _ in want)
    got = list(results.pages(own, 2000))
    assert [(r["_src_partition"], r["_src_seq"], bytes(r["_path"]), (("word", r.word),)) for r in got] == order
    first = results.page(own, None, 2000)
    sizes = [168 + 2 + 2 + 4 + 1 + 2 + len(f[0][1].encode()) for *_, f in order]
    n = len(first.records)
    assert sum(sizes[:n]) <= 2000 < sum(sizes[: n + 1]) and not first.end
    assert results.page(own, tuple(got[-1][c] for c in results.ORDER)).records == []
    with pytest.raises(PageTooSmall) as small:
        results.page(own, None, 100)
    assert small.value.required == sizes[0]
    assert len(results.page(own, None, sizes[0]).records) == 1
    for budget in (0, (512 << 10) + 1):
        with pytest.raises(LimitExceeded):
            results.page(own, None, budget)


def test_manifest(spark, tmp_path):
    folder = str(tmp_path / "r")
    with pytest.raises(ResultUnavailable):
        results.open_results(spark, folder)
    own = sealed(spark, NUMBERS, folder)
    assert sum(p["records"] for p in own.manifest["partitions"]) == 6 and sum(p["bytes"] for p in own.manifest["partitions"]) == 6 * 186
    assert results.open_results(spark, folder, own.digest).digest == own.digest
    with pytest.raises(ManifestMismatch):
        results.open_results(spark, folder, "0" * 64)
    again = sealed(spark, NUMBERS, tmp_path / "again")
    assert again.manifest["partitions"] == own.manifest["partitions"]


def test_empty_results(spark, tmp_path):
    g = graph("empty", ("range", 2, {"start": 0, "end_exclusive": 0}), ("collect", 2, {}))
    own = sealed(spark, g, tmp_path / "r")
    assert results.page(own) == results.Page([], None, True) and [p["records"] for p in own.manifest["partitions"]] == [0, 0]


def test_failed_seal_shows_nothing(spark, tmp_path):
    with pytest.raises(PySparkException):
        sealed(spark, OVERFLOW, tmp_path / "r")
    with pytest.raises(ResultUnavailable):
        results.open_results(spark, str(tmp_path / "r"))


def test_data_limits(spark, tmp_path):
    register_corpus("wide", "y" * 600)
    g = graph("wide", ("lines", 1, {"corpus": "wide"}), ("collect", 1, {}))
    with pytest.raises(PySparkException):
        sealed(spark, g, tmp_path / "a")
    assert sealed(spark, g, tmp_path / "b", limits=Limits(data_limits=False)).rows.count() == 1
    with pytest.raises(LimitExceeded):
        sealed(spark, NUMBERS, tmp_path / "c", limits=Limits(result_bytes_per_job=1000))


def test_identity_in_two_partitions(spark, tmp_path):
    g = graph("p", ("range", 1, {"start": 0, "end_exclusive": 40}), ("collect", 2, {}), edges=[(1, 2, "shuffle"), (1, 2, "shuffle")])
    with pytest.raises(CorruptResult):
        sealed(spark, g, tmp_path / "r")


def test_count_by(spark):
    rows = spark.createDataFrame([(10,), (9,), (2,), (2,), (10,), (9,), (3,)], "value long")
    assert [(r.value, r["count"]) for r in results.count_by(rows, "value").collect()] == [("10", 2), ("2", 2), ("9", 2), ("3", 1)]
    assert [r.value for r in results.count_by(rows, "value", 2).collect()] == ["10", "2"]
    assert results.totals(rows, "value") == (7, 4) and results.totals(rows.limit(0), "value") == (0, 0)
    with pytest.raises(MissingField):
        results.count_by(rows, "word")
    with pytest.raises(PySparkException):
        results.count_by(spark.createDataFrame([(1,), (None,)], "value long"), "value").collect()
    assert results.count_by(spark.createDataFrame([(bytearray(b"ab"),)], "raw binary"), "raw").first().raw == "YWI="


# ---------------------------------------------------------------------------------------------------------------- jobs


@pytest.fixture
def catalogue(spark, tmp_path):
    return Catalogue(spark, str(tmp_path / "jobs"))


def test_job(catalogue):
    answer = catalogue.submit(spec.to_json(WORDS.topology), CLIENT, 1)
    job = answer["job_id"]
    assert answer == {"command": "submit", "job_id": job, "job_control_revision": 1, "state": "pending"}
    with pytest.raises(ResultUnavailable):
        catalogue.results(job)
    status = catalogue.run(job)
    assert (status["state"], status["source_task_count"], status["completed_source_tasks"], status["manifest_count"], status["has_failure"]) == ("succeeded", 2, 2, 2, False)
    assert catalogue.results(job, status["manifest_set_digest"]).rows.count() == 154
    with pytest.raises(InvalidTransition):
        catalogue.run(job)
    with pytest.raises(InvalidTransition):
        catalogue.cancel(job, 1)
    assert [j["job_id"] for j in catalogue.jobs()["jobs"]] == [job]
    with pytest.raises(NotFound):
        catalogue.status("00" * 16)


def test_streamed_job(catalogue, monkeypatch):
    told, own = [], Catalogue._progressed
    monkeypatch.setattr(Catalogue, "_progressed", lambda self, job, done: (told.append(done), own(self, job, done)))
    job = catalogue.submit(NUMBERS.topology, CLIENT, 1)["job_id"]
    status = catalogue.run(job, stream=True)
    assert (status["state"], status["completed_source_tasks"], told[-1]) == ("succeeded", 2, 2) and told == sorted(told)
    assert catalogue.results(job).rows.count() == 6
    failing = catalogue.submit(OVERFLOW.topology, CLIENT, 2)["job_id"]
    assert catalogue.run(failing, stream=True)["failure_code"] == 1
    assert catalogue.overview()["states"] | {"succeeded": 1, "failed": 1} == catalogue.overview()["states"]


def test_a_job_always_ends(catalogue, monkeypatch):
    job = catalogue.submit(NUMBERS.topology, CLIENT, 1)["job_id"]
    monkeypatch.setattr(results, "seal", lambda *a, **b: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        catalogue.run(job)
    status = catalogue.status(job)
    assert (status["state"], status["failure_code"]) == ("failed", 3)


def test_damaged_results(catalogue, spark):
    job = catalogue.submit(NUMBERS.topology, CLIENT, 1)["job_id"]
    catalogue.run(job)
    found = results.open_results(spark, f"{catalogue.root}/jobs/{job}/results")
    rows = found.rows.withColumn("value", F.when(F.col("value") == 3, 4).otherwise(F.col("value")))
    for other in (rows, found.rows.filter("value <> 3"), found.rows.unionByName(found.rows.filter("value = 3"))):
        with pytest.raises(CorruptResult):
            results.verify(results.ResultSet(other, found.manifest, found.digest))
    assert results.verify(found) is found


def test_failing_job(catalogue):
    job = catalogue.submit(OVERFLOW.topology, CLIENT, 1)["job_id"]
    status = catalogue.run(job)
    assert (status["state"], status["has_failure"], status["failure_code"], status["manifest_set_digest"]) == ("failed", True, 1, "")
    with pytest.raises(ResultUnavailable):
        catalogue.results(job)


def test_requests(catalogue):
    first = catalogue.submit(WORDS.topology, CLIENT, 1)
    assert catalogue.submit(WORDS.topology, CLIENT, 1) == first and len(catalogue.jobs()["jobs"]) == 1
    with pytest.raises(IdentityReuse):
        catalogue.submit(NUMBERS.topology, CLIENT, 1)
    with pytest.raises(SkippedRequest):
        catalogue.submit(NUMBERS.topology, CLIENT, 3)
    second = catalogue.submit(NUMBERS.topology, CLIENT, 2)
    assert second["job_id"] != first["job_id"]
    with pytest.raises(StaleRequest):
        catalogue.submit(WORDS.topology, CLIENT, 1)
    with pytest.raises(SkippedRequest):
        catalogue.submit(WORDS.topology, bytes([9]) * 16, 2)
    with pytest.raises(InvalidTopology):
        catalogue.submit("{}", CLIENT, 3)
    assert catalogue.submit(WORDS.topology, CLIENT, 3)["job_id"] != first["job_id"]


def test_cancel(catalogue):
    job = catalogue.submit(WORDS.topology, CLIENT, 1)["job_id"]
    with pytest.raises(InvalidTransition):
        catalogue.cancel(job, 2)
    assert catalogue.cancel(job, 1)["job_control_revision"] == 2 == catalogue.cancel(job, 1)["job_control_revision"]
    with pytest.raises(InvalidTransition):
        catalogue.cancel(job, 2)
    with pytest.raises(InvalidTransition):
        catalogue.run(job)
    assert catalogue.status(job)["state"] == "canceled"


def test_capacity(spark, tmp_path):
    own = Catalogue(spark, str(tmp_path / "jobs"), Limits(active_jobs=1, retained_jobs=2))
    first = own.submit(WORDS.topology, CLIENT, 1)["job_id"]
    with pytest.raises(CapacityExhausted):
        own.submit(NUMBERS.topology, CLIENT, 2)
    own.cancel(first, 1)
    own.cancel(own.submit(NUMBERS.topology, CLIENT, 2)["job_id"], 1)
    with pytest.raises(CapacityExhausted):
        own.submit(WORDS.topology, CLIENT, 3)


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.write("a/b.txt", "é") and not store.write("a/b.txt", "x") and store.read("a/b.txt") == "é"
    assert store.write("a/b.txt", "z", replace=True) and store.read("a/b.txt") == "z" and store.names("a") == ["b.txt"] and store.names("none") == []


# -------------------------------------------------------------------------------------------------------- command line


def run(*args):
    out = io.StringIO()
    code = cli.main(list(args), out)
    return code, out.getvalue().splitlines()


def test_command_line(spark, tmp_path, capsys):
    root = ["--root", str(tmp_path / "jobs")]
    (tmp_path / "g.json").write_text(spec.to_json(WORDS.topology))
    submit = [*root, "submit", "--topology", str(tmp_path / "g.json"), "--state", str(tmp_path / "state.json")]
    code, lines = run(*submit, "--run")
    job = json.loads(lines[0])["job_id"]
    assert code == 0 and json.loads(lines[1])["state"] == "succeeded"
    code, lines = run(*root, "results", "--job", job)
    assert code == 0 and len(lines) == 155 and json.loads(lines[-1]) == {"command": "results", "job_id": job, "records": 154, "complete": True}
    assert set(json.loads(lines[0])) == {"job_id", "source_stage_id", "source_partition", "source_sequence", "sink_stage_id", "sink_partition", "fields"}
    code, lines = run(*root, "results", "--job", job, "--count-by", "word", "--top", "2")
    assert lines[:4] == ["   count  word", "      13  that", "       8  here", "     154  records, 100 distinct word"]
    assert run(*root, "results", "--job", job, "--count-by", "value")[0] == 1
    second = json.loads(run(*submit)[1][0])["job_id"]
    assert second != job and json.loads(run(*root, "cancel", "--job", second, "--expected-revision", "1")[1][0])["state"] == "canceled"
    assert len(json.loads(run(*root, "jobs")[1][0])["jobs"]) == 2 and json.loads(run(*root, "status", "--job", second)[1][0])["state"] == "canceled"
    assert run(*root, "results", "--job", second)[0] == 1 and "ResultUnavailable" in capsys.readouterr().err


# ------------------------------------------------------------------------------------------------------------- streams


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_completed_prefix(spark, block):
    done = {0: [1, 2, 3, 4, 5, 6, 7], 1: [2, 3, 4], 2: [1, 2, 3, 5, 6, 9, 9], 3: [], 4: [1, 1, 2], 5: [1, 2, 3, 4, 5, 6, 8]}
    rows = spark.createDataFrame([(p, s) for p, own in done.items() for s in own], "part int, seq long")
    eofs = spark.createDataFrame([(p, 7) for p in range(5)] + [(5, 8), (6, 0)], "part int, eof long")
    got = {r.part: (r.completed, r.final) for r in progress.completed_prefix(rows, eofs, block).collect()}
    assert got == {0: (7, True), 1: (0, False), 2: (3, False), 3: (0, False), 4: (2, False), 5: (6, False), 6: (0, True)}


def test_stream_equals_batch(spark, tmp_path):
    own = streaming.run_sealed(spark, WORDS, JOB, str(tmp_path), files_per_batch=2)
    batch = sealed(spark, WORDS, tmp_path / "batch")
    assert own.manifest["partitions"] == batch.manifest["partitions"]


def test_parallel_edges_of_a_stream_are_made_one(spark, tmp_path):
    g = graph("p", ("range", 2, {"start": 0, "end_exclusive": 9}), ("collect", 1, {}), edges=[(1, 2, "shuffle"), (1, 2, "shuffle")])
    own = streaming.run_sealed(spark, g, JOB, str(tmp_path))
    assert sorted(r.value for r in own.rows.collect()) == list(range(9))


def test_progress_of_a_stopped_stream(spark, tmp_path):
    source, checkpoint = str(tmp_path / "source"), str(tmp_path / "checkpoint")
    range_rows(spark, 0, 4, 2).coalesce(1).write.parquet(source)
    streaming.run_stream(spark, NUMBERS, JOB, source, str(tmp_path / "out"), checkpoint)
    range_rows(spark, 4, 6, 2).selectExpr("value", "_src_partition", "_src_seq + 2L as _src_seq").coalesce(1).write.mode("append").parquet(source)
    done = {r.part: (r.completed, r.final) for r in streaming.completed(spark, source, checkpoint, (2, 3)).collect()}
    assert done == {0: (2, True), 1: (2, False)}


def test_stream_goes_on(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("source", "out", "checkpoint"))
    streaming.source_files(spark, NUMBERS, source, files=3)
    go = lambda: streaming.run_stream(spark, NUMBERS, JOB, source, out, checkpoint, files_per_batch=1).count()
    assert go() == 6 and go() == 6
    more = range_rows(spark, 100, 103, 2).selectExpr("value", "_src_partition", "_src_seq + 100 as _src_seq")
    more.coalesce(1).write.mode("append").parquet(source)
    assert go() == 9 and go() == 9


def test_failing_stream(spark, tmp_path):
    with pytest.raises(PySparkException):
        streaming.run_sealed(spark, OVERFLOW, JOB, str(tmp_path))
    with pytest.raises(ResultUnavailable):
        results.open_results(spark, str(tmp_path / "results"))
