"""Documents, validation and plans."""

import dataclasses
import hashlib
import json
import random
import struct

import pytest
from pyspark.errors import PySparkException

from millrace import results
from millrace.errors import InvalidTopology, LimitExceeded, OperatorFailure
from millrace.functions import identity
from millrace.limits import Limits
from millrace.plans import planner, spec
from millrace.plans.spec import Edge, Stage
from millrace.plans.validate import source_lengths, validate
from millrace.queries import JOB, graph
from tests.oracle import Failure, evaluate

SCALED = {
    "schema_version": 1,
    "name": "scaled-range",
    "stages": [
        {"stage_id": 1, "name": "numbers", "role": "source", "parallelism": 1, "operator": {"name": "range", "version": 1, "settings": [{"key": "end_exclusive", "value": "4"}, {"key": "start", "value": "1"}]}},
        {"stage_id": 2, "name": "scaled", "role": "transform", "parallelism": 1, "operator": {"name": "multiply", "version": 1, "settings": [{"key": "factor", "value": "3"}]}},
        {"stage_id": 3, "name": "collected", "role": "sink", "parallelism": 1, "operator": {"name": "collect", "version": 1}},
    ],
    "edges": [
        {"edge_id": 1, "source_stage_id": 1, "destination_stage_id": 2, "routing": "shuffle"},
        {"edge_id": 2, "source_stage_id": 2, "destination_stage_id": 3, "routing": "shuffle"},
    ],
}


def numbers(**more):
    """range [1, 7) over 2, times 3 over 2, collect over 2; the second edge goes by value."""
    own = graph("numbers", ("range", 2, {"start": 1, "end_exclusive": 7}), ("multiply", 2, {"factor": 3}), ("collect", 2, {}), edges=[(1, 2, "shuffle"), (2, 3, "field_hash")]).topology
    return dataclasses.replace(own, **more)


def evaluated(spark, g):
    rows = planner.compile_graph(spark, g, JOB).collect()
    out = []
    for r in rows:
        fields = tuple(sorted((k, v) for k, v in r.asDict().items() if k[0] != "_" and v is not None))
        out.append((fields, r["_src_partition"], r["_src_seq"], bytes(r["_path"]), r["_part"]))
    return sorted(out, key=str)


# ----------------------------------------------------------------------------------------------------------- documents


def test_document_round_trip():
    own = spec.parse(json.dumps(SCALED))
    assert spec.parse(spec.to_json(own)) == own
    assert spec.decode(own.canonical()) == own
    assert own.digest() == spec.parse(json.dumps(SCALED, indent=3)).digest()
    for cut in range(len(own.canonical())):
        with pytest.raises(InvalidTopology):
            spec.decode(own.canonical()[:cut])
    with pytest.raises(InvalidTopology):
        spec.decode(own.canonical() + b"x")


@pytest.mark.parametrize(
    "change",
    [
        lambda d: d.update(extra=1), lambda d: d.pop("name"), lambda d: d.update(schema_version="1"), lambda d: d.update(schema_version=True),
        lambda d: d["stages"][0].update(note="x"), lambda d: d["stages"][0].update(role="reader"), lambda d: d["stages"][0].update(parallelism=65536),
        lambda d: d["stages"][0]["operator"].update(x=1), lambda d: d["stages"][0]["operator"]["settings"][0].update(value=4),
        lambda d: d["edges"][0].update(routing="round_robin"), lambda d: d["edges"][0].update(edge_id=-1), lambda d: d.update(stages={}),
    ],
)
def test_strict_documents(change):
    own = json.loads(json.dumps(SCALED))
    change(own)
    with pytest.raises(InvalidTopology):
        spec.parse(json.dumps(own))


@pytest.mark.parametrize("text", ["", "[]", "{", json.dumps(SCALED) + "{}", json.dumps(SCALED)[:-1] + ', "name": "twice"}', " " * (1 << 20) + json.dumps(SCALED), b"\xff"])
def test_bad_documents(text):
    with pytest.raises(InvalidTopology):
        spec.parse(text)


# ---------------------------------------------------------------------------------------------------------- validation


def changed_stage(k, **more):
    own = numbers()
    stages = list(own.stages)
    stages[k] = dataclasses.replace(stages[k], **more)
    return numbers(stages=tuple(stages))


def changed_edge(k, **more):
    edges = list(numbers().edges)
    edges[k] = dataclasses.replace(edges[k], **more)
    return numbers(edges=tuple(edges))


def extra(*stages, edges=()):
    own = numbers()
    return numbers(stages=own.stages + stages, edges=own.edges + tuple(edges))


EVEN = Stage(4, "even", "transform", 1, "even", 1)
BAD = {
    "schema version": numbers(schema_version=2),
    "other operators": numbers(fingerprint=bytes(32)),
    "name with line feed": numbers(name="a\nb"),
    "name of 65 bytes": numbers(name="x" * 65),
    "no name": numbers(name=""),
    "stages out of order": numbers(stages=numbers().stages[::-1]),
    "duplicate stage id": changed_stage(1, stage_id=1),
    "duplicate stage name": changed_stage(1, name="s1"),
    "parallelism 0": changed_stage(1, parallelism=0),
    "parallelism 257": changed_stage(1, parallelism=257),
    "role": changed_stage(1, role="sink"),
    "settings out of order": changed_stage(0, settings=numbers().stages[0].settings[::-1]),
    "plus sign": changed_stage(1, settings=(("factor", "+3"),)),
    "leading zero": changed_stage(1, settings=(("factor", "03"),)),
    "no number": changed_stage(1, settings=(("factor", "x"),)),
    "beyond int64": changed_stage(1, settings=(("factor", str(1 << 63)),)),
    "no setting": changed_stage(1, settings=()),
    "33 settings": changed_stage(1, settings=tuple((f"k{k:02}", "1") for k in range(33))),
    "key of 65 bytes": changed_stage(1, settings=(("k" * 65, "1"),)),
    "value of 1025 bytes": changed_stage(1, settings=(("factor", "1" * 1025),)),
    "start after end": changed_stage(0, settings=(("end_exclusive", "1"), ("start", "2"))),
    "whole int64": changed_stage(0, settings=(("end_exclusive", str((1 << 63) - 1)), ("start", str(-(1 << 63))))),
    "a million and more": changed_stage(0, settings=(("end_exclusive", "2000001"), ("start", "0"))),
    "unknown operator": changed_stage(1, operator="odd", settings=()),
    "unknown version": changed_stage(1, version=2),
    "unknown corpus": changed_stage(0, operator="lines", settings=(("corpus", "nowhere"),)),
    "edges out of order": numbers(edges=numbers().edges[::-1]),
    "duplicate edge id": changed_edge(1, edge_id=1),
    "unknown stage": changed_edge(1, destination=9),
    "self edge": changed_edge(0, destination=1),
    "field_hash on another field": changed_edge(1, field="word"),
    "field on shuffle": changed_edge(0, field="value"),
    "broadcast into the sink": changed_edge(1, routing="broadcast", field=""),
    "two sources": extra(Stage(4, "more", "source", 1, "range", 1, (("end_exclusive", "2"), ("start", "1"))), edges=[Edge(3, 4, 2, "shuffle")]),
    "two sinks": extra(Stage(4, "more", "sink", 1, "collect", 1), edges=[Edge(3, 2, 4, "shuffle")]),
    "unreachable": extra(EVEN, edges=[Edge(3, 4, 3, "shuffle")]),
    "dead end": extra(EVEN, edges=[Edge(3, 2, 4, "shuffle")]),
    "cycle": extra(EVEN, edges=[Edge(3, 2, 4, "shuffle"), Edge(4, 4, 2, "shuffle")]),
    "into the source": extra(EVEN, edges=[Edge(3, 2, 4, "shuffle"), Edge(4, 4, 1, "shuffle")]),
    "no edges": numbers(edges=()),
    "65 stages": numbers(stages=tuple(Stage(k, f"s{k}", "transform", 1, "even", 1) for k in range(1, 66))),
    "257 edges": numbers(edges=tuple(Edge(k, 1, 2, "shuffle") for k in range(1, 258))),
}


@pytest.mark.parametrize("name", BAD)
def test_invalid(name):
    with pytest.raises(InvalidTopology):
        validate(BAD[name])


def test_expansion():
    def chain(n):
        stages = [("range", 1, {"start": 0, "end_exclusive": 1}), *[("even", 3, {})] * n, ("collect", 1, {})]
        return graph("wide", *stages, edges=[*((k, k + 1, "broadcast") for k in range(1, n + 1)), (n + 1, n + 2, "shuffle")])

    assert chain(6).deliveries[1] == 1821
    with pytest.raises(LimitExceeded):
        chain(8)
    words = graph("words", ("lines", 2, {"corpus": "gettysburg"}), ("split_words", 2, {}), ("min_length", 2, {"length": 4}), ("collect", 1, {}))
    assert words.deliveries == {4: 0, 3: 1, 2: 32, 1: 33} and words.eofs == (9, 8)


def test_task_limit():
    with pytest.raises(LimitExceeded):
        graph("tasks", ("range", 256, {"start": 0, "end_exclusive": 1}), *[("even", 256, {})] * 3, ("collect", 1, {}))


def test_source_lengths():
    assert source_lengths(6, 2) == (3, 3) and source_lengths(5, 2) == (3, 2) and source_lengths(0, 2) == (0, 0) and source_lengths(1, 3) == (1, 0, 0)
    with pytest.raises(LimitExceeded):
        source_lengths(1_000_001, 1)
    assert source_lengths(1_000_001, 1, Limits(data_limits=False)) == (1_000_001,)


# ------------------------------------------------------------------------------------------------------------ identity


def test_identities():
    """Against digests that are put together by hand."""
    sha = lambda *parts: hashlib.sha256(b"".join(parts)).digest()
    client, topology, job = bytes(range(16)), bytes(range(32)), bytes(range(16, 32))
    assert identity.job_id(client, 0x0102030405060708, topology) == sha(b"millrace/job/v1\0", client, bytes(range(1, 9)), topology)[:16]
    path = identity.source_path(job, 0x1122, 0x3344, 0x0102030405060708)
    assert path == sha(b"millrace/source-tuple/v1\0", job, job, b"\x11\x22\x33\x44", bytes(range(1, 9)))
    parent = identity.tuple_bytes(job, 0x1122, 0x3344, 0x0102030405060708, path)
    assert parent == job + job + b"\x11\x22\x33\x44" + bytes(range(1, 9)) + path
    children = [identity.child_path(parent, identity.task_bytes(job, 0x5566, 0x7788), 0x99AA, k) for k in (0, 1)]
    assert children == [sha(b"millrace/derived-tuple/v1\0", parent, job, b"\x55\x66\x77\x88\x99\xaa\x00", bytes([k])) for k in (0, 1)]
    other = dict.fromkeys(identity.DOMAINS, b"another domain")
    assert identity.source_path(job, 1, 2, 3, other) == sha(b"another domain", job, job, b"\0\1\0\2", bytes(7), b"\3")


def test_routes():
    assert identity.value_route(42, 2) == 0


def test_column_routes(spark):
    values = [0, 1, 42, -1, -(1 << 63), (1 << 63) - 1, 10**15]
    rows = spark.createDataFrame([(v,) for v in values], "value long")
    for n in (1, 2, 7, 256):
        got = {r.value: r.part for r in rows.withColumn("part", identity.value_route_column(rows.value, n)).collect()}
        assert got == {v: identity.value_route(v, n) for v in values}


# --------------------------------------------------------------------------------------------------------------- plans


FIXED = {
    "scaled": (graph("a", ("range", 1, {"start": 1, "end_exclusive": 4}), ("multiply", 1, {"factor": 3}), ("collect", 1, {})), [3, 6, 9]),
    "numbers": (validate(numbers()), [3, 6, 9, 12, 15, 18]),
    "plain": (graph("a", ("range", 1, {"start": 0, "end_exclusive": 6}), ("collect", 1, {})), [0, 1, 2, 3, 4, 5]),
    "empty": (graph("a", ("range", 2, {"start": 0, "end_exclusive": 0}), ("collect", 1, {})), []),
    "chain": (graph("a", ("range", 2, {"start": 0, "end_exclusive": 10}), ("even", 1, {}), ("multiply", 1, {"factor": 3}), ("collect", 1, {})), [0, 6, 12, 18, 24]),
    "lifecycle": (graph("a", ("range", 3, {"start": 0, "end_exclusive": 30}), ("multiply", 3, {"factor": 3}), ("even", 2, {}), ("less_than", 2, {"threshold": 10000}), ("collect", 1, {})), list(range(0, 90, 6))),
    "negative": (graph("a", ("range", 2, {"start": -5, "end_exclusive": 3}), ("even", 1, {}), ("less_than", 1, {"threshold": 0}), ("collect", 1, {})), [-4, -2]),
    "extremes": (graph("a", ("range", 1, {"start": (1 << 63) - 3, "end_exclusive": (1 << 63) - 1}), ("collect", 1, {})), [(1 << 63) - 3, (1 << 63) - 2]),
    "guarded product": (graph("a", ("range", 1, {"start": 0, "end_exclusive": 10}), ("less_than", 1, {"threshold": 2}), ("multiply", 1, {"factor": 1 << 62}), ("collect", 1, {})), [0, 1 << 62]),
}


@pytest.mark.parametrize("name", FIXED)
def test_fixed_graphs(spark, name):
    g, values = FIXED[name]
    got = evaluated(spark, g)
    assert sorted(f[0][1] for f, *_ in got) == values
    assert got == evaluate(g, JOB)


def test_word_count(spark):
    g = graph("words", ("lines", 2, {"corpus": "gettysburg"}), ("split_words", 2, {}), ("min_length", 2, {"length": 4}), ("collect", 1, {}))
    rows = planner.compile_graph(spark, g, JOB)
    assert evaluated(spark, g) == evaluate(g, JOB)
    top = [(r.word, r["count"]) for r in results.count_by(rows, "word", 10).collect()]
    assert top == [("that", 13), ("here", 8), ("have", 5), ("nation", 5), ("dedicated", 4), ("this", 4), ("dead", 3), ("great", 3), ("people", 3), ("shall", 3)]
    assert results.totals(rows, "word") == (154, 100)


@pytest.mark.parametrize("seed", range(6))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    steps = [rng.choice([("even", {}), ("multiply", {"factor": rng.randint(-3, 3)}), ("less_than", {"threshold": rng.randint(-5, 20)})]) for _ in range(rng.randint(1, 3))]
    stages = [("range", rng.randint(1, 3), {"start": rng.randint(-4, 0), "end_exclusive": rng.randint(1, 9)}), *((op, rng.randint(1, 3), s) for op, s in steps), ("collect", rng.randint(1, 3), {})]
    edges = []
    for k in range(1, len(stages)):
        to = [k + 1] + [j for j in range(k + 2, len(stages) + 1) if rng.random() < 0.3]
        edges += [(k, j, rng.choice(["shuffle", "field_hash"] + ["broadcast"] * (j < len(stages)))) for j in to]
    g = graph("random", *stages, edges=edges)
    assert evaluated(spark, g) == evaluate(g, JOB)


def test_parallel_edges_to_the_sink(spark):
    g = graph("p", ("range", 2, {"start": 0, "end_exclusive": 5}), ("collect", 1, {}), edges=[(1, 2, "shuffle"), (1, 2, "shuffle")])
    assert len(evaluated(spark, g)) == 5 and evaluated(spark, g) == evaluate(g, JOB)
    g = graph("p", ("range", 1, {"start": 0, "end_exclusive": 5}), ("even", 1, {}), ("collect", 1, {}), edges=[(1, 2, "shuffle"), (1, 2, "shuffle"), (2, 3, "shuffle")])
    with pytest.raises(OperatorFailure):
        planner.compile_graph(spark, g, JOB)


MISFITS = {
    "lines into multiply": graph("m", ("lines", 1, {"corpus": "gettysburg"}), ("multiply", 1, {"factor": 2}), ("collect", 1, {})),
    "numbers into split_words": graph("m", ("range", 1, {"start": 0, "end_exclusive": 3}), ("split_words", 1, {}), ("collect", 1, {})),
    "words by value": graph("m", ("lines", 1, {"corpus": "gettysburg"}), ("split_words", 1, {}), ("collect", 2, {}), edges=[(1, 2, "shuffle"), (2, 3, "field_hash")]),
    "product": graph("m", ("range", 1, {"start": 1, "end_exclusive": 4}), ("multiply", 1, {"factor": 1 << 62}), ("collect", 1, {})),
    "least times -1": graph("m", ("range", 1, {"start": -(1 << 63), "end_exclusive": 1 - (1 << 63)}), ("multiply", 1, {"factor": -1}), ("collect", 1, {})),
    "product before filter": graph("m", ("range", 1, {"start": 0, "end_exclusive": 4}), ("multiply", 1, {"factor": 1 << 62}), ("less_than", 1, {"threshold": 5}), ("collect", 1, {})),
    "mixed fan-in": graph("m", ("lines", 1, {"corpus": "gettysburg"}), ("split_words", 1, {}), ("min_length", 1, {"length": 1}), ("collect", 1, {}), edges=[(1, 2, "shuffle"), (1, 3, "shuffle"), (2, 3, "shuffle"), (3, 4, "shuffle")]),
}


@pytest.mark.parametrize("name", MISFITS)
def test_rows_that_fail(spark, name):
    with pytest.raises(Failure):
        evaluate(MISFITS[name], JOB)
    with pytest.raises(PySparkException):
        evaluated(spark, MISFITS[name])


def test_nothing_fails_behind_an_empty_source(spark):
    g = graph("m", ("range", 2, {"start": 4, "end_exclusive": 4}), ("split_words", 1, {}), ("collect", 2, {}), edges=[(1, 2, "shuffle"), (2, 3, "field_hash")])
    assert evaluated(spark, g) == []


def test_mixed_rows_in_the_sink(spark):
    g = graph("m", ("lines", 1, {"corpus": "gettysburg"}), ("split_words", 1, {}), ("collect", 1, {}), edges=[(1, 2, "shuffle"), (1, 3, "shuffle"), (2, 3, "shuffle")])
    assert evaluated(spark, g) == evaluate(g, JOB)


def test_no_python_in_plans(spark, capsys):
    g = graph("words", ("lines", 2, {"corpus": "gettysburg"}), ("split_words", 2, {}), ("min_length", 2, {"length": 4}), ("collect", 3, {}))
    planner.compile_graph(spark, g, JOB).explain()
    assert "Python" not in capsys.readouterr().out


def test_pack():
    assert struct.unpack(">Q", validate(numbers()).topology.canonical()[:8])[0] == len(validate(numbers()).topology.canonical()) - 8
