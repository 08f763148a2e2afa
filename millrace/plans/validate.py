"""What a job graph has to be before anything runs.

That neighbours' fields agree is no part of it: a row that reaches an operator which can't take it fails the job.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from millrace import registry
from millrace.errors import InvalidTopology, LimitExceeded
from millrace.limits import DEFAULT, Limits
from millrace.plans.spec import ROUTINGS, Edge, Stage, Topology
from millrace.sources import corpus_text, range_settings


@dataclass(frozen=True)
class Validated:
    topology: Topology
    order: tuple[int, ...]  # stage ids, sources first
    stages: dict[int, Stage]
    incoming: dict[int, list[Edge]]
    outgoing: dict[int, list[Edge]]
    settings: dict[int, dict[str, int | str]]
    source: Stage
    sink: Stage
    eofs: tuple[int, ...]  # rows of each source partition
    deliveries: dict[int, int]  # that one row of a stage can lead to, at most

    def digest(self) -> bytes:
        return self.topology.digest()


def source_lengths(length: int, parallelism: int, limits: Limits = DEFAULT) -> tuple[int, ...]:
    """Rows of each partition when they are dealt in turn."""
    eofs = tuple((length - p + parallelism - 1) // parallelism if length > p else 0 for p in range(parallelism))
    if limits.data_limits and max(eofs) > limits.source_sequences:
        raise LimitExceeded(f"a source partition has at most {limits.source_sequences} rows")
    return eofs


def _source_length(stage: Stage, settings: dict, limits: Limits) -> int:
    if stage.operator == "range":
        return range_settings(settings["start"], settings["end_exclusive"], limits)
    return -(-len(corpus_text(settings["corpus"]).split()) // limits.words_per_line)


def _walk(start: int, steps: dict[int, list[int]]) -> set[int]:
    seen, todo = {start}, [start]
    while todo:
        for k in steps[todo.pop()]:
            if k not in seen:
                seen.add(k)
                todo.append(k)
    return seen


def validate(topology: Topology, limits: Limits = DEFAULT) -> Validated:
    if topology.schema_version != 1:
        raise InvalidTopology("unknown schema version")
    registry.check_name(topology.name, "topology name", limits.identifier_bytes)
    if topology.fingerprint != registry.fingerprint():
        raise InvalidTopology("the graph was made for another set of operators")
    if not 1 <= len(topology.stages) <= limits.stages or not 1 <= len(topology.edges) <= limits.edges:
        raise LimitExceeded(f"a graph has 1..{limits.stages} stages and 1..{limits.edges} edges")
    if sum(len(x.encode()) for s in topology.stages for pair in s.settings for x in pair) > limits.total_settings_bytes:
        raise LimitExceeded("the settings are too long in total")

    stages: dict[int, Stage] = {}
    operators, settings, names, before = {}, {}, set(), 0
    for stage in topology.stages:
        if stage.stage_id <= before:
            raise InvalidTopology("stages are not in ascending order of ids above 0")
        before = stage.stage_id
        registry.check_name(stage.name, "stage name", limits.identifier_bytes)
        if stage.name in names:
            raise InvalidTopology(f"two stages are named {stage.name!r}")
        names.add(stage.name)
        if not 1 <= stage.parallelism <= limits.tasks_per_stage:
            raise LimitExceeded(f"a stage has 1..{limits.tasks_per_stage} tasks")
        operators[before], settings[before] = registry.lookup(stage.operator, stage.version, stage.settings, limits)
        if operators[before].role != stage.role:
            raise InvalidTopology(f"{stage.operator!r} is no {stage.role}")
        stages[before] = stage
    if sum(s.parallelism for s in topology.stages) > limits.tasks_per_job:
        raise LimitExceeded(f"a job has at most {limits.tasks_per_job} tasks")
    sources, sinks = ([s for s in topology.stages if s.role == role] for role in ("source", "sink"))
    if len(sources) != 1 or len(sinks) != 1:
        raise InvalidTopology("a graph has one source and one sink")
    source, sink = sources[0], sinks[0]
    eofs = source_lengths(_source_length(source, settings[source.stage_id], limits), source.parallelism, limits)

    incoming, outgoing, before = defaultdict(list), defaultdict(list), 0
    for edge in topology.edges:
        if edge.edge_id <= before:
            raise InvalidTopology("edges are not in ascending order of ids above 0")
        before = edge.edge_id
        if edge.source not in stages or edge.destination not in stages or edge.source == edge.destination:
            raise InvalidTopology(f"edge {before} does not join two stages")
        if edge.routing not in ROUTINGS:
            raise InvalidTopology(f"unknown routing {edge.routing!r}")
        if edge.field != ("value" if edge.routing == "field_hash" else ""):
            raise InvalidTopology("field_hash goes by the field 'value', other routes by none")
        if edge.routing == "broadcast" and edge.destination == sink.stage_id:
            raise InvalidTopology("no broadcast goes to the sink")
        incoming[edge.destination].append(edge)
        outgoing[edge.source].append(edge)
    if incoming[source.stage_id] or outgoing[sink.stage_id]:
        raise InvalidTopology("the source has an input, or the sink an output")

    waiting, order = {k: len(incoming[k]) for k in stages}, []
    ready = [k for k in stages if not waiting[k]]
    while ready:
        order.append(k := ready.pop(0))
        for edge in outgoing[k]:
            waiting[edge.destination] -= 1
            if not waiting[edge.destination]:
                ready.append(edge.destination)
    if len(order) < len(stages):
        raise InvalidTopology("the graph has a cycle")
    down, up = ({k: [getattr(e, end) for e in edges[k]] for k in stages} for edges, end in ((outgoing, "destination"), (incoming, "source")))
    if _walk(source.stage_id, down) != set(stages) or _walk(sink.stage_id, up) != set(stages):
        raise InvalidTopology("a stage is not on a way from the source to the sink")

    deliveries: dict[int, int] = {}
    for k in reversed(order):
        copies = sum((stages[e.destination].parallelism if e.routing == "broadcast" else 1) * (deliveries[e.destination] + 1) for e in outgoing[k])
        deliveries[k] = operators[k].outputs * copies
        if max(copies, deliveries[k]) > limits.derived_deliveries:
            raise LimitExceeded(f"a row can lead to more than {limits.derived_deliveries} deliveries")
    if len(topology.canonical()) > limits.topology_bytes:
        raise LimitExceeded("the graph is too large")
    return Validated(topology, tuple(order), stages, dict(incoming), dict(outgoing), settings, source, sink, eofs, deliveries)
