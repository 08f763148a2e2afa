"""An independent evaluation of job graphs, row by row in plain Python."""

from __future__ import annotations

import unicodedata

from millrace.functions import identity
from millrace.sources import corpus_text


class Failure(Exception):
    pass


def _one(fields: dict, name: str):
    if list(fields) != [name]:
        raise Failure(f"needs exactly {name}")
    return fields[name]


def apply(operator: str, s: dict, fields: dict) -> list[dict]:
    if operator in ("even", "less_than", "multiply"):
        value = _one(fields, "value")
        if operator == "even":
            return [fields] if value % 2 == 0 else []
        if operator == "less_than":
            return [fields] if value < s["threshold"] else []
        product = value * s["factor"]
        if not -(1 << 63) <= product < 1 << 63:
            raise Failure("overflow")
        return [{"value": product}]
    if operator == "split_words":
        words = ["".join(c.lower() for c in w if unicodedata.category(c)[0] == "L") for w in _one(fields, "line").split()]
        words = [w for w in words if w]
        if len(words) > 16:
            raise Failure("too many words")
        return [{"word": w} for w in words]
    return [fields] if len(_one(fields, "word")) >= s["length"] else []


def evaluate(graph, job: bytes) -> list[tuple]:
    """(fields, source partition, sequence, path, sink partition) of the sink's records, each identity once."""
    first, s = graph.source.stage_id, graph.settings[graph.source.stage_id]
    if graph.source.operator == "range":
        items = [{"value": v} for v in range(s["start"], s["end_exclusive"])]
    else:
        words = corpus_text(s["corpus"]).split()
        items = [{"line": " ".join(words[k : k + 16])} for k in range(0, len(words), 16)]
    out: dict = {}

    def deliver(stage: int, fields: dict, part: int, lineage: tuple) -> None:
        if stage == graph.sink.stage_id:
            out[(part, *lineage)] = (tuple(sorted(fields.items())), lineage[0], lineage[1], lineage[2], part)
            return
        own = graph.stages[stage]
        for ordinal, made in enumerate(apply(own.operator, graph.settings[stage], fields)):
            for edge in graph.outgoing[stage]:
                parent = identity.tuple_bytes(job, first, *lineage)
                path = identity.child_path(parent, identity.task_bytes(job, stage, part), edge.edge_id, ordinal)
                send(edge, made, (lineage[0], lineage[1], path))

    def send(edge, fields: dict, lineage: tuple) -> None:
        n = graph.stages[edge.destination].parallelism
        if edge.routing == "broadcast":
            parts = range(n)
        elif edge.routing == "field_hash":
            if "value" not in fields:
                raise Failure("routing field is missing")
            parts = [identity.value_route(fields["value"], n)]
        else:
            parts = [identity.shuffle_route(job, edge.edge_id, identity.tuple_bytes(job, first, *lineage), n)]
        for part in parts:
            deliver(edge.destination, fields, part, lineage)

    for k, fields in enumerate(items):
        part, seq = k % graph.source.parallelism, k // graph.source.parallelism + 1
        path = identity.source_path(job, first, part, seq)
        for edge in graph.outgoing[first]:
            send(edge, fields, (part, seq, path))
    return sorted(out.values(), key=str)
