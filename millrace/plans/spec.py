"""Job graph documents: strict JSON, and canonical bytes with their digest."""

from __future__ import annotations

import hashlib
import json
import struct
from dataclasses import dataclass

from millrace import registry
from millrace.errors import InvalidTopology, LimitExceeded
from millrace.limits import DEFAULT, Limits

ROUTINGS = ("shuffle", "field_hash", "broadcast")


@dataclass(frozen=True)
class Stage:
    stage_id: int
    name: str
    role: str
    parallelism: int
    operator: str
    version: int
    settings: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Edge:
    edge_id: int
    source: int
    destination: int
    routing: str
    field: str = ""


@dataclass(frozen=True)
class Topology:
    schema_version: int
    name: str
    stages: tuple[Stage, ...]
    edges: tuple[Edge, ...]
    fingerprint: bytes = b""

    def canonical(self) -> bytes:
        return encode(self)

    def digest(self) -> bytes:
        return hashlib.sha256(encode(self)).digest()


# ---------------------------------------------------------------------------------------------------------------- JSON


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise InvalidTopology("a field occurs twice")
    return out


def _take(value: object, what: str, fields: dict[str, type], optional: tuple[str, ...] = ()) -> dict:
    if not isinstance(value, dict):
        raise InvalidTopology(f"{what} is no object")
    unknown = set(value) - set(fields)
    if unknown:
        raise InvalidTopology(f"{what} has unknown fields {sorted(unknown)}")
    out = {}
    for name, kind in fields.items():
        if name not in value:
            if name not in optional:
                raise InvalidTopology(f"{what} lacks {name!r}")
            out[name] = kind()
            continue
        own = value[name]
        if type(own) is not kind or kind is int and not 0 <= own < 1 << 16:
            raise InvalidTopology(f"{what}: {name!r} is no {'16-bit number' if kind is int else kind.__name__}")
        out[name] = own
    return out


def parse(document: str | bytes, limits: Limits = DEFAULT) -> Topology:
    """A document's graph, not validated yet. Unknown or repeated fields and anything after the document are errors."""
    data = document.encode() if isinstance(document, str) else document
    if len(data) > limits.document_bytes:
        raise LimitExceeded(f"the document has more than {limits.document_bytes} bytes")
    try:
        top = json.loads(data.decode("utf-8"), object_pairs_hook=_unique)
    except (ValueError, RecursionError) as error:
        raise InvalidTopology(f"no JSON document: {error}") from None
    top = _take(top, "the document", {"schema_version": int, "name": str, "stages": list, "edges": list})
    stages, edges = [], []
    for own in top["stages"]:
        own = _take(own, "a stage", {"stage_id": int, "name": str, "role": str, "parallelism": int, "operator": dict})
        if own["role"] not in registry.ROLES:
            raise InvalidTopology(f"unknown role {own['role']!r}")
        op = _take(own["operator"], "an operator", {"name": str, "version": int, "settings": list}, ("settings",))
        settings = [_take(s, "a setting", {"key": str, "value": str}) for s in op["settings"]]
        stages.append(Stage(own["stage_id"], own["name"], own["role"], own["parallelism"], op["name"], op["version"], tuple((s["key"], s["value"]) for s in settings)))
    for own in top["edges"]:
        own = _take(own, "an edge", {"edge_id": int, "source_stage_id": int, "destination_stage_id": int, "routing": str, "field": str}, ("field",))
        if own["routing"] not in ROUTINGS:
            raise InvalidTopology(f"unknown routing {own['routing']!r}")
        edges.append(Edge(own["edge_id"], own["source_stage_id"], own["destination_stage_id"], own["routing"], own["field"]))
    return Topology(top["schema_version"], top["name"], tuple(stages), tuple(edges), registry.fingerprint())


def to_json(topology: Topology) -> str:
    stages = []
    for s in topology.stages:
        operator: dict = {"name": s.operator, "version": s.version}
        if s.settings:
            operator["settings"] = [{"key": k, "value": v} for k, v in s.settings]
        stages.append({"stage_id": s.stage_id, "name": s.name, "role": s.role, "parallelism": s.parallelism, "operator": operator})
    edges = []
    for e in topology.edges:
        edges.append({"edge_id": e.edge_id, "source_stage_id": e.source, "destination_stage_id": e.destination, "routing": e.routing} | ({"field": e.field} if e.field else {}))
    return json.dumps({"schema_version": topology.schema_version, "name": topology.name, "stages": stages, "edges": edges})


# ------------------------------------------------------------------------------------------------------ canonical bytes


def _text(value: str) -> bytes:
    data = value.encode()
    return struct.pack(">H", len(data)) + data


def encode(topology: Topology) -> bytes:
    """Length, then every field in order; numbers are big-endian, texts have their length before them."""
    out = [struct.pack(">H", topology.schema_version), _text(topology.name), topology.fingerprint]
    out.append(struct.pack(">H", len(topology.stages)))
    for s in topology.stages:
        out += [struct.pack(">H", s.stage_id), _text(s.name), struct.pack(">BH", registry.ROLES.index(s.role), s.parallelism)]
        out += [_text(s.operator), struct.pack(">HH", s.version, len(s.settings)), *(_text(x) for pair in s.settings for x in pair)]
    out.append(struct.pack(">H", len(topology.edges)))
    for e in topology.edges:
        out += [struct.pack(">HHHB", e.edge_id, e.source, e.destination, ROUTINGS.index(e.routing)), _text(e.field)]
    body = b"".join(out)
    return struct.pack(">Q", len(body)) + body


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, size: int) -> bytes:
        if self.at + size > len(self.data):
            raise InvalidTopology("the bytes are cut short")
        self.at += size
        return self.data[self.at - size : self.at]

    def numbers(self, form: str) -> tuple:
        return struct.unpack(f">{form}", self.take(struct.calcsize(f">{form}")))

    def text(self) -> str:
        try:
            return self.take(self.numbers("H")[0]).decode()
        except UnicodeDecodeError:
            raise InvalidTopology("a text is no UTF-8") from None

    def pick(self, names: tuple[str, ...]) -> str:
        (k,) = self.numbers("B")
        if k >= len(names):
            raise InvalidTopology("unknown role or routing")
        return names[k]


def decode(data: bytes, limits: Limits = DEFAULT) -> Topology:
    """The inverse of encode(); anything but canonical bytes is an error."""
    read = _Reader(data)
    (size,) = read.numbers("Q")
    if size > limits.topology_bytes or size != len(data) - 8:
        raise InvalidTopology("the declared length is wrong")
    (version,), name, fingerprint = read.numbers("H"), read.text(), read.take(32)
    stages, edges = [], []
    for _ in range(read.numbers("H")[0]):
        (stage_id,), own, role, (parallelism,), op, (op_version, n) = read.numbers("H"), read.text(), read.pick(registry.ROLES), read.numbers("H"), read.text(), read.numbers("HH")
        stages.append(Stage(stage_id, own, role, parallelism, op, op_version, tuple((read.text(), read.text()) for _ in range(n))))
    for _ in range(read.numbers("H")[0]):
        edge_id, source, destination = read.numbers("HHH")
        edges.append(Edge(edge_id, source, destination, read.pick(ROUTINGS), read.text()))
    if read.at != len(data):
        raise InvalidTopology("bytes follow the graph")
    return Topology(version, name, tuple(stages), tuple(edges), fingerprint)
