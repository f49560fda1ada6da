"""Schema of a property graph: keys, labels, multiplicities, constraints and indexes, kept as plain data that goes to and from JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

MULTIPLICITIES = ("MULTI", "SIMPLE", "MANY2ONE", "ONE2MANY", "ONE2ONE")
CARDINALITIES = ("SINGLE", "LIST", "SET")
INDEX_STATES = ("INSTALLED", "REGISTERED", "ENABLED", "DISABLED", "DISCARDED", "WRITE_ONLY_ENABLED")


@dataclass
class PropertyKey:
    name: str
    type: str = "string"
    cardinality: str = "SINGLE"
    ttl_seconds: int | None = None
    meta: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.cardinality not in CARDINALITIES:
            raise ValueError(f"no such cardinality: {self.cardinality}")


@dataclass
class VertexLabel:
    name: str
    keys: tuple[str, ...] = ()
    static: bool = False
    partitioned: bool = False
    ttl_seconds: int | None = None


@dataclass
class EdgeLabel:
    name: str
    multiplicity: str = "MULTI"
    connections: tuple[tuple[str, str], ...] = ()
    keys: tuple[str, ...] = ()
    sort_key: tuple[str, ...] = ()
    directed: bool = True
    ttl_seconds: int | None = None

    def __post_init__(self) -> None:
        if self.multiplicity not in MULTIPLICITIES:
            raise ValueError(f"no such multiplicity: {self.multiplicity}")


@dataclass
class Index:
    """kind: composite (equality on all keys), mixed (any predicate), or vertex_centric (per-vertex order of an edge label)."""

    name: str
    kind: str
    keys: tuple[str, ...]
    label: str | None = None
    unique: bool = False
    status: str = "INSTALLED"
    #: Properties that a composite index holds beside its keys, so that a lookup needs no vertex.
    inline: tuple[str, ...] = ()


@dataclass
class GraphSchema:
    """mode: 'infer' adds unknown names on first use, 'none' refuses them, 'ignore' drops unknown properties. Names are one space for keys and edge labels."""

    keys: dict[str, PropertyKey] = field(default_factory=dict)
    vertex_labels: dict[str, VertexLabel] = field(default_factory=dict)
    edge_labels: dict[str, EdgeLabel] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)
    mode: str = "infer"
    constraints: bool = False

    def add_key(self, key: PropertyKey) -> GraphSchema:
        self._free(key.name)
        self.keys[key.name] = key
        return self

    def add_vertex_label(self, label: VertexLabel) -> GraphSchema:
        if label.name in self.vertex_labels:
            raise ValueError(f"vertex label exists: {label.name}")
        self.vertex_labels[label.name] = label
        return self

    def add_edge_label(self, label: EdgeLabel) -> GraphSchema:
        self._free(label.name)
        self.edge_labels[label.name] = label
        return self

    def _free(self, name: str) -> None:
        if name in self.keys or name in self.edge_labels:
            raise ValueError(f"a key or edge label has this name already: {name}")

    def rename(self, old: str, new: str) -> GraphSchema:
        """Types never change, names may."""
        for table in (self.keys, self.vertex_labels, self.edge_labels, self.indexes):
            if old in table:
                item = table.pop(old)
                item.name = new
                table[new] = item
                return self
        raise KeyError(old)

    # What a change may bring ------------------------------------------------------------------------------------------

    def _admit(self, rows, own: tuple[str, ...] | None, reserved: tuple[str, ...], what: str):
        """rows with the properties that may stay; own: those that the label allows, if constraints hold."""
        names = [(c, t) for c, t in rows.dtypes if c not in reserved]
        unknown = [c for c, _ in names if c not in self.keys]
        if unknown and self.mode == "none":
            raise ValueError(f"unknown properties: {unknown}")
        if unknown and self.mode == "ignore":
            return self._admit(rows.drop(*unknown), own, reserved, what)
        for c, t in names:
            self.keys.setdefault(c, PropertyKey(c, t.removeprefix("array<").removesuffix(">"), "LIST" if t.startswith("array") else "SINGLE"))
        if self.constraints and own is not None and self.mode != "infer" and (extra := [c for c, _ in names if c not in own]):
            raise ValueError(f"{what} has no properties {extra}")
        return rows

    def admit_vertices(self, label: str, rows):
        """Rows (a DataFrame with id) that a change adds under the label, as the mode and the constraints let them in."""
        if label not in self.vertex_labels:
            if self.mode == "none":
                raise ValueError(f"no such vertex label: {label}")
            self.vertex_labels[label] = VertexLabel(label)
        v = self.vertex_labels[label]
        out = self._admit(rows, v.keys, ("id",), label)
        v.keys = v.keys if not v.keys or self.mode != "infer" else tuple(dict.fromkeys((*v.keys, *[c for c in out.columns if c != "id"])))
        return out

    def admit_edges(self, label: str, rows):
        if label not in self.edge_labels:
            if self.mode == "none":
                raise ValueError(f"no such edge label: {label}")
            self.edge_labels[label] = EdgeLabel(label)
        return self._admit(rows, self.edge_labels[label].keys or None, ("eid", "src", "dst"), label)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> GraphSchema:
        d = json.loads(text)
        tup = lambda x: {k: tuple(tuple(y) if isinstance(y, list) else y for y in v) if isinstance(v, list) else v for k, v in x.items()}
        return GraphSchema(
            {k: PropertyKey(**tup(v)) for k, v in d.get("keys", {}).items()},
            {k: VertexLabel(**tup(v)) for k, v in d.get("vertex_labels", {}).items()},
            {k: EdgeLabel(**tup(v)) for k, v in d.get("edge_labels", {}).items()},
            {k: Index(**tup(v)) for k, v in d.get("indexes", {}).items()},
            d.get("mode", "infer"),
            d.get("constraints", False),
        )
