"""Type codes, header layout and canonical schemas of update logs."""

from __future__ import annotations

import struct
from dataclasses import asdict, dataclass

#: Fixed values of the packed format: code, name, bytes, numpy kind, Spark type.
TYPES = {
    0: ("NONE", 0, None, None),
    10: ("UINT8", 1, "<u1", "short"),
    11: ("UINT16", 2, "<u2", "int"),
    12: ("UINT32", 4, "<u4", "long"),
    13: ("UINT64", 8, "<u8", "decimal(20,0)"),
    20: ("INT8", 1, "<i1", "byte"),
    21: ("INT16", 2, "<i2", "short"),
    22: ("INT32", 4, "<i4", "int"),
    23: ("INT64", 8, "<i8", "long"),
    30: ("FLOAT32", 4, "<f4", "float"),
    31: ("FLOAT64", 8, "<f8", "double"),
}
CODES = {name.lower(): code for code, (name, *_) in TYPES.items()}
INSERT, DELETE = 0, 1
HEADER_BYTES = 32
HEADER = struct.Struct("<QQQ5B3x")
LOG = "src long, dst long, ts long"
UPDATES = "step long, src long, dst long, ts long, weight double, op byte"
ARRIVALS = "u long, v long, step long, src long"
INTERVALS = "u long, v long, s0 long, e0 long"


@dataclass
class Header:
    """The eight fields of a packed log."""

    num_vertices: int
    num_unique_edges: int
    total_updates: int
    signal: bool
    vertex_id_type: int
    timestamp_type: int
    directed: bool
    weight_type: int

    @classmethod
    def unpack(cls, data: bytes) -> Header:
        if len(data) < HEADER_BYTES:
            raise ValueError(f"a header has {HEADER_BYTES} bytes; found {len(data)}")
        v, e, n, signal, vid, ts, directed, weight = HEADER.unpack(data[:HEADER_BYTES])
        for code in (vid, ts, weight):
            if code not in TYPES:
                raise ValueError(f"unknown type code {code}")
        return cls(v, e, n, bool(signal), vid, ts, bool(directed), weight)

    def pack(self) -> bytes:
        return HEADER.pack(self.num_vertices, self.num_unique_edges, self.total_updates, self.signal, self.vertex_id_type, self.timestamp_type, self.directed, self.weight_type)

    def as_dict(self) -> dict:
        names = {k: TYPES[getattr(self, k)][0].lower() for k in ("vertex_id_type", "timestamp_type", "weight_type")}
        return asdict(self) | names

    def fields(self) -> list[tuple[str, str]]:
        """(name, numpy kind) of a row's stored fields, in order."""
        out = [("src", TYPES[self.vertex_id_type][2]), ("dst", TYPES[self.vertex_id_type][2])]
        if self.timestamp_type:
            out.append(("ts", TYPES[self.timestamp_type][2]))
        if self.weight_type:
            out.append(("weight", TYPES[self.weight_type][2]))
        if not self.signal:
            out.append(("op", "<u1"))
        return out

    @property
    def row_bytes(self) -> int:
        return sum(int(kind[2:]) for _, kind in self.fields())
