"""Geometry columns to geometries and back, by whole batches: offsets and flat coordinates, no dictionary per position."""

from __future__ import annotations

from itertools import pairwise, repeat

import pyarrow as pa

from .base import Geom, collection

_DIMS = ("x", "y", "z", "m")
POSITION = pa.struct([(d, pa.float64()) for d in _DIMS])


def _lists(column: pa.ListArray, values: list) -> list:
    return [values[a:b] for a, b in pairwise(column.offsets.to_pylist())]


def _tree(members: list[tuple], depth: int) -> Geom:
    """The collection that holds members (path, geometry) below a depth of their paths."""
    groups: dict[int, list[tuple]] = {}
    for m in members:
        if len(m[0]) > depth:
            groups.setdefault(m[0][depth], []).append(m)
    return collection([g[0][1] if len(g[0][0]) == depth + 1 else _tree(g, depth + 1) for _, g in sorted(groups.items())])


def geometries(column: pa.Array) -> list[Geom | None]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kinds, members = column.flatten()
    member = members.values
    path, member_kind, parts = (f for f in member.flatten())
    rings, lines = parts.values, parts.values.values
    axes = [f if f.null_count < len(f) else None for f in lines.values.flatten()]
    n = len(lines.values)
    positions = list(zip(*(repeat(None, n) if a is None else a.to_pylist() for a in axes), strict=True))
    built = _lists(parts, _lists(rings, _lists(lines, positions)))
    made = [Geom(k, p) for k, p in zip(member_kind.to_pylist(), built, strict=True)]
    out = []
    spans = pairwise(members.offsets.to_pylist())
    paths = None
    for kind, (a, b), valid in zip(kinds.to_pylist(), spans, column.is_valid().to_pylist(), strict=True):
        if not valid:
            out.append(None)
        elif kind != "GeometryCollection":
            out.append(made[a])
        else:
            paths = path.to_pylist() if paths is None else paths
            out.append(_tree(list(zip(paths[a:b], made[a:b], strict=True)), 0))
    return out


def column(geoms: list[Geom | None]) -> pa.Array:
    kinds, member_ends, paths, path_ends, member_kinds, part_ends, ring_ends, line_ends, positions = [], [0], [], [0], [], [0], [0], [0], []

    def add(g: Geom, path: list[int]) -> None:
        if g.kind == "GeometryCollection" and g.children:
            for i, c in enumerate(g.children):
                add(c, [*path, i])
            return
        paths.extend(path)
        path_ends.append(len(paths))
        member_kinds.append(g.kind)
        for part in g.parts:
            for ring in part:
                positions.extend(ring)
                line_ends.append(len(positions))
            ring_ends.append(len(line_ends) - 1)
        part_ends.append(len(ring_ends) - 1)

    for g in geoms:
        kinds.append(None if g is None else g.kind)
        if g is not None:
            add(g, [])
        member_ends.append(len(member_kinds))
    axes = zip(*positions, strict=True) if positions else [()] * 4
    position = pa.StructArray.from_arrays([pa.array(a, pa.float64()) for a in axes], fields=list(POSITION))
    nest = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    parts = nest(part_ends, nest(ring_ends, nest(line_ends, position)))
    member = pa.StructArray.from_arrays([nest(path_ends, pa.array(paths, pa.int32())), pa.array(member_kinds, pa.string()), parts], ["path", "type", "parts"])
    return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), nest(member_ends, member)], ["type", "members"], mask=pa.array([g is None for g in geoms], pa.bool_()))
