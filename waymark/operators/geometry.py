"""Polylines: lengths, interpolation, snapping of nodes to lines."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import haversine_m

GEOJSON = "type STRING, coordinates ARRAY<ARRAY<DOUBLE>>"
EARTH_M = 6_371_000.0
SNAP_M, GUARD_M, GUARD_SHARE, SAME_PLACE = 30.0, 2.0, 0.01, 1e-6


def coordinates(geojson):
    """[[lon, lat], ..] of a LineString text; NULL if it is none."""
    return F.from_json(geojson, GEOJSON)["coordinates"]


def length_km(points):
    """Length along [[lon, lat], ..] in km."""
    n = F.size(points)
    steps = F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), lambda a, b: haversine_m(a[1], a[0], b[1], b[0]))
    return F.when(n < 2, 0.0).otherwise(F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)) / 1000.0


def bearing(lat_u, lon_u, lat_v, lon_v):
    """sin and cos of the planar angle from u to v, in degrees of longitude and latitude."""
    angle = F.atan2(lat_v - lat_u, lon_v - lon_u)
    return F.sin(angle), F.cos(angle)


def box_overlaps(points, west: float, south: float, east: float, north: float):
    """Whether the bounding box of [[lon, lat], ..] meets a given box."""
    lon, lat = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return (F.array_max(lon) >= west) & (F.array_min(lon) <= east) & (F.array_max(lat) >= south) & (F.array_min(lat) <= north)


def planar(points: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """Azimuthal equidistant projection around origin, in metres."""
    lon, lat, lon0, lat0 = *np.radians(points).T, *np.radians(origin)
    cos_c = np.clip(np.sin(lat0) * np.sin(lat) + np.cos(lat0) * np.cos(lat) * np.cos(lon - lon0), -1, 1)
    c = np.arccos(cos_c)
    k = np.where(c < 1e-12, 1.0, c / np.maximum(np.sin(c), 1e-12))
    return EARTH_M * np.column_stack([k * np.cos(lat) * np.sin(lon - lon0), k * (np.cos(lat0) * np.sin(lat) - np.sin(lat0) * np.cos(lat) * np.cos(lon - lon0))])


def project(line: np.ndarray, point: np.ndarray) -> tuple[float, float]:
    """(distance to the line, place along it) of a point, all planar."""
    seg = np.diff(line, axis=0)
    length = np.hypot(*seg.T)
    t = np.clip(((point - line[:-1]) * seg).sum(1) / np.maximum(length**2, 1e-18), 0, 1)
    gap = np.hypot(*(line[:-1] + seg * t[:, None] - point).T)
    k = int(gap.argmin())
    return float(gap[k]), float(length[:k].sum() + t[k] * length[k])


def point_at(line, share: float) -> tuple[float, float] | None:
    """The point at a share of a polyline's planar length."""
    p = np.asarray(line, float)
    if not len(p):
        return None
    cum = np.append(0.0, np.cumsum(np.hypot(*np.diff(p, axis=0).T))) if len(p) > 1 else np.zeros(1)
    if cum[-1] == 0:
        return tuple(p[0])
    at = min(max(share, 0.0), 1.0) * cum[-1]
    return float(np.interp(at, cum, p[:, 0])), float(np.interp(at, cum, p[:, 1]))


def interpolate(line, share):
    """Column [lon, lat] at a share of the line's length."""

    @F.pandas_udf("array<double>")
    def run(line: pd.Series, share: pd.Series) -> pd.Series:
        return pd.Series([None if pt is None or pd.isna(s) else point_at([list(x) for x in pt], float(s)) for pt, s in zip(line, share, strict=True)])

    return run(line, share)


def snap(points: list[list[float]], begin: int, end: int, nodes: list[tuple[int, float, float]], eps_m: float = SNAP_M) -> tuple[list[list[float]], list[int | None]]:
    """A section's vertices with the nodes on it: ends forced, equal places matched, then near nodes inserted.

    nodes: (op_id, lon, lat). A node near the line is projected unless it lies within the guard at
    an end; one that falls on a vertex takes that vertex.
    """
    vertices: list[list] = [[*p, None] for p in points]
    if len(vertices) < 2:
        return points, [None] * len(points)
    vertices[0][2], vertices[-1][2] = begin, end
    used, exact = {begin, end}, {}
    for op, lon, lat in nodes:
        exact.setdefault((round(lon, 9), round(lat, 9)), []).append(op)
    for v in vertices[1:-1]:
        found = next((op for op in exact.get((round(v[0], 9), round(v[1], 9)), ()) if op not in used), None)
        if found is not None:
            v[2] = found
            used.add(found)
    xy = np.array([v[:2] for v in vertices])
    origin = xy.mean(0)
    line = planar(xy, origin)
    along = np.append(0.0, np.cumsum(np.hypot(*np.diff(line, axis=0).T)))
    guard, extra = min(GUARD_M, GUARD_SHARE * along[-1]), []
    for op, lon, lat in sorted(nodes):
        if op in used:
            continue
        gap, at = project(line, planar(np.array([[lon, lat]]), origin)[0])
        if gap > eps_m or at <= guard or at >= along[-1] - guard:
            continue
        near = int(np.abs(along - at).argmin())
        if abs(along[near] - at) <= SAME_PLACE and vertices[near][2] is None:
            vertices[near][2] = op
        else:
            extra.append((at, op))
        used.add(op)
    every = [(a, v[0], v[1], v[2]) for a, v in zip(along, vertices, strict=True)]
    every += [(at, float(np.interp(at, along, xy[:, 0])), float(np.interp(at, along, xy[:, 1])), op) for at, op in extra]
    every.sort(key=lambda e: e[0])
    return [[x, y] for _, x, y, _ in every], [op for *_, op in every]


def snap_sections(sections: DataFrame, nodes: DataFrame, eps_m: float = SNAP_M) -> DataFrame:
    """sections(line_section_id, op_begin_id, op_end_id, points) with vertices and matched_op_node_ids.

    Candidates come by an equi join on grid cells of the padded bounding box, so a section only
    sees the nodes around it; one section is one row.
    """
    cell = 0.05
    pad = eps_m / 111_000 * 2
    lon, lat = F.transform("points", lambda p: p[0]), F.transform("points", lambda p: p[1])
    grid = lambda c: F.floor(c / cell).cast("int")
    cells = lambda v: F.sequence(grid(F.array_min(v) - pad), grid(F.array_max(v) + pad))
    s = sections.withColumn("cx", F.explode(cells(lon))).withColumn("cy", F.explode(cells(lat)))
    n = nodes.where("lat is not null and lon is not null").select(F.col("op_id").alias("n_op"), F.col("lon").alias("n_lon"), F.col("lat").alias("n_lat"), grid(F.col("lon")).alias("nx"), grid(F.col("lat")).alias("ny"))
    near = s.join(n, (F.col("cx") == F.col("nx")) & (F.col("cy") == F.col("ny")), "left").groupBy("line_section_id", "op_begin_id", "op_end_id", "points")
    near = near.agg(F.array_sort(F.collect_set(F.when(F.col("n_op").isNotNull(), F.struct("n_op", "n_lon", "n_lat")))).alias("near"))

    @F.pandas_udf("vertices array<array<double>>, matched_op_node_ids array<bigint>")
    def run(points: pd.Series, begin: pd.Series, end: pd.Series, near: pd.Series) -> pd.DataFrame:
        rows = [snap([list(p) for p in pt], int(b), int(e), [(x["n_op"], x["n_lon"], x["n_lat"]) for x in n], eps_m) for pt, b, e, n in zip(points, begin, end, near, strict=True)]
        return pd.DataFrame({"vertices": [r[0] for r in rows], "matched_op_node_ids": [r[1] for r in rows]})

    out = near.withColumn("_s", run("points", "op_begin_id", "op_end_id", "near"))
    return out.select("line_section_id", "op_begin_id", "op_end_id", "_s.vertices", "_s.matched_op_node_ids")


MOST_EDGES = 200_000


def shipped_edges(links) -> list[tuple[int, int]]:
    """The (u, v) pairs of a network that is small enough for one dense matrix; a larger one is an error."""
    rows = links.select("u_node_id", "v_node_id").limit(MOST_EDGES + 1).collect()
    if len(rows) > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} links do not fit one dense matrix")
    return [(r.u_node_id, r.v_node_id) for r in rows]


def sub_line(points, start, end):
    """The part of a polyline (array) between two 0-based vertices, in the direction from the first to the second."""
    low, high = F.least(start, end), F.greatest(start, end)
    part = F.slice(points, (low + 1).cast("int"), (high - low + 1).cast("int"))
    return F.when(start <= end, part).otherwise(F.reverse(part))


def laplacian_embedding(edges: list[tuple[int, int]], dim: int = 8) -> dict[int, list[float]]:
    """Rows of the first eigenvectors of the normalised Laplacian, scaled to length 1. The network is small: its
    nodes must fit one matrix. Signs are arbitrary."""
    nodes = sorted({x for e in edges for x in e})
    if len(nodes) > 20_000:
        raise ValueError(f"{len(nodes)} nodes do not fit one dense matrix")
    at = {n: i for i, n in enumerate(nodes)}
    a = np.zeros((len(nodes),) * 2)
    for u, v in edges:
        if u != v:
            a[at[u], at[v]] = a[at[v], at[u]] = 1.0
    d = a.sum(1)
    s = 1 / np.sqrt(np.maximum(d, 1e-12))
    values, vectors = np.linalg.eigh(np.diag((d > 0).astype(float)) - a * s[:, None] * s[None, :])
    use = vectors[:, values > 1e-12][:, :dim]
    use = np.pad(use, ((0, 0), (0, max(0, dim - use.shape[1]))))
    norm = np.linalg.norm(use, axis=1, keepdims=True)
    return dict(zip(nodes, (use / np.where(norm > 0, norm, 1)).tolist(), strict=True))


