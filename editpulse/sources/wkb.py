"""Envelopes of boundaries stored as well-known binary."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Geometry types of the format, and the flags of its extended form
POLYGON, MULTI_POLYGON = 3, 6
HAS_Z, HAS_M, HAS_SRID = 0x80000000, 0x40000000, 0x20000000

BOX = ("xmin", "ymin", "xmax", "ymax")


def _polygons(data: bytes, at: int = 0) -> Iterator[tuple[np.ndarray, int]]:
    """Corner coordinates (x, y) of every ring from offset ``at`` on, and the offset after it."""
    order = "<" if data[at] == 1 else ">"
    (kind,) = struct.unpack_from(f"{order}I", data, at + 1)
    at += 9 if kind & HAS_SRID else 5
    plain = kind & 0x0FFFFFFF
    size = 2 + (bool(kind & HAS_Z) or plain // 1000 in (1, 3)) + (bool(kind & HAS_M) or plain // 1000 in (2, 3))
    (parts,) = struct.unpack_from(f"{order}I", data, at)
    at += 4
    if plain % 1000 == MULTI_POLYGON:
        for _ in range(parts):
            end = at + 9
            for ring, end in _polygons(data, at):
                yield ring, end
            at = end
    elif plain % 1000 == POLYGON:
        for _ in range(parts):
            (corners,) = struct.unpack_from(f"{order}I", data, at)
            at += 4
            end = at + 8 * size * corners
            yield np.frombuffer(data, f"{order}f8", size * corners, at).reshape(corners, size)[:, :2], end
            at = end
    else:
        raise ValueError(f"boundary of geometry type {plain}; polygons and multi-polygons have an envelope here")


def envelope(data: bytes | None) -> tuple[float, float, float, float] | None:
    """Smallest and largest coordinates of all rings; None for a missing or empty geometry."""
    if not data:
        return None
    rings = [ring for ring, _ in _polygons(data) if len(ring)]
    if not rings:
        return None
    low, high = np.min([r.min(0) for r in rings], axis=0), np.max([r.max(0) for r in rings], axis=0)
    return float(low[0]), float(low[1]), float(high[0]), float(high[1])


def envelopes(boundaries: DataFrame, geometry: str = "geometry") -> DataFrame:
    """The rows of ``boundaries`` with ``xmin, ymin, xmax, ymax`` in place of the geometry column.

    Both byte orders, further coordinates and reference systems of the extended form are read. Rows
    without a geometry, or with one without corners, have no box and are left out.
    """
    kept = [c for c in boundaries.columns if c != geometry]
    layout = ", ".join([*(f"`{c}` {boundaries.schema[c].dataType.simpleString()}" for c in kept), *(f"{c} double" for c in BOX)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = [envelope(data.as_py()) for data in batch.column(geometry)]
            sides = [pa.array([box and box[k] for box in boxes], pa.float64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *sides], names=[*kept, *BOX])

    return boundaries.mapInArrow(run, layout).where(F.col("xmin").isNotNull())
