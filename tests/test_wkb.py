"""Envelopes of well-known binary against boxes of the corners."""

import struct

import pytest

from editpulse.sources import readers, wkb


def polygon(rings, order="<", kind=3, size=2, srid=None):
    flags = kind | (wkb.HAS_SRID if srid else 0)
    data = struct.pack(f"{order}bI", order == "<", flags) + (struct.pack(f"{order}I", srid) if srid else b"")
    data += struct.pack(f"{order}I", len(rings))
    for ring in rings:
        data += struct.pack(f"{order}I", len(ring)) + b"".join(struct.pack(f"{order}{size}d", *(*p, *[7.0] * (size - 2))) for p in ring)
    return data


def multi(parts, order="<"):
    return struct.pack(f"{order}bII", order == "<", 6, len(parts)) + b"".join(parts)


RING = [(1.0, 2.0), (3.0, 2.0), (3.0, 5.5), (1.0, 2.0)]
HOLE = [(1.5, 3.0), (2.0, 3.0), (2.0, 3.5), (1.5, 3.0)]
FAR = [(-9.0, 4.0), (-8.0, 4.0), (-8.0, 9.0), (-9.0, 4.0)]


@pytest.mark.parametrize("order", ["<", ">"])
def test_envelopes_of_both_byte_orders(order):
    assert wkb.envelope(polygon([RING, HOLE], order)) == (1.0, 2.0, 3.0, 5.5)
    other = "<" if order == ">" else ">"
    assert wkb.envelope(multi([polygon([RING], order), polygon([FAR], other)], order)) == (-9.0, 2.0, 3.0, 9.0)


def test_further_coordinates_and_extended_form():
    assert wkb.envelope(polygon([RING], kind=1003, size=3)) == (1.0, 2.0, 3.0, 5.5)
    assert wkb.envelope(polygon([RING], kind=3003, size=4)) == (1.0, 2.0, 3.0, 5.5)
    assert wkb.envelope(polygon([RING], kind=3 | wkb.HAS_Z, size=3)) == (1.0, 2.0, 3.0, 5.5)
    assert wkb.envelope(polygon([FAR], srid=4326)) == (-9.0, 4.0, -8.0, 9.0)


def test_nothing_to_span():
    assert wkb.envelope(None) is wkb.envelope(b"") is wkb.envelope(polygon([])) is wkb.envelope(multi([])) is wkb.envelope(multi([polygon([])])) is None
    with pytest.raises(ValueError, match="geometry type 1"):
        wkb.envelope(struct.pack("<bI2d", 1, 1, 0.0, 0.0))


def test_boundaries_are_read_from_either_form(spark, tmp_path):
    rows = [("AAA", polygon([RING])), ("AAA", multi([polygon([FAR], ">")])), ("x", None), (None, polygon([HOLE]))]
    spark.createDataFrame(rows, "iso string, geometry binary").write.parquet(str(tmp_path / "wkb"))
    got = [tuple(r) for r in readers.read_boundaries(spark, str(tmp_path / "wkb")).collect()]
    boxes = [("AAA", 1.0, 2.0, 3.0, 5.5), ("AAA", -9.0, 4.0, -8.0, 9.0), (None, 1.5, 3.0, 2.0, 3.5)]
    assert sorted(got, key=str) == sorted(boxes, key=str)
    spark.createDataFrame(boxes, "iso string, xmin double, ymin double, xmax double, ymax double").write.parquet(str(tmp_path / "boxes"))
    assert sorted(map(tuple, readers.read_boundaries(spark, str(tmp_path / "boxes")).collect()), key=str) == sorted(boxes, key=str)
