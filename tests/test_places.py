"""Coordinates and outlines against brute force."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import places as pl


def test_coordinates(spark):
    rows = [("at 45.5°N, 122.3°W and 10 S 20.25 E", [(45.5, -122.3), (-10.0, 20.25)]), ("45°30'N 122°45'30\"W", [(45.5, -(122 + 45 / 60 + 30 / 3600))]), ("(-33.92, 18.42); 1.5, 2", [(-33.92, 18.42)]), ("95.0N, 200.0E 12.5, 190.0", []), (None, []), ("12 NE of", [])]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string").coalesce(1)
    got = [[(c.lat, c.lon) for c in r.c] for r in df.select(pl.coordinates(F.col("t")).alias("c")).collect()]
    assert got == [[pytest.approx(p) for p in ps] for _, ps in rows]
    long = spark.createDataFrame([("45N " * 250_000,), ("45.5, " * 160_000,), ("1°" * 300_000,)], "t string")
    assert {r.n for r in long.select(F.size(pl.coordinates(F.col("t"))).alias("n")).collect()} == {0, 80_000}


@pytest.mark.parametrize("size", [1.0, 0.5, 3.0])
def test_points_in_outlines(spark, size):
    rng = np.random.default_rng(6)
    rings = {"none": [(0, 0), (1, 1)], "square": [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], "notch": [(-5, -5), (5, -5), (5, 5), (0, -2), (-5, 5)]}
    for k in range(12):
        turn = np.sort(rng.random(9)) * 2 * np.pi
        far = rng.uniform(0.3, 6, 9)
        centre = rng.uniform(-8, 8, 2)
        rings[f"star{k}"] = [tuple(map(float, centre + f * np.array([np.cos(a), np.sin(a)]))) for a, f in zip(turn, far)]
    points = np.concatenate([rng.uniform(-12, 12, (3_000, 2)), np.stack(np.meshgrid(np.arange(-6, 7), np.arange(-6, 7)), -1).reshape(-1, 2).astype(float)])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)] + [(-1, None, 1.0)], "id long, x double, y double")
    outlines = spark.createDataFrame([(n, [(float(x), float(y)) for x, y in r]) for n, r in rings.items()] + [("null", None)], "name string, ring array<struct<x:double,y:double>>")
    got = {(r.id, r.place) for r in pl.located(df, "x", "y", outlines, "name", "ring", size=size).collect()}
    want = {(i, n) for n, r in rings.items() if len(r) > 2 for i in np.nonzero(pl._inside(points[:, 0], points[:, 1], np.array(r, float)))[0].tolist()}
    assert got == want


def test_outlines_of_geojson(spark, tmp_path):
    from quillspark.sources import files as fl

    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    holed = {"type": "Feature", "properties": {"name": "A", "n": 1}, "geometry": {"type": "Polygon", "coordinates": [square(0, 10), square(2, 4), square(6, 8)]}}
    several = {"type": "Feature", "properties": {"name": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(20, 21)], [square(30, 31)]]}}
    point = {"type": "Feature", "properties": {"name": "C"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    none = {"type": "Feature", "properties": {"name": "D"}, "geometry": None}
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, (holed, several, point, none))) + "\n\n")
    (tmp_path / "all.json").write_text(json.dumps({"type": "FeatureCollection", "features": [holed, several, point, none]}))
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 7.0, 7.0), (4, 5.0, 5.0), (5, 20.5, 20.5), (6, 30.5, 30.5), (7, 9.0, 3.0)], "id long, x double, y double")
    for file in ("lines.json", "all.json"):
        outlines = fl.read_outlines(spark, f"file://{tmp_path}/{file}", "name")
        assert sorted((r.name, r.part) for r in outlines.collect()) == [("A", 0), ("B", 0), ("B", 1)]
        got = sorted((r.id, r.place) for r in pl.located(points, "x", "y", outlines, "name", "ring").collect())
        assert got == [(1, "A"), (4, "A"), (5, "B"), (6, "B"), (7, "A")]
