"""Points on the map: coordinates read from texts, and the outlines that hold them.

Outlines are rings of (x, y). Each is laid over a grid of ``size``-degree cells: a cell that no edge
touches lies wholly inside or outside, so points there need no test; points of the other cells are
tested against the ring (even-odd rule; of two outlines with a common edge one has the points on it).
Points meet outlines by their cell, an equi-join whose outline side has at most as many rows as the
outlines have cells.

Defined cases: null and impossible coordinates hold no place; a point in several outlines gives a
row for each; rings of fewer than three corners hold nothing, closed and open rings are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: SQL patterns of a latitude and a longitude beside each other: decimal degrees with letters, degrees
#: with minutes and seconds, and signed decimals.
LETTERED = r"(\d{1,2}(?:\.\d{1,10})?)\s?°?\s?([NS])[,;]?\s{0,3}(\d{1,3}(?:\.\d{1,10})?)\s?°?\s?([EW])(?![A-Za-z])"
MINUTES = r"""(\d{1,2})\s?°\s?(\d{1,2})\s?['′]\s?(?:(\d{1,2}(?:\.\d{1,5})?)\s?["″]\s?)?([NS])[,;]?\s{0,3}(\d{1,3})\s?°\s?(\d{1,2})\s?['′]\s?(?:(\d{1,2}(?:\.\d{1,5})?)\s?["″]\s?)?([EW])(?![A-Za-z])"""
SIGNED = r"(?<![\d.-])(-?\d{1,2}\.\d{1,10})\s?,\s?(-?\d{1,3}\.\d{1,10})(?![\d.])"


def coordinates(text: Column) -> Column:
    """An array of (lat, lon) of the coordinates in a text that are possible: those with letters, then
    those with minutes, then signed ones, each in the order of the text."""

    def found(pattern: str, lat, lon) -> Column:
        hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))

        def one(hit: Column) -> Column:
            part = lambda i: F.regexp_extract(hit, "^" + pattern.replace(r"(?<![\d.-])", "").removesuffix("(?![A-Za-z])").removesuffix(r"(?![\d.])"), i)
            return F.struct(lat(part).alias("lat"), lon(part).alias("lon"))

        return F.transform(hits, one)

    number = lambda c: F.coalesce(F.expr("try_cast(null as double)"), c.try_cast("double"))
    signed = lambda value, letter, minus: F.when(letter == minus, -value).otherwise(value)
    degrees = lambda p, i: number(p(i)) + number(p(i + 1)) / 60 + F.coalesce(number(p(i + 2)), F.lit(0.0)) / 3600
    every = F.concat(
        found(LETTERED, lambda p: signed(number(p(1)), p(2), "S"), lambda p: signed(number(p(3)), p(4), "W")),
        found(MINUTES, lambda p: signed(degrees(p, 1), p(4), "S"), lambda p: signed(degrees(p, 5), p(8), "W")),
        found(SIGNED, lambda p: number(p(1)), lambda p: number(p(2))),
    )
    return F.filter(every, lambda c: (F.abs(c["lat"]) <= 90) & (F.abs(c["lon"]) <= 180))


def _inside(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)
    for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, axis=0)):
        if y1 != y2:
            out ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return out


def cells(ring: np.ndarray, size: float) -> list[tuple[int, int, bool]]:
    """(column, row, whole) of the grid's cells that the ring's inside meets."""
    if len(ring) > 1 and (ring[0] == ring[-1]).all():
        ring = ring[:-1]
    if len(ring) < 3:
        return []
    edge: set[tuple[int, int]] = set()
    for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, axis=0)):
        low, high = sorted((x1, x2))
        for c in range(int(np.floor(low / size)), int(np.floor(high / size)) + 1):  # the edge's part in each column
            if x1 == x2:
                ys = (y1, y2)
            else:
                ends = np.clip([c * size, (c + 1) * size], low, high)
                ys = y1 + (y2 - y1) * (ends - x1) / (x2 - x1)
            slack = 1e-9 * max(1.0, abs(y1), abs(y2))  # places on a line belong to both of its cells
            for r in range(int(np.floor((min(ys) - slack) / size)), int(np.floor((max(ys) + slack) / size)) + 1):
                edge |= {(c, r), (c - 1, r)} if c * size >= low - slack and abs(c * size - low) <= slack else {(c, r)}
    (x0, y0), (x1, y1) = np.floor(ring.min(0) / size).astype(int), np.floor(ring.max(0) / size).astype(int)
    columns, rows = (a.ravel() for a in np.meshgrid(np.arange(x0, x1 + 1), np.arange(y0, y1 + 1)))
    inside = _inside((columns + 0.5) * size, (rows + 0.5) * size, ring)
    plain = [(int(c), int(r), True) for c, r, ok in zip(columns, rows, inside) if ok and (c, r) not in edge]
    return plain + [(int(c), int(r), False) for c, r in edge]


def gridded(outlines: DataFrame, name: str, ring: str, size: float = 1.0) -> DataFrame:
    """(name, column, row, whole, ring) of the cells of each outline; whole cells carry no ring."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for n, r in zip(f["name"], f["ring"]):
                corners = np.array([(p["x"], p["y"]) for p in (r if r is not None else [])], float).reshape(-1, 2)
                out += [(n, c, row, whole, None if whole else r) for c, row, whole in cells(corners, size)]
            yield pd.DataFrame(out, columns=["name", "column", "row", "whole", "ring"])

    rows = outlines.select(F.col(name).cast("string").alias("name"), F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("ring"))
    return rows.mapInPandas(run, "name string, column long, row long, whole boolean, ring array<struct<x:double,y:double>>")


#: SQL: the even-odd rule over a ring for the point (px, py).
_RULE = """aggregate(sequence(1, size(ring)), false, (odd, i) -> odd != ((ring[i - 1].y > py) != (ring[i % size(ring)].y > py)
    and px < (ring[i % size(ring)].x - ring[i - 1].x) * (py - ring[i - 1].y) / (ring[i % size(ring)].y - ring[i - 1].y) + ring[i - 1].x))"""


def located(points: DataFrame, x: str, y: str, outlines: DataFrame, name: str, ring: str, into: str = "place", size: float = 1.0) -> DataFrame:
    """The points that an outline holds, each with its name."""
    own = points.columns
    placed = points.withColumns({"px": F.col(x).cast("double"), "py": F.col(y).cast("double")}).where("px is not null and py is not null and not isnan(px) and not isnan(py)")
    placed = placed.withColumns({"column": F.floor(F.col("px") / size), "row": F.floor(F.col("py") / size)})
    hits = placed.join(gridded(outlines, name, ring, size), ["column", "row"]).where(F.col("whole") | F.expr(f"coalesce({_RULE}, false)"))
    return hits.select(*own, F.col("name").alias(into))
