"""Services that end at some offset: a year beyond it is read by its days."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.sources import paged


def dated(options: dict, request: dict) -> dict:
    """Record k of a year, of ``size``, is of day 1 + k % 366."""
    days = range(request.get("day", 1), request.get("until", 366) + 1)
    ids = [y * 1000 + k for y in range(request["from"], request["to"] + 1) for k in range(int(options["size"])) if 1 + k % 366 in days]
    return {"records": [{"id": i} for i in ids[request["offset"] : request["offset"] + request["limit"]]], "total": len(ids)}


@pytest.mark.parametrize("size", [0, 20, 37, 900])
def test_a_year_beyond_the_window_is_read_by_days(size):
    got = list(paged.pages(dated, {"limit": "10", "window": "20", "days": "true", "size": str(size)}, {"from": 2000, "to": 2001}))
    assert all(e is None for *_, e in got)
    assert sorted(r["id"] for _, rs, _ in got for r in rs) == [y * 1000 + k for y in (2000, 2001) for k in range(size)]


def test_a_day_beyond_the_window_is_told():
    got = list(paged.pages(dated, {"limit": "1", "window": "2", "days": True, "size": "999"}, {"from": 2000, "to": 2000, "day": 5, "until": 5}))
    assert len([r for _, rs, _ in got for r in rs]) == 2 and got[-1][2] == "the service ends at 2 records"
    assert got[-1][0] == {"from": 2000, "to": 2000, "day": 5, "until": 5, "offset": 2, "limit": 1, "rest": True}


@pytest.mark.parametrize("window", [30, 1000])
def test_recorded_days(spark, tmp_path, window):
    rows = spark.range(400).select("id", (2000 + F.col("id") % 4).alias("year"), (1 + F.col("id") % 365).alias("day"), F.concat(F.lit("n"), "id").alias("name"))
    rows = rows.unionByName(spark.range(1000, 1045).select("id", F.lit(2005).cast("long").alias("year"), F.lit(366).cast("long").alias("day"), F.lit("x").alias("name")))
    folder = str(tmp_path / "service")
    paged.record(rows, folder, "year", "id", [(2000, 2003), (2004, 2006)], 7, paged.json_answer, window, "day")
    asked = paged.read_pages(spark, "id long, name string", "quillspark.sources.paged:recorded", folder=folder, requests='[{"from": 2000, "to": 2003}, {"from": 2004, "to": 2006}]', limit=7, window=window, days=True, attempts=1)
    got = asked.collect()
    kept = 45 if window > 45 else 35  # of one day: whole pages as far as the service goes
    assert sorted(r.id for r in got if not r.error) == [*range(400), *range(1000, 1000 + kept)]
    assert [r.error for r in got if r.error] == ([] if window > 45 else ["the service ends at 30 records"])
