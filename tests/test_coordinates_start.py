"""The beginnings by which coordinates are searched lose none of the forms."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillspark.operators import extraction as ex

PARTS = ["45", "4", "122.3", "-", "°", "N", "S", "E", "W", ", ", " ", "(", ")", "[", "]", "SU", "ab", "1234", "123456", "1234567", "12345678", "'", "′", "30", ".5", "m", "\n", "٤٥", " ", "é", "x"]
FORMS = ["45.5°N, 122.3°W", "45.5, -122.3", "45°30'45\"N, 122°45'30\"W", "45.5N, 122.3W", "45N, 122W", "45 30 N, 122 45 W", "( 45.5, -122.3 )", "45°30′N, 122°45′W", "45N 123456 7890123", "45N123456", "40-50°N, 120-130°W", "N45.5, W122.3", "[ -45.5, 122.3]", "45.5°N 122.3°W 1500m", "SU 1234 5678", "SU12345678", "SU-1234-5678", "1234N123456W", "123456N 123456W", "12345678NW"]


def test_hits_are_the_same(spark):
    rng = random.Random(5)
    texts = [*FORMS, *(f"at {x} in" for x in FORMS), *("".join(rng.choices(PARTS, k=rng.randint(1, 25))) for _ in range(4000)), "none", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    every = "|".join(ex.COORDINATES)
    old, new = (F.regexp_extract_all("t", F.lit(f"(?U){p}"), F.lit(0)) for p in (every, f"{ex.COORDINATES_START}(?:{every})"))
    rows = df.select("t", old.alias("old"), new.alias("new"), ex.has_coordinates(F.col("t")).alias("has")).collect()
    assert [r for r in rows if r.old != r.new] == [] and sum(bool(r.old) for r in rows) > 100
    assert all(r.has is False for r in rows if not r.old)
    assert {r.t for r in rows if r.t in FORMS and not r.old} == set()
