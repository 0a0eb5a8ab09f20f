"""Paged services: halved ranges, cursors, failures, dead letters and their second reading."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillspark.sources import paged

FIELDS = "id long, name string"


def numbers(options: dict, request: dict) -> dict:
    """Ids year * 1000 + k of ``size`` records a year; ``broken`` lists offsets that always fail and
    ``odd`` an offset with a value of another type."""
    ids = [y * 1000 + k for y in range(request.get("from", 0), request.get("to", -1) + 1) for k in range(int(options["size"]))]
    if "cursor" in request:
        at = 0 if request["cursor"] == "*" else int(request["cursor"])
    else:
        at = request["offset"]
    if str(at) in options.get("broken", "").split(","):
        raise TimeoutError(f"no answer at {at}")
    if options.get("refused") == str(at):
        raise paged.Refused("not allowed")
    page = [{"id": i, "name": f"n{i}"} for i in ids[at : at + request["limit"]]]
    if options.get("odd") == str(at):
        page[0]["id"] = "none"
        del page[1]["name"]
    more = at + request["limit"] < len(ids)
    return {"records": page, "total": len(ids)} if "offset" in request else {"records": page, "next": str(at + request["limit"]) if more else None}


def every(first, last, size):
    return sorted(y * 1000 + k for y in range(first, last + 1) for k in range(size))


def requests(options, request):
    return list(paged.pages(numbers, {"limit": "10", "pause": "0", "attempts": "2", **options}, request))


@pytest.mark.parametrize("paging", paged.PAGINGS)
@pytest.mark.parametrize("size", [0, 5, 10, 37])
def test_all_records_come_once(paging, size):
    got = requests({"size": str(size), "paging": paging}, {"from": 2000, "to": 2002})
    assert [r["id"] for _, rs, e in got for r in rs] == every(2000, 2002, size) and all(e is None for *_, e in got)


def test_ranges_are_halved_where_the_service_ends():
    got = requests({"size": "37", "window": "60"}, {"from": 2000, "to": 2004})
    assert sorted(r["id"] for _, rs, _ in got for r in rs) == every(2000, 2004, 37)
    assert {(q["from"], q["to"]) for q, rs, _ in got if rs} == {(y, y) for y in range(2000, 2005)}
    got = requests({"size": "37", "window": "20"}, {"from": 2000, "to": 2000})
    assert len([r for _, rs, _ in got for r in rs]) == 20 and got[-1][2] == "the service ends at 20 records" and got[-1][0]["offset"] == 20


def test_a_failing_page():
    got = requests({"size": "37", "broken": "10"}, {"from": 2000, "to": 2000})
    bad = [(q, e) for q, _, e in got if e]
    assert len(bad) == 1 and bad[0][0]["offset"] == 10 and bad[0][0]["rest"] is False and bad[0][1] == "TimeoutError: no answer at 10"
    assert len([r for _, rs, _ in got for r in rs]) == 27
    again = requests({"size": "37"}, bad[0][0])
    assert [r["id"] for _, rs, _ in again for r in rs] == [2000 * 1000 + k for k in range(10, 20)]
    for paging in ("empty", "cursor"):  # where no total is known, the rest is open
        got = requests({"size": "37", "broken": "10", "paging": paging}, {"from": 2000, "to": 2000})
        assert got[-1][0]["rest"] is True
        again = requests({"size": "37", "paging": paging}, got[-1][0])
        assert sorted(r["id"] for x in (got, again) for _, rs, _ in x for r in rs) == every(2000, 2000, 37)


def test_attempts_and_pauses(monkeypatch):
    asked, slept = [], []
    monkeypatch.setattr(paged.time, "sleep", slept.append)

    def flaky(options, request):
        asked.append(request)
        if len(asked) < 3:
            raise OSError("busy")
        return {"records": []}

    assert paged.answered(flaky, {"attempts": "4", "pause": "2"}, {}) == ({"records": []}, None) and slept == [2, 4]
    assert paged.answered(numbers, {"size": "1", "refused": "0"}, {"offset": 0, "limit": 1})[1] == "Refused: not allowed" and len(slept) == 2


def test_source(spark):
    options = {"size": "37", "first": 2000, "last": 2009, "years": 4, "limit": 10, "attempts": 2, "pause": 0}
    spark.sparkContext.addPyFile(__file__)  # the workers import the service from here
    fetch = "test_paged:numbers"
    df = paged.read_pages(spark, FIELDS, fetch, **options, broken="20", odd="30")
    assert df.rdd.getNumPartitions() == 3
    rows = df.collect()
    dead = [r for r in rows if r.error]
    assert {r.error.split(":")[0] for r in dead if r.error.startswith("Timeout")} == {"TimeoutError"} and len(dead) == 6
    good = [r.id for r in rows if not r.error]
    assert len(good) == len(set(good)) and all(r.id is None and r.name is None for r in dead)
    assert sum(r.name is None for r in rows if not r.error) == 3  # a field that the record lacks
    again = paged.read_pages(spark, FIELDS, fetch, requests=paged.failed(df), size="37", limit=10).collect()
    assert not [r for r in again if r.error]
    assert sorted({r.id for r in again} | set(good)) == every(2000, 2009, 37)
    with pytest.raises(ValueError):
        paged.failed(df, most=1)
    assert json.loads(paged.failed(df.where(F.lit(False)))) == []


def test_articles():
    xml = "<Set total='2'><PubmedArticle><ArticleTitle>A <i>b</i></ArticleTitle><AuthorList><Author><LastName>Ito</LastName><Initials>K</Initials></Author><Author><LastName>Wu</LastName></Author></AuthorList><Journal><Title>J</Title></Journal><AbstractText>One.</AbstractText><AbstractText>Two.</AbstractText></PubmedArticle><PubmedArticle/></Set>"
    assert paged.articles(xml) == [{"title": "A b", "authors": "Ito K; Wu", "doi": None, "year": None, "journal": "J", "abstract": "One. Two."}, {"title": None, "authors": None, "doi": None, "year": None, "journal": None, "abstract": ""}]
