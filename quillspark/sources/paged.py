"""Paged services as a data source: each partition reads ranges of years, page by page.

A service is a function ``fetch(options, request)`` named as ``module:function``; a request has the
years ``from`` and ``to`` and ``offset`` and ``limit``, or ``cursor``, and the answer is a
dictionary with ``records`` (dictionaries), and ``total`` or ``next`` where the service gives them.

* Paging: ``total`` (offsets until the total is reached), ``empty`` (offsets until a page has no
  records) or ``cursor`` (until no next cursor comes).
* A failed request is repeated ``attempts`` times, each time after twice the pause; then it becomes
  a row with ``error`` set and all fields null. With a known total the next page follows; else the
  rest of the range is open, and its ``request`` says so (``rest``).
* Services that end at some offset (``window``) get a range of several years halved until its parts
  fit. Where the service takes ``days``, a single year with more is halved by its days (1 to 366, a
  request then has the first as ``day`` and the last as ``until``). What can't be halved is read as
  far as it goes, and the rest is a row with an error.
* ``failed`` gives the open requests of an earlier reading; read again with ``requests`` they are
  the partitions, so that nothing else is fetched twice.

A lost task reads its range again. Rows are the fields, then ``request`` and ``error``; a field that
a record lacks is null, and values that don't fit their field's type give a row with an error.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quillspark.operators.tables import positioned

Fetch = Callable[[dict, dict], dict]
PAGINGS = ("total", "empty", "cursor")
DAYS = 366


class Refused(Exception):
    """A request that will fail whenever it is repeated."""


class Years(InputPartition):
    def __init__(self, request: dict):
        self.request = request


def answered(fetch: Fetch, options: dict, request: dict) -> tuple[dict | None, str | None]:
    """The answer, or what the last attempt said."""
    attempts, pause = int(options.get("attempts", 4)), float(options.get("pause", 1))
    for attempt in range(attempts):
        try:
            return fetch(options, request), None
        except Refused as e:
            return None, f"{type(e).__name__}: {e}"
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
        if attempt + 1 < attempts:
            time.sleep(pause * 2**attempt)
    return None, error


def halved(request: dict, days: bool) -> list[dict]:
    """The two halves of a range of years or, with ``days``, of the days of a year; none where it is one year or day."""
    first, last = request["from"], request["to"]
    if first < last:
        middle = (first + last) // 2
        return [{"from": first, "to": middle}, {"from": middle + 1, "to": last}]
    day, until = request.get("day", 1), request.get("until", DAYS)
    if not days or day == until:
        return []
    middle = (day + until) // 2
    return [{"from": first, "to": last, "day": a, "until": b} for a, b in ((day, middle), (middle + 1, until))]


def pages(fetch: Fetch, options: dict, request: dict) -> Iterator[tuple[dict, list[dict], str | None]]:
    """(request, records, error) of each page from the request on, of that page alone if ``rest`` is false."""
    paging, window = options.get("paging", "total"), int(options.get("window", 0))
    days = str(options.get("days", False)).lower() == "true"
    request, only, total = dict(request), request.get("rest") is False, None
    request.pop("rest", None)
    if paging == "cursor":
        request.setdefault("cursor", "*")
    else:
        request.setdefault("offset", 0)
    request.setdefault("limit", int(options.get("limit", 200)))
    while True:
        answer, error = answered(fetch, options, request)
        if error is not None:
            known = paging == "total" and total is not None
            yield request | {"rest": not (known or only)}, [], error
            if only or not known:
                return
            records, following = [], None
        else:
            records, following, total = answer.get("records") or [], answer.get("next"), answer.get("total", total)
            halves = halved(request, days) if paging == "total" and window and total > window and request["offset"] == 0 else []
            if halves:
                for half in halves:
                    yield from pages(fetch, options, half)
                return
            yield request, records, None
        if only or paging == "empty" and not records or paging == "cursor" and not following:
            return
        if paging == "cursor":
            request = request | {"cursor": following}
            continue
        request = request | {"offset": request["offset"] + request["limit"]}
        if paging == "total" and (total is None or request["offset"] >= total):
            return
        if window and request["offset"] >= window:
            yield request | {"rest": True}, [], f"the service ends at {window} records"
            return


def named(path: str) -> Fetch:
    module, _, function = path.partition(":")
    return getattr(importlib.import_module(module), function)


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, {k.lower(): v for k, v in options.items()}
        if self.options.get("paging", "total") not in PAGINGS:
            raise ValueError(f"paging is one of {', '.join(PAGINGS)}")

    def partitions(self) -> list[InputPartition]:
        if "requests" in self.options:
            return [Years(r) for r in json.loads(self.options["requests"])]
        first, last, step = (int(self.options[k]) for k in ("first", "last", "years"))
        return [Years({"from": y, "to": min(y + step - 1, last)}) for y in range(first, last + 1, step)]

    def read(self, partition: Years) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, fetch = to_arrow_schema(self.schema), named(self.options["fetch"])
        fields = self.schema.names[:-2]
        for request, records, error in pages(fetch, self.options, partition.request):
            told, rows = json.dumps(request, sort_keys=True), []
            if error is not None:
                rows.append({"request": told, "error": error})
            for record in records:
                row = {f: record.get(f) for f in fields} | {"request": told, "error": None}
                try:  # a value of another type fails alone
                    pa.RecordBatch.from_pylist([row], schema=kind)
                except (pa.ArrowInvalid, pa.ArrowTypeError) as e:
                    row = {"request": told, "error": f"record {json.dumps(record, default=str)[:500]}: {e}"}
                rows.append(row)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kind)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, dict(self.options))


def read_pages(spark: SparkSession, fields: str, fetch: str, **options) -> DataFrame:
    """The records of a service, with ``request`` and ``error``. ``first``, ``last`` and ``years`` give
    the partitions, or ``requests``, those of an earlier reading that failed."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").schema(f"{fields}, request string, error string").options(fetch=fetch, **options).load()


def failed(df: DataFrame, most: int = 10_000) -> str:
    """The requests that failed as the ``requests`` of a new reading; raises beyond ``most``, as
    a service that fails so often is down."""
    rows = [r.request for r in df.where("error is not null").select("request").distinct().limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} requests failed")
    return json.dumps([json.loads(r) for r in rows])


# --- recorded answers -------------------------------------------------------------------------
RANGE = ("from", "to", "day", "until")


def _filesystem(uri: str):
    from pyarrow import fs

    scheme, mark, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}://{rest}" if mark else "file://" + uri.removeprefix("file:"))


def recorded(options: dict, request: dict) -> dict:
    """A service that answers from a folder as ``record`` wrote it."""
    from pyarrow.fs import FileSelector

    fs, top = _filesystem(options["folder"])
    page = f"{top}/page=" + "-".join(str(request[k]) for k in (*RANGE, "offset") if k in request)
    files = [f.path for f in fs.get_file_info(FileSelector(page)) if f.base_name.startswith("part-")]
    with fs.open_input_stream(files[0]) as f:
        text = f.read().decode()
    if options.get("format") == "xml":
        return {"records": articles(text), "total": int(ElementTree.fromstring(text).get("total"))}
    return json.loads(text)


def articles(xml: str) -> list[dict]:
    """title, authors, doi, year, journal and abstract of the articles of a page: authors as surname
    and initials, joined by "; "; all parts of the abstract, joined by blanks."""

    def one(article, path):
        found = article.find(path)
        return None if found is None else "".join(found.itertext())

    out = []
    for article in ElementTree.fromstring(xml).iter("PubmedArticle"):
        people = [" ".join(filter(None, (one(a, "LastName"), one(a, "Initials")))) for a in article.iterfind(".//AuthorList/Author")]
        doi = article.find(".//ArticleIdList/ArticleId[@IdType='doi']")
        out.append({
            "title": one(article, ".//ArticleTitle"), "authors": "; ".join(people) or None, "doi": None if doi is None else doi.text,
            "year": one(article, ".//PubDate/Year"), "journal": one(article, ".//Journal/Title"), "abstract": " ".join("".join(t.itertext()) for t in article.iter("AbstractText")),
        })
    return out


def asked(counts: dict[tuple[int, int], int], request: dict, window: int) -> Iterator[tuple[dict, int, bool]]:
    """(request, total, whether its pages are read) of all requests of a reader that halves ranges beyond
    the window, given the records of each year and day."""
    bounds = request["from"], request["to"], request.get("day", 1), request.get("until", DAYS)
    within = {k: n for k, n in counts.items() if bounds[0] <= k[0] <= bounds[1] and bounds[2] <= k[1] <= bounds[3]}
    total = sum(within.values())
    halves = halved(request, True) if total > window else []
    yield request, total, not halves
    for half in halves:
        yield from asked(within, half, window)


def record(df: DataFrame, folder: str, year: str, order: str, ranges: list[tuple[int, int]], limit: int, answer: Callable[[F.Column, F.Column], F.Column], window: int = 0, day: str | None = None) -> None:
    """Write the answers of a service over the rows to a folder, one file a page; ``answer`` makes a
    page's text of its rows (an array of structs in order) and the range's total. Each range also
    gets the page behind its last, which is empty. With ``window`` and ``day`` (the column of the day
    within the year, 1 to 366), these are the answers to a reader that halves ranges: each row is
    written once, and a range beyond the window is answered by its total alone."""
    spark = df.sparkSession
    name = F.concat_ws("-", *[f"_{k}" for k in RANGE]).alias("_asked")
    kind = ", ".join(f"_{k} long" for k in RANGE)
    table = lambda found: [tuple(r.get(k) for k in RANGE) for r in found]
    requests = [{"from": a, "to": b} for a, b in ranges]
    if window and day:
        # as many counts as days
        counts = {(r[0], r[1]): r[2] for r in df.where(F.col(year).isNotNull()).groupBy(year, day).agg(F.count("*")).collect()}
        found = [x for r in requests for x in asked(counts, r, window)]
        requests, wide = [r for r, _, read in found if read], [(*table([r])[0], n) for r, n, read in found if not read]
        wanted = spark.createDataFrame(table(requests), kind)
        dates = wanted.select(name, F.explode(F.sequence("_from", "_to")).alias("_y"), F.coalesce("_day", F.lit(1)).alias("_d"), F.coalesce("_until", F.lit(DAYS)).alias("_u"))
        dates = dates.select("_asked", "_y", F.explode(F.sequence("_d", "_u")).alias("_d"))
        placed = df.join(F.broadcast(dates), (F.col(year) == F.col("_y")) & (F.col(day) == F.col("_d"))).drop("_y", "_d")
    else:
        wanted = spark.createDataFrame(table(requests), kind)
        placed = df.join(F.broadcast(wanted.select(name, "_from", "_to")), F.col(year).between(F.col("_from"), F.col("_to"))).drop("_from", "_to")
        wide = []
    at = positioned(placed, ["_asked", order], "_at")
    starts_at = at.groupBy("_asked").agg(F.min("_at").alias("_first"), F.count("*").alias("_total"))
    offset = (F.floor((F.col("_at") - F.col("_first")) / limit) * limit).alias("_offset")
    columns = F.struct(F.col(order).alias("_order"), *df.columns)
    grouped = at.join(F.broadcast(starts_at), "_asked").groupBy("_asked", offset).agg(F.sort_array(F.collect_list(columns)).alias("_rows"))
    totals = wanted.select(name).join(starts_at.drop("_first"), "_asked", "left").withColumn("_total", F.coalesce("_total", F.lit(0)))
    starts = totals.withColumn("_offset", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_total") / limit) * limit, F.lit(limit).cast("long"))))
    if wide:
        beyond = spark.createDataFrame(wide, f"{kind}, _total long").select(name, "_total", F.lit(0).cast("long").alias("_offset"))
        starts = starts.unionByName(beyond)
    full = starts.join(grouped, ["_asked", "_offset"], "left")
    text = answer(F.coalesce("_rows", F.array().cast(grouped.schema["_rows"].dataType)), F.col("_total"))
    full.select(F.concat_ws("-", "_asked", "_offset").alias("page"), text.alias("value")).write.partitionBy("page").text(folder)


def json_answer(rows: F.Column, total: F.Column) -> F.Column:
    return F.to_json(F.struct(total.alias("total"), F.transform(rows, lambda r: r.dropFields("_order")).alias("records")))


def xml_answer(rows: F.Column, total: F.Column) -> F.Column:
    """Articles with title, surname, initials, doi, year, journal and text; characters that XML can't hold are left out."""

    def element(name: str, value: F.Column, more: str = "") -> F.Column:
        clean = F.regexp_replace(value.cast("string"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
        safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(clean, "&", "&amp;"), "<", "&lt;"), ">", "&gt;"), "\r", "&#13;")
        return F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"<{name}{more}>"), F.regexp_replace(safe, "\n", "&#10;"), F.lit(f"</{name}>")))

    def article(r: F.Column) -> F.Column:
        author = F.concat(F.lit("<AuthorList><Author>"), element("LastName", r["surname"]), element("Initials", r["initials"]), F.lit("</Author></AuthorList>"))
        journal = F.concat(F.lit("<Journal>"), element("Title", r["journal"]), F.lit("<PubDate>"), element("Year", r["year"]), F.lit("</PubDate></Journal>"))
        ids = F.concat(F.lit("<ArticleIdList>"), element("ArticleId", r["doi"], " IdType='doi'"), F.lit("</ArticleIdList>"))
        return F.concat(F.lit("<PubmedArticle>"), element("ArticleTitle", r["title"]), author, journal, ids, element("AbstractText", r["abstract"]), F.lit("</PubmedArticle>"))

    return F.concat(F.lit("<Set total='"), total.cast("string"), F.lit("'>"), F.array_join(F.transform(rows, article), ""), F.lit("</Set>"))
