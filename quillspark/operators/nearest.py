"""The nearest of many names by Jaro-Winkler, without comparing them all.

The characters that two strings share bound how many can match, and with the common beginning that
bounds the similarity. The bounds against all candidates of a part come from one operation on
arrays (characters are counted in ``BINS``, which can only raise a bound). Candidates are then
visited from the highest bound on and compared exactly, until the next bound is below the best that
was found: the rest can't be nearer, so the result is exact.

Candidates are broadcast in parts of at most about ``PART`` characters, dealt by a hash; each
part is a narrow pass over the names. In a worker a candidate takes some 150 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import jaro_winkler, octets

#: Characters of candidates in a part, and bins of characters.
PART, BINS = 4_000_000, 32
#: Places to which distances are rounded; equal ones are ties.
PLACES = 9
#: Candidates whose exact similarity is computed between two looks at the bounds.
STEP = 64


def counts(names: list[str]) -> np.ndarray:
    """How many characters of each name fall in each bin."""
    out = np.zeros((len(names), BINS), np.uint16)
    for i, name in enumerate(names):
        codes = np.frombuffer(name.encode("utf-32-le"), np.uint32)
        out[i] = np.bincount(codes % BINS, minlength=BINS)
    return out


class Candidates:
    """Names in their order; ``nearest`` gives the first of the nearest. With ``sql`` bytes are compared,
    as DuckDB does."""

    def __init__(self, names: list[str], sql: bool = False):
        self.names, self.sql = [*map(octets, names)] if sql else names, sql
        names = self.names
        self.sizes = np.fromiter(map(len, names), np.int64, len(names))
        self.bins = counts(names)
        self.starts = np.zeros((len(names), 4), np.uint32)
        for i, name in enumerate(names):
            self.starts[i, : min(4, len(name))] = np.frombuffer(name[:4].encode("utf-32-le"), np.uint32) + 1

    def bounds(self, name: str) -> np.ndarray:
        """At least the similarity with each candidate."""
        if not name:
            return ((self.sizes == 0) & (not self.sql)).astype(float)
        shared = np.minimum(self.bins, counts([name])[0]).sum(1, dtype=np.int64)
        sizes = np.maximum(self.sizes, 1)
        jaro = np.where(shared > 0, (shared / len(name) + shared / sizes + 1) / 3, 0.0)
        start = np.zeros(4, np.uint32)
        start[: min(4, len(name))] = np.frombuffer(name[:4].encode("utf-32-le"), np.uint32) + 1
        same = np.cumprod((self.starts == start) & (start > 0), axis=1).sum(1)
        return jaro + same * 0.1 * (1 - jaro)

    def nearest(self, name: str) -> tuple[float, int, int]:
        """(distance, index, candidates compared)."""
        if self.sql:
            name = octets(name)
        bounds = self.bounds(name)
        order = np.argsort(-bounds, kind="stable")
        best, at, n = 2.0, -1, 0
        slack = 10.0**-PLACES
        for i in order.tolist():
            if 1 - bounds[i] > best + slack:
                break
            n += 1
            d = round(1 - jaro_winkler(name, self.names[i], sql=self.sql), PLACES)
            if d < best or d == best and i < at:
                best, at = d, i
        return best, at, n


_HELD: dict[int, tuple] = {}


def _held(part: Broadcast, sql: bool) -> tuple[pa.Table, Candidates]:
    key = hash((part.value, sql))
    if key not in _HELD:
        _HELD.clear()
        table = pa.ipc.open_stream(part.value).read_all().combine_chunks()
        _HELD[key] = table, Candidates(table.column(0).to_pylist(), sql)
    return _HELD[key]


def nearest(names: DataFrame, key: str, name: str, candidates: DataFrame, candidate: str, order: str, part: int = PART, sql: bool = False) -> DataFrame:
    """(key, distance, candidate, compared): the nearest candidate of each key and how many were
    compared for it; of equally near ones the first in ``order``. A null name, or no candidate,
    gives nulls. With ``sql`` strings are compared as DuckDB compares them (``jaro_winkler``)."""
    spark = names.sparkSession
    some = candidates.select(F.col(candidate).alias("candidate"), F.col(order).alias("order")).where("candidate is not null")
    many = max(1, -(-(some.agg(F.sum(F.length("candidate"))).first()[0] or 0) // part))
    kind = some.schema["order"].dataType.simpleString()

    def sent(k: int) -> Broadcast:
        rows = some.where(F.pmod(F.xxhash64("candidate"), F.lit(many)) == k).orderBy("order", "candidate").toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        return spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def found(broadcast: Broadcast) -> DataFrame:
        def run(batches) -> Iterator[pa.RecordBatch]:
            table, known = _held(broadcast, sql)
            seen: dict[str, tuple] = {}
            for batch in batches:
                hits = []
                for value in batch.column(1).to_pylist():
                    if value is None or not known.names:
                        hits.append((None, None, 0))
                    else:
                        if value not in seen:
                            if len(seen) > 10_000:
                                seen.clear()
                            seen[value] = known.nearest(value)
                        hits.append(seen[value])
                distance, at, n = zip(*hits) if hits else ((), (), ())
                chosen = table.take(pa.array(at, pa.int64())).combine_chunks()
                columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in chosen.columns]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(distance, pa.float64()), columns[1], columns[0], pa.array(n, pa.int64())], ["key", "distance", "order", "candidate", "compared"])

        asked = names.select(F.col(key).alias("key"), F.col(name).cast("string").alias("name"))
        return asked.mapInArrow(run, f"key {asked.schema['key'].dataType.simpleString()}, distance double, order {kind}, candidate string, compared long")

    every = reduce(DataFrame.unionByName, [found(sent(k)) for k in range(many)])
    least = F.min(F.when(F.col("distance").isNotNull(), F.struct("distance", "order", "candidate")))
    first = every.groupBy("key").agg(least.alias("x"), F.sum("compared").alias("compared"))
    return first.select(F.col("key").alias(key), F.col("x.distance").alias("distance"), F.col("x.candidate").alias("candidate"), "compared")
