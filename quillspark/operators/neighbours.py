"""Exact nearest neighbours among all rows of a table, by pivots and the triangle inequality.

Each row goes to its nearest of a few pivots (``PIVOTS`` drawn rows; any would be right). Rows in the
order of pivot and distance from it are cut into blocks of ``BLOCK`` rows, so no block is larger,
whatever cell is hot. A row's neighbours within its own block bound the distance of its true ones; from
a block whose rows lie between ``low`` and ``high`` from a pivot p, a row x is at least
``d(x, p) - high`` and ``low - d(x, p)`` away, so most blocks can't hold any and are not visited.
Rows meet the others in groups of a block and at most about ``BLOCK`` rows that ask for it.

What is broadcast are the pivots and two numbers a block (some 40 bytes for each ``BLOCK`` rows).

Defined cases: rows with a null key or value are left out; equal distances go by key, then by the
row's place; repeated rows are each other's neighbours at distance 0; a table of few rows gives
fewer neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.tables import draw, positioned, shared_folder

PIVOTS, BLOCK = 64, 2_000
#: What bounds give way to, as distances are rounded.
SLACK = 1e-9


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(2))


def _stacked(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.empty((0, width))


def _written(df: DataFrame, name: str) -> DataFrame:
    import uuid

    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nearest_rows(df: DataFrame, key: str, values: list[str], near: int, block: int = BLOCK, pivots: int = PIVOTS, seed: int = 1) -> DataFrame:
    """(id, key, v, neighbours): each row with its ``near`` nearest other rows by the Euclidean distance
    of the values, as structs of distance, key, id and v in that order; id is the row's place."""
    spark, width = df.sparkSession, len(values)
    rows = df.select(F.col(key).cast("long").alias("key"), F.array(*[F.col(v).cast("double") for v in values]).alias("v"))
    rows = rows.where(F.col("key").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    centre = np.array([r.v for r in rows.orderBy(draw("key", seed), "key", "v").limit(pivots).collect()], float).reshape(-1, width)
    if not len(centre):
        centre = np.zeros((1, width))
    sent = spark.sparkContext.broadcast(centre)

    def celled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            far = _distances(_stacked(f["v"], width), sent.value)
            cell = far.argmin(1) if len(far) else np.empty(0, int)
            yield f.assign(cell=cell.astype("int32"), far=far[np.arange(len(far)), cell])

    cells = rows.mapInPandas(celled, "key long, v array<double>, cell int, far double")
    placed = positioned(cells, ["cell", "far", "key", "v"], "id").withColumn("block", F.floor(F.col("id") / block).cast("long"))
    placed = _written(placed.select("id", "key", "v", "cell", "far", "block"), "blocks")

    meta = placed.groupBy("block", "cell").agg(F.min("far").alias("low"), F.max("far").alias("high")).toPandas()
    facts = spark.sparkContext.broadcast({c: meta[c].to_numpy() for c in meta})

    def bounded(f: pd.DataFrame) -> pd.DataFrame:
        """The distance within which a row's neighbours in its own block lie."""
        x = _stacked(f["v"], width)
        bound = np.full(len(x), np.inf)
        if len(x) > near:
            for i in range(0, len(x), 256):
                bound[i : i + 256] = np.partition(_distances(x[i : i + 256], x), near, axis=1)[:, near]  # itself is one
        return f[["id", "key", "v"]].assign(bound=bound)

    asked = placed.groupBy("block").applyInPandas(bounded, "id long, key long, v array<double>, bound double")

    def routed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = facts.value
        for f in frames:
            for i in range(0, len(f), 256):
                part = f.iloc[i : i + 256]
                to_pivot = _distances(_stacked(part["v"], width), sent.value)[:, m["cell"]]
                least = np.maximum(to_pivot - m["high"], m["low"] - to_pivot)
                who, which = np.nonzero(least <= part["bound"].to_numpy()[:, None] * (1 + SLACK) + SLACK)
                out = part.iloc[who].assign(block=m["block"][which])
                yield out.drop_duplicates(["id", "block"])[["block", "id", "v", "bound"]]

    queries = _written(asked.mapInPandas(routed, "block long, id long, v array<double>, bound double"), "visits")
    many = queries.groupBy("block").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = queries.join(F.broadcast(many), "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    copied = placed.join(F.broadcast(many.toDF("block", "times")), "block").select("id", "key", "v", "block", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("part"))

    def met(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        theirs = theirs.sort_values(["key", "id"], kind="stable")
        y, ids, keys = _stacked(theirs["v"], width), theirs["id"].to_numpy(), theirs["key"].to_numpy()
        out = []
        for i in range(0, len(mine) if len(y) else 0, 256):
            part = mine.iloc[i : i + 256]
            far = _distances(_stacked(part["v"], width), y)
            for row, own, bound in zip(far, part["id"].to_numpy(), part["bound"].to_numpy()):
                row[ids == own] = np.inf
                for at in np.argsort(row, kind="stable")[:near]:
                    if row[at] <= bound * (1 + SLACK) + SLACK and row[at] < np.inf:
                        out.append((own, row[at], keys[at], ids[at], y[at].tolist()))
        return pd.DataFrame(out, columns=["id", "distance", "key", "other", "v"])

    theirs = copied.toDF(*copied.columns)  # columns of its own, as both sides come from the same frames
    found = dealt.groupBy("block", "part").cogroup(theirs.groupBy("block", "part")).applyInPandas(met, "id long, distance double, key long, other long, v array<double>")
    best = found.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "key", F.col("other").alias("id"), "v"))), 1, near).alias("neighbours"))
    none = F.array().cast("array<struct<distance:double,key:bigint,id:bigint,v:array<double>>>")
    return placed.select("id", "key", "v").join(best, "id", "left").withColumn("neighbours", F.coalesce("neighbours", none))
