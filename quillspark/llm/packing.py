"""Best-fit packing of token sequences by minimum bin slack.

The lengths of all pieces are counted (at most ``capacity`` different ones), and the bins are
planned on these counts alone: each bin takes the longest piece left, and a subset-sum dynamic
program over a bitset of reachable sums finds the fullest combination of the lengths left for
the rest of the bin. The combination is then removed, as often as the counts allow. So the plan's
size depends on the capacity and not on the number of pieces; pieces find their places by their
rank within their length.

Defined cases: null text counts as empty (a document is then its end id alone); rows that share a
doc_id or have none are packed each for itself; an empty table gives an empty result; columns
beside the key and the text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, lean, stored, table
from .tokens import encoder

CAPACITY = 1024
END = 2
#: Pieces are ranked in buckets of one in so many of all, and no fewer than these; a bucket has one length.
BUCKETS, BUCKET = 4_096, 256


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece: a document's ids and the
    end id, cut only where it is longer than ``capacity``; the first piece takes what is left over."""

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.append(enc.encode(t.as_py() or ""), np.uint32(end))
                at = 0
                for k in range(-(-len(x) // capacity)):
                    to = at + (capacity if k or len(x) % capacity == 0 else len(x) % capacity)
                    row = (doc, k, at, to - at, zlib.crc32(x[at:to].astype("<u4").tobytes()), x[at:to] if with_ids else None)
                    for c, v in zip(cols, row):
                        c.append(v)
                    at = to
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds)][: 6 if with_ids else 5]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), kind)


def fullest(left: dict[int, int], capacity: int) -> dict[int, int]:
    """How often each length goes into the fullest bin that holds the longest piece left.

    Bit s of the bitset says that the sum s can be reached; lengths go in from the longest, and
    each sum remembers the length that reached it first, so long pieces are preferred.
    """
    longest = max(left)
    uses = {longest: 1}
    room = capacity - longest
    reach, steps, every = 1, [], (1 << room + 1) - 1
    for length in sorted((x for x in left if x <= room), reverse=True):
        shifted = reach
        for times in range(1, min(left[length] - (length == longest), room // length) + 1):
            shifted = shifted << length & every
            new = shifted & ~reach
            if new:
                steps.append((length, times, new))
                reach |= new
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    for length, times, new in reversed(steps):
        if new >> total & 1:
            uses[length] = uses.get(length, 0) + times
            total -= times * length
    return uses


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bins as (uses of each length, number of bins alike) until no piece is left."""
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        uses = fullest(left, capacity)
        times = min(left[x] // n for x, n in uses.items())
        for x, n in uses.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((uses, times))
    return out


def pack(found: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32")) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of 1 to ``capacity``; columns of these names,
    whatever their case, are replaced.

    ``found`` is read three times and should be stored. A length that a third of all rows share
    is ranked in many buckets; the rank goes on over the buckets by their counts.
    """
    spark, found = found.sparkSession, found.drop("sequence_id", "offset")
    bucket, rank, before, n_, share, size = fresh(found, "bucket", "rank", "before", "n", "share", "size")
    rows_of = {r.length: r["count"] for r in found.groupBy("length").count().collect()}  # at most capacity rows
    segments, sequences = [], 0
    done: dict[int, int] = {}
    for uses, times in plan(rows_of, capacity):
        at = 0
        for length, n in sorted(uses.items(), reverse=True):
            segments.append((length, done.get(length, 0), n, sequences, at))
            done[length] = done.get(length, 0) + n * times
            at += n * length
        sequences += times
    seg = np.array(sorted(segments), np.int64).reshape(-1, 5)
    most = max(BUCKET, sum(rows_of.values()) // BUCKETS)
    shares = spark.createDataFrame([(x, -(-n // most)) for x, n in sorted(rows_of.items())], f"{size} long, {share} long")
    placed = found.join(F.broadcast(shares), F.col("length") == F.col(size)).withColumn(bucket, F.pmod(F.xxhash64(*order), F.col(share))).drop(size, share)
    earlier = placed.groupBy("length", bucket).agg(F.count("*").alias(n_))  # at most capacity + BUCKETS rows
    earlier = earlier.select("length", bucket, (F.sum(n_).over(Window.partitionBy("length").orderBy(bucket)) - F.col(n_)).alias(before))
    ranked = placed.withColumn(rank, F.row_number().over(Window.partitionBy("length", bucket).orderBy(*order)) - 1)
    ranked = ranked.join(F.broadcast(earlier), ["length", bucket]).withColumn(rank, F.col(rank) + F.col(before)).select(*found.columns, rank)
    names = found.columns
    wide = 1 << 40  # more than the pieces of one length

    def run(batches):
        keys = seg[:, 0] * wide + seg[:, 1]
        for b in batches:
            length, at_rank = (b.column(c).to_numpy() for c in ("length", rank))
            at = np.searchsorted(keys, length * wide + at_rank, side="right") - 1
            n, first, offset = seg[at, 2], seg[at, 3], seg[at, 4]
            k = at_rank - seg[at, 1]
            out = [b.column(c) for c in names] + [pa.array(first + k // n), pa.array(offset + k % n * length)]
            yield pa.RecordBatch.from_arrays(out, [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return ranked.mapInArrow(lean(run), kinds + ", sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids in order; pieces need ``ids``."""
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    found, _ = stored(pieces(docs, tokenizer, capacity), "pieces")
    return pack(found, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
