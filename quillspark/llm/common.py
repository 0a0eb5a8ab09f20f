"""Helpers that several operators share: stored intermediates, clean input columns, hashes."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset (tests, one machine) a folder under the warehouse is taken and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediates within the shared one."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all intermediates of this application, once its results are written: results are
    lazy and read what their operators stored."""
    discard(spark, run_dir(spark))


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it again: it cuts the lineage,
    survives the loss of an executor, and later readers prune columns."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stored intermediates that no pending plan reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Keys with more than one in so many of all rows are joined by broadcast; there are fewer of them.
HEAVY = 20_000


def split_join(rows: DataFrame, facts: DataFrame, key: str, total: int, heavy: int = HEAVY) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row a key and says in ``n`` how many of the
    ``total`` rows the key has.

    Fewer than ``heavy`` keys can have more than ``total / heavy`` rows, whatever the data: these
    are broadcast, so that their rows stay where they are. All others are shuffled, and no key
    brings more than ``total / heavy`` rows into a task. Both sides are read twice.
    """
    most = max(total // heavy, 1)
    many, few = facts.where(F.col("n") > most), facts.where(F.col("n") <= most)
    here = rows.join(F.broadcast(many), key)
    return here.unionByName(rows.join(F.broadcast(many.select(key)), key, "left_anti").join(few, key))


def lean(run):
    """Wrap the function of a ``mapInArrow``: what a worker has freed goes back to the system
    when a task ends, as idle workers stay beside the executor's own memory."""

    def inner(batches):
        yield from run(batches)
        trim()

    return inner


def trim() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Rows of a batch sent to Python: whole texts may be long, so batches are small.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to ``BATCH_ROWS`` rows; it only bounds memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled(df: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows (all rows where there are fewer), chosen by a hash of ``key``:
    the same rows each time, whatever the partitioning. For fitting classifiers only."""
    n = df.count()
    if n <= most:
        return df
    cut = int(most / n * 2**31)
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(2**31)) < cut)


_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """Word (bytes) to a signed 64-bit hash, remembered up to a bound."""

    MOST = 150_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.MOST:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        h -= (h >> 63) << 64
        self[word] = h
        return h


WORD_HASH = WordHash()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORD_HASH.__getitem__, words), np.int64, len(words)).view(np.uint64)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; with fewer words the
    whole sequence is one shingle; without words there is none."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)
