"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table: a start and a step from
hashes of its name. Shards take turns (as many in a round as their weight) and claim the first
free slot of their order until the table is full. A row's shard is the table entry at its key's
hash: one lookup, and few keys move when a shard comes or goes.

The table has a fixed size (65,537 slots, under 1 MB as rows) whatever the data, so it is
broadcast. Defined cases: a null key has the hash of its null mark and so one fixed shard; rows
that share a key share a shard; an empty table gives an empty result; all columns are kept and a
``shard`` column in the input is replaced (also where it is the key).
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

SLOTS = 65_537
SHARDS = 64


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: Mapping[str, int], slots: int = SLOTS) -> list[str]:
    """The shard of each slot; ``shards`` gives the turns of each shard in a round."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    names = [n for n, w in sorted(shards.items()) if w > 0]
    if not names or len(names) > slots:
        raise ValueError("there must be at least one shard with a weight, and no more than slots")
    at = {n: _number(n, "start") % slots for n in names}
    step = {n: _number(n, "step") % (slots - 1) + 1 for n in names}
    out: list[str | None] = [None] * slots
    left = slots
    while True:
        for n in names:
            for _ in range(shards[n]):
                while out[at[n]] is not None:
                    at[n] = (at[n] + step[n]) % slots
                out[at[n]] = n
                left -= 1
                if not left:
                    return out


def slot(key: str, slots: int = SLOTS) -> F.Column:
    """The slot of a key: the first 60 bits of the MD5 of its text, modulo the table's size."""
    text = F.coalesce(F.col(key).cast("string"), F.lit("␀"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % slots


def assign(df: DataFrame, key: str, shards: Mapping[str, int], slots: int = SLOTS) -> DataFrame:
    """Add ``shard``; a narrow operation apart from the broadcast of the table."""
    spark = df.sparkSession
    plain = df if key == "shard" else df.drop("shard")
    at, name = fresh(df, "slot", "name")
    rows = spark.createDataFrame(list(enumerate(lookup_table(shards, slots))), f"{at} long, {name} string")
    found = plain.join(F.broadcast(rows), slot(key, slots) == F.col(at), "left")
    return found.select(*[c for c in plain.columns if c != "shard"], F.col(name).alias("shard"))


#: Rows of a file, roughly.
FILE_ROWS = 1_000_000


def write(df: DataFrame, key: str, shards: Mapping[str, int], path: str, slots: int = SLOTS, rows: int = FILE_ROWS) -> None:
    """Write one folder per shard; a shard's rows are dealt to tasks by a second hash, so that each
    writes about ``rows`` of them."""
    placed = assign(df, key, shards, slots)
    spread = max(1, -(-placed.count() // (rows * len(shards))))
    dealt = F.pmod(F.xxhash64(*[c for c in placed.columns if c != "shard"]), F.lit(spread))
    placed.repartition(len(shards) * spread, "shard", dealt).write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    shards = {f"shard-{i:03d}": 1 for i in range(SHARDS)}
    return assign(table(spark, sf_dir, "documents"), "doc_id", shards).select("doc_id", "n_chars", "shard")


def sql(shards: Mapping[str, int], slots: int = SLOTS) -> str:
    """The query as SQL: the table comes from ``lookup_table``, the slot from the engine's own MD5."""
    names = ", ".join(f"'{n}'" for n in lookup_table(shards, slots))
    return f"""WITH t AS (SELECT unnest(range({slots})) AS slot, unnest([{names}]) AS shard)
SELECT doc_id, n_chars, shard FROM documents JOIN t ON slot = CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '␀')), 1, 15) AS BIGINT) % {slots}"""


SQL = sql({f"shard-{i:03d}": 1 for i in range(SHARDS)})
