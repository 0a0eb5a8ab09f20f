"""Bloom filters as tables: built by an aggregation, stored, merged, and probed before a lookup.

A filter is a row for each 64 bits that has one set: domain, word and bits. Names set bits by
``bit_or``, so tasks combine what they have before anything is shuffled, filters of equal size merge
by the same aggregate, and an updated dictionary only adds its new names. To probe, each domain's
words become one array, a broadcast of at most ``MOST`` bits a domain, read in place by built-in
functions. A name of the dictionary is never lost; of others about the stated share passes, and
the exact lookup behind the filter decides.

Defined cases: null names are in no filter and null candidates never pass; a domain without names
passes nothing; an empty dictionary passes nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a domain's filter, at most (16 MB); with more names the share that passes grows.
MOST = 1 << 27
#: Domains that may be probed at once.
DOMAINS = 16


@dataclass(frozen=True)
class Shape:
    """Bits of a filter and the number that a name sets."""

    bits: int
    hashes: int


def shape(names: int, false_share: float = 0.01) -> Shape:
    """The size for so many names in the largest domain and the share of others that may pass."""
    wanted = math.ceil(-max(names, 1) * math.log(false_share) / math.log(2) ** 2)
    bits = min(-(-wanted // 64) * 64, MOST)
    return Shape(bits, max(1, round(bits / max(names, 1) * math.log(2))) if bits < MOST else max(1, min(8, round(bits / names * math.log(2)))))


def positions(name: str, of: Shape) -> list[str]:
    """SQL: the bits of a name, by two hashes."""
    first, second = (f"pmod(xxhash64({x}), {of.bits}L)" for x in (name, f"{name}, 'second'"))
    return [f"pmod({first} + {i} * {second}, {of.bits}L)" for i in range(of.hashes)]


def built(names: DataFrame, name: str, domain: str, of: Shape) -> DataFrame:
    """The filters of all domains as rows (domain, word, bits)."""
    rows = names.where(F.col(name).isNotNull()).select(F.col(domain).alias("domain"), F.explode(F.array(*map(F.expr, positions(f"`{name}`", of)))).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    return rows.groupBy("domain", F.expr("at div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))


def merged(*filters: DataFrame) -> DataFrame:
    """The union of filters of one shape."""
    every = filters[0]
    for f in filters[1:]:
        every = every.unionByName(f)
    return every.groupBy("domain", "word").agg(F.bit_or("bits").alias("bits"))


def save(filters: DataFrame, of: Shape, path: str) -> None:
    filters.withColumns({"size": F.lit(of.bits), "hashes": F.lit(of.hashes)}).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, Shape | None]:
    """The filters and their shape, which is None if no domain has a name."""
    df = spark.read.parquet(path)
    row = df.select("size", "hashes").first()
    return df.drop("size", "hashes"), Shape(*row) if row else None


def arrays(filters: DataFrame, of: Shape) -> DataFrame:
    """A row for each domain with its words as one array; raises beyond ``DOMAINS``."""
    domains = filters.select("domain").distinct().limit(DOMAINS + 1).count()
    if domains > DOMAINS:
        raise ValueError(f"more than {DOMAINS} domains: probe some at a time")
    words = filters.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("_s"))
    return words.select("domain", _filled("_s", of).alias("_bits"))


def _filled(sorted_words: str, of: Shape) -> Column:
    """A dense array of a domain's sorted (word, bits): gaps between them become zeros."""
    n = of.bits // 64
    gaps = F.expr(
        f"flatten(transform({sorted_words}, (x, i) -> concat(array_repeat(0L, cast(x.word - if(i = 0, -1L, {sorted_words}[i - 1].word) - 1 as int)), array(x.bits))))"
    )
    return F.concat(gaps, F.expr(f"array_repeat(0L, cast({n - 1} - element_at({sorted_words}, -1).word as int))"))


def may_have(bits: str, name: str, of: Shape) -> Column:
    """Whether all bits of a name are set in a domain's array."""
    every = (f"shiftright(get({bits}, cast({at} div 64 as int)), cast({at} % 64 as int)) & 1L = 1L" for at in positions(name, of))
    return F.coalesce(F.expr(" and ".join(f"({x})" for x in every)), F.lit(False))


def probed(candidates: DataFrame, name: str, domain: str, filters: DataFrame, of: Shape) -> DataFrame:
    """The candidates that may be in the dictionary of their domain: a narrow pass beside the
    broadcast of the filters' arrays."""
    found = arrays(filters, of).withColumnRenamed("domain", "_domain")
    rows = candidates.join(F.broadcast(found), F.col(domain) == F.col("_domain"))
    return rows.where(may_have("_bits", f"`{name}`", of)).drop("_domain", "_bits")


def validated(candidates: DataFrame, name: str, domain: str, filters: DataFrame, of: Shape, exact: DataFrame) -> DataFrame:
    """The candidates that ``exact`` (its columns ``name`` and ``domain``, with what else it says of
    them) has; only those that pass the filter are shuffled for it."""
    passed = probed(candidates, name, domain, filters, of)
    known = exact.withColumnsRenamed({"name": "_name", "domain": "_domain"})
    return passed.join(known, (F.col(name) == F.col("_name")) & (F.col(domain) == F.col("_domain"))).drop("_name", "_domain")
