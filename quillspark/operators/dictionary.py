"""Large dictionaries of names in texts: Aho-Corasick automata in one narrow pass.

Documents stay where they are. The names are dealt by a hash into parts of at most about ``PART``
characters; each part is a broadcast of known size, from which a worker builds an automaton once. An
automaton takes some 20 to 30 bytes a character of names of two words (shared beginnings once), up to
140 of short unlike ones: 100,000 names of 18 characters are 2 MB to send, 50 MB in a worker and half
a second to build. A dictionary of one part is found in one pass; a larger one in a pass a part, in
tasks of their own, so that no worker ever holds more than one automaton (``HELD``) of bounded size.

A text of n characters is read once a part, whatever the number of names; all occurrences are found,
overlapping ones too. Defined cases: null text has no names; null and empty names are left out and
repeated ones count once; a name that occurs repeatedly in a text is given once, with its number; an
empty dictionary finds nothing. The rows keep their columns and their number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import ngrams, preprocessed, run_lengths, tokens
from quillspark.operators.tables import exploded, repeated_keys

#: Characters of names in a part.
PART = 4_000_000
#: Automata that a worker holds.
HELD = 1
#: What stands between and around the tokens of texts and names that are compared by whole tokens.
GAP = " "


@dataclass
class Dictionary:
    """Names in broadcast parts; ``whole`` names match whole tokens only."""

    parts: list[Broadcast]
    whole: bool
    names: int
    characters: int


def dictionary(names: DataFrame, name: str, whole: bool = True, part: int = PART) -> Dictionary:
    """The distinct names of a column. Each part is collected for its broadcast, and has about
    ``part`` characters: parts are dealt by a hash of the names, as many as the sum asks for."""
    distinct = names.select(F.col(name).alias("name")).where(F.length("name") > 0).distinct()
    n, characters = distinct.agg(F.count("*"), F.coalesce(F.sum(F.length("name")), F.lit(0))).first()
    spark, many = names.sparkSession, max(1, -(-characters // part))
    dealt = distinct.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(many)))
    if many > 1:  # several parts: the distinct names are made once
        from quillspark.sources.files import scratch

        path = scratch(spark, "names")
        dealt.write.parquet(path)
        dealt = spark.read.parquet(path)
    packed = (dealt.where(F.col("part") == k).select("name").toArrow().column(0) for k in range(many))
    return Dictionary([spark.sparkContext.broadcast(_bytes(p)) for p in packed], whole, n, characters)


def _bytes(names: pa.ChunkedArray) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({"name": names})
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def automaton(names: list[str], whole: bool):
    """The automaton of names; words are their own values."""
    import ahocorasick

    made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, name in enumerate(names):
        made.add_word(f"{GAP}{name}{GAP}" if whole else name, i)
    if names:
        made.make_automaton()
    return made


_HELD: dict[int, tuple] = {}


def _held(part: Broadcast, whole: bool) -> tuple[list[str], object]:
    """A worker's names and automaton of a part, kept between tasks."""
    key = hash((part.value[:64], len(part.value), hash(part.value), whole))
    if key not in _HELD:
        while len(_HELD) >= HELD:
            _HELD.pop(next(iter(_HELD)))
        names = pa.ipc.open_stream(part.value).read_all().column(0).to_pylist()
        _HELD[key] = names, automaton(names, whole)
    return _HELD[key]


def spaced(text: Column) -> Column:
    """A text's tokens (lower case, without punctuation and digits) as whole names meet them."""
    found = F.array_join(tokens(preprocessed(text)), GAP)
    return F.concat(F.lit(GAP), found, F.lit(GAP))


def with_names(df: DataFrame, text: Column, found: Dictionary, into: str = "names") -> DataFrame:
    """``df`` with an array of (name, n): the names in the text and how often each occurs. Raises for
    a dictionary of several parts, whose names ``pairs`` finds part by part.

    For whole names ``text`` has single blanks around and between its tokens (``spaced`` makes
    that); else names are found anywhere in it, letter for letter.
    """
    if len(found.parts) > 1:
        raise ValueError("the dictionary has several parts: take pairs()")
    return _with_part(df, text, found.parts[0], found.whole, into)


def _with_part(df: DataFrame, text: Column, part: Broadcast, whole: bool, into: str) -> DataFrame:
    kept = [c for c in df.columns if c.lower() != into.lower()]
    kind = pa.list_(pa.struct([("name", pa.string()), ("n", pa.int32())]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        names, made = _held(part, whole)
        for batch in batches:
            *own, texts = batch.columns
            rows = []
            for value in texts:
                text = value.as_py()
                hits = Counter(i for _, i in made.iter(text)) if names and text else {}
                rows.append([{"name": names[i], "n": n} for i, n in sorted(hits.items())])
            yield pa.RecordBatch.from_arrays([*own, pa.array(rows, kind)], [*kept, into])

    schema = df.select(*kept, F.lit(None).cast("array<struct<name:string,n:int>>").alias(into)).schema
    return df.select(*kept, text.alias("_text")).mapInArrow(run, schema)


def pairs(df: DataFrame, text: Column, found: Dictionary, name: str = "name") -> DataFrame:
    """A row for each document and name that it has, with ``n``; a pass over ``df`` for each part."""
    some = (_with_part(df, text, part, found.whole, "_names") for part in found.parts)
    every = reduce(DataFrame.unionByName, some)
    return every.select(*df.columns, F.explode("_names").alias("_x")).select(*df.columns, F.col("_x.name").alias(name), "_x.n")


def name_counts(df: DataFrame, key: str, text: Column, found: Dictionary) -> DataFrame:
    """(key, n_names, n): how many names of the dictionary the texts of each key have, and how often;
    keys without any are left out. A name is in one part alone, so that numbers of the parts add up:
    of a document and a part a row of two numbers is shuffled. Only where a key stands for several
    rows, whose names may be the same, the names themselves are."""
    if df.groupBy(key).count().where("count > 1").isEmpty():
        some = (_with_part(df.select(key, text.alias("_t")), F.col("_t"), part, found.whole, "_names") for part in found.parts)
        total = F.aggregate("_names", F.lit(0).cast("long"), lambda n, x: n + x["n"])
        each = reduce(DataFrame.unionByName, [f.where(F.size("_names") > 0).select(key, F.size("_names").cast("long").alias("n_names"), total.alias("n")) for f in some])
        return each if len(found.parts) == 1 else each.groupBy(key).agg(F.sum("n_names").alias("n_names"), F.sum("n").alias("n"))
    names = pairs(df.select(key, text.alias("_t")), F.col("_t"), found, "_name")
    return names.groupBy(key).agg(F.countDistinct("_name").alias("n_names"), F.sum("n").cast("long").alias("n"))


def name_counts(df: DataFrame, key: str, text: Column, names: DataFrame, name: str, part: int = PART) -> DataFrame:
    """(key, n_names, n): how many of the whole names the texts of each key have, and how often; keys
    without any are left out. ``text`` is as for ``with_names``.

    Names of one part are found by its automaton. More of them would take a pass over the texts for
    each part, so that the work grew with the product of both: they meet the texts' runs of as many
    tokens in a join instead, each run once a text with its number.
    """
    distinct = names.select(F.col(name).alias("_name")).where(F.length("_name") > 0).distinct()
    rows = df.select(key, text.alias("_spaced"))
    once = not repeated_keys(df, key)
    if distinct.agg(F.coalesce(F.sum(F.length("_name")), F.lit(0))).first()[0] <= part:
        seen = with_names(rows, F.col("_spaced"), dictionary(distinct, "_name", part=part), "_names")
        if once:
            total = F.aggregate("_names", F.lit(0).cast("long"), lambda n, x: n + x["n"])
            return seen.where(F.size("_names") > 0).select(key, F.size("_names").cast("long").alias("n_names"), total.alias("n"))
        found = seen.select(key, F.explode("_names").alias("_x")).select(key, "_x.name", "_x.n")
    else:
        size = F.size(F.split("_name", GAP))
        sizes = [r[0] for r in distinct.select(size).distinct().limit(101).collect()]
        if len(sizes) > 100:
            raise ValueError("names of more than 100 different numbers of tokens")
        runs = F.concat(*[run_lengths(ngrams(F.split(F.trim("_spaced"), GAP), k)) for k in sizes])
        found = exploded(rows, [key], runs).join(distinct, F.col("value") == F.col("_name")).select(key, F.col("_name").alias("name"), "n")
    distinct_names = F.count("*") if once else F.countDistinct("name")  # a text has a name once
    return found.groupBy(key).agg(distinct_names.alias("n_names"), F.sum("n").cast("long").alias("n"))


def with_any(df: DataFrame, text: Column, found: Dictionary) -> DataFrame:
    """The rows whose text has any of the names."""
    return with_names(df, text, found, "_names").where(F.size("_names") > 0).drop("_names")
