"""Source divergence audit: how far the sources of a language differ in their words.

1. A count-min sketch of document frequencies: each task counts the documents of every (language,
   term) it meets into ``ROWS`` rows of saturating one-byte counters; the sketches are added by
   blocks. A counter is never below the frequency of a term that falls on it, so a term with an
   estimate under the least frequency can't be kept.
2. The second pass discards those terms in the task that reads them and shuffles only the others,
   already added up by (language, source, term). They are counted exactly, so what collisions
   let through goes then: results don't depend on the sketch.
3. Pairs of sources are compared over sparse counts. The value of a pair is a sum over all kept
   terms of the language; terms that neither source has give the same value each, terms that one
   has depend on its count alone and are taken from a histogram of counts, and only terms that
   both have are joined.

The sketch has a fixed size (``ROWS * width`` bytes, by default 32 MB), whatever the data, and is
broadcast; at most ``SKETCHES`` tasks make one. On a corpus with far more rare terms than counters
it discards less, and nothing else changes.

Terms are runs of ASCII letters and of characters outside ASCII; only A to Z are lower-cased.
Shares are exact integers in units of 1e-9, with one added to each count.

Defined cases: null text, language or source count as ''; a row is a document, so repeated rows
and rows that share a doc_id count each; texts without terms still make their group, and groups
whose language keeps no term get 0 for each pair; ties are ranked by the item's UTF-8 bytes; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, mix64, stored, table

#: Documents of its language that a term needs.
LEAST = 3
#: Ranks of a group's terms that are reported.
TERMS = 200
#: Rows of the sketch, and counters in each.
ROWS, WIDTH = 4, 1 << 23
#: Blocks in which sketches are added up, and most tasks that make one.
BLOCKS, SKETCHES = 64, 4_096
#: Entries that a task holds before it hands them on.
HELD = 400_000

UNIT = 1_000_000_000

#: All bytes but those of terms become spaces, A to Z lower case; UTF-8 keeps what is outside ASCII above 127.
_TERM_BYTES = bytes(b if b > 127 or chr(b) in string.ascii_lowercase else b + 32 if chr(b) in string.ascii_uppercase else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_TERM_BYTES).split()


def _pack(counters: np.ndarray) -> bytes:
    return pa.compress(counters.tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, size, "zstd"), np.uint8)


class Sketch:
    """Count-min with saturating counters: ``estimate`` is never below the number added (up to 255)."""

    def __init__(self, width: int, counters: np.ndarray | None = None):
        self.width = width
        self.counters = np.zeros((ROWS, width), np.uint8) if counters is None else counters.reshape(ROWS, width)

    @staticmethod
    def hashes(lang: bytes, words: list[bytes]) -> np.ndarray:
        import xxhash

        seed = xxhash.xxh64_intdigest(lang)
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))

    def places(self, hashes: np.ndarray):
        with np.errstate(over="ignore"):
            for row in range(ROWS):
                yield row, (mix64(hashes + np.uint64(row * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(self.width)).astype(np.int64)

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        for row, at in self.places(hashes):
            distinct, back = np.unique(at, return_inverse=True)
            total = np.bincount(back, counts) + self.counters[row, distinct]
            self.counters[row, distinct] = np.minimum(total, 255)

    def estimate(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(hashes), 255, np.uint8)
        for row, at in self.places(hashes):
            np.minimum(least, self.counters[row, at], out=least)
        return least


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")))


def frequencies(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """The merged sketch of the documents in which each (lang, term) occurs; ``width`` is a multiple of ``BLOCKS``."""
    size = ROWS * width // BLOCKS
    read = _read(docs).select("lang", "text").coalesce(SKETCHES)

    def sketches(batches):
        sketch, held, n = Sketch(width), defaultdict(Counter), 0

        def hand_on():
            for lang, found in held.items():
                sketch.add(Sketch.hashes(lang, list(found)), np.fromiter(found.values(), np.int64, len(found)))
            held.clear()

        any_rows = False
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                any_rows = True
                distinct = set(terms(text.as_py()))
                held[lang].update(distinct)
                n += len(distinct)
                if n > 10 * HELD and sum(map(len, held.values())) > HELD:
                    hand_on()
                    n = 0
        hand_on()
        if any_rows:
            blocks = np.split(sketch.counters.reshape(-1), BLOCKS)
            for k, block in enumerate(blocks):
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "counters": pa.array([_pack(block)], pa.binary())})

    def merged(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = _unpack(packed.as_py(), size)
                if k in sums:  # saturating addition
                    np.add(sums[k], np.minimum(block, 255 - sums[k]), out=sums[k])
                else:
                    sums[k] = block.copy()
        for k, block in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "counters": pa.array([_pack(block)], pa.binary())})

    schema = "block int, counters binary"
    parts = read.mapInArrow(lean(sketches), schema).repartition(BLOCKS, "block").mapInArrow(lean(merged), schema)
    counters = np.zeros((BLOCKS, size), np.uint8)
    for k, packed in parts.collect():  # BLOCKS rows of ROWS * width bytes in all, before compression
        counters[k] = _unpack(packed, size)
    return counters


def counted(docs: DataFrame, least: int = LEAST, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Exact counts of the terms in at least ``least`` documents of their language: (lang, source,
    term, n, lang_n) and the groups (lang, source, n, lang_n, v), both stored.

    A group that has no kept term is in the second table alone, with n = 0.
    """
    if not 1 <= least <= 255:
        raise ValueError("the least document frequency lies between 1 and 255")
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(_pack(frequencies(docs, width)))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def survivors(batches):
        seen = Sketch(width, _unpack(sketch.value, ROWS * width))
        uses, docs_of, n = defaultdict(Counter), defaultdict(Counter), 0

        def hand_on():
            for (lang, source), found in docs_of.items():
                words = list(found)
                kept = [w for w, ok in zip(words, seen.estimate(Sketch.hashes(lang, words)) >= least) if ok]
                total = uses[lang, source]
                rows = [(b"", 0, 0), *((w, total[w], found[w]) for w in kept)]  # the first one is the group's
                for i in range(0, len(rows), 50_000):
                    some = rows[i : i + 50_000]
                    words, ns, ds = zip(*some)
                    text = pa.array(words, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang.decode()] * len(some)), pa.array([source.decode()] * len(some)), text, pa.array(ns, pa.int64()), pa.array(ds, pa.int64())], schema=schema)
            uses.clear()
            docs_of.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = terms(text.as_py())
                uses[lang, source].update(found)
                docs_of[lang, source].update(set(found))
                n += len(found)
                if n > 10 * HELD and sum(map(len, docs_of.values())) > HELD:
                    yield from hand_on()
                    n = 0
        yield from hand_on()

    rows = _read(docs).mapInArrow(lean(survivors), "lang string, source string, term string, n long, docs long")
    exact = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_lang = Window.partitionBy("lang", "term")  # as many rows as the language has sources
    totals = exact.withColumn("lang_docs", F.sum("docs").over(of_lang)).withColumn("lang_n", F.sum("n").over(of_lang))
    all_rows, _ = stored(totals.where((F.col("term") == "") | (F.col("lang_docs") >= least)).select("lang", "source", "term", "n", "lang_n"), "divergence-counts")
    kept = all_rows.where("term <> ''")
    of_groups = all_rows.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_terms = kept.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_n"))
    groups = of_groups.join(of_terms, "lang", "left").select("lang", "source", "n", F.coalesce("lang_n", F.lit(0)).alias("lang_n"), F.coalesce("v", F.lit(0)).alias("v"))
    return kept, stored(groups, "divergence-groups")[0]


def share(n: str, total: str, v: str) -> F.Column:
    """1 + floor(1e9 * (n + 1) / (total + v)), exact at any size."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10, 0)) * cast({n} + 1 as decimal(20, 0))) div cast({total} + {v} as decimal(20, 0))")


def excess(p: str, q: str) -> F.Column:
    """floor((p - q)^2 / q); shares are at most 1e9 + 1, so that squares fit in a long."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def _ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    out = rows.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= most) if most else out


def over_used(kept: DataFrame, groups: DataFrame, most: int = TERMS) -> DataFrame:
    """Each group's terms with a greater share than in its language, by excess."""
    facts = groups.where("v > 0").withColumnsRenamed({"n": "all_n", "lang_n": "all_lang_n"})
    rows = kept.where("n > 0").join(facts, ["lang", "source"])
    rows = rows.withColumn("p", share("n", "all_n", "v")).withColumn("q", share("lang_n", "all_lang_n", "v")).where("p > q")
    return _ranked(rows.select("lang", "source", F.col("term").alias("item"), excess("p", "q").alias("value")), most)


def pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """For each group its divergence from every other source of the language, ranked."""
    facts = groups.withColumn("p0", F.when(F.col("v") > 0, share("0", "n", "v"))).select("lang", "source", "v", "p0", F.col("n").alias("all_n"))
    counts = kept.where("n > 0").join(facts, ["lang", "source"]).withColumn("p", share("n", "all_n", "v")).select("lang", "source", "term", "p", "p0")
    a, b = (facts.select("lang", "v", F.col("source").alias(f"source_{x}"), F.col("p0").alias(f"{x}0")) for x in "ab")

    # every ordered pair, with the terms that neither has
    both = a.join(b.drop("v"), "lang").where("source_a <> source_b")
    none = both.select("lang", "source_a", "source_b", F.coalesce(F.col("v") * excess("a0", "b0"), F.lit(0)).alias("value"))

    # terms that one of them has: by its distinct shares
    shares = counts.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
    one = shares.withColumnRenamed("source", "source_x").join(facts.select("lang", F.col("source").alias("source_y"), F.col("p0").alias("y0")), "lang").where("source_x <> source_y")
    as_a = one.select("lang", F.col("source_x").alias("source_a"), F.col("source_y").alias("source_b"), (F.col("n") * (excess("p", "y0") - excess("p0", "y0"))).alias("value"))
    as_b = one.select("lang", F.col("source_y").alias("source_a"), F.col("source_x").alias("source_b"), (F.col("n") * (excess("y0", "p") - excess("y0", "p0"))).alias("value"))

    # terms that both have: what the two sums above get wrong there
    left, right = (counts.select("lang", "term", F.col("source").alias(f"source_{x}"), F.col("p").alias(x), F.col("p0").alias(f"{x}0")) for x in "ab")
    meet = left.join(right, ["lang", "term"]).where("source_a < source_b")
    there = meet.groupBy("lang", "source_a", "source_b").agg(
        *(F.sum(excess(x, y) - excess(x, f"{y}0") - excess(f"{x}0", y) + excess(f"{x}0", f"{y}0")).alias(f"{x}{y}") for x, y in ("ab", "ba"))
    )
    met = there.select("lang", F.inline(F.array(F.struct("source_a", "source_b", F.col("ab").alias("value")), F.struct(F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), F.col("ba").alias("value")))))

    total = none.unionByName(as_a).unionByName(as_b).unionByName(met.toDF("lang", "source_a", "source_b", "value")).groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))
    return _ranked(total.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), "value"))


def audit(docs: DataFrame, least: int = LEAST, most: int = TERMS, width: int = WIDTH) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank; see the module's head."""
    kept, groups = counted(docs, least, width)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs(kept, groups).withColumn("part", F.lit("pair")).select(columns).unionByName(over_used(kept, groups, most).withColumn("part", F.lit("term")).select(columns))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS text FROM documents),
t AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= {LEAST}),
langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
dense AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + langs.v) AS p,
    1 + ({UNIT}::HUGEINT * (kept.n + 1)) // (langs.total + langs.v) AS q
    FROM sizes g JOIN kept ON kept.lang = g.lang JOIN langs ON langs.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(v.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
        FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source) v
    ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
    UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM term) WHERE rank <= {TERMS})
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
"""
