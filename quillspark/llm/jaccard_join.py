"""N-gram Jaccard join by T-occurrence search.

1. Each text becomes its set of distinct word shingles (64-bit hashes). Texts with the same set
   are one record, named by its smallest doc_id.
2. Two linked records of n shingles must share at least K(n) of their prefixes, the
   floor((1-t)n) + K(n) smallest hashes. Only prefixes are shuffled, as inverted lists; a record
   that has not K prefix shingles in common with *any* others is linked with nothing and drops out.
3. Lists are short (up to ``LIST`` records) or long. With L of its lists long, a record shares at
   least K - L shingles of short lists with whatever it is linked to, so merging the short lists
   alone, with that threshold, gives all candidates of records with L < K: the DivideSkip rule
   over the whole corpus. Long lists are never paired.
4. Records with L >= K lie in large families of near copies, or consist of passages that many
   others have. Their whole sets are looked at, with their shingles from the rarest to the most
   frequent among such records: linked ones share one of the first floor((1-t)n) + 1. A text with
   enough shingles of its own shares none and drops out; the others meet in their family.
5. Candidates form clusters. Within a cluster DivideSkip decides on the whole sets: the inverted
   lists of a record's shingles are split into the longest and the rest; the rest are merged, and
   the records that occur there often enough are probed in the long lists by binary search. Those
   that reach the overlap are links, and only links make components. Clusters too large for one
   task are searched as pairs of blocks, after all records that are linked to the cluster's most
   central one are settled with it. Pairs already connected are not searched again, which changes
   no component.
6. Where links are counted, the same search runs over all pairs of a cluster, in pairs of blocks,
   and each block gives a sum for a record.

Keys that many rows share (a frequent shingle, a family, a set of many copies) are joined by
``split_join``, so none of them gathers in one task.

Defined cases: null and empty texts and texts without words have an empty set and are linked
with nothing; rows that share a doc_id count as one record for linking, each row gets its own
result; a null doc_id never names a component but its row takes its set's; an empty table gives
an empty result; columns beside the key and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, shingle_hashes, split_join, stored, table
from .graph import components

#: Records and shingles of a block at most, roughly.
BLOCK, BLOCK_SHINGLES = 2_000, 1_500_000
#: Records in a short list at most: each brings no more than half as many pairs an entry.
LIST = 32
#: Clusters that are joined with their centre's set by broadcast, at most.
FAMILIES = 200
#: How much dearer merging an entry is than probing for one, in DivideSkip's choice of the long lists.
MERGE = 0.0085
#: Searches from single records before the records outside of the largest group are searched.
CENTRES = 8
#: Bits of the map that keeps most texts out of the second reading; 8 MB whatever the input.
MAP_BITS = 1 << 26


def _required(n: int, num: int, den: int) -> tuple[int, int]:
    """Length of the prefix, and how many of its shingles any linked record shares."""
    k = lambda m: 1 + 6 * m // 100
    loss = n - -(-num * n // den)
    return min(n, loss + k(n)), k(-(-num * n // den))


def _key(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _sets(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """doc_id, n, set_key, need, prefix of each row; the text itself is left behind."""

    def run(batches):
        for b in batches:
            ns, keys, needs, prefixes = [], [], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                s = shingle_hashes((t or b"").lower().split(), words)
                p, need = _required(len(s), num, den)
                ns.append(len(s))
                keys.append(_key(s))
                needs.append(need)
                prefixes.append(s[:p].view(np.int64))
            sizes = np.cumsum([0, *map(len, prefixes)])
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(prefixes) if prefixes else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array(needs, pa.int64()), lists], ["doc_id", "n", "set_key", "need", "prefix"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n long, set_key binary, need long, prefix array<long>")


def _bit(column: str) -> F.Column:
    return F.pmod(F.xxhash64(column), F.lit(MAP_BITS))


def _full_sets(docs: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """doc_id, whole set and set_key of each row whose doc_id is (or, rarely, only seems) wanted."""
    spark = docs.sparkSession
    rows = wanted.select(F.floor(_bit("rep") / 32).alias("w"), F.expr(f"shiftleft(1L, int(pmod(xxhash64(rep), {MAP_BITS}) % 32))").alias("x")).groupBy("w").agg(F.bit_or("x").alias("x")).toArrow()
    bits = np.zeros(MAP_BITS // 32, np.uint32)
    bits[rows.column("w").to_numpy()] = rows.column("x").to_numpy()
    shared = spark.sparkContext.broadcast(bits)

    def run(batches):
        bits = shared.value
        for b in batches:
            at = b.column(2).to_numpy()
            here = np.flatnonzero(bits[at // 32] >> (at % 32).astype(np.uint32) & 1)
            if not len(here):
                continue
            b = b.take(pa.array(here))
            sets = [shingle_hashes((t or b"").lower().split(), words).view(np.int64) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array(map(_key, sets), pa.binary())], ["rep", "items", "set_key"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", _bit("doc_id").alias("bit")).mapInArrow(lean(run), "rep long, items array<long>, set_key binary")


def _linked(common: np.ndarray | int, n: np.ndarray | int, m: int, num: int, den: int):
    return den * common >= num * (n + m - common)


class _Index:
    """Inverted lists of sorted sets, searched by DivideSkip."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den, self.size = num, den, len(sets)
        self.n = np.array([len(s) for s in sets])
        self.first = np.cumsum(self.n) - self.n
        # the owners of equal items, ascending, one list after the other
        items, self.of = np.unique(np.concatenate(sets), return_inverse=True)
        self.place = self.of * self.size + np.repeat(np.arange(self.size), self.n)
        self.place.sort()
        self.owner = self.place % self.size
        self.ends = np.searchsorted(self.place, np.arange(1, len(items) + 1) * self.size)
        self.starts = np.append(0, self.ends[:-1])

    def links(self, q: int, wanted: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The records linked to ``q`` among those that ``wanted`` marks, and how many shingles
        they share with it in the short and in the long lists."""
        size, n, num, den = self.size, self.n, self.num, self.den
        lists = self.of[self.first[q] : self.first[q] + n[q]]
        lengths = self.ends[lists] - self.starts[lists]
        lists, lengths = lists[lengths > 1], lengths[lengths > 1]  # lists of one hold q alone
        t = -(-num * int(n[q]) // den)  # the least overlap with any record that is linked to q
        none = np.empty(0, np.int64)
        if len(lists) < t:
            return none, none, none
        lists = lists[np.argsort(-lengths, kind="stable")]
        n_long = max(0, min(t - 1, int(t / (MERGE * np.log2(int(lengths.max())) + 1))))
        long_, short = lists[:n_long], lists[n_long:]
        # a natural merge of the sorted short lists, and how often each record comes
        ids, counts = np.unique(np.sort(np.concatenate([self.owner[self.starts[k] : self.ends[k]] for k in short.tolist()]), kind="stable"), return_counts=True)
        keep = (counts >= t - n_long) & wanted(ids)
        ids, counts = ids[keep], counts[keep]
        keep = _linked(counts + n_long, n[ids], n[q], num, den)  # those that the long lists can still bring there
        ids, counts = ids[keep], counts[keep]
        if not len(ids):
            return none, none, none
        # binary search for each of these records in each of the long lists
        probes = (long_[:, None] * size + ids[None, :]).ravel()
        at = np.minimum(np.searchsorted(self.place, probes), len(self.place) - 1)
        probed = (self.place[at] == probes).reshape(len(long_), len(ids)).sum(axis=0)
        keep = _linked(counts + probed, n[ids], n[q], num, den)
        return ids[keep], counts[keep], probed[keep]


def _across(side: np.ndarray, q: int, ids: np.ndarray) -> np.ndarray:
    return (side[ids] != side[q]) | (side[q] == 2)


def divide_skip(sets: list[np.ndarray], sides: list[int], num: int, den: int, tally: Counter | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect all that is linked; sets are sorted. ``sides``: 0 and 1 when only
    pairs across the sides count, 2 for records that pair with all. ``tally`` counts the shingles
    of links found by merging and by probing."""
    index, side = _Index(sets, num, den), np.array(sides)
    size = index.size
    group = np.arange(size)
    out: list[tuple[int, int]] = []

    def search(q: int) -> None:
        for j, merged, probed in zip(*(x.tolist() for x in index.links(q, lambda ids: (group[ids] != group[q]) & _across(side, q, ids)))):
            if group[j] != group[q]:
                a, b = sorted((group[q], group[j]))
                group[group == b] = a
                out.append((q, j))
                if tally is not None:
                    tally["merged"] += merged
                    tally["probed"] += probed

    # near copies of one text: a few searches connect most of a large group
    tried = np.zeros(size, bool)
    for _ in range(min(CENTRES, size)):
        alone = np.flatnonzero((np.bincount(group, minlength=size)[group] == 1) & ~tried)
        if not len(alone):
            break
        tried[alone[0]] = True
        search(int(alone[0]))
    # a link from a record of the largest group leads to one that is searched itself
    anchor = int(np.flatnonzero(group == np.bincount(group).argmax())[0])
    for q in range(size):
        if not tried[q] and group[q] != group[anchor]:
            search(q)
    return out


def linked_copies(sets: list[np.ndarray], sides: list[int], copies: list[int], num: int, den: int) -> np.ndarray:
    """For each record, the sum of ``copies`` over all records linked to it; each is searched once,
    from the one end of a pair, and no pairs are kept. ``sides`` as in ``divide_skip``."""
    index, side, weight = _Index(sets, num, den), np.array(sides), np.array(copies, np.int64)
    out = np.zeros(index.size, np.int64)
    for q in range(index.size):
        ids, _, _ = index.links(q, lambda ids: (ids > q) & _across(side, q, ids))
        out[q] += weight[ids].sum()
        out[ids] += weight[q]
    return out


def _search(blocks: DataFrame, num: int, den: int) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "ascending"), ("rep", "ascending")])
        reps = t.column("rep").to_pylist()
        sets = [x.values.to_numpy().view(np.uint64) for x in t.column("items")]
        links = divide_skip(sets, t.column("side").to_pylist(), num, den)
        return pa.table({"a": pa.array([reps[i] for i, _ in links], pa.int64()), "b": pa.array([reps[j] for _, j in links], pa.int64())})

    return blocks.groupBy("cluster", "x", "y").applyInArrow(run, "a long, b long")


def _candidates(lists: DataFrame) -> DataFrame:
    """(a, b) of records that share enough shingles of short lists; ``lists`` has the record's
    threshold ``need``, its number ``far`` of long lists and the shingles ``near`` of short ones."""
    each = lists.select("rep", "need", "far", F.explode("near").alias("item"))
    side = lambda x: each.select("item", *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "need", "far")])
    met = side("a").join(side("b"), "item").where("rep_a < rep_b").groupBy("rep_a", "rep_b", "need_a", "need_b", "far_a", "far_b").agg(F.count("*").alias("c"))
    return met.where("c >= greatest(need_a, need_b) - least(far_a, far_b)").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))


def _families(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, list[str]]:
    """(a, b) that connect the records of (rep, items) which share one of their rarest shingles,
    and the folders this reads."""
    entries, p1 = stored(sets.select("rep", F.size("items").alias("size"), F.explode("items").alias("item")), "entries")
    often, p2 = stored(entries.groupBy("item").agg(F.count("*").alias("n")).where("n > 1"), "often")
    found = split_join(entries, often, "item", entries.count()).groupBy("rep", "size").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("found"))
    # the shingles that are in this record alone come first in the order
    first = f"size - cast(ceil({num} * size / {den}) as int) + 1 - (size - size(found))"
    rare, p3 = stored(found.select("rep", F.explode(F.expr(f"slice(found, 1, greatest(0, {first}))")).alias("f")).select("rep", "f.item"), "rare")
    least, p4 = stored(rare.groupBy("item").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1"), "least")
    return split_join(rare, least, "item", rare.count()).select(F.col("rep").alias("a"), F.col("least").alias("b")).where("a <> b").distinct(), [p1, p2, p3, p4]


def _clusters(docs: DataFrame, words: int, num: int, den: int, reps: DataFrame, rows: DataFrame) -> tuple[DataFrame, str]:
    """(rep, cluster, central): linked records are in one cluster; and the folder this reads."""
    spark = docs.sparkSession
    # prefixes of one row of each set; a doc_id with several rows brings those of each
    named = reps.where("rep is not null").select(F.col("rep").alias("doc_id"), "set_key")
    one = rows.where("n > 0").join(named, ["doc_id", "set_key"]).select(F.col("doc_id").alias("rep"), "need", "prefix", "set_key").dropDuplicates(["rep", "set_key"])
    items, p1 = stored(one.select("rep", "need", F.size("prefix").alias("size"), F.explode("prefix").alias("item")), "items")
    often, p2 = stored(items.groupBy("item").agg(F.count("*").alias("n")).where("n > 1"), "often")
    common = split_join(items, often, "item", items.count())
    long_ = F.sum((F.col("n") > LIST).cast("int"))
    lists = common.groupBy("rep", "need", "size").agg(long_.alias("far"), F.collect_list(F.when(F.col("n") <= LIST, F.col("item"))).alias("near")).where("far + size(near) >= need")
    lists, p3 = stored(lists, "lists")
    discard(spark, p1, p2)

    pairs, p4 = stored(_candidates(lists), "candidates")
    hot, p5 = stored(lists.where("far >= need").select("rep").distinct(), "frequent")
    whole, p6 = stored(_full_sets(docs, words, hot).drop("set_key").join(hot, "rep", "left_semi").where("size(items) > 0").dropDuplicates(["rep", "items"]), "frequent-sets")
    family, gone = _families(whole, num, den)
    clusters = components(pairs.union(family)).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    central = lists.groupBy("rep").agg(F.max(F.col("far") / F.col("size")).alias("central"))
    clusters, p7 = stored(clusters.join(central, "rep"), "clusters")
    discard(spark, p3, p4, p5, p6, *gone)
    return clusters, p7


def links(docs: DataFrame, words: int, num: int, den: int, clusters: DataFrame) -> DataFrame:
    """Verified links (a, b) between the records' smallest doc_ids that connect all linked ones."""
    spark = docs.sparkSession
    sets = _full_sets(docs, words, clusters).drop("set_key").join(clusters, "rep").withColumn("size", F.size("items").cast("long")).where("size > 0").dropDuplicates(["rep", "size", "items"])
    sets, p8 = stored(sets, "members")
    total = sets.count()
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("int")
    sizes = sets.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.max_by("rep", F.struct("central", -F.col("rep"))).alias("centre")).where("n > 1").withColumn("parts", parts)
    sizes, p9 = stored(sizes.select("cluster", "n", "parts", "centre"), "sizes")
    member = ["cluster", "rep", "size", "items"]
    small = sets.join(sizes.where("parts = 1").select("cluster"), "cluster", "left_semi").select("cluster", F.lit(0).alias("x"), F.lit(0).alias("y"), *member[1:], F.lit(2).alias("side"))

    # large clusters: who is linked to the centre is settled, the others meet all
    wide = sizes.where("parts > 1")
    centre, p10 = stored(sets.join(wide.select(F.col("cluster").alias("_c"), F.col("centre").alias("_r"), "n", "parts"), (F.col("cluster") == F.col("_c")) & (F.col("rep") == F.col("_r"))).groupBy("cluster", "n", "parts").agg(F.max_by("items", "size").alias("middle"), F.max("rep").alias("centre")), "centres")
    same = F.size(F.array_intersect("items", "middle"))
    linked = den * same >= num * (F.size("items") + F.size("middle") - same)
    large, p11 = stored(split_join(sets.select(*member), centre, "cluster", total, FAMILIES).select(*member, "parts", "centre", linked.alias("settled")), "large")
    star = large.where("settled and rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b"))
    queries = F.ceil(F.greatest(F.sum((~F.col("settled")).cast("int")) / BLOCK, F.sum(F.when(F.col("settled"), 0).otherwise(F.col("size"))) / BLOCK_SHINGLES)).cast("int")
    asked, p12 = stored(large.groupBy("cluster").agg(F.count("*").alias("n"), queries.alias("queries")).where("queries > 0"), "queries")
    large = split_join(large, asked, "cluster", total, FAMILIES)
    large = large.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("settled"), F.col("parts")).otherwise(F.col("queries"))).cast("int"))
    # queries i meet queries j at (i, j) for i <= j, and settled rows k at (i, -1 - k)
    meet = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    each = F.transform(F.sequence(F.lit(0), F.col("queries") - 1), lambda j: meet(F.least("own", j), F.greatest("own", j)))
    rest = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda k: meet(F.col("own"), -k))
    open_ = large.where("not settled").withColumn("at", F.explode(F.concat(each, rest)))
    open_ = open_.select("cluster", "at.x", "at.y", *member[1:], F.when(F.expr("at.x = at.y"), 2).when(F.expr("at.y < 0 or own = at.x"), 0).otherwise(1).alias("side"))
    given = large.where("settled").select("cluster", F.explode(F.sequence(F.lit(0), F.col("queries") - 1)).alias("x"), (-1 - F.col("own")).alias("y"), *member[1:], F.lit(1).alias("side"))
    found, _ = stored(_search(small, num, den).union(_search(open_.unionByName(given), num, den)).union(star), "links")
    discard(spark, p8, p9, p10, p11, p12)
    return found


def link_counts(docs: DataFrame, words: int, num: int, den: int, clusters: DataFrame, reps: DataFrame) -> DataFrame:
    """(set_key, others): how many rows have other sets that are linked to this one.

    All pairs of a cluster are searched, as pairs of its blocks: its cost grows with the square of
    a cluster's distinct sets. A block gives one row a record, whatever the number of its links.
    """
    spark = docs.sparkSession
    copies = reps.where("rep is not null").select("rep", "set_key", F.col("n").alias("copies"))
    sets = _full_sets(docs, words, clusters).join(clusters.select("rep", "cluster"), "rep").join(copies, ["rep", "set_key"]).withColumn("size", F.size("items").cast("long")).where("size > 0").dropDuplicates(["set_key"])
    sets, p1 = stored(sets.select("cluster", "set_key", "size", "items", "copies"), "counted")
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("int")
    sizes = sets.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("all")).where("n > 1")
    sizes, p2 = stored(sizes.select("cluster", "n", parts.alias("parts")), "counted-sizes")
    dealt = split_join(sets, sizes, "cluster", sets.count(), FAMILIES).withColumn("own", F.pmod(F.xxhash64("set_key"), F.col("parts")).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("own", j).alias("x"), F.greatest("own", j).alias("y")))
    side = F.expr("case when at.x = at.y then 2 when own = at.x then 0 else 1 end")
    blocks = dealt.withColumn("at", F.explode(meet)).select("cluster", "at.x", "at.y", "set_key", "size", "items", "copies", side.alias("side"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "ascending"), ("set_key", "ascending")])
        whole = [x.values.to_numpy().view(np.uint64) for x in t.column("items")]
        others = linked_copies(whole, t.column("side").to_pylist(), t.column("copies").to_pylist(), num, den)
        return pa.table({"set_key": t.column("set_key"), "others": pa.array(others)})

    found = blocks.groupBy("cluster", "x", "y").applyInArrow(run, "set_key binary, others long").groupBy("set_key").agg(F.sum("others").alias("others"))
    found, _ = stored(found, "link-counts")
    discard(spark, p1, p2)
    return found


def join(docs: DataFrame, words: int, num: int, den: int, counted: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of each row; records link when
    ``den * intersection >= num * union``. With ``counted`` also n_links, the number of other rows
    linked to it: copies of its set and rows of all sets linked to that. A set that only rows
    without a doc_id have counts its copies alone."""
    rows, _ = stored(_sets(docs, words, num, den), "sets")
    some = rows.where("n > 0")
    reps, _ = stored(some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "reps")
    clusters, path = _clusters(docs, words, num, den, reps, rows)
    found, _ = stored(components(links(docs, words, num, den, clusters)), "components")
    named = reps.join(found, reps.rep == found.node, "left").select("set_key", "n", F.coalesce("component", "rep").alias("component_id"))
    out, zero = ["doc_id", "n_shingles", "component_id"], []
    if counted:
        each = link_counts(docs, words, num, den, clusters, reps)
        named = named.join(each, "set_key", "left").withColumn("n_links", F.col("n") - 1 + F.coalesce("others", F.lit(0)))
        out, zero = [*out, "n_links"], [F.lit(0).cast("long")]
    discard(docs.sparkSession, path)
    full = split_join(some.select("doc_id", F.col("n").alias("n_shingles"), "set_key"), named, "set_key", some.count())
    return full.select(*out).union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), *zero))


def query(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), 4, 85, 100, counted=True)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
m AS (SELECT node, min(root) AS root FROM r GROUP BY 1),
k AS (SELECT a AS doc_id, count(*) AS k FROM e GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, coalesce(k, 0) AS n_links FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) JOIN m ON node = doc_id
"""
