"""Schema, join, duplicate, aggregate, window, reshape and sampling operators.

Where the order of rows matters it is an argument, so results don't depend on partitions.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from quillspark.functions.text import WRITTEN, normalize_text, snake_case

Keys = Sequence[str]


# --- schema -----------------------------------------------------------------------------------
def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """All renames at once, so that a -> b and b -> c don't chain; other columns stay."""
    return df.toDF(*[names.get(c, c) for c in df.columns])


def clean_names(df: DataFrame) -> DataFrame:
    """Snake case names; equal ones get a number from the second on."""
    seen: dict[str, int] = {}
    out = []
    for c in map(snake_case, df.columns):
        seen[c] = seen.get(c, 0) + 1
        out.append(c if seen[c] == 1 else f"{c}_{seen[c]}")
    return df.toDF(*out)


def present(df: DataFrame, names: Keys) -> DataFrame:
    """Those of the columns that there are."""
    return df.select(*[c for c in names if c in df.columns])


def without(df: DataFrame, names: Keys = (), suffixes: Keys = ()) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in names and not any(c.endswith(s) for s in suffixes)])


def aligned(df: DataFrame, names: Keys) -> DataFrame:
    """The columns in this order; missing ones are null strings."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names])


def bind_rows(*frames: DataFrame) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# --- filters ----------------------------------------------------------------------------------
def non_empty(c: str, sentinel: str = "[No abstract available]") -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "") & (F.col(c) != sentinel)


def in_or_null(c: str, values: Sequence) -> Column:
    """Membership where null is a member."""
    return F.col(c).isin(*values) | F.col(c).isNull()


def group_size_at_least(df: DataFrame, keys: Keys, n: int) -> DataFrame:
    big = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).drop("_n")
    return df.join(big, list(keys), "left_semi")


# --- joins ------------------------------------------------------------------------------------
def left_many_to_one(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Left join that fails, at run time, if a key is on the right more than once."""
    once = right.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in right.columns if c not in keys])
    checked = once.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("a key is on the right side more than once"))).otherwise(F.lit(True)))
    return left.join(checked.where("_ok").drop("_n", "_ok"), list(keys), "left")


def not_in_any(df: DataFrame, *others: tuple[DataFrame, str, str]) -> DataFrame:
    """Chained anti joins with (frame, left key, right key)."""
    for other, a, b in others:
        df = df.join(other.select(F.col(b).alias("_b")).distinct(), F.col(a) == F.col("_b"), "left_anti")
    return df


def full_with_zero(left: DataFrame, right: DataFrame, keys: Keys, zeros: Keys) -> DataFrame:
    return left.join(right, list(keys), "full_outer").fillna(0, list(zeros))


def bind_columns(left: DataFrame, right: DataFrame, left_order: Keys, right_order: Keys) -> DataFrame:
    """Row k of the left beside row k of the right, both in their order.
    """
    return positioned(left, left_order).join(positioned(right, right_order), "_position").drop("_position")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local
    master takes one within the warehouse; on a cluster that may be a folder of one machine, so it raises."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return top.rstrip("/")


def _ranged(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The rows dealt to ranges of the order, and stored with the number of their range."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/ranges-{uuid.uuid4().hex}"
    df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def positioned(df: DataFrame, order: Keys, name: str = "_position") -> DataFrame:
    """Consecutive numbers from 0 in the order. Rows are dealt to ranges of the order and stored,
    numbered within each range, and shifted by the sizes of the ranges before; there are only as
    many sizes as ranges, and no task holds all rows."""
    dealt = _ranged(df, order)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_rank", rank).join(F.broadcast(before), "_range").withColumn(name, F.col("_rank") + F.col("_before")).drop("_rank", "_before", "_range")


def running(df: DataFrame, order: Sequence[str | Column], totals: dict[str, str]) -> DataFrame:
    """Running totals over the whole table in the order: each new column sums the named one up to its
    row. As ``positioned``, by ranges and the totals of the ranges before; the order must be of
    distinct rows, for rows that tie may come in any order."""
    dealt = _ranged(df, order)
    sums = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in totals.items()])
    so_far = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_range", *[F.coalesce(F.sum(f"_s_{n}").over(so_far), F.lit(0)).alias(f"_b_{n}") for n in totals])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({f"_w_{n}": F.sum(c).over(within) for n, c in totals.items()}).join(F.broadcast(before), "_range")
    return out.select(*df.columns, *[(F.col(f"_w_{n}") + F.col(f"_b_{n}")).alias(n) for n in totals])


def quantiles(df: DataFrame, name: str, shares: dict[str, float], keys: Keys = ()) -> DataFrame:
    """Exact quantiles of each group with linear interpolation, as ``percentile`` gives them; nulls are
    left out, and a group without values has no row. Values are counted, then numbered by ranges of
    (group, value), so that no task holds a group's values."""
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    groups = [f"_k{i}" for i in range(len(keys))]
    counts = df.where(F.col(name).isNotNull()).groupBy(*own, F.col(name).alias("_v")).agg(F.count("*").alias("_n"))
    placed = running(counts, [*groups, "_v"], {"_upto": "_n"})
    sizes = placed.groupBy(*groups).agg(F.min(F.col("_upto") - F.col("_n")).alias("_base"), F.sum("_n").alias("_all")).withColumnsRenamed({g: f"{g}_" for g in groups})
    same = [F.col(g).eqNullSafe(F.col(f"{g}_")) for g in groups]
    facts = placed.join(sizes, same) if groups else placed.crossJoin(F.broadcast(sizes))
    last, first = F.col("_upto") - F.col("_base") - 1, F.col("_upto") - F.col("_base") - F.col("_n")

    def at(q: float) -> Column:
        place = F.lit(float(q)) * (F.col("_all") - 1)
        value = lambda index: F.max(F.when((index >= first) & (index <= last), F.col("_v").cast("double")))
        low, high = value(F.floor(place)), value(F.ceil(place))
        part = F.max(place - F.floor(place))
        return F.when(low == high, low).otherwise((1 - part) * low + part * high)

    found = facts.groupBy(*groups).agg(*[at(q).alias(n) for n, q in shares.items()])
    return found.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *shares)


def containing(docs: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """(document, term) pairs where the document has all words of the term next to each other.

    The terms are a dictionary of words in lower case, found in one pass over the documents.
    """
    from quillspark.operators import dictionary as dc

    known = dc.dictionary(terms.select(F.lower(F.col(term)).alias(term)), term)
    low = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    return dc.pairs(docs, low, known, term).drop("n")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table as it was read, dealt out to all cores by a key if it came in fewer partitions than
    there are cores; larger ones are not shuffled. Its rows are the same."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def repeated_keys(df: DataFrame, key: str) -> bool:
    """Whether a key (null too) stands for more than one row; reads that column alone."""
    return not df.groupBy(key).count().where("count > 1").isEmpty()


def exploded(df: DataFrame, keys: Keys, structs: Column) -> DataFrame:
    """The keys with each struct of an array. ``explode`` alone would make Spark compute the array twice,
    once for a filter that it adds."""
    return df.select(*keys, F.explode_outer(structs).alias("_x")).where("_x is not null").select(*keys, "_x.*")


# --- duplicates -------------------------------------------------------------------------------
def digest(*keys: str) -> Column:
    """128 bits that stand for the values of the keys; nulls are told from empty values. Long
    texts are compared and shuffled by it instead of as they are."""
    told = [F.coalesce(F.concat(F.lit("v"), F.col(k).cast("string")), F.lit("n")) for k in keys]
    return F.md5(F.concat_ws("\x1f", *told).cast("binary"))


def first_by(df: DataFrame, keys: Keys, order: Sequence[str | Column], group: Sequence[str | Column] = (), columns: Keys | None = None) -> DataFrame:
    """The first row of each key in the order; null keys are one group. ``group`` may give other
    expressions that tell the keys apart. Where only some ``columns`` of the rows are wanted, and the
    order is one of columns, the others (long texts) are not carried along.

    Where the order is one of columns, the first row is an aggregate, so that a key with very many
    rows is reduced before the shuffle; else the rows of a key are numbered.
    """
    by = list(group or keys)
    if all(isinstance(o, str) for o in order) and not any(isinstance(f.dataType, (MapType, VariantType)) for f in df.schema):
        columns = list(columns or df.columns)
        rest = [c for c in columns if c not in order]
        least = df.groupBy(*[(F.col(k) if isinstance(k, str) else k).alias(f"_key{i}") for i, k in enumerate(by)]).agg(F.min(F.struct(*order, *rest)).alias("_first"))
        return least.select(*[F.col("_first").getField(c).alias(c) for c in columns])
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*(columns or df.columns))


def first_by_keyed(df: DataFrame, key: str, order: Sequence[str | Column], group: Column | None = None) -> DataFrame:
    """As ``first_by``, but all rows with a null or empty key stay."""
    missing = F.col(key).isNull() | (F.col(key) == "")
    return first_by(df.where(~missing), [key], order, [group] if group is not None else ()).unionByName(df.where(missing))


def first_by_text(df: DataFrame, text: str, order: Sequence[str | Column], columns: Keys | None = None) -> DataFrame:
    """The first row of each normalised text, told apart by digests; rows without text stay, that is
    those whose text has nothing but white space and punctuation. Each text is normalised once."""
    has = F.coalesce(F.col(text).rlike(WRITTEN), F.lit(False))
    first = first_by(df.where(has), [text], order, [F.md5(normalize_text(F.col(text)).cast("binary"))], columns)
    return first.unionByName(df.where(~has).select(*(columns or df.columns)))


def without_duplicated(df: DataFrame, keys: Keys) -> DataFrame:
    """Only rows whose key is unique: all members of larger groups go."""
    many = df.groupBy(digest(*keys).alias("_many")).count().where("count > 1").select("_many")
    return df.join(many, digest(*keys) == F.col("_many"), "left_anti")


def duplicate_report(df: DataFrame, keys: Keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


# --- aggregates -------------------------------------------------------------------------------
def counted(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def counted_with_share(df: DataFrame, *keys: str) -> DataFrame:
    """Counts and percentages of all rows; the total is of the few groups."""
    n = counted(df, *keys)
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_all")))).withColumn("percentage", F.round(100 * F.col("n") / F.col("_all"), 4)).drop("_all")


def share_within(df: DataFrame, group: Keys, key: str) -> DataFrame:
    n = counted(df, *group, key)
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*group)), 6))


def missing_profile(df: DataFrame, names: Keys) -> DataFrame:
    row = df.agg(*[F.sum((F.col(c).isNull() | (F.col(c).cast("string") == "")).cast("long")).alias(c) for c in names])
    return row.unpivot([], list(names), "column", "missing")


def summary(df: DataFrame, name: str) -> DataFrame:
    c = F.col(name)
    row = df.agg(F.min(c).alias("min"), F.round(F.avg(c), 6).alias("mean"), F.max(c).alias("max"), F.sum(c.isNull().cast("long")).alias("n_missing"))
    found = row.join(F.broadcast(quantiles(df, name, {"q1": 0.25, "median": 0.5, "q3": 0.75})), how="left")
    return found.select("min", "q1", "median", "mean", "q3", "max", "n_missing")


def described(df: DataFrame, name: str, key: str) -> DataFrame:
    """mean, median, sd, least and most of a column for each value of a key."""
    c = F.col(name)
    rows = df.groupBy(key).agg(F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("sd"), F.min(c).alias("least"), F.max(c).alias("most"))
    median = quantiles(df, name, {"median": 0.5}, [key]).withColumnRenamed(key, "_key")
    return rows.join(median, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, "mean", "median", "sd", "least", "most")


def contingency(df: DataFrame, a: str, b: str, values: Sequence) -> DataFrame:
    return df.groupBy(a).pivot(b, list(values)).count().fillna(0)


# --- windows ----------------------------------------------------------------------------------
def top_with_ties(df: DataFrame, by: str, n: int, keys: Keys = ()) -> DataFrame:
    """The n largest of each group, with all that tie with the last; nulls are the smallest. Without keys
    the n-th largest value is found first, by a distributed top-n, so that nothing is ranked in one task."""
    if not keys:
        top = df.select(F.col(by).alias("_v")).where("_v is not null").orderBy(F.desc("_v")).limit(n)
        cut = top.agg(F.min("_v").alias("_cut"), F.count("*").alias("_some"))
        return df.crossJoin(F.broadcast(cut)).where((F.col(by) >= F.col("_cut")) | (F.col("_some") < n)).drop("_cut", "_some")
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last())
    return df.withColumn("_rk", F.rank().over(w)).where(F.col("_rk") <= n).drop("_rk")


def growth(df: DataFrame, value: str, order: str, keys: Keys = ()) -> DataFrame:
    """Change from the row before in percent, and the running total."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(value).over(w)
    return df.withColumn("growth", F.round((F.col(value) - before) / before * 100, 4)).withColumn("cumulative", F.sum(value).over(w))


# --- reshape ----------------------------------------------------------------------------------
def longer(df: DataFrame, ids: Keys, values: Keys, name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def wider(df: DataFrame, ids: Keys, name: str, value: str, names: Sequence, fill=0) -> DataFrame:
    return df.groupBy(*ids).pivot(name, list(names)).agg(F.first(value)).fillna(fill)


def separated(df: DataFrame, name: str, by: str = "; ") -> DataFrame:
    """One row per part of a delimited cell; empty parts and null cells go."""
    return df.withColumn(name, F.explode(F.split(name, by))).withColumn(name, F.trim(name)).where(F.col(name) != "")


def completed(df: DataFrame, year: str, fills: Keys) -> DataFrame:
    """A row for each year from the first to the last; new rows have zeros."""
    years = df.agg(F.explode(F.sequence(F.min(year).cast("long"), F.max(year).cast("long"))).alias(year))
    return years.join(df.withColumn(year, F.col(year).cast("long")), year, "left").fillna(0, list(fills))


def completed_pairs(df: DataFrame, a: str, b: str, fills: Keys) -> DataFrame:
    """A row for each pair of the (few) values of two categories."""
    grid = df.select(a).distinct().crossJoin(F.broadcast(df.select(b).distinct()))
    return grid.join(df, [a, b], "left").fillna(0, list(fills))


# --- sampling ---------------------------------------------------------------------------------
def draw(key: str, seed: int) -> Column:
    """A uniform draw of each row: a hash of its key and the seed, so samples are repeatable and
    independent of partitions. 52 bits of an MD5, which other engines can compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), 1, 13), 16, 10).cast("long")


def sample_n(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n rows without replacement; a distributed top-n of the draws."""
    return df.orderBy(draw(key, seed), key).limit(n)


#: Draws lie below this.
_DRAWS = 1 << 52
#: Deviations around a stratum's expected draw that are looked through for its quota.
_MARGIN = 6


def _first_draws(df: DataFrame, strata: str, quota: Column, key: str, seed: int) -> DataFrame:
    """``df`` with ``_in``: whether a row is among the first draws of its stratum, as many as its quota.

    Draws are even, so the last one that counts lies near quota / n of their range. Rows clearly
    below are counted, not sorted; only those within some deviations are ranked, so that no task
    sorts a stratum. Where a count shows that a stratum's draws are not so even, all of it is ranked.
    """
    if taken := {c for c in df.columns if c.lower() in ("_in", "_g", "_u", "_q", "_low", "_high", "_below")}:
        raise ValueError(f"columns of these names are made here: {sorted(taken)}")
    group = F.col(strata).alias("_g")
    rows = df.withColumns({"_u": draw(key, seed), "_q": quota.cast("double")})
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"), F.min("_q").alias("_least"), F.max("_q").alias("_most"))
    edge = lambda q, sign: F.lit(float(_DRAWS)) * (F.col(q) + sign * (_MARGIN * F.sqrt(F.greatest(F.col(q), F.lit(1.0))) + 10)) / F.col("_n")
    edges = sizes.withColumns({"_low": F.coalesce(F.when(F.col("_least") >= F.col("_n"), float(_DRAWS)).otherwise(edge("_least", -1)), F.lit(0.0)), "_high": F.coalesce(edge("_most", 1), F.lit(0.0))})
    same = F.col(strata).eqNullSafe(F.col("_g"))
    below = rows.select(strata, "_u").join(edges, same).groupBy("_g", "_n", "_least", "_most", "_low", "_high").agg(F.sum((F.col("_u") < F.col("_low")).cast("long")).alias("_below"), F.sum((F.col("_u") < F.col("_high")).cast("long")).alias("_upto"))
    even = (F.col("_below") <= F.col("_least")) & (F.col("_upto") >= F.least(F.ceil("_most"), F.col("_n")))
    known = below.select("_g", F.when(even, F.col("_low")).otherwise(0.0).alias("_low"), F.when(even, F.col("_high")).otherwise(float(_DRAWS)).alias("_high"), F.when(even, F.col("_below")).otherwise(0).alias("_below"))
    placed = rows.join(known, same)
    sure = placed.where("_u < _low").withColumn("_in", F.col("_q").isNotNull())
    rank = F.row_number().over(Window.partitionBy("_g").orderBy("_u", key))
    near = placed.where("_u >= _low and _u < _high").withColumn("_in", F.coalesce(F.col("_below") + rank <= F.col("_q"), F.lit(False)))
    out = placed.where("_u >= _low and _u >= _high").withColumn("_in", F.lit(False))
    return sure.unionByName(near).unionByName(out).select(*df.columns, "_in")


def sample_strata(df: DataFrame, strata: str, quota: Column, key: str, seed: int) -> DataFrame:
    """In each stratum as many rows as the quota column says, or all there are."""
    return _first_draws(df, strata, quota, key, seed).where("_in").drop("_in")


def split(df: DataFrame, strata: str, share: float, key: str, seed: int) -> DataFrame:
    """Add ``is_train``: the first ceil(share * n) draws of each stratum."""
    sizes = df.groupBy(F.col(strata).alias("_s")).agg(F.ceil(F.count("*") * share).alias("_goal"))
    goal = df.join(sizes, F.col(strata).eqNullSafe(F.col("_s"))).drop("_s")
    return _first_draws(goal, strata, F.col("_goal"), key, seed).drop("_goal").withColumnRenamed("_in", "is_train")


def proportional_quotas(counts: dict[str, int], total: int) -> dict[str, int]:
    """Rounded shares of at least 1; the largest is lowered, or raised, until the sum fits."""
    all_ = sum(counts.values())
    out = {k: max(1, round(total * n / all_)) for k, n in sorted(counts.items())}
    while sum(out.values()) > total and max(out.values()) > 1:
        out[max(out, key=lambda k: out[k])] -= 1
    while out and sum(out.values()) < min(total, all_):
        free = [k for k in out if out[k] < counts[k]]
        if not free:
            break
        out[max(free, key=lambda k: out[k])] += 1
    return out


def balanced_quotas(names: Sequence[str], total: int) -> dict[str, int]:
    each, extra = divmod(total, len(names))
    return {k: each + (i < extra) for i, k in enumerate(sorted(names))}


def balanced_draws(names: Sequence[str], total: int, seed: int) -> dict[str, int]:
    """As many for each name, and one more for as many drawn names as there are left over."""
    import hashlib

    each, extra = divmod(total, len(names))
    order = sorted(names, key=lambda k: (hashlib.md5(f"{k}:{seed}".encode()).hexdigest(), k))
    return {k: each + (k in order[:extra]) for k in sorted(names)}


def rolled_up(df: DataFrame, keys: Keys, *aggregates: Column) -> DataFrame:
    """Aggregates of the keys and of each shorter list of them, to the total; ``level`` counts the keys
    that are summed over."""
    return df.rollup(*keys).agg(F.grouping_id().alias("_id"), *aggregates).withColumn("level", F.bit_count("_id").cast("int")).drop("_id")


def cubed(df: DataFrame, keys: Keys, *aggregates: Column) -> DataFrame:
    """Aggregates of each subset of the keys."""
    return df.cube(*keys).agg(F.grouping_id().alias("_id"), *aggregates).withColumn("level", F.bit_count("_id").cast("int")).drop("_id")


def narrowed(df: DataFrame, names: Keys) -> DataFrame:
    """Whole numbers in the narrowest type that holds all values of a column; found in one pass."""
    whole = [c for c in names]
    row = df.agg(*[F.max(F.abs(c)).alias(f"m_{c}") for c in whole], *[F.max((F.col(c) != F.floor(c)).cast("int")).alias(f"f_{c}") for c in whole]).first()

    def kind(c: str) -> str | None:
        most, fraction = row[f"m_{c}"], row[f"f_{c}"]
        if most is None or fraction:
            return None
        return next(k for k, top in (("tinyint", 127), ("smallint", 32_767), ("int", 2**31 - 1), ("bigint", 2**63 - 1)) if most <= top)

    kinds = {c: kind(c) for c in whole}
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) if kinds.get(c) else F.col(c) for c in df.columns])


def first_names(df: DataFrame) -> DataFrame:
    """Of columns that share a name, the first stays."""
    first = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    unique = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return unique.select(*[F.col(f"_{i}").alias(name) for i, name in enumerate(df.columns) if first[name] == i])


def column_sets(a: Keys, b: Keys) -> dict[str, list[str]]:
    """Names that both lists have, that one alone has, and all, in the order they come."""
    a, b = list(dict.fromkeys(a)), list(dict.fromkeys(b))
    return {"shared": [c for c in a if c in b], "only_first": [c for c in a if c not in b], "only_second": [c for c in b if c not in a], "all": list(dict.fromkeys([*a, *b]))}


def repeated(df: DataFrame, times: str, name: str) -> DataFrame:
    """Each row as often as ``times`` says, numbered from 1; none for null or less than one."""
    n = F.col(times).cast("long")
    return df.withColumn(name, F.explode(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n))))
