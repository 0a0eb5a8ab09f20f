"""Analyses of extracted and classified documents: profiles, rates, rankings, flows and run grids.

Each is one aggregation that combines before its shuffle; what is returned has a row for a group, a
flag or a run, so no result grows with the documents unless it says so."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.tables import counted, separated


def _stacked(df: DataFrame, rows: Sequence[dict[str, Column]]) -> DataFrame:
    """A row for each of ``rows`` from the one row of an aggregate."""
    return df.select(F.explode(F.array(*[F.struct(*[c.alias(k) for k, c in r.items()]) for r in rows])).alias("x")).select("x.*")


def _percent(part: Column, whole: Column) -> Column:
    return F.round(100.0 * part / F.when(whole > 0, whole), 4)


def completeness(*flags: Column) -> Column:
    """How many of the flags are set; null counts as not set."""
    return sum((F.coalesce(f, F.lit(False)).cast("long") for f in flags), F.lit(0).cast("long"))


def info_rates(docs: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """flag, n and percent of the documents that have it; percent is null of an empty table."""
    sums = [F.coalesce(F.sum(F.coalesce(f, F.lit(False)).cast("long")), F.lit(0)).alias(f"f{i}") for i, f in enumerate(flags.values())]
    one = docs.agg(F.count("*").alias("all"), *sums)
    return _stacked(one, [{"flag": F.lit(k), "n": F.col(f"f{i}"), "percent": _percent(F.col(f"f{i}"), F.col("all"))} for i, k in enumerate(flags)])


def run_matrix(df: DataFrame, methods: dict[str, Column], filters: dict[str, Column]) -> DataFrame:
    """method, run, n, found and percent for each method under each filter, also where no row passes."""
    names = [(m, f) for m in methods for f in filters]
    passes = lambda f: F.coalesce(filters[f], F.lit(False))
    sums = []
    for i, (m, f) in enumerate(names):
        hit = passes(f) & F.coalesce(methods[m], F.lit(False))
        sums += [F.count_if(passes(f)).alias(f"n{i}"), F.count_if(hit).alias(f"h{i}")]
    rows = [{"method": F.lit(m), "run": F.lit(f), "n": F.col(f"n{i}"), "found": F.col(f"h{i}"), "percent": _percent(F.col(f"h{i}"), F.col(f"n{i}"))} for i, (m, f) in enumerate(names)]
    return _stacked(df.agg(*sums), rows)


def flow(steps: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """position, step, n and the number of rows removed since the step before (null at the first)."""
    each = [df.agg(F.count("*").alias("n")).select(F.lit(i).alias("position"), F.lit(name).alias("step"), "n") for i, (name, df) in enumerate(steps)]
    out = each[0]
    for df in each[1:]:
        out = out.unionByName(df)
    return out.withColumn("removed", F.lag("n").over(Window.orderBy("position")) - F.col("n"))  # a row a step


def class_balance(steps: dict[str, DataFrame], label: str) -> DataFrame:
    """step, label, n and percent of each class before and after balancing, or at any other steps."""
    out = None
    for name, df in steps.items():
        one = counted(df, label).select(F.lit(name).alias("step"), label, "n")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("percent", _percent(F.col("n"), F.sum("n").over(Window.partitionBy("step"))))


def training_profile(df: DataFrame, label: str, origin: str, year: str, length: str, category: str, top: int = 10) -> DataFrame:
    """section, label, name and value: numbers of each label, of each label and origin, years and text
    lengths by label, and the ``top`` values of a category column that holds lists with "; "."""
    kind = [F.col(label).alias("label")]
    by = df.groupBy(*kind).agg(F.count("*").alias("n"), F.min(year).alias("first"), F.max(year).alias("last"), F.min(length).alias("shortest"), F.avg(length).alias("mean"), F.max(length).alias("longest"))
    facts = [("labels", "n", "n"), ("years", "first", "first"), ("years", "last", "last"), ("lengths", "shortest", "shortest"), ("lengths", "mean", "mean"), ("lengths", "longest", "longest")]
    row = lambda section, name, c: F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), F.round(F.col(c).cast("double"), 6).alias("value"))
    by = by.select("label", F.explode(F.array(*[row(*f) for f in facts])).alias("x")).select("x.section", "label", "x.name", "x.value")
    origins = df.groupBy(*kind, F.col(origin).alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit("origins").alias("section"), "label", "name", "value")
    most = counted(separated(df.select(F.col(category).alias("name")), "name"), "name").orderBy(F.desc("n"), "name").limit(top)
    return by.unionByName(origins).unionByName(most.select(F.lit("top").alias("section"), F.lit(None).cast("string").alias("label"), "name", F.col("n").cast("double").alias("value")))


def region_class(countries: Column, north: Sequence[str], south: Sequence[str]) -> Column:
    """Both, North, South or Other of a list of countries; None of an empty list or null."""
    some = lambda names: F.coalesce(F.exists(countries, lambda x: x.isin(*names)), F.lit(False))
    n, s = some(north), some(south)
    return F.when(n & s, "Both").when(n, "North").when(s, "South").when(F.size(countries) > 0, "Other").otherwise("None")


def known_counts(known: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """name and n for each known value, 0 for those that ``found`` lacks; found values that aren't
    known are left out."""
    return known.select(name).distinct().join(counted(found, name), name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"))


def extremes(known: DataFrame, found: DataFrame, name: str, n: int = 15) -> DataFrame:
    """side ("top" or "bottom"), name and n of the n most and least frequent known values, by their
    full counts; ties by name."""
    all_ = known_counts(known, found, name)
    side = lambda s, by: all_.orderBy(by, name).limit(n).select(F.lit(s).alias("side"), name, "n")
    return side("top", F.desc("n")).unionByName(side("bottom", F.asc("n")))


def below(known: DataFrame, found: DataFrame, name: str, least: int = 15) -> DataFrame:
    """Known values found fewer than ``least`` times, with their numbers."""
    return known_counts(known, found, name).where(F.col("n") < least)


def top_values(df: DataFrame, name: str, by: str = "; ", excluded: Sequence[str] = (), n: int = 15) -> DataFrame:
    """The n most frequent values of a column of lists, without the excluded ones; ties by value."""
    return counted(separated(df.select(name), name, by).where(~F.col(name).isin(*excluded)), name).orderBy(F.desc("n"), name).limit(n)


def per_document(df: DataFrame, name: str, by: str = "; ") -> DataFrame:
    """size and n: how many rows have so many distinct values in their list; null is an empty list."""
    values = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(F.col(name), F.lit("")), by), F.trim), lambda x: x != ""))
    return df.groupBy(F.size(values).cast("long").alias("size")).agg(F.count("*").alias("n"))


def share_of_all(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """share of the keys all of whose rows have the flag; a null flag is not set."""
    each = df.groupBy(key).agg(F.bool_and(F.coalesce(flag, F.lit(False))).alias("every"))
    return each.agg(F.round(F.avg(F.col("every").cast("int")), 6).alias("share"))


def share_by(df: DataFrame, key: str, group: str) -> DataFrame:
    """group, n and percent of all distinct keys that have a row in the group."""
    pairs = df.select(key, group).distinct()
    total = pairs.agg(F.countDistinct(key).alias("_all"))
    return pairs.groupBy(group).agg(F.count(key).alias("n")).crossJoin(total).select(group, "n", _percent(F.col("n"), F.col("_all")).alias("percent"))  # the total is one row


def best_config(grid: DataFrame, scores: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the highest mean of the scores; of equal ones the first by ``order`` (numbers)."""
    mean = sum((F.col(c) for c in scores[1:]), F.col(scores[0])) / len(scores)
    return grid.agg(F.max_by(F.struct(*grid.columns), F.struct(mean.alias("score"), *[(-F.col(c)).alias(c) for c in order])).alias("x")).where("x is not null").select("x.*")


# --- combinations and trends --------------------------------------------------------------------
def first_combination(rules: Sequence[tuple[Sequence[str], str]], otherwise: str) -> Column:
    """The label of the first rule all of whose flags are set; null counts as not set."""
    out = F.when(F.lit(False), F.lit(""))
    for flags, label in rules:
        out = out.when(completeness(*map(F.col, flags)) == len(flags), label)
    return out.otherwise(otherwise)


def combination_rules(core: dict[str, str], others: dict[str, str] | None = None) -> list[tuple[tuple[str, ...], str]]:
    """Rules for a few core flags (column to name): all, then each smaller combination, largest first. With
    ``others`` there are classes for these alone as well, and one before all for the cores with the
    first two of the others."""
    from itertools import combinations

    columns, rules = list(core), []
    if others:
        rules.append((tuple(columns) + tuple(others)[:2], f"Multiple methods ({len(columns) + 2}+ types)"))
    for size in range(len(columns), 0, -1):
        for some in combinations(columns, size):
            whole = size == len(columns) and not others
            rules.append((some, f"All {('zero', 'one', 'two', 'three', 'four')[size]} methods" if whole else f"{core[some[0]]} only" if size == 1 else " + ".join(core[c] for c in some)))
    return rules + [((c,), f"{name} only") for c, name in (others or {}).items()]


def combination_counts(docs: DataFrame, schemes: dict[str, Sequence[tuple[Sequence[str], str]]], otherwise: str = "No methods detected") -> DataFrame:
    """(scheme, label, n, percent) of the documents, which are read once for all schemes."""
    told = F.array(*[F.struct(F.lit(k).alias("scheme"), first_combination(rules, otherwise).alias("label")) for k, rules in schemes.items()])
    n = docs.select(F.explode(told).alias("x")).groupBy("x.scheme", "x.label").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("scheme")), 4))


def trends(rows: DataFrame, key: str, period: str, methods: dict[str, str], north: str, south: str, species: str, kingdom: str, flags: Sequence[str], high: int = 3) -> DataFrame:
    """(trend, period, item, n, total, percent): methods, geography, species, kingdoms and completeness over
    the periods. ``rows`` may have several rows of a document: the first three trends count a document
    once a period with what any of its rows has, the others count rows, as each is a finding.

    geography is of documents with either of its flags; "distinct species" has no total; "mean score"
    has the sum of the flags as n.
    """
    any_of = lambda c: F.max(F.coalesce(F.col(c), F.lit(False)))
    docs = rows.groupBy(period, key).agg(*[any_of(c).alias(f"_m{i}") for i, c in enumerate(methods.values())], any_of(north).alias("_n"), any_of(south).alias("_s"), F.max(F.col(species).isNotNull()).alias("_f"))
    count = lambda c: F.sum(c.cast("long"))
    either = F.col("_n") | F.col("_s")
    once = docs.groupBy(period).agg(F.count("*").alias("_all"), *[count(F.col(f"_m{i}")).alias(f"_m{i}") for i in range(len(methods))], count(either).alias("_either"), count(F.col("_n")).alias("_n"), count(F.col("_s")).alias("_s"), count(F.col("_f")).alias("_f"))
    row = lambda trend, item, n, total: F.struct(F.lit(trend).alias("trend"), F.lit(item).alias("item"), n.cast("long").alias("n"), total.cast("long").alias("total"))
    of_docs = [row("methods", name, F.col(f"_m{i}"), F.col("_all")) for i, name in enumerate(methods)]
    of_docs += [row("geography", "north", F.col("_n"), F.col("_either")), row("geography", "south", F.col("_s"), F.col("_either")), row("species", "documents with species", F.col("_f"), F.col("_all"))]
    score = completeness(*map(F.col, flags))
    every = rows.groupBy(period).agg(F.countDistinct(species).alias("_d"), F.count("*").alias("_rows"), F.sum(score).alias("_score"), count(score >= high).alias("_high"))
    of_rows = [row("species", "distinct species", F.col("_d"), F.lit(None)), row("completeness", "mean score", F.col("_score"), F.col("_rows")), row("completeness", f"score of {high} or more", F.col("_high"), F.col("_rows"))]
    by_kingdom = rows.where(F.col(kingdom).isNotNull()).groupBy(period, kingdom).agg(F.count("*").alias("_n"))
    by_kingdom = by_kingdom.select(period, F.struct(F.lit("kingdoms").alias("trend"), F.col(kingdom).cast("string").alias("item"), F.col("_n").alias("n"), F.sum("_n").over(Window.partitionBy(period)).alias("total")).alias("x"))
    tall = once.select(period, F.explode(F.array(*of_docs)).alias("x")).unionByName(every.select(period, F.explode(F.array(*of_rows)).alias("x"))).unionByName(by_kingdom)
    return tall.select("x.trend", F.col(period).alias("period"), "x.item", "x.n", "x.total", _percent(F.col("x.n"), F.col("x.total")).alias("percent"))
