"""Information extraction from texts: names against a taxonomy, methods, parts, places, traits,
evidence and statements. Dictionaries are arguments, or tables of ``sources.reference``."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import dictionary as dc
from quillspark.operators import nearest as nr
from quillspark.operators.tables import exploded, first_by, repeated_keys
from quillspark.sources.files import scratch


# --- taxonomy ---------------------------------------------------------------------------------
@dataclass
class Lookups:
    accepted: DataFrame
    synonyms: DataFrame
    genus: DataFrame
    family: DataFrame


def lookups(taxonomy: DataFrame) -> Lookups:
    """Accepted names, synonyms with the accepted name they point to (the first by taxonID), and
    the distinct genera and families with their places."""
    lower = taxonomy.withColumn("name", F.lower("canonicalName"))
    accepted = lower.where("taxonomicStatus = 'accepted'")
    target = accepted.select(F.col("taxonID").alias("acceptedNameUsageID"), F.col("canonicalName").alias("resolved_name"), "kingdom", "phylum", "family", "genus")
    synonyms = lower.where("taxonomicStatus <> 'accepted' and acceptedNameUsageID is not null").select("taxonID", "name", "acceptedNameUsageID").join(target, "acceptedNameUsageID")
    genus = accepted.where("genus is not null and phylum is not null").select(F.lower("genus").alias("name"), "genus", "kingdom", "phylum", "family").distinct()
    family = accepted.where("family is not null and phylum is not null").select(F.lower("family").alias("name"), "kingdom", "phylum", "family").distinct()
    return Lookups(accepted, first_by(synonyms, ["name"], ["taxonID"]), genus, family)


def validated(names: DataFrame, name: str, found: Lookups) -> DataFrame:
    """ACCEPTED rows and, of the names that are not, SYNONYM rows with the accepted taxon; a name
    in two kingdoms gives two rows, and unknown names none."""
    asked = names.withColumn("name", F.lower(name))
    yes = asked.join(found.accepted.select("name", F.col("canonicalName").alias("resolved_name"), "kingdom", "phylum", "family", "genus"), "name").withColumn("status", F.lit("ACCEPTED"))
    rest = asked.join(found.accepted.select("name").distinct(), "name", "left_anti")
    syn = rest.join(found.synonyms.select("name", "resolved_name", "kingdom", "phylum", "family", "genus"), "name").withColumn("status", F.lit("SYNONYM"))
    return yes.unionByName(syn)


def taxa(docs: DataFrame, key: str, text: str, found: Lookups, max_tokens: int | None = None) -> DataFrame:
    """One row per document and match (species, genus, family), or one NO_MATCH row.

    The names of the taxonomy are found in one pass over the documents (``operators.dictionary``),
    and only what they have is joined; names of two words only in texts of at most ``max_tokens``
    tokens where that is given. Names of more than two words are not searched.
    """
    one = found.accepted.select("name").union(found.synonyms.select("name")).union(found.genus.select("name")).union(found.family.select("name"))
    known = dc.dictionary(one.where(~F.contains("name", F.lit("  ")) & (F.size(F.split("name", " ")) <= 2)), "name")
    low = docs.select(key, dc.spaced(F.col(text)).alias("_t"))
    if max_tokens:
        low = low.withColumn("_long", F.size(F.split("_t", " ")) - 2 > max_tokens)
    terms = dc.pairs(low, F.col("_t"), known, "term")
    if max_tokens:
        terms = terms.where(~F.col("_long") | ~F.contains("term", F.lit(" ")))
    terms = terms.select(key, "term").distinct()
    species = validated(terms, "term", found).select(key, F.lit("species").alias("match_type"), "resolved_name", "kingdom", "phylum", "family", "genus", "status")
    genus = terms.join(found.genus, F.col("term") == F.col("name")).select(key, F.lit("genus").alias("match_type"), F.col("genus").alias("resolved_name"), "kingdom", "phylum", "family", "genus", F.lit("ACCEPTED").alias("status"))
    family = terms.join(found.family, F.col("term") == F.col("name")).select(key, F.lit("family").alias("match_type"), F.col("family").alias("resolved_name"), "kingdom", "phylum", "family", F.lit(None).cast("string").alias("genus"), F.lit("ACCEPTED").alias("status"))
    hits = species.union(genus).union(family).distinct()
    none = docs.join(hits.select(key).distinct(), key, "left_anti").select(key, F.lit("none").alias("match_type"), *[F.lit(None).cast("string").alias(c) for c in ("resolved_name", "kingdom", "phylum", "family", "genus")], F.lit("NO_MATCH").alias("status"))
    return hits.union(none)


def expanded_abbreviations(names: DataFrame, name: str, taxonomy: DataFrame) -> DataFrame:
    """"A. macrophyllum" to the accepted names with that initial and epithet."""
    parts = names.withColumn("_i", F.lower(F.substring(name, 1, 1))).withColumn("_e", F.lower(F.regexp_extract(name, r"^[A-Za-z]\.\s+(\S+)$", 1))).where("_e <> ''")
    known = taxonomy.where("taxonomicStatus = 'accepted'").select("canonicalName", F.lower(F.substring("canonicalName", 1, 1)).alias("_i"), F.lower(F.element_at(F.split("canonicalName", " "), -1)).alias("_e"))
    return parts.join(known, ["_i", "_e"]).drop("_i", "_e")


# --- traits -----------------------------------------------------------------------------------
#: The guilds that count as mycorrhizal.
MYCORRHIZAL = ("Ectomycorrhizal", "Arbuscular Mycorrhizal", "Ericoid Mycorrhizal", "Orchid Mycorrhizal")


def is_mycorrhizal(guild: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(guild, F.lit(g)) for g in MYCORRHIZAL]), F.lit(False))


def classified(names: DataFrame, traits: DataFrame) -> DataFrame:
    """resolved_name, is_mycorrhizal, guild, confidence: by clade (0.95), by the species' guild
    (0.9), by the genus' most common guild (0.7), or unknown (0.1)."""
    wide = traits.groupBy("species").agg(F.max(F.when(F.col("trait_name") == "guild_fg", F.col("value"))).alias("guild"), F.max(F.when(F.col("trait_name") == "higher_clade", F.col("value"))).alias("clade"))
    genus = wide.where("guild is not null").groupBy(F.split("species", "_")[0].alias("_genus"), "guild").count()
    genus = first_by(genus, ["_genus"], [F.desc("count"), "guild"]).select("_genus", F.col("guild").alias("_genus_guild"))
    out = names.select("resolved_name").distinct().withColumn("species", F.regexp_replace("resolved_name", " ", "_")).withColumn("_genus", F.split("resolved_name", " ")[0])
    out = out.join(wide, "species", "left").join(genus, "_genus", "left")
    clade = F.col("clade") == "Glomeromycota"
    return out.select(
        "resolved_name",
        F.when(clade, True).when(F.col("guild").isNotNull(), is_mycorrhizal(F.col("guild"))).when(F.col("_genus_guild").isNotNull(), is_mycorrhizal(F.col("_genus_guild"))).otherwise(False).alias("is_mycorrhizal"),
        F.coalesce(F.when(clade, F.coalesce("guild", F.lit("Arbuscular Mycorrhizal"))), "guild", "_genus_guild", F.lit("Unknown")).alias("guild"),
        F.when(clade, 0.95).when(F.col("guild").isNotNull(), 0.9).when(F.col("_genus_guild").isNotNull(), 0.7).otherwise(0.1).alias("confidence"),
    )


def only_such(found: DataFrame, key: str, flag: str) -> DataFrame:
    """Per document: members, those with the flag, those without, and whether all have it."""
    yes, no = F.sum(F.col(flag).cast("long")), F.sum((~F.col(flag)).cast("long"))
    return found.groupBy(key).agg(F.count("*").alias("n"), yes.alias("with_flag"), no.alias("without_flag"), ((yes > 0) & (no == 0)).alias("only"))


# --- methods, parts, places -------------------------------------------------------------------
def methods(docs: DataFrame, text: str, keywords: dict[str, list[str]]) -> DataFrame:
    """A flag per category and the summary of the true ones, in the order of the dictionary."""
    flags = {f"{k}_methods": F.coalesce(tx.has_any(F.col(text), ws), F.lit(False)) for k, ws in keywords.items()}
    out = docs.withColumns(flags)
    return out.withColumn("methods_summary", F.array_join(F.filter(F.array(*[F.when(F.col(f"{k}_methods"), F.lit(k)) for k in keywords]), lambda x: x.isNotNull()), "; "))


def singular(word: Column, irregular: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in irregular.items() for x in kv]) if irregular else F.create_map(F.lit(""), F.lit(""))
    plain = F.when(word.endswith("ies"), F.regexp_replace(word, "ies$", "y")).when(word.endswith("ves"), F.regexp_replace(word, "ves$", "f")).when(word.endswith("s") & ~word.endswith("ss"), F.regexp_replace(word, "s$", "")).otherwise(word)
    return F.coalesce(F.element_at(pairs, word) if irregular else F.lit(None), plain)


def parts(docs: DataFrame, text: str, simple: list[str], compound: list[str], irregular: dict[str, str]) -> DataFrame:
    """Parts in the order of the text, then compound terms in the dictionary's; their number; and
    the distinct singulars, kept only where they are keywords."""
    known = F.array(*map(F.lit, sorted({*simple, *compound})))
    found = F.concat(tx.extract_words(F.col(text), simple), tx.contained(F.col(text), compound))
    one = lambda w: F.when(F.array_contains(known, singular(w, irregular)), singular(w, irregular)).otherwise(w)
    out = docs.withColumn("_f", F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))))
    return out.withColumns({"plant_parts_detected": F.array_join("_f", "; "), "parts_count": F.size("_f").cast("long"), "parts_normalized": F.array_join(F.array_distinct(F.transform("_f", one)), "; ")}).drop("_f")


@dataclass
class PlaceRule:
    """A country whose name means other things too: it counts where ``needs`` (if given) is
    found and ``not_with`` (if given) isn't."""

    name: str
    needs: str = ""
    not_with: str = ""


def places(docs: DataFrame, text: str, countries: dict[str, str], rules: list[PlaceRule], synonyms: dict[str, str], adjectives: dict[str, str], continents: list[str], regions: list[str], north: set[str], institutions: dict[str, str] | None = None, again: bool = False) -> DataFrame:
    """Countries by name (longest first), synonym, institution (patterns of the lower-cased text) and
    adjective, in this order, canonical and distinct; North and South, continents, regions, whether
    coordinates are given, and a summary. With ``again``, texts without a country are searched once
    more for capitalised phrases (``second_pass``)."""
    c, low = F.col(text), F.lower(text)
    special = {r.name: r for r in rules}
    bounded = lambda w: rf"(?i)(?<!\w){tx.escaped(w)}(?!\w)".replace(" ", r"\s+")

    def hit(name: str, to: str) -> Column:
        yes = c.rlike(bounded(name))
        r = special.get(to)
        if r and r.needs:
            yes = yes & low.rlike(r.needs)
        if r and r.not_with:
            yes = yes & ~low.rlike(r.not_with)
        return F.when(yes, F.lit(to))

    names = sorted(countries, key=lambda n: (-len(n), n))
    every = [hit(n, n) for n in names] + [hit(s, to) for s, to in synonyms.items()]
    every += [F.when(low.rlike(pattern), F.lit(to)) for pattern, to in (institutions or {}).items()] + [hit(a, to) for a, to in adjectives.items()]
    clean = lambda cols: F.array_distinct(F.filter(F.array(*cols), lambda x: x.isNotNull()))
    out = docs.withColumn("_c", clean(every))
    if again:
        out = second_pass(out, text, "_c", list(countries), synonyms, rules)
    words_of = lambda ws: clean([F.when(c.rlike(bounded(w)), F.lit(w)) for w in ws])
    out = out.withColumns({"_k": words_of(continents), "_r": words_of(regions)})
    top = F.array(*map(F.lit, sorted(north)))
    return out.withColumns({
        "countries_detected": F.array_join("_c", "; "), "global_north_countries": F.array_join(F.array_intersect("_c", top), "; "),
        "global_south_countries": F.array_join(F.array_except("_c", top), "; "), "continents_detected": F.array_join("_k", "; "),
        "regions_detected": F.array_join("_r", "; "), "has_coordinates": F.coalesce(has_coordinates(c), F.lit(False)),
        "geographic_summary": geographic_summary(F.col("_c"), F.col("_k"), F.col("_r")),
    }).drop("_c", "_k", "_r")


_D, _P = r"-?\d{1,2}(?:\.\d+)?\s*,\s*-?\d{1,3}(?:\.\d+)?", r"\b\d{1,2}(?:\.\d+)?[°]?\s*[NS]\b.*?\b\d{1,3}(?:\.\d+)?[°]?\s*[EW]\b"
#: The 19 forms of coordinates, in the order in which they are tried.
COORDINATES = [
    _P,  # 45.5°N, 122.3°W
    rf"\b{_D}\b",  # 45.5, -122.3
    r"""\b\d{1,2}[°]\s*\d{1,2}['′]?\s*\d{0,2}[″"]?\s*[NS]\b.*?\b\d{1,3}[°]\s*\d{1,2}['′]?\s*\d{0,2}[″"]?\s*[EW]\b""",  # 45°30'45"N, 122°45'30"W
    r"\b\d{1,2}\.\d+[NS]\s*,?\s*\d{1,3}\.\d+[EW]\b",  # 45.5N, 122.3W
    r"\b\d{1,2}[NS]\s*,?\s*\d{1,3}[EW]\b",  # 45N, 122W
    r"\b\d{1,2}\s+\d{1,2}[′']?\s*[NS]\s*,?\s*\d{1,3}\s+\d{1,2}[′']?\s*[EW]\b",  # 45 30 N, 122 45 W
    rf"\(\s*{_D}\s*\)",  # (45.5, -122.3)
    r"\b\d{1,2}°\d{1,2}['′]\s*[NS]\s*,?\s*\d{1,3}°\d{1,2}['′]\s*[EW]\b",  # 45°30′N, 122°45′W
    r"\b\d{1,2}[NS]\s+\d{6}\s+\d{7}\b",  # 45N 123456 7890123
    r"\b\d{1,2}[NS]\d{6,7}\b",  # 45N123456
    r"\b\d{1,2}-\d{1,2}[°]?[NS]\s*,?\s*\d{2,3}-\d{2,3}[°]?[EW]\b",  # 40-50°N, 120-130°W
    r"\b[NS]\d{1,2}\.\d+\s*,?\s*[EW]\d{2,3}\.\d+\b",  # N45.5, W122.3
    rf"\[\s*{_D}\s*\]",  # [45.5, -122.3]
    _P + r".*?\b\d+[mft]\b",  # 45.5°N 122.3°W 1500m
    r"\b[a-zA-Z]{2}\s*\d{4}\s*\d{4}\b",  # SU 1234 5678
    r"\b[a-zA-Z]{2}-\d{4}-\d{4}\b",  # SU-1234-5678
    r"\b\d{4}[NS]\d{6}[EW]\b",
    r"\b\d{6}[NS]\s*\d{6}[EW]\b",
    r"\b\d{8}[NS][EW]\b",
]

#: How each of the forms begins: at other places none of them is tried.
COORDINATES_START = r"(?=-?\d|[(\[]\s*+-?\d|[NS]\d|[a-zA-Z]{2}(?:\s*+|-)\d)"


def has_coordinates(c: Column) -> Column:
    """Whether any of all matches is possible: of two or more numbers one is at most 90, a single
    one at most 180, or a grid reference from 100,000 on. No text has none."""
    hits = F.regexp_extract_all(c, F.lit(f"(?U){COORDINATES_START}(?:{'|'.join(COORDINATES)})"), F.lit(0))
    numbers = lambda hit: F.transform(F.regexp_extract_all(hit, F.lit(r"-?\d+\.?\d*"), F.lit(0)), lambda x: x.try_cast("double"))
    possible = lambda n: F.when(F.size(n) >= 2, F.exists(n, lambda x: F.abs(x) <= 90)).otherwise(F.exists(n, lambda x: (F.abs(x) <= 180) | (x >= 100_000)))
    # every form has a digit
    return F.when(c.rlike(r"(?U)\d"), F.coalesce(F.exists(hits, lambda hit: possible(numbers(hit))), F.lit(False))).otherwise(False)


def geographic_summary(countries: Column, continents: Column, regions: Column) -> Column:
    """All places found, each once, in the order countries, continents, regions."""
    return F.array_join(F.array_distinct(F.concat(countries, continents, regions)), "; ")


def standard_country(c: Column, canonical: list[str], synonyms: dict[str, str]) -> Column:
    """A country's canonical name: the title-cased name if it is one, else by synonym, else the
    title-cased input."""
    titled = F.initcap(F.trim(c))
    same = {n.lower(): n for n in canonical} | {s.lower(): to for s, to in synonyms.items()}
    table = F.create_map(*[F.lit(x) for kv in same.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(F.trim(c))), titled)


# --- evidence and statements ------------------------------------------------------------------
def evidence(docs: DataFrame, text: str, absence: dict[str, tuple[int, list[str]]], method: dict[str, tuple[int, list[str]]]) -> DataFrame:
    """absence_score, method_score, the categories found and the level."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = lambda d: F.filter(F.array(*[F.when(reduce(lambda a, b: a | b, [low.rlike(tx.phrase_pattern(p)) for p in ps]), F.lit(k)) for k, (_, ps) in d.items()]), lambda x: x.isNotNull())
    out = docs.withColumns({"absence_score": tx.phrase_score(low, absence).cast("long"), "method_score": tx.phrase_score(low, method).cast("long"), "_a": found(absence), "_m": found(method)})
    return out.withColumns({"absence_categories": F.array_join("_a", "; "), "method_categories": F.array_join("_m", "; "), "confidence_level": evidence_level(F.col("absence_score"), F.col("method_score"), F.size("_a"))}).drop("_a", "_m")


def evidence_level(absence: Column, method: Column, categories: Column) -> Column:
    """The level by its fixed least scores and number of categories."""
    return F.when((absence >= 8) & (method >= 4) & (categories >= 2), "Very High").when((absence >= 6) & (method >= 3), "High").when((absence >= 3) & (method >= 2), "Medium").when((absence >= 1) & (method >= 1), "Low").otherwise("None")


def _labelled(values: Column, dimension: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(dimension).alias("dimension"), v.alias("value")))


def evidence_by(found: DataFrame, level: str, lists: dict[str, str], flags: dict[str, str] | None = None, by: str = "; ") -> DataFrame:
    """(dimension, value, level, n, percent): documents by level for each value of several columns at
    once. ``lists`` names columns of values joined by ``by`` (or of one value), ``flags`` columns that
    are true or not; percent is of the level's documents. Each document is read once."""
    split = lambda c: F.filter(F.array_distinct(F.transform(F.split(F.col(c).cast("string"), by), lambda v: F.trim(v))), lambda v: v != "")
    told = []
    for dimension, c in lists.items():
        values = F.coalesce(split(c), F.array().cast("array<string>"))
        told.append(_labelled(values, dimension))
    for name, c in (flags or {}).items():
        told.append(F.when(F.col(c), F.array(F.struct(F.lit("flag").alias("dimension"), F.lit(name).alias("value")))).otherwise(F.array().cast("array<struct<dimension:string,value:string>>")))
    kind = "array<struct<dimension:string,value:string>>"
    tall = found.select(F.col(level).alias("level"), F.explode(F.concat(*[t.cast(kind) for t in told])).alias("x")).groupBy("x.dimension", "x.value", "level").agg(F.count("*").alias("n"))
    totals = found.groupBy(F.col(level).alias("_level")).agg(F.count("*").alias("_all"))
    out = tall.join(totals, F.col("level").eqNullSafe(F.col("_level")))
    return out.select("dimension", "value", "level", "n", F.round(100 * F.col("n") / F.col("_all"), 4).alias("percent"))


def statements(docs: DataFrame, key: str, text: str, phrases: dict[str, list[str]], least: float = 0.9, sql: bool = False) -> DataFrame:
    """One row per document and phrase found, exactly or within the similarity; texts of fewer
    than 10 characters have none. A text is lower-cased and cut into tokens once for all phrases. ``sql``
    is as for ``near_window``."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    row = lambda category, p, similarity: F.struct(F.lit(category).alias("category"), F.lit(p).alias("phrase"), similarity.alias("similarity"))

    def found(lo: Column, t: Column, category: str, p: str) -> Column:
        near = tx.let(tx.near_window(t, p, least, sql), lambda n: F.when(n.isNotNull(), row(category, p, F.round(n["similarity"], 4))))
        return F.when(lo.rlike(tx.phrase_pattern(p)), row(category, p, F.lit(1.0))).when(F.contains(lo, F.lit(p.lower().split()[0])), near)

    each = [(category, p) for category, ps in phrases.items() for p in ps]
    every = tx.let(low, lambda lo: tx.let(tx.tokens(lo), lambda t: F.filter(F.array(*[found(lo, t, *x) for x in each]), lambda x: x.isNotNull())))
    hits = docs.where(F.length(low) >= 10).select(key, F.explode_outer(every).alias("s"))  # outer: else a filter computes the array too
    return hits.where("s is not null").select(key, "s.*")


def merged(base: DataFrame, key: str, *components: DataFrame) -> DataFrame:
    """Left join of component outputs by key; a component's columns replace those of the base."""
    for c in components:
        base = base.drop(*[x for x in c.columns if x != key]).join(c, key, "left")
    return base


def unrepresented(known: DataFrame, found: DataFrame, name: str) -> DataFrame:
    return known.join(found.select(name).distinct(), name, "left_anti")


def coverage(known: DataFrame, found: DataFrame, name: str, by: str) -> DataFrame:
    """Per group of the reference: how many of its names are found."""
    hit = known.select(by, name).distinct().join(found.select(name).distinct().withColumn("_f", F.lit(1)), name, "left")
    return hit.groupBy(by).agg(F.count("*").alias("total"), F.count("_f").alias("found")).withColumn("percent", F.round(100 * F.col("found") / F.col("total"), 4))


def covered_names(known: DataFrame, found: DataFrame, levels: list[str], group: str) -> DataFrame:
    """(group, level, name, members, found): each distinct name of each level of the reference, how
    many names of the first level it has, and whether it is found.

    ``levels`` go from the lowest up, as columns of ``known``; ``found`` has the columns ``level`` and
    ``name``. A name is found if it is so itself or a name of the first level below it is; one pass
    over the reference, with names added up before they are shuffled.
    """
    hits = found.select("level", "name").where("name is not null").distinct()
    lowest = hits.where(F.col("level") == levels[0]).select(F.col("name").alias(levels[0]), F.lit(True).alias("_hit"))
    rows = known.select(group, *levels).distinct().join(lowest, levels[0], "left")
    each = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(c).alias("level"), F.col(c).cast("string").alias("name")) for i, c in enumerate(levels)])
    tall = rows.select(group, F.col(levels[0]).alias("_lowest"), "_hit", F.explode(each).alias("x")).select(group, "_lowest", "_hit", "x.*").where("name is not null")
    names = tall.groupBy(group, "at", "level", "name").agg(F.countDistinct("_lowest").alias("members"), F.max(F.coalesce("_hit", F.lit(False))).alias("_below"))
    direct = hits.withColumn("_direct", F.lit(True))
    out = names.join(direct, ["level", "name"], "left")
    return out.select(group, "at", "level", "name", "members", (F.col("_below") | F.coalesce("_direct", F.lit(False))).alias("found"))


def coverage_levels(names: DataFrame, group: str) -> DataFrame:
    """(group, level, total, found, percent) of ``covered_names``; the null group is that of all groups,
    where a name counts once."""
    whole = names.groupBy("at", "level", "name").agg(F.max("found").alias("found")).withColumn(group, F.lit(None).cast(names.schema[group].dataType))
    every = names.where(F.col(group).isNotNull()).select(group, "at", "level", "name", "found").unionByName(whole)
    out = every.groupBy(group, "at", "level").agg(F.count("*").alias("total"), F.sum(F.col("found").cast("long")).alias("found"))
    return out.select(group, "level", "total", "found", F.round(100 * F.col("found") / F.col("total"), 4).alias("percent"))


def missing_ranked(names: DataFrame, group: str, level: str, most: int = 5) -> DataFrame:
    """(group, n_missing, members, top): the names of a level that are not found, how many names of the
    first level they have, and the ``most`` largest as "name (members); ..."."""
    lost = names.where((F.col("level") == level) & ~F.col("found"))
    order = Window.partitionBy(group).orderBy(F.desc("members"), "name")
    top = lost.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.format_string("%s (%d)", "name", "members").alias("x")))), lambda x: x["x"]), "; ")
    totals = lost.groupBy(group).agg(F.count("*").alias("n_missing"), F.sum("members").alias("members"))
    return totals.join(top.groupBy(F.col(group).alias("_g")).agg(text.alias("top")), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def tf_idf(terms: DataFrame, doc: str, term: str, n: str) -> DataFrame:
    """tf = n / all of the document, idf = ln(documents / documents with the term). ``terms`` has one
    row of a document and term, as ``term_counts`` gives them."""
    df = terms.groupBy(term).agg(F.count(doc).alias("_df"))
    docs = terms.agg(F.countDistinct(doc).alias("_docs"))
    # a document's terms are few, those of a frequent term's documents are not: only the first are summed in a window
    out = terms.where(F.col(doc).isNotNull()).withColumn("_all", F.sum(n).over(Window.partitionBy(doc))).join(df, term).crossJoin(F.broadcast(docs))
    tf, idf = F.col(n) / F.col("_all"), F.log(F.col("_docs") / F.col("_df"))
    return out.select(doc, term, tf.alias("tf"), idf.alias("idf"), (tf * idf).alias("tf_idf"))


#: Words whose document frequencies are broadcast.
BROADCAST_WORDS = 500_000


def text_tf_idf(docs: DataFrame, key: str, text: str, stop: list[str]) -> DataFrame:
    """``tf_idf`` of the ``term_counts`` of texts. Where each key has one text, words are counted and summed
    within their row; the documents of each word are counted and stored, and where there are not
    more words than ``BROADCAST_WORDS`` they are broadcast, so that the counts themselves are never shuffled."""
    if repeated_keys(docs, key):
        return tf_idf(term_counts(docs, key, text, stop), key, "word", "n")
    plain = F.filter(tx.run_lengths(tx.words(F.col(text))), lambda x: ~x["value"].rlike(r"\d") & ~x["value"].isin(*stop))
    total = lambda t: F.aggregate(t, F.lit(0).cast("long"), lambda n, x: n + x["n"])
    terms = exploded(docs, [key], tx.let(plain, lambda t: tx.let(total(t), lambda n: F.transform(t, lambda x: F.struct(x["value"].alias("word"), x["n"].alias("n"), n.alias("_all"))))))
    path = scratch(docs.sparkSession, "frequencies")
    terms.groupBy("word").agg(F.count(key).alias("_df")).write.parquet(path)
    df = docs.sparkSession.read.parquet(path)
    has = F.coalesce(F.exists(tx.words(F.col(text)), lambda w: ~w.rlike(r"\d") & ~w.isin(*stop)), F.lit(False))
    n_docs = docs.where(F.col(key).isNotNull() & has).agg(F.count("*").alias("_docs"))
    out = terms.where(F.col(key).isNotNull()).join(F.broadcast(df) if df.count() <= BROADCAST_WORDS else df, "word").crossJoin(F.broadcast(n_docs))
    tf, idf = F.col("n") / F.col("_all"), F.log(F.col("_docs") / F.col("_df"))
    return out.select(key, "word", tf.alias("tf"), idf.alias("idf"), (tf * idf).alias("tf_idf"))


def vocabulary(terms: DataFrame, term: str, n: str, least: int, most: int) -> DataFrame:
    """The most frequent terms of at least ``least`` occurrences."""
    return terms.groupBy(term).agg(F.sum(n).alias("total")).where(F.col("total") >= least).orderBy(F.desc("total"), term).limit(most)


def term_counts(docs: DataFrame, key: str, text: str, stop: list[str]) -> DataFrame:
    """Long document-term counts of words without digits and stop words. Where each key has one text,
    words are counted within their row, and nothing is shuffled."""
    plain = ~F.col("word").rlike(r"\d") & ~F.col("word").isin(*stop)
    if not repeated_keys(docs, key):
        return exploded(docs, [key], tx.run_lengths(tx.words(F.col(text)))).select(key, F.col("value").alias("word"), "n").where(plain)
    w = docs.select(key, F.explode(tx.words(F.col(text))).alias("word"))
    return w.where(plain).groupBy(key, "word").agg(F.count("*").alias("n"))


def nearest_names(names: DataFrame, key: str, name: str, candidates: DataFrame, candidate: str, order: str, most: float = 0.15, sql: bool = False) -> DataFrame:
    """key, distance of the nearest candidate by Jaro-Winkler on whole names, and that candidate as
    ``nearest`` if it is at most ``most`` away; the first in order of equal ones. Bounds spare most of the
    comparisons (``operators.nearest``)."""
    first = nr.nearest(names, key, name, candidates, candidate, order, sql=sql)
    return first.select(key, "distance", F.when(F.col("distance") <= most, F.col("candidate")).alias("nearest"))


def bigram_counts(docs: DataFrame, key: str, text: str, stop: list[str], least: int = 2) -> DataFrame:
    """Long document-bigram counts without digits and stop words, of the bigrams that all documents
    together have ``least`` times; a document without any has one row: no bigram, 0 times."""
    plain = lambda x: ~x.rlike(r"\p{Nd}") & ~F.substring_index(x, "_", 1).isin(*stop) & ~F.substring_index(x, "_", -1).isin(*stop)
    # counted where the text is; then each row is shuffled once by its bigram and, if that is frequent, once by its key
    counts = docs.select(key, F.inline(tx.run_lengths(F.filter(tx.ngrams(tx.words(F.col(text)), 2, "_"), plain))).alias("bigram", "n"))
    often = counts.withColumn("all", F.sum("n").over(Window.partitionBy("bigram"))).where(F.col("all") >= least).drop("all")
    # rows that share a key are one document
    return docs.select(key).distinct().join(often, key, "left").groupBy(key, "bigram").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


# --- second pass, groups, join-back -------------------------------------------------------------
def second_pass(docs: DataFrame, text: str, found: str, canonical: list[str], synonyms: dict[str, str], rules: list[PlaceRule] = ()) -> DataFrame:
    """Where the array ``found`` is empty, it becomes the canonical names of the text's capitalised
    phrases that are countries or synonyms, each once in the order of the text. A name with a rule
    that the text's other words don't meet is left out, as in the first pass."""
    phrases = F.regexp_extract_all(F.col(text), F.lit(r"\b([A-Z][a-z]+\b(?:\s+[A-Z][a-z]+\b)*+)"), F.lit(1))
    to = {n.lower(): n for n in canonical} | {s.lower(): c for s, c in synonyms.items() if c in canonical}
    table = F.create_map(*[F.lit(x) for kv in to.items() for x in kv])
    names = F.transform(phrases, lambda p: F.element_at(table, F.lower(F.regexp_replace(p, r"\s+", " "))))
    low = F.lower(text)
    against = [F.when(low.rlike(r.not_with), F.lit(r.name)) for r in rules if r.not_with]
    against += [F.when(~low.rlike(r.needs), F.lit(r.name)) for r in rules if r.needs]
    kept = F.filter(names, lambda n: n.isNotNull())
    if against:
        kept = F.array_except(kept, F.filter(F.array(*against), lambda x: x.isNotNull()))
    return docs.withColumn(found, F.when(F.size(found) == 0, F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))).otherwise(F.col(found)))


def plural_groups(words: list[str], special: dict[str, str] | None = None, exempt: tuple[str, ...] = ()) -> dict[str, str]:
    """The singular of each listed word that is another listed word with an s; and the special ones."""
    known = set(words)
    return {w: w[:-1] for w in words if w.endswith("s") and w not in exempt and w[:-1] in known} | (special or {})


def grouped(word: Column, groups: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv]) if groups else None
    return F.coalesce(F.element_at(table, word), word) if groups else word


def joined_back(taxa_found: DataFrame, classes: DataFrame, documents: DataFrame, key: str, kingdom: str = "Fungi") -> DataFrame:
    """Matches with the class of their name and the assessment of their document; the class's columns
    are null where the match isn't of the kingdom."""
    out = taxa_found.join(classes, "resolved_name", "left").join(documents, key, "left")
    mine = [c for c in classes.columns if c != "resolved_name"]
    return out.withColumns({c: F.when(F.col("kingdom") == kingdom, F.col(c)) for c in mine})


def everything(docs: DataFrame, key: str, text: str, *detectors) -> DataFrame:
    """All detectors over the documents at once: each is a function of a frame that adds columns, so
    one pass over the texts does for all of them."""
    out = docs
    for d in detectors:
        out = d(out)
    return out.drop(text)
