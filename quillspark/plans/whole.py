"""Queries over whole tables by mechanisms of their own: curves at every cut, coverage at every level."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import analysis as an
from quillspark.operators import extraction as ex
from quillspark.operators import models as md
from quillspark.operators import penalised as pn
from quillspark.operators import places as pl
from quillspark.operators import tables as tb
from quillspark.operators.tables import spread
from quillspark.sources import files as fl

from .registry import DOCS, SQL, docs, register, table
from .texts import _ABS, _ASCII, _EV, _MET, _ascii

# --- curves -----------------------------------------------------------------------------------
_POINTS = """c AS (SELECT l_extendedprice AS score, count(*) FILTER (l_returnflag = 'R') AS positives, count(*) FILTER (l_returnflag <> 'R') AS negatives FROM lineitem GROUP BY 1),
    p AS (SELECT *, sum(positives) OVER w AS tp, sum(negatives) OVER w AS fp, sum(positives) OVER () AS n_positive, sum(negatives) OVER () AS n_negative FROM c WINDOW w AS (ORDER BY score DESC))"""


def _points(s, d):
    return md.curve(table(s, d, "lineitem"), "l_extendedprice", "l_returnflag", "R")


@register("ML19_whole", f"WITH {_POINTS} SELECT score, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / n_positive, 9) AS tpr, round(fp / n_negative, 9) AS fpr, round(tp / (tp + fp), 9) AS precision FROM p")
def roc(s, d):
    """The ROC and precision-recall curves of a price as the score of a return, at every price."""
    return _points(s, d).select("score", "tp", "fp", *(F.round(c, 9).alias(c) for c in ("tpr", "fpr", "precision")))


@register("ML19_areas", f"WITH {_POINTS} SELECT round(sum(negatives * (2 * tp - positives)) / 2 / max(n_positive) / max(n_negative), 9) AS roc_area, round(sum(positives * (tp / (tp + fp))) / max(n_positive), 9) AS average_precision, count(*) AS cuts FROM p")
def roc_areas(s, d):
    return md.areas(_points(s, d)).select(F.round("roc_area", 9).alias("roc_area"), F.round("average_precision", 9).alias("average_precision"), "cuts")


# --- quantiles --------------------------------------------------------------------------------
@register("AG6_whole", "SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.1) AS p10, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY ALL")
def price_quantiles(s, d):
    return tb.quantiles(table(s, d, "lineitem"), "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, ["l_returnflag", "l_linestatus"])


# --- coverage ---------------------------------------------------------------------------------
_NAMES = """known AS (SELECT DISTINCT r_name AS phylum, n_name AS family, n_name || ' ' || c_mktsegment AS genus, c_name AS species FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    hits AS (SELECT DISTINCT 'species' AS level, c_name AS name FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 490000
        UNION SELECT 'genus', n_name || ' ' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9900 UNION SELECT 'family', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 9700),
    tall AS (SELECT phylum, 'species' AS level, species AS name, species FROM known UNION ALL SELECT phylum, 'genus', genus, species FROM known UNION ALL SELECT phylum, 'family', family, species FROM known),
    names AS (SELECT phylum, level, name, count(DISTINCT species) AS members, bool_or(species IN (SELECT name FROM hits WHERE level = 'species')) OR (level, name) IN (SELECT (level, name) FROM hits) AS found FROM tall WHERE name IS NOT NULL GROUP BY phylum, level, name)"""


def _names(s, d):
    """Customers as species of a market (genus) of a nation (family) of a region (phylum); found by large
    orders, and markets and nations by large balances."""
    nation, customer = table(s, d, "nation"), table(s, d, "customer")
    of_nation = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    market = F.concat_ws(" ", "n_name", "c_mktsegment")
    known = of_nation.join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("phylum"), F.col("n_name").alias("family"), market.alias("genus"), F.col("c_name").alias("species"))
    hit = lambda df, level, name: df.select(F.lit(level).alias("level"), name.alias("name"))
    species = hit(customer.join(table(s, d, "orders").where("o_totalprice > 490000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi"), "species", F.col("c_name"))
    genus = hit(of_nation.where("c_acctbal > 9900"), "genus", market)
    family = hit(table(s, d, "supplier").where("s_acctbal > 9700").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "family", F.col("n_name"))
    return ex.covered_names(known, species.union(genus).union(family), ["species", "genus", "family"], "phylum")


@register(
    "AG24_levels",
    f"WITH {_NAMES}, w AS (SELECT level, name, bool_or(found) AS found FROM names GROUP BY 1, 2), e AS (SELECT phylum, level, found FROM names WHERE phylum IS NOT NULL UNION ALL SELECT NULL, level, found FROM w) SELECT phylum, level, count(*) AS total, count(*) FILTER (found) AS found, round(100.0 * count(*) FILTER (found) / count(*), 4) AS percent FROM e GROUP BY 1, 2",
)
def coverage_by_level(s, d):
    """Found and total species, genera and families of each phylum, and of all."""
    return ex.coverage_levels(_names(s, d), "phylum")


@register(
    "AN8_missing",
    f"WITH {_NAMES}, lost AS (SELECT *, row_number() OVER (PARTITION BY phylum, level ORDER BY members DESC, name) AS rank FROM names WHERE NOT found AND level <> 'species') SELECT phylum, level, count(*) AS n_missing, sum(members)::BIGINT AS members, string_agg(name || ' (' || members || ')', '; ' ORDER BY rank) FILTER (rank <= 5) AS top FROM lost GROUP BY 1, 2",
)
def missing_groups(s, d):
    """The largest genera and families of each phylum that are not found."""
    names = _names(s, d)
    some = [ex.missing_ranked(names, "phylum", level).withColumn("level", F.lit(level)) for level in ("genus", "family")]
    return some[0].unionByName(some[1])

# --- combinations, trends, breakdowns ------------------------------------------------------------
#: Stems of nine made-up method categories, three of them the core.
_STEMS = {
    "molecular": ["the", "heit"], "culture": ["ment", "schein"], "microscopy": ["que", "ing"], "inoculation": ["ble", "ung"], "interaction": ["les"],
    "bioactivity": ["xx", "die"], "physiology": ["als"], "ecology": ["por"], "sterilization": ["eau"],
}
_CORE = {"molecular_methods": "Molecular", "culture_methods": "Culture", "microscopy_methods": "Microscopy"}
_OTHERS = {f"{k}_methods": k.capitalize() for k in list(_STEMS)[3:]}
_SCHEMES = {"core": an.combination_rules(_CORE), "expanded": an.combination_rules(_CORE, _OTHERS)}
_FLAGS = ", ".join(f"coalesce(regexp_matches(lower(abstract), '{'|'.join(v)}'), false) AS {k}_methods" for k, v in _STEMS.items())
_CASE = lambda rules: "CASE " + " ".join(f"WHEN {' AND '.join(flags)} THEN '{label}'" for flags, label in rules) + " ELSE 'No methods detected' END"


def _flagged(s, d):
    return ex.methods(spread(docs(s, d), "id"), "abstract", _STEMS)


@register(
    "AN10_classes",
    f"WITH {DOCS}, f AS (SELECT id, {_FLAGS} FROM docs), c AS (" + " UNION ALL ".join(f"SELECT '{k}' AS scheme, {_CASE(rules)} AS label FROM f" for k, rules in _SCHEMES.items()) + ") SELECT scheme, label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY scheme), 4) AS percent FROM c GROUP BY 1, 2",
)
def combinations(s, d):
    """Documents by their combination of methods, in 7 and in 14 classes and none."""
    return an.combination_counts(_flagged(s, d), _SCHEMES)


_ROWS = f"""WITH {DOCS}, e AS (SELECT *, {_FLAGS}, lang = 'en' AS north, lang = 'es' AS south, nullif(source, 'src0') AS species FROM docs UNION ALL SELECT *, {_FLAGS}, lang = 'fr', lang = 'en', source FROM docs WHERE n_chars > 1000),
    r AS (SELECT *, year // 5 * 5 AS period, coalesce(molecular_methods, false)::INT + coalesce(culture_methods, false)::INT + coalesce(north, false)::INT + (species IS NOT NULL)::INT AS score FROM e),
    o AS (SELECT period, id, bool_or(molecular_methods) AS m, bool_or(culture_methods) AS c, bool_or(coalesce(north, false)) AS n, bool_or(coalesce(south, false)) AS s, bool_or(species IS NOT NULL) AS f FROM r GROUP BY 1, 2),
    k AS (SELECT period, lang, count(*) AS n FROM r WHERE lang IS NOT NULL GROUP BY 1, 2),
    t AS (SELECT 'methods' AS trend, period, 'Molecular' AS item, count(*) FILTER (m) AS n, count(*) AS total FROM o GROUP BY period UNION ALL SELECT 'methods', period, 'Culture', count(*) FILTER (c), count(*) FROM o GROUP BY period
    UNION ALL SELECT 'geography', period, 'north', count(*) FILTER (n), count(*) FILTER (n OR s) FROM o GROUP BY period UNION ALL SELECT 'geography', period, 'south', count(*) FILTER (s), count(*) FILTER (n OR s) FROM o GROUP BY period
    UNION ALL SELECT 'species', period, 'documents with species', count(*) FILTER (f), count(*) FROM o GROUP BY period UNION ALL SELECT 'species', period, 'distinct species', count(DISTINCT species), NULL FROM r GROUP BY period
    UNION ALL SELECT 'completeness', period, 'mean score', sum(score)::BIGINT, count(*) FROM r GROUP BY period UNION ALL SELECT 'completeness', period, 'score of 3 or more', count(*) FILTER (score >= 3), count(*) FROM r GROUP BY period
    UNION ALL SELECT 'kingdoms', period, lang, n, sum(n) OVER (PARTITION BY period)::BIGINT FROM k)
    SELECT trend, period, item, n, total, round(100.0 * n / CASE WHEN total > 0 THEN total END, 4) AS percent FROM t"""


@register("AN2_trends", _ROWS)
def all_trends(s, d):
    """The five trends over rows of which a long document has two."""
    f = _flagged(s, d).withColumn("period", md.period(F.col("year")))
    one = f.withColumns({"north": F.col("lang") == "en", "south": F.col("lang") == "es", "species": F.nullif("source", F.lit("src0"))})
    two = f.where("n_chars > 1000").withColumns({"north": F.col("lang") == "fr", "south": F.col("lang") == "en", "species": F.col("source")})
    rows = one.unionByName(two).withColumn("found", F.col("species").isNotNull())
    return an.trends(rows, "id", "period", {"Molecular": "molecular_methods", "Culture": "culture_methods"}, "north", "south", "species", "lang", ["molecular_methods", "culture_methods", "north", "found"])


@register(
    "EXT17_all",
    f"""{_EV}, f AS (SELECT id, {_FLAGS} FROM docs), b AS (SELECT id, year // 5 * 5 AS period, confidence_level AS level, concat_ws('; ', lang, source) AS places, f.molecular_methods, f.culture_methods FROM docs JOIN v USING (id) JOIN f USING (id)),
    t AS (SELECT 'place' AS dimension, unnest(list_distinct(string_split(places, '; '))) AS value, level FROM b UNION ALL SELECT 'period', period::VARCHAR, level FROM b UNION ALL SELECT 'method', 'molecular', level FROM b WHERE molecular_methods UNION ALL SELECT 'method', 'culture', level FROM b WHERE culture_methods)
    SELECT dimension, value, level, count(*) AS n, round(100.0 * count(*) / max(n_all), 4) AS percent FROM t JOIN (SELECT level, count(*) AS n_all FROM b GROUP BY 1) USING (level) WHERE value <> '' GROUP BY 1, 2, 3""",
)
def evidence_breakdown(s, d):
    """Evidence levels by place, method and period in one pass."""
    found = ex.evidence(_flagged(s, d), "abstract", _ABS, _MET).withColumns({"places": F.concat_ws("; ", "lang", "source"), "period": md.period(F.col("year"))})
    out = ex.evidence_by(found, "confidence_level", {"place": "places", "period": "period"}, {"molecular": "molecular_methods", "culture": "culture_methods"})
    return out.withColumn("dimension", F.when(F.col("dimension") == "flag", "method").otherwise(F.col("dimension")))


# --- places -----------------------------------------------------------------------------------
_NATIONS = {"The": "", "And La": "", "Of": "", "Und": ""}
_ANY = lambda w: f"regexp_matches(abstract, '(?i)\\b{w}\\b')"


def _placed(df):
    rules = [ex.PlaceRule("The", needs="ing|ed", not_with="xx")]
    return ex.places(df, "abstract", _NATIONS, rules, {"Der": "Und"}, {"Une": "Of"}, ["Que"], ["In", "For"], {"The", "Por"}, institutions={r"\bpor\s+el\b|quer": "Por"}, again=True)


@register(
    "EXT9_places",
    f"""WITH {_ASCII}, c AS (SELECT id, abstract, list_filter([CASE WHEN {_ANY('And\\s+La')} THEN 'And La' END, CASE WHEN {_ANY('The')} AND regexp_matches(lower(abstract), 'ing|ed') AND NOT regexp_matches(lower(abstract), 'xx') THEN 'The' END, CASE WHEN {_ANY('Und')} THEN 'Und' END,
    CASE WHEN {_ANY('Of')} THEN 'Of' END, CASE WHEN {_ANY('Der')} THEN 'Und' END, CASE WHEN regexp_matches(lower(abstract), '\\bpor\\s+el\\b|quer') THEN 'Por' END, CASE WHEN {_ANY('Une')} THEN 'Of' END], lambda x: x IS NOT NULL) AS l,
    list_filter([CASE WHEN {_ANY('Que')} THEN 'Que' END], lambda x: x IS NOT NULL) AS k, list_filter([CASE WHEN {_ANY('In')} THEN 'In' END, CASE WHEN {_ANY('For')} THEN 'For' END], lambda x: x IS NOT NULL) AS r FROM docs),
    u AS (SELECT id, list_filter(l, lambda x, i: list_position(l, x) = i) AS c, k, r FROM c)
    SELECT id, array_to_string(c, '; ') AS countries_detected, array_to_string(list_filter(c, lambda x: x IN ('The', 'Por')), '; ') AS global_north_countries, array_to_string(list_filter(c, lambda x: x NOT IN ('The', 'Por')), '; ') AS global_south_countries,
    array_to_string(k, '; ') AS continents_detected, array_to_string(r, '; ') AS regions_detected, array_to_string(list_concat(c, list_concat(k, r)), '; ') AS geographic_summary FROM u""",
)
def all_places(s, d):
    """Names (one with a rule), a synonym, an institution, an adjective, continents and regions."""
    return _placed(_ascii(s, d)).select("id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("countries_detected", "global_north_countries", "global_south_countries", "continents_detected", "regions_detected", "geographic_summary"))).where("id is not null")


@register(
    "EXT22_all",
    f"""WITH {_ASCII}, f AS (SELECT id, {_FLAGS} FROM docs), m AS (SELECT id, {", ".join(f"{k}_methods" for k in _STEMS)} FROM f),
    p AS ({SQL["EXT9_places"]}), e AS ({_EV.replace(DOCS, _ASCII)} SELECT id, absence_score, method_score, confidence_level FROM v)
    SELECT id, m.* EXCLUDE (id), countries_detected, regions_detected, absence_score, method_score, confidence_level FROM m JOIN p USING (id) JOIN e USING (id)""",
)
def all_detectors(s, d):
    """Methods, places and evidence of each document, in one pass over its text."""
    found = ex.everything(
        _ascii(s, d), "id", "abstract",
        lambda f: ex.methods(f, "abstract", _STEMS),
        lambda f: _placed(f),
        lambda f: ex.evidence(f, "abstract", _ABS, _MET),
    )
    return found.select("id", *[f"{k}_methods" for k in _STEMS], *(F.coalesce(c, F.lit("")).alias(c) for c in ("countries_detected", "regions_detected")), "absence_score", "method_score", "confidence_level")


@register(
    "AN12_map",
    f"""WITH n AS (SELECT n_name AS place, n_nationkey * 11.0 % 160 - 80 AS cx, n_nationkey * 7.0 % 80 - 40 AS cy FROM nation), e AS (SELECT place, unnest([{", ".join(f"[cx + {x}, cy + {y}, cx + {u}, cy + {v}]" for (x, y), (u, v) in zip([(-9, -3), (-2, 6), (1, 1), (8, 5), (6, -7)], [(-2, 6), (1, 1), (8, 5), (6, -7), (-9, -3)]))}]) AS g FROM n),
    p AS (SELECT c_custkey, round(abs(c_acctbal) / 250, 3) * CASE WHEN c_acctbal < 5000 THEN -1 ELSE 1 END AS y, c_custkey * 0.7 % 160 - 80 AS x FROM customer),
    h AS (SELECT c_custkey, place FROM p JOIN e ON (g[2] > y) <> (g[4] > y) AND x < (g[3] - g[1]) * (y - g[2]) / (g[4] - g[2]) + g[1] GROUP BY 1, 2 HAVING count(*) % 2 = 1) SELECT place, count(*) AS n FROM h GROUP BY 1""",
)
def on_the_map(s, d):
    """Customers by the outline of a nation that holds the coordinates in their descriptions."""
    y = F.round(F.abs("c_acctbal") / 250, 3)
    x = F.col("c_custkey") * 7 % 1600 / 10 - 80  # in whole numbers: a double just below 160 would be 80 degrees, not -80
    side = lambda c, plus, minus: F.when(c < 0, minus).otherwise(plus)
    text = F.concat(F.lit("plot at "), y.cast("decimal(9,3)").cast("string"), F.lit("°"), F.when(F.col("c_acctbal") < 5000, "S").otherwise("N"), F.lit(", "), F.abs(x).cast("decimal(9,1)").cast("string"), F.lit("°"), side(x, "E", "W"), F.lit(" in summer"))
    points = table(s, d, "customer").select("c_custkey", F.explode(pl.coordinates(text)).alias("at")).select("c_custkey", "at.lat", "at.lon")
    centre = {"x": F.col("n_nationkey") * 11.0 % 160 - 80, "y": F.col("n_nationkey") * 7.0 % 80 - 40}
    ring = F.array(*[F.struct((centre["x"] + u).alias("x"), (centre["y"] + v).alias("y")) for u, v in ((-9, -3), (-2, 6), (1, 1), (8, 5), (6, -7))])
    outlines = table(s, d, "nation").select("n_name", ring.alias("ring"))
    return pl.located(points, "lon", "lat", outlines, "n_name", "ring").groupBy("place").agg(F.count("*").alias("n"))


@register("ML8_tuned", None)
def tuned(s, d):
    """Mean areas of elastic nets over a grid of mixings and penalties by 5-fold cross-validation, three times repeated."""
    labelled = table(s, d, "documents").select("doc_id", "text").join(table(s, d, "labels").select("doc_id", "toxic"), "doc_id")
    areas, _ = pn.tuned(labelled, "doc_id", "text", "toxic", [0.1, 0.5, 1.0], [0.1, 0.03, 0.01], features=500)
    return areas.select("mixing", "penalty", F.round("area", 4).alias("area"), F.round("sd", 4).alias("sd"), "folds")


def _square(x: str, y: str, half: int) -> str:
    return "[" + ", ".join(f"[', {x} + {half * a}, ', ', {y} + {half * b}, ']" for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))) + "]"


@register(
    "SRC16_outlines",
    """WITH n AS (SELECT n_name AS name, n_nationkey * 7 % 90 AS x, n_nationkey * 3 % 60 AS y FROM nation), p AS (SELECT s_suppkey, s_acctbal / 110 AS px, s_suppkey * 1.7 % 60 AS py FROM supplier)
    SELECT name, count(s_suppkey) AS n FROM n LEFT JOIN p ON px >= x - 5 AND px < x + 5 AND py >= y - 5 AND py < y + 5 AND NOT (px >= x - 2 AND px < x + 2 AND py >= y - 2 AND py < y + 2) GROUP BY 1""",
)
def outlines_from_files(s, d):
    """Outlines with holes, one a nation, written as GeoJSON and read again; and the suppliers within."""
    x, y = "(n_nationkey * 7 % 90)", "(n_nationkey * 3 % 60)"
    shape = f"concat('{{\"type\": \"Feature\", \"properties\": {{\"name\": \"', n_name, '\"}}, \"geometry\": {{\"type\": \"Polygon\", \"coordinates\": [{_square(x, y, 5)}, {_square(x, y, 2)}]}}}}')"
    path = fl.scratch(s, "outlines")
    table(s, d, "nation").select(F.expr(shape).alias("value")).write.text(path)
    outlines = fl.read_outlines(s, path, "name")
    points = table(s, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 110).alias("px_"), (F.col("s_suppkey") * 1.7 % 60).alias("py_"))
    found = pl.located(points, "px_", "py_", outlines, "name", "ring").groupBy("place").agg(F.count("*").alias("n"))
    names = outlines.select("name").distinct()
    return names.join(found, F.col("name") == F.col("place"), "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))
