"""Queries of the reference data, the stages, the writers, further extraction and model operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark import workflow as wf
from quillspark.functions import text as tx
from quillspark.operators import extraction as ex
from quillspark.operators import tables as tb
from quillspark.operators import training as tr
from quillspark.sources import files as fl
from quillspark.sources import reference as rf

from .more import _ASCII, _ascii
from .registry import CLASSES, DOCS, classes, docs, register, table

_LOW = "lower(abstract)"


def _reference(s, d) -> rf.Reference:
    """Reference lists made of the nations and regions, written and read as a user's files are."""
    to = fl.scratch(s, "reference")
    nation = table(s, d, "nation")
    fl.write_csv(nation.select(F.initcap("n_name").alias("name"), F.when(F.col("n_regionkey") < 2, "North").otherwise("South").alias("hemisphere")), f"{to}/countries.csv")
    fl.write_csv(nation.select(F.concat(F.lit("Land "), F.col("n_nationkey").cast("string")).alias("name"), F.initcap("n_name").alias("country")), f"{to}/synonyms.csv")
    fl.write_csv(table(s, d, "region").select(F.initcap("r_name").alias("name")), f"{to}/continents.csv")
    return rf.read(s, to)


# --- reference data (ORC8) ---------------------------------------------------------------------
_TITLE = "upper(left({c}, 1)) || lower(substr({c}, 2))"
_NATION = _TITLE.format(c="n_name")


@register("ORC8", f"SELECT {_NATION} AS country, CASE WHEN n_regionkey < 2 THEN 'North' ELSE 'South' END AS hemisphere FROM nation")
def _(s, d):
    return _reference(s, d).classification(s)


@register("ORC8_countries", f"SELECT c_custkey, {_NATION} AS country FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(s, d):
    ref = _reference(s, d)
    return table(s, d, "customer").select("c_custkey", ref.country(F.concat(F.lit(" land "), F.col("c_nationkey").cast("string"))).alias("country"))


@register("SRC16", f"SELECT {_NATION} AS country, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def _(s, d):
    known = _reference(s, d).classification(s).select("country")
    seen = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.initcap("n_name").alias("country"), "c_custkey")
    return known.join(seen, "country", "left").groupBy("country").agg(F.count("c_custkey").alias("n"))


# --- second pass, summary, abbreviations, plurals ------------------------------------------------
_PHRASES = "regexp_extract_all(abstract, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)\\b', 1)"
_SECOND = "list_filter(list_transform({p}, lambda x: CASE lower(x) WHEN 'the' THEN 'The' WHEN 'in' THEN 'In' WHEN 'une' THEN 'In' WHEN 'der' THEN 'Der' END), lambda x: x IS NOT NULL)".format(p=_PHRASES)


@register("STR17", f"WITH {_ASCII}, f AS (SELECT id, {_SECOND} AS l FROM docs) SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '; ') AS found FROM f")
def _(s, d):
    none = _ascii(s, d).withColumn("found", F.array().cast("array<string>"))
    return ex.second_pass(none, "abstract", "found", ["The", "In", "Der"], {"Une": "In", "Los": "Elsewhere"}).select("id", F.array_join("found", "; ").alias("found"))


@register("STR22", "SELECT n_nationkey, CASE WHEN n_name = r_name THEN n_name ELSE n_name || '; ' || r_name END AS summary FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    both = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", ex.geographic_summary(F.array("n_name"), F.array("r_name"), F.array("n_name")).alias("summary"))


@register("STR29", "WITH n AS (SELECT DISTINCT upper(left(p_name, 1)) || '. ' || split_part(p_name, ' ', 2) AS short FROM part WHERE p_size <= 10), t AS (SELECT DISTINCT p_name FROM part WHERE p_size > 40) SELECT short, p_name AS name FROM n JOIN t ON lower(left(p_name, 1)) = lower(left(short, 1)) AND lower(split_part(p_name, ' ', -1)) = substr(short, 4)")
def _(s, d):
    parts = table(s, d, "part")
    short = parts.where("p_size <= 10").select(F.concat(F.upper(F.substring("p_name", 1, 1)), F.lit(". "), F.split("p_name", " ")[1]).alias("short")).distinct()
    taxonomy = parts.where("p_size > 40").select(F.col("p_name").alias("canonicalName"), F.lit("accepted").alias("taxonomicStatus")).distinct()
    return ex.expanded_abbreviations(short, "short", taxonomy).select("short", F.col("canonicalName").alias("name"))


@register("STR37", f"WITH {DOCS}, w AS (SELECT unnest(regexp_extract_all({_LOW}, '[a-z]+')) AS w FROM docs) SELECT CASE w WHEN 'ons' THEN 'on' WHEN 'ins' THEN 'in' WHEN 'stomata' THEN 'stoma' ELSE w END AS part, count(*) AS n FROM w WHERE w IN ('on', 'ons', 'in', 'ins', 'stomata', 'des', 'les') GROUP BY 1")
def _(s, d):
    words = ["on", "ons", "in", "ins", "des", "les", "stomata"]
    groups = ex.plural_groups(words, {"stomata": "stoma"})
    found = docs(s, d).select(F.explode(F.regexp_extract_all(F.lower("abstract"), F.lit("([a-z]+)"), F.lit(1))).alias("w")).where(F.col("w").isin(*words))
    return found.groupBy(ex.grouped(F.col("w"), groups).alias("part")).agg(F.count("*").alias("n"))


@register("EXT13", "SELECT l_orderkey AS id, l_linenumber AS k, CASE WHEN p_brand = 'Brand#1' THEN p_size > 25 END AS is_mycorrhizal, o_totalprice > 100000 AS only FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey")
def _(s, d):
    part = table(s, d, "part")
    taxa = table(s, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), F.col("p_partkey").alias("resolved_name"), F.when(F.col("p_brand") == "Brand#1", "Fungi").otherwise("Plantae").alias("kingdom"))
    classes_ = part.select(F.col("p_partkey").alias("resolved_name"), (F.col("p_size") > 25).alias("is_mycorrhizal"))
    documents = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") > 100000).alias("only"))
    return ex.joined_back(taxa, classes_, documents, "id").select("id", "k", "is_mycorrhizal", "only")


@register("EXT22", f"WITH {DOCS} SELECT id, regexp_matches({_LOW}, 'the|of') AS a_methods, regexp_matches({_LOW}, 'and') AS b_methods, len(regexp_extract_all({_LOW}, '\\b(the|and)\\b')) AS parts FROM docs")
def _(s, d):
    found = ex.everything(docs(s, d), "id", "abstract", lambda x: ex.methods(x, "abstract", {"a": ["the", "of"], "b": ["and"]}), lambda x: x.withColumn("parts", F.size(tx.extract_words(F.col("abstract"), ["the", "and"])).cast("long")))
    return found.select("id", "a_methods", "b_methods", "parts")


def _measured(row: dict) -> dict:
    if "ring" in row["p_name"]:
        raise ValueError(row["p_name"])
    return {"n": len(row["p_name"])}


@register("EXT6", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'error' ELSE 'ok' END AS status, CASE WHEN contains(p_name, 'ring') THEN 'ValueError: ' || p_name END AS message, CASE WHEN NOT contains(p_name, 'ring') THEN length(p_name) END AS n FROM part")
def _(s, d):
    return wf.row_by_row(table(s, d, "part").select("p_partkey", "p_name"), "p_partkey", _measured, "n long")


# --- oracles of fuzzy phrases, parts and classes -------------------------------------------------
def _near(phrase: str, category: str) -> str:
    words = phrase.split()
    window = " || ' ' || ".join(f"t[i + {k}]" if k else "t[i]" for k in range(len(words)))
    exact = "\\b" + "\\s+".join(words) + "\\b"
    sims = f"list_transform(range(1, len(t) - {len(words) - 2}), lambda i: 1 - levenshtein({window}, '{phrase}') / greatest(length({window}), {len(phrase)}))"
    return f"SELECT id, '{category}' AS category, '{phrase}' AS phrase, CASE WHEN regexp_matches(low, '{exact}') THEN 1.0::DOUBLE WHEN contains(low, '{words[0]}') THEN round(list_filter({sims}, lambda x: x >= 0.9)[1], 4) END AS similarity FROM t"


def _statements(phrases: dict[str, list[str]]) -> str:
    every = " UNION ALL ".join(_near(p, c) for c, ps in phrases.items() for p in ps)
    return f"WITH {DOCS}, t AS (SELECT id, {_LOW} AS low, list_filter(regexp_split_to_array({_LOW}, '\\s+'), lambda x: x <> '') AS t FROM docs WHERE length(abstract) >= 10), s AS ({every})"


_A = {"x": ["of the thing", "that the"]}
register("STR27", f"{_statements(_A)} SELECT * FROM s WHERE similarity IS NOT NULL")(lambda s, d: ex.statements(docs(s, d), "id", "abstract", _A, sql=True))
_B = {"a": ["of the", "that the"], "b": ["in the thing"]}
register("EXT18", f"{_statements(_B)} SELECT category, phrase, count(*) AS n FROM s WHERE similarity IS NOT NULL GROUP BY 1, 2")(lambda s, d: tb.counted(ex.statements(docs(s, d), "id", "abstract", _B, sql=True), "category", "phrase"))

_PARTS = f"regexp_extract_all({_LOW}, '\\b(the|and|la|der)\\b') || CASE WHEN contains({_LOW}, 'of the') THEN ['of the'] ELSE [] END"
register("EXT8", f"WITH {_ASCII}, p AS (SELECT id, {_PARTS} AS l FROM docs), u AS (SELECT id, list_filter(l, lambda x, i: list_position(l, x) = i) AS u FROM p) SELECT id, array_to_string(u, '; ') AS plant_parts_detected, len(u) AS parts_count, array_to_string(u, '; ') AS parts_normalized FROM u")(lambda s, d: ex.parts(_ascii(s, d), "abstract", ["the", "and", "la", "der"], ["of the"], {}).select("id", "plant_parts_detected", "parts_count", "parts_normalized"))
register("EXT11", """WITH w AS (SELECT regexp_replace(p_name, ' ', '_', 'g') AS species, max(CASE WHEN p_brand = 'Brand#1' THEN 'Ectomycorrhizal' ELSE 'Saprotroph' END) AS guild FROM part WHERE p_size > 40 GROUP BY 1),
g AS (SELECT split_part(species, '_', 1) AS genus, guild, count(*) AS n FROM w GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY genus ORDER BY n DESC, guild) = 1),
r AS (SELECT DISTINCT p_name AS resolved_name FROM part),
j AS (SELECT resolved_name, w.guild AS mine, g.guild AS of_genus FROM r LEFT JOIN w ON species = regexp_replace(resolved_name, ' ', '_', 'g') LEFT JOIN g ON genus = split_part(resolved_name, ' ', 1))
SELECT resolved_name, coalesce(mine, of_genus, '') = 'Ectomycorrhizal' AS is_mycorrhizal, coalesce(mine, of_genus, 'Unknown') AS guild, CASE WHEN mine IS NOT NULL THEN 0.9 WHEN of_genus IS NOT NULL THEN 0.7 ELSE 0.1 END::DOUBLE AS confidence FROM j""")(lambda s, d: ex.classified(table(s, d, "part").select(F.col("p_name").alias("resolved_name")), table(s, d, "part").where("p_size > 40").select(F.regexp_replace("p_name", " ", "_").alias("species"), F.lit("guild_fg").alias("trait_name"), F.when(F.col("p_brand") == "Brand#1", "Ectomycorrhizal").otherwise("Saprotroph").alias("value"))))

# --- samples by quota -------------------------------------------------------------------------------
_DRAW = "('0x' || substr(md5(doc_id || ':{seed}'), 1, 13))::BIGINT"


def _quota(names, quotas):
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(names)), F.lit(0))


# the largest stratum takes what rounding leaves over or under; strata here differ by more than that
register("SM3", f"WITH c AS (SELECT lang, count(*) AS n, sum(count(*)) OVER () AS a FROM documents GROUP BY 1), q AS (SELECT lang, n, greatest(1, round_even(60.0 * n / a, 0)) AS q FROM c), z AS (SELECT lang, q + CASE WHEN row_number() OVER (ORDER BY n DESC, lang) = 1 THEN 60 - sum(q) OVER () ELSE 0 END AS q FROM q), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW.format(seed=11)}, doc_id) AS k FROM documents) SELECT doc_id, lang FROM r JOIN z USING (lang) WHERE k <= q")(lambda s, d: (lambda n: tb.sample_strata(table(s, d, "documents"), "lang", _quota("lang", tb.proportional_quotas(n, 60)), "doc_id", 11).select("doc_id", "lang"))({r.lang: r.n for r in tb.counted(table(s, d, "documents"), "lang").collect()}))
register("SM4", f"WITH l AS (SELECT DISTINCT lang FROM documents), q AS (SELECT lang, 41 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY md5(lang || ':12'), lang) <= 41 % count(*) OVER () THEN 1 ELSE 0 END AS q FROM l), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW.format(seed=12)}, doc_id) AS k FROM documents) SELECT doc_id, lang FROM r JOIN q USING (lang) WHERE k <= q")(lambda s, d: (lambda n: tb.sample_strata(table(s, d, "documents"), "lang", _quota("lang", tb.balanced_draws(n, 41, 12)), "doc_id", 12).select("doc_id", "lang"))([r.lang for r in table(s, d, "documents").select("lang").distinct().collect()]))

# --- aggregates -----------------------------------------------------------------------------------
register("AG29", "SELECT l_returnflag, l_linestatus, count(*) AS n, bit_count(grouping(l_returnflag, l_linestatus)::INT)::INT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")(lambda s, d: tb.rolled_up(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], F.count("*").alias("n")))
register("AG29_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, bit_count(grouping(l_returnflag, l_linestatus)::INT)::INT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")(lambda s, d: tb.cubed(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], F.count("*").alias("n")))
register("PRJ18", "SELECT l_orderkey, l_linenumber::TINYINT AS l_linenumber FROM lineitem")(lambda s, d: tb.narrowed(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_linenumber"]))


@register("UDF1", f"WITH {DOCS} SELECT id, length(abstract) AS n FROM docs")
def _(s, d):
    return wf.in_chunks(docs(s, d).select("id", "abstract"), lambda c: c.assign(n=c["abstract"].str.len())[["id", "n"]], "id long, n long")


@register("UDF2", "SELECT p_partkey, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS name FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", tx.correct_capitalization(F.col("p_name")).alias("name"))


@register("UDF4", f"WITH {CLASSES} SELECT label, round(5.0 * count(*) FILTER (guess = 'Presence' AND label = 'Presence') / greatest(1, 5.0 * count(*) FILTER (guess = 'Presence' AND label = 'Presence') + 4.0 * count(*) FILTER (guess <> 'Presence' AND label = 'Presence') + count(*) FILTER (guess = 'Presence' AND label <> 'Presence')), 6) AS f2 FROM classes GROUP BY 1")
def _(s, d):
    # a metric over sums, so it is combined before the shuffle
    both = lambda g, t: F.sum(((F.col("guess") == "Presence") == g).cast("int") * ((F.col("label") == "Presence") == t).cast("int"))
    tp, fn, fp = both(True, True), both(False, True), both(True, False)
    return classes(s, d).groupBy("label").agg(F.round(5.0 * tp / F.greatest(F.lit(1.0), 5.0 * tp + 4.0 * fn + fp), 6).alias("f2"))


# --- models -----------------------------------------------------------------------------------------
_labelled = lambda s, d: table(s, d, "documents").select("doc_id", "text").join(table(s, d, "labels").select("doc_id", "toxic"), "doc_id")
_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _nzv(c: str) -> str:
    return f"SELECT '{c}' AS name, {c} AS v, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 2"


register("ML11", "WITH c AS (" + " UNION ALL ".join(_nzv(c) for c in _NUMBERS) + "), r AS (SELECT name, n, row_number() OVER (PARTITION BY name ORDER BY n DESC) AS k FROM c), f AS (SELECT name, max(n) FILTER (k = 1) AS a, max(n) FILTER (k = 2) AS b, count(*) AS u, sum(n) AS m FROM r GROUP BY 1) SELECT name, round(coalesce(a / b, 0), 6) AS freq_ratio, round(100 * u / m, 6) AS percent_unique, u = 1 OR (coalesce(a / b, 0) > 19 AND 100 * u / m <= 10) AS nzv FROM f")(lambda s, d: tr.near_zero_variance(table(s, d, "lineitem"), _NUMBERS))
_PAIRS = [(a, b) for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]]
register("ML11_correlated", "SELECT a, b, round(r, 6) AS correlation FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a, b in _PAIRS) + ") WHERE abs(r) > 0.001")(lambda s, d: tr.correlated(table(s, d, "lineitem"), _NUMBERS, 0.001).select("a", "b", F.round("correlation", 6).alias("correlation")))
_WEIGHT = "round(sum((label = 'Presence')::INT * 2 - 1) / count(*), 9)"
_DIRECTION = "CASE WHEN coefficient > 0 THEN 'Positive' WHEN coefficient < 0 THEN 'Negative' ELSE 'Neutral' END"


def _weights(s, d, column):
    both = classes(s, d).join(table(s, d, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return both.groupBy(F.col("source").alias("feature")).agg(F.round(F.sum((F.col(column) == "Presence").cast("int") * 2 - 1) / F.count("*"), 9).alias("coefficient"))


_TOP = f"WITH {CLASSES}, j AS (SELECT classes.*, source FROM classes JOIN documents ON id = doc_id), a AS (SELECT source AS feature, {_WEIGHT} AS coefficient FROM j GROUP BY 1), b AS (SELECT source AS feature, {_WEIGHT.replace('label', 'guess')} AS coefficient FROM j GROUP BY 1), ta AS (SELECT *, {_DIRECTION} AS direction FROM a ORDER BY abs(coefficient) DESC, feature LIMIT 15), tb AS (SELECT *, {_DIRECTION} AS direction FROM b ORDER BY abs(coefficient) DESC, feature LIMIT 15)"
register("ML21", f"{_TOP} SELECT coalesce(ta.feature, tb.feature) AS feature, coalesce(ta.coefficient, 0) AS coefficient_a, ta.direction AS direction_a, coalesce(tb.coefficient, 0) AS coefficient_b, tb.direction AS direction_b, ta.direction = tb.direction AS agree FROM ta FULL JOIN tb ON ta.feature = tb.feature")(lambda s, d: tr.compared(_weights(s, d, "label"), _weights(s, d, "guess")))


@register("ML10", None)
def _(s, d):
    return tr.predicted(tr.forest(_labelled(s, d), "text", "toxic"), table(s, d, "documents"), "text", "doc_id")


@register("ML10_boosted", None)
def _(s, d):
    return tr.predicted(tr.boosted(_labelled(s, d), "text", "toxic", rounds=5), table(s, d, "documents"), "text", "doc_id")


@register("ML18", None)
def _(s, d):
    # a model that was saved and read again, applied where the documents are (SRC8)
    to = fl.scratch(s, "model")
    tr.save(tr.elastic_net(_labelled(s, d), "text", "toxic"), to)
    return tr.predicted(tr.load(to), table(s, d, "documents"), "text", "doc_id")


@register("ML20", None)
def _(s, d):
    parted = tb.split(_labelled(s, d), "toxic", 0.8, "doc_id", 5)
    return tr.learning_curve(parted.where("is_train"), parted.where("not is_train"), "text", "toxic", "doc_id", [0.25, 0.5, 1.0])


# --- sources and writers ------------------------------------------------------------------------------
@register("SRC12", "SELECT n_name AS title, CAST(n_nationkey AS VARCHAR) AS doi, CASE WHEN n_regionkey > 0 THEN CAST(2000 + n_regionkey AS VARCHAR) END AS year, n_name || ' & more' || ' ' || 'part two' AS abstract FROM nation")
def _(s, d):
    to = fl.scratch(s, "articles")
    year = F.when(F.col("n_regionkey") > 0, F.concat(F.lit("<PubDate><Year>"), (2000 + F.col("n_regionkey")).cast("string"), F.lit("</Year></PubDate>"))).otherwise("")
    one = F.concat(F.lit("<PubmedArticle>\n<ArticleTitle>"), "n_name", F.lit("</ArticleTitle>"), year, F.lit('<ArticleIdList><ArticleId IdType="pmid">0</ArticleId><ArticleId IdType="doi">'), F.col("n_nationkey").cast("string"), F.lit("</ArticleId></ArticleIdList><Abstract><AbstractText>"), "n_name", F.lit(" &amp; more</AbstractText><AbstractText>part two</AbstractText></Abstract>\n</PubmedArticle>"))
    table(s, d, "nation").select(one.alias("value")).write.text(to)
    return fl.read_xml(s, to, "PubmedArticle", {"title": "//ArticleTitle", "doi": "//ArticleId[@IdType='doi']", "year": "//PubDate/Year"}, {"abstract": "//AbstractText"})


@register("SRC15", """SELECT '( endophyte* OR "latent fung*" ) AND ( plant* OR moss* ) AND (1990/01/01[PDAT] : 1999/12/31[PDAT])' AS query""")
def _(s, d):
    return s.createDataFrame([(fl.search_string([["endophyte*", "latent fung*"], ["plant*", "moss*"]], 1990, 1999),)], "query string")


@register("SNK3", "SELECT c_custkey, c_name FROM customer")
def _(s, d):
    to, df = fl.scratch(s, "batches"), table(s, d, "customer").select("c_custkey", "c_name")
    fl.write_batches(df, "c_custkey", to, 12)
    return fl.write_batches(df, "c_custkey", to, 12)  # all steps are there


@register("SNK4", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    # partial results of batches, written and summed
    parts = fl.write_batches(table(s, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")), "o_orderstatus", fl.scratch(s, "partial"), 4, 1)
    return parts.groupBy("o_orderpriority").agg(F.sum("n").alias("n"))


@register("SNK5", "SELECT unnest(['Counts', '======', '', 'regions', '-------', 'n: ' || (SELECT count(*) FROM region)]) AS line")
def _(s, d):
    lines = fl.report("Counts", {"regions": table(s, d, "region").agg(F.count("*").alias("n"))})
    return s.createDataFrame([(x,) for x in lines], "line string")


@register("SNK6", "SELECT '| r_regionkey | r_name |' AS line UNION ALL SELECT '| --- | --- |' UNION ALL SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region")
def _(s, d):
    return s.createDataFrame([(x,) for x in fl.markdown(table(s, d, "region").select("r_regionkey", "r_name")).split("\n")], "line string")


@register("SNK9", "SELECT unnest([true, false, true]) AS written")
def _(s, d):
    to, df = fl.scratch(s, "lookup"), table(s, d, "nation")
    return s.createDataFrame([(fl.build_lookup(df, "n_name", to),), (fl.build_lookup(df, "n_name", to),), (fl.build_lookup(df, "n_name", to, again=True),)], "written boolean")


@register("SNK10", "SELECT r_regionkey, r_name FROM region")
def _(s, d):
    to = fl.scratch(s, "kept")
    table(s, d, "region").select("r_regionkey", "r_name").write.parquet(f"{to}/region.parquet")
    return s.read.parquet(fl.backup(s, f"{to}/region.parquet", f"{to}/backups", "20240131_120000"))


@register("SNK12", "SELECT p_partkey, p_brand FROM part")
def _(s, d):
    to = fl.scratch(s, "subsets")
    fl.write_subsets(table(s, d, "part").select("p_partkey", "p_brand"), "p_brand", to)
    return s.read.parquet(to)


# --- stages and checks ----------------------------------------------------------------------------------
def _stages(s, d, to):
    write = lambda name, df: lambda spark: df.write.mode("overwrite").parquet(f"{to}/{name}")
    region = table(s, d, "region")
    return [
        wf.Stage("first", write("first", region), outputs=[f"{to}/first"]),
        wf.Stage("second", write("second", region), required=[f"{to}/first"], outputs=[f"{to}/second"]),
        wf.Stage("lost", write("lost", region), required=[f"{to}/nowhere"], outputs=[f"{to}/lost"]),
        wf.Stage("last", write("last", region), outputs=[f"{to}/last"]),
    ]


register("ORC1", "SELECT * FROM (VALUES (0, 'first', 'done'), (1, 'second', 'done'), (2, 'lost', 'failed'), (3, 'last', 'not run')) t(position, stage, status)")(lambda s, d: wf.run_stages(s, _stages(s, d, fl.scratch(s, "stages"))).select("position", "stage", "status"))
register("ORC2", "SELECT * FROM (VALUES (0, 'first', 'done'), (1, 'last', 'done')) t(position, stage, status)")(lambda s, d: wf.run_stages(s, wf.subset(_stages(s, d, fl.scratch(s, "stages")), {"ends": ["last", "first"]}, "ends")).select("position", "stage", "status"))
register("ORC3", "SELECT * FROM (VALUES (0, 'first', 'skipped'), (1, 'second', 'skipped'), (2, 'lost', 'failed'), (3, 'last', 'done')) t(position, stage, status)")(lambda s, d: (lambda stages: (wf.run_stages(s, stages), wf.run_stages(s, stages, stop_on_error=False))[1])(_stages(s, d, fl.scratch(s, "stages"))).select("position", "stage", "status"))
register("ORC4", "SELECT 'first' AS stage, 'done' AS status, true AS timed")(lambda s, d: wf.run_stages(s, _stages(s, d, fl.scratch(s, "stages")), only=["first"]).select("stage", "status", (F.col("seconds") >= 0).alias("timed")))
register("ORC5", "SELECT c_custkey, any_value(try_cast(c_acctbal AS DOUBLE)) AS c_acctbal FROM customer GROUP BY 1")(lambda s, d: (lambda c: wf.recovered(c.unionByName(c).unionByName(c.limit(1).select(*[F.lit(None).cast("string").alias(x) for x in c.columns])), "c_custkey", ["c_acctbal"]))(table(s, d, "customer").select("c_custkey", F.col("c_acctbal").cast("string").alias("c_acctbal"))).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_acctbal"))
register("ORC7", "SELECT * FROM (VALUES ('loose', 0.5::DOUBLE), ('medium', 0.6::DOUBLE), ('strict', 0.8::DOUBLE), ('super_strict', 0.9::DOUBLE)) t(level, threshold)")(lambda s, d: s.createDataFrame(list(wf.Settings().presence.items()), "level string, threshold double"))
register("ORC11", "SELECT unnest(['missing column: nowhere', '5 rows, at least 100 needed']) AS problem")(lambda s, d: s.createDataFrame([(p,) for p in wf.problems(table(s, d, "region"), ["r_name", "nowhere"], 100)], "problem string"))
register("AN21", f"WITH {CLASSES}, n AS (SELECT guess AS sample_type, count(*) AS n FROM classes GROUP BY 1) SELECT sample_type, validation_status, CASE WHEN validation_status = 'Not Started' THEN n ELSE 0 END AS count, CASE WHEN validation_status = 'Not Started' THEN 100 ELSE 0 END AS percentage FROM n CROSS JOIN (SELECT unnest(['Not Started', 'In Progress', 'Completed', 'Reviewed']) AS validation_status)")(lambda s, d: tb.counted(classes(s, d), "guess").select(F.col("guess").alias("sample_type"), "n", F.explode(F.array(*map(F.lit, ("Not Started", "In Progress", "Completed", "Reviewed")))).alias("validation_status")).select("sample_type", "validation_status", F.when(F.col("validation_status") == "Not Started", F.col("n")).otherwise(0).alias("count"), F.when(F.col("validation_status") == "Not Started", 100).otherwise(0).alias("percentage")))
