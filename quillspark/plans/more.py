"""Further queries of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import analysis as an
from quillspark.operators import extraction as ex
from quillspark.operators import models as md
from quillspark.operators import tables as tb
from quillspark.operators import training as tr
from quillspark.sources import files as fl

from .registry import CLASSES, DOCS, classes, docs, register, table
from .texts import _STOP as STOP

# --- sources and schema -----------------------------------------------------------------------


def _csv(s, df):
    to = fl.scratch(s, "csv")
    fl.write_csv(df, to)
    return to


register("SRC3", "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")(lambda s, d: fl.read_delimited(s, _csv(s, table(s, d, "region")), empties=True))
register("SRC4", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents")(lambda s, d: fl.read_delimited(s, _csv(s, table(s, d, "documents")), columns=["doc_id", "text"], empties=True))
register("SRC5", "SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS name")(lambda s, d: (lambda c: s.range(1).select(F.explode(F.array(*map(F.lit, c))).alias("name")))(fl.read_delimited(s, _csv(s, table(s, d, "nation"))).columns))
register("SRC6", "SELECT r_name FROM region")(lambda s, d: fl.read_first(s, fl.scratch(s, "none"), _csv(s, table(s, d, "region")), empties=True).select("r_name"))
register("SRC7", "SELECT doc_id, text FROM documents")(lambda s, d: fl.read_with_fallback(s, _csv(s, table(s, d, "documents").select("doc_id", "text")), empties=True).select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
register("SRC9", "SELECT p_name FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_type IN ('ECONOMY', 'STANDARD', 'PROMO', 'LARGE', 'SMALL', 'MEDIUM')")(lambda s, d: (lambda to: (table(s, d, "part").select("p_name", F.col("p_brand").alias("kingdom"), F.col("p_type").alias("taxonRank")).write.csv(to, sep="\t", header=True), fl.read_taxonomy(s, to, ["Brand#1", "Brand#2"], ["ECONOMY", "STANDARD", "PROMO", "LARGE", "SMALL", "MEDIUM"]).select("p_name"))[1])(fl.scratch(s, "tax")))
register("SNK1", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer")(lambda s, d: fl.read_delimited(s, _csv(s, table(s, d, "customer").select("c_custkey", "c_name")), empties=True))
register("PRJ8", "SELECT n_nationkey, n_name FROM nation")(lambda s, d: tb.first_names(table(s, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("n_nationkey"), F.lit("").alias("n_name"))))
register("PRJ12", "SELECT 'shared' AS kind, 'doc_id' AS name UNION ALL SELECT 'only_first', unnest(['quality', 'toxic']) UNION ALL SELECT 'only_second', unnest(['text', 'lang', 'source', 'n_chars'])")(lambda s, d: (lambda sets: s.createDataFrame([(k, c) for k in ("shared", "only_first", "only_second") for c in sets[k]], "kind string, name string"))(tb.column_sets(table(s, d, "labels").columns, table(s, d, "documents").columns)))
register("FLT11", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag = 'R'))")(lambda s, d: tb.not_in_any(table(s, d, "orders"), (ex.only_such(table(s, d, "lineitem").withColumn("f", F.col("l_returnflag") == "R"), "l_orderkey", "f").where("only"), "o_orderkey", "l_orderkey")).select("o_orderkey"))
register("FLT13", "SELECT p_partkey FROM part WHERE nullif(p_brand, 'Brand#1') IS NOT NULL")(lambda s, d: table(s, d, "part").withColumn("phylum", F.nullif("p_brand", F.lit("Brand#1"))).where("phylum is not null").select("p_partkey"))

# --- aggregates, samples, order ---------------------------------------------------------------
_BAND = "CASE WHEN conf >= 0.8 THEN 'high' WHEN conf >= 0.6 THEN 'medium' ELSE 'low' END"
register("AG20", f"WITH {CLASSES} SELECT {_BAND} AS band, round(avg((label = guess)::INT) FILTER (guess = 'Presence'), 6) AS presence, round(avg((label = guess)::INT) FILTER (guess = 'Absence'), 6) AS absence FROM classes GROUP BY 1")(lambda s, d: (lambda ok: classes(s, d).groupBy(F.expr(_BAND).alias("band")).agg(F.round(F.avg(F.when(F.col("guess") == "Presence", ok)), 6).alias("presence"), F.round(F.avg(F.when(F.col("guess") == "Absence", ok)), 6).alias("absence")))((F.col("label") == F.col("guess")).cast("int")))
register("AG23", "WITH b AS (SELECT toxic, count(*) AS n, count(*) * CASE WHEN toxic = 1 THEN 3 ELSE 1 END AS m FROM labels GROUP BY 1), s AS (SELECT 'before' AS step, toxic, n FROM b UNION ALL SELECT 'after', toxic, m FROM b) SELECT step, toxic, n, round(100.0 * n / sum(n) OVER (PARTITION BY step), 4) AS percent FROM s")(lambda s, d: (lambda x: an.class_balance({"before": x, "after": tb.repeated(x.withColumn("k", F.when(F.col("toxic") == 1, 3).otherwise(1)), "k", "i")}, "toxic"))(table(s, d, "labels")))
register("AG24", "WITH f AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45) SELECT p_brand, count(*) AS total, count(l_partkey) AS found, round(100.0 * count(l_partkey) / count(*), 4) AS percent FROM part LEFT JOIN f ON p_partkey = l_partkey GROUP BY 1")(lambda s, d: ex.coverage(table(s, d, "part"), table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "p_brand"))
register("SR3", "SELECT n_name, r.p FROM nation JOIN (SELECT r_regionkey, row_number() OVER (ORDER BY r_name DESC) AS p FROM region) r ON n_regionkey = r_regionkey ORDER BY p, n_name")(lambda s, d: table(s, d, "nation").join(F.broadcast(tb.positioned(table(s, d, "region").withColumn("neg", F.expr("translate(r_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ZYXWVUTSRQPONMLKJIHGFEDCBA')")), ["neg"])).withColumn("p", F.col("_position") + 1), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "p").orderBy("p", "n_name"))
register("ARR1", "SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, bool_or(l_quantity > 40) AS some, bool_and(l_quantity > 5) AS every FROM lineitem GROUP BY 1")(lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("a"), F.collect_list("l_quantity").alias("q")).select("l_orderkey", F.size(F.array_distinct("a")).cast("long").alias("n"), F.exists("q", lambda x: x > 40).alias("some"), F.forall("q", lambda x: x > 5).alias("every")))
register("RS9", "SELECT a.doc_id, a.n_chars, b.quality FROM documents a JOIN labels b ON a.doc_id = b.doc_id")(lambda s, d: table(s, d, "documents").select("doc_id", "n_chars").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id"))
register("MTH7", f"WITH {CLASSES}, t AS (SELECT count(*) FILTER (label = 'Presence' AND guess = 'Presence') AS tp, count(*) FILTER (label = 'Absence' AND guess = 'Presence') AS fp, count(*) FILTER (label = 'Presence' AND guess = 'Absence') AS fn FROM classes) SELECT round(5 * tp / (5 * tp + 4 * fn + fp), 6) AS f2 FROM t")(lambda s, d: md.metrics(classes(s, d), "label", "guess", "Presence", "Absence").select("f2"))

# --- text -------------------------------------------------------------------------------------
_ASCII = DOCS.replace("text AS abstract", "regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS abstract")
_ascii = lambda s, d: docs(s, d).withColumn("abstract", F.regexp_replace("abstract", r"[^\x00-\x7F]", "_"))
register("STR7", f"WITH {_ASCII} SELECT id, regexp_matches(abstract, '\\b(sp|spp|var|subsp)\\.') AS hit FROM docs")(lambda s, d: _ascii(s, d).select("id", F.col("abstract").rlike(tx.INDICATORS).alias("hit")))
def _place(s, d, name, rules):
    """Whether the documents have one country by the library's rules; null of a null text."""
    found = ex.places(_ascii(s, d), "abstract", {name: ""}, rules, {}, {}, [], [], set())
    return found.select("id", F.when(F.col("abstract").isNotNull(), F.col("countries_detected") == name).alias("hit"))


register("STR15", f"WITH {_ASCII} SELECT id, regexp_matches(abstract, '(?i)\\bthe\\b') AND regexp_matches(lower(abstract), 'ing|ed') AND NOT regexp_matches(lower(abstract), 'xx') AS hit FROM docs")(lambda s, d: _place(s, d, "the", [ex.PlaceRule("the", needs="ing|ed", not_with="xx")]))
register("STR16", f"WITH {_ASCII} SELECT id, regexp_matches(abstract, '(?i)\\bof\\s+the\\b') AS hit FROM docs")(lambda s, d: _place(s, d, "of the", []))
register("STR18", "SELECT c_custkey, CASE WHEN regexp_matches(c_mktsegment, '\\bBUILDING\\b') THEN 'Houses' WHEN regexp_matches(c_mktsegment, '\\bMACHINERY\\b') THEN 'Works' END AS place FROM customer")(lambda s, d: table(s, d, "customer").select("c_custkey", tx.labelled_by(F.col("c_mktsegment"), {r"\bbuilding\b": "Houses", r"\bmachinery\b": "Works"}).alias("place")))
register("STR19", "SELECT r_name, trim(c) AS country FROM (SELECT r_name, unnest(string_split(r_name || 'land; Multiple others; ' || r_name || 'ia', ';')) AS c FROM region) WHERE trim(c) NOT LIKE 'Multiple%'")(lambda s, d: tb.separated(table(s, d, "region").select("r_name", F.concat("r_name", F.lit("land; Multiple others; "), "r_name", F.lit("ia")).alias("country")), "country").where("country not like 'Multiple%'"))
_HITS = "regexp_extract_all(abstract, '" + "|".join(ex.COORDINATES).replace("'", "''") + "')"
_POSSIBLE = "CASE WHEN len(n) >= 2 THEN len(list_filter(n, lambda x: abs(x) <= 90)) > 0 ELSE len(list_filter(n, lambda x: abs(x) <= 180 OR x >= 100000)) > 0 END"
register("STR21", f"WITH {DOCS}, h AS (SELECT id, unnest({_HITS}) AS h FROM docs), n AS (SELECT id, list_transform(regexp_extract_all(h, '-?\\d+\\.?\\d*'), lambda x: CAST(x AS DOUBLE)) AS n FROM h) SELECT id, id IN (SELECT id FROM n WHERE {_POSSIBLE}) AS hit FROM docs")(lambda s, d: docs(s, d).select("id", ex.has_coordinates(F.col("abstract")).alias("hit")))
register("STR24", f"WITH {DOCS}, t AS (SELECT id, list_filter(regexp_split_to_array(lower(abstract), '\\s+'), lambda x: x <> '') AS t FROM docs), p AS (SELECT id, t, list_position(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), 'of the') AS p FROM t), g AS (SELECT id, array_to_string(t[greatest(1, p - 15):p + 16], ' ') AS g FROM p WHERE p > 0) SELECT id, CASE WHEN length(g) > 300 THEN left(g, 300) || '...' ELSE g END AS context FROM g")(lambda s, d: docs(s, d).select("id", tx.context_words(F.col("abstract"), "of the").alias("context")).where("context is not null"))
register("STR25", f"WITH {DOCS}, g AS (SELECT id, regexp_extract(abstract, '(?is)(?:^|\\s)(.{{0,60}}of\\s+the.{{0,60}})(?:\\s|$)', 1) AS g FROM docs) SELECT id, left(trim(g), 500) AS context FROM g WHERE g <> ''")(lambda s, d: docs(s, d).select("id", tx.context_chars(F.col("abstract"), "of the").alias("context")).where("context is not null"))
register("STR28", "SELECT s_suppkey, d AS distance, CASE WHEN d <= 0.15 THEN n_name END AS nearest FROM (SELECT s_suppkey, n_name, n_nationkey, round(1 - jaro_winkler_similarity(s_name, n_name), 9) AS d FROM supplier CROSS JOIN nation) QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY d, n_nationkey) = 1")(lambda s, d: ex.nearest_names(table(s, d, "supplier"), "s_suppkey", "s_name", table(s, d, "nation"), "n_name", "n_nationkey", sql=True))
register("STR34", "SELECT r_regionkey, CASE WHEN lower(r_name) LIKE 'a%' THEN 'Plantae' ELSE 'Fungi' END AS kingdom FROM region")(lambda s, d: table(s, d, "region").select("r_regionkey", tx.labelled_by(F.col("r_name"), {"^a": "Plantae"}, "Fungi").alias("kingdom")))
register("STR36", "SELECT p_partkey FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'box')")(lambda s, d: table(s, d, "part").where(tx.contains_any(F.col("p_name"), ["ring", "box"])).select("p_partkey"))
register("STR38", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN contains(p_name, 'sm') THEN 'small' END, CASE WHEN contains(p_name, 'in') THEN 'in' END], lambda x: x IS NOT NULL), '; ') AS found FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(tx.categories_found(F.col("p_name"), {"small": ["sm"], "in": ["in"]}), "; ").alias("found")))

# --- extraction -------------------------------------------------------------------------------
register("EXT9", None)(lambda s, d: ex.places(docs(s, d), "abstract", dict.fromkeys(["The", "And", "La"], ""), [ex.PlaceRule("La", not_with="the")], {"Der": "The"}, {"Une": "La"}, ["Of"], ["In"], {"The"}).select("id", "countries_detected", "global_north_countries", "global_south_countries", "continents_detected", "regions_detected", "has_coordinates", "geographic_summary"))
register("EXT19", "SELECT DISTINCT lower(p_name) AS name FROM part WHERE lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_size > 30)")(lambda s, d: (lambda to: (fl.write_lookup(table(s, d, "part").where("p_size > 30").select(F.lower("p_name").alias("name")), "name", to), fl.looked_up(table(s, d, "part"), "p_name", to).select("name"))[1])(fl.scratch(s, "lookup")))
register("EXT23", "SELECT n_name, count(c_custkey) AS n, count(c_custkey) > 0 AS detected FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1")(lambda s, d: table(s, d, "nation").join(table(s, d, "customer").where("c_acctbal > 9000"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("n")).withColumn("detected", F.col("n") > 0))

# --- models -----------------------------------------------------------------------------------
_labelled = lambda s, d: table(s, d, "documents").select("doc_id", "text").join(table(s, d, "labels").select("doc_id", "toxic"), "doc_id")
_STOPS = ", ".join(f"'{w}'" for w in STOP)
register("ML2", f"WITH {DOCS}, w AS (SELECT id, regexp_extract_all(lower(abstract), '([\\p{{L}}\\p{{N}}]+(?:''[\\p{{L}}\\p{{N}}]+)*)', 1) AS t FROM docs), p AS (SELECT id, t[i] AS a, t[i + 1] AS b FROM (SELECT id, t, unnest(range(1, len(t))) AS i FROM w)), c AS (SELECT id, a || '_' || b AS bigram, count(*) AS n FROM p WHERE a NOT IN ({_STOPS}) AND b NOT IN ({_STOPS}) AND NOT regexp_matches(a || b, '\\p{{Nd}}') GROUP BY 1, 2), k AS (SELECT bigram FROM c GROUP BY 1 HAVING sum(n) >= 2) SELECT docs.id, m.bigram, coalesce(m.n, 0) AS n FROM docs LEFT JOIN (SELECT * FROM c WHERE bigram IN (SELECT bigram FROM k)) m ON docs.id = m.id")(lambda s, d: ex.bigram_counts(docs(s, d), "id", "abstract", STOP))
register("ML5", None)(lambda s, d: tr.balanced_by_neighbours(table(s, d, "labels").join(table(s, d, "documents"), "doc_id").withColumn("n_chars", F.col("n_chars").cast("double")), "toxic", 1, ["n_chars"], 2, "doc_id"))
register("ML8", None)(lambda s, d: tr.predicted(tr.elastic_net(_labelled(s, d), "text", "toxic"), table(s, d, "documents"), "text", "doc_id"))
register("ML9", None)(lambda s, d: tr.predicted(tr.linear_svm(_labelled(s, d), "text", "toxic"), table(s, d, "documents"), "text", "doc_id"))
_GRID = f"WITH {CLASSES}, t AS (SELECT * FROM classes CROSS JOIN (SELECT unnest([0.4::DOUBLE, 0.5::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE]) AS weight) CROSS JOIN (SELECT unnest([0.3::DOUBLE, 0.35::DOUBLE, 0.4::DOUBLE, 0.45::DOUBLE, 0.5::DOUBLE, 0.55::DOUBLE, 0.6::DOUBLE, 0.65::DOUBLE, 0.7::DOUBLE]) AS threshold)), h AS (SELECT *, round(weight * conf + (1 - weight) * conf2, 9) >= threshold AS hit FROM t), g AS (SELECT weight, threshold, round(count(*) FILTER (hit AND label = 'Presence') / count(*) FILTER (label = 'Presence'), 6) AS presence_recall, round(count(*) FILTER (NOT hit AND label = 'Absence') / count(*) FILTER (label = 'Absence'), 6) AS absence_recall FROM h GROUP BY 1, 2)"
_grid = lambda s, d: md.weight_grid(classes(s, d), "conf", "conf2", "label", "Presence", [0.4, 0.5, 0.6, 0.8], [0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7])
register("ML15", f"{_GRID} SELECT * FROM g")(_grid)
register("SR8_grid", f"{_GRID} SELECT * FROM g ORDER BY (presence_recall + absence_recall) / 2 DESC, weight, threshold LIMIT 1")(lambda s, d: an.best_config(_grid(s, d), ["presence_recall", "absence_recall"], ["weight", "threshold"]))
register("ML17", f"WITH {CLASSES} SELECT id, CASE WHEN conf >= 0.6 THEN guess WHEN conf2 >= 0.6 THEN label ELSE 'Uncertain' END AS final FROM classes")(lambda s, d: classes(s, d).select("id", md.cascade([(F.col("conf"), 0.6, F.col("guess")), (F.col("conf2"), 0.6, F.col("label"))]).alias("final")))
register("ML22", f"WITH {CLASSES} SELECT label, count(*) AS n, round(avg((label = guess)::INT), 6) AS accuracy, round(avg(conf), 6) AS mean_conf FROM classes GROUP BY 1")(lambda s, d: classes(s, d).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("guess")).cast("int")), 6).alias("accuracy"), F.round(F.avg("conf"), 6).alias("mean_conf")))

# --- analyses ---------------------------------------------------------------------------------
register("AN9", "WITH f AS (SELECT lang IS NOT NULL AS a, n_chars > 1000 AS b, contains(text, 'the') AS c FROM documents) SELECT flag, count(*) FILTER (x) AS n, round(100.0 * count(*) FILTER (x) / count(*), 4) AS percent FROM (SELECT unnest(['lang', 'long', 'the']) AS flag, unnest([a, b, c]) AS x FROM f) GROUP BY 1")(lambda s, d: an.info_rates(table(s, d, "documents"), {"lang": F.col("lang").isNotNull(), "long": F.col("n_chars") > 1000, "the": F.contains("text", F.lit("the"))}))
register("AN11", "SELECT w AS part, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> 'ring' GROUP BY 1 ORDER BY n DESC, part LIMIT 15")(lambda s, d: an.top_values(table(s, d, "part").select(F.col("p_name").alias("part")), "part", " ", ["ring"]))
_BIG = "SELECT l_orderkey, bool_or(n_regionkey < 2) AS a, bool_or(n_regionkey IN (2, 3)) AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity > 30 GROUP BY 1"


@register("AN12", f"SELECT o_orderkey, CASE WHEN a AND b THEN 'Both' WHEN a THEN 'North' WHEN b THEN 'South' WHEN l_orderkey IS NOT NULL THEN 'Other' ELSE 'None' END AS class FROM orders LEFT JOIN ({_BIG}) ON o_orderkey = l_orderkey")
def _(s, d):
    nation = table(s, d, "nation")
    named = lambda rule: [r.n_name for r in nation.where(rule).select("n_name").collect()]  # noqa: E731  (a dictionary of countries)
    places = table(s, d, "lineitem").where("l_quantity > 30").join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    each = places.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("n_name").alias("countries"))
    return table(s, d, "orders").select("o_orderkey").join(each, "o_orderkey", "left").select("o_orderkey", an.region_class(F.col("countries"), named("n_regionkey < 2"), named("n_regionkey in (2, 3)")).alias("class"))


_RICH = "WITH k AS (SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 7500 GROUP BY 1)"
_rich = lambda s, d: table(s, d, "customer").where("c_acctbal > 7500").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name")
register("AN12_extremes", f"{_RICH} SELECT 'top' AS side, * FROM (SELECT * FROM k ORDER BY n DESC, n_name LIMIT 10) UNION ALL SELECT 'bottom', * FROM (SELECT * FROM k ORDER BY n, n_name LIMIT 10)")(lambda s, d: an.extremes(table(s, d, "nation"), _rich(s, d), "n_name", 10))
register("AN13", f"{_RICH} SELECT * FROM k WHERE n < 15")(lambda s, d: an.below(table(s, d, "nation"), _rich(s, d), "n_name"))
register("AN11_sizes", "SELECT len(list_distinct(string_split(p_name, ' '))) AS size, count(*) AS n FROM part GROUP BY 1")(lambda s, d: an.per_document(table(s, d, "part"), "p_name", " "))
register("AN14", "SELECT round(avg(x::INT), 6) AS share FROM (SELECT l_orderkey, bool_and(l_suppkey % 2 = 0) AS x FROM lineitem GROUP BY 1)")(lambda s, d: an.share_of_all(table(s, d, "lineitem"), "l_orderkey", F.col("l_suppkey") % 2 == 0))
register("AN15", "SELECT source, count(DISTINCT doc_id) AS n, round(100.0 * count(DISTINCT doc_id) / (SELECT count(DISTINCT doc_id) FROM documents), 4) AS percent FROM documents GROUP BY 1")(lambda s, d: an.share_by(table(s, d, "documents"), "doc_id", "source"))
register("AN19", f"WITH {CLASSES} SELECT guess, round(avg((label = guess)::INT), 6) AS precision FROM classes GROUP BY 1 ORDER BY precision, guess LIMIT 1")(lambda s, d: classes(s, d).groupBy("guess").agg(F.round(F.avg((F.col("label") == F.col("guess")).cast("int")), 6).alias("precision")).orderBy("precision", "guess").limit(1))
register("AN23", "SELECT DISTINCT p_name FROM part WHERE p_brand <> 'Brand#1' AND p_name NOT IN (SELECT p_name FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_quantity > 49)")(lambda s, d: ex.unrepresented(table(s, d, "part").where("p_brand <> 'Brand#1'").select("p_name").distinct(), table(s, d, "part").join(table(s, d, "lineitem").where("l_quantity > 49"), F.col("p_partkey") == F.col("l_partkey")), "p_name"))
register("AN24", f"WITH {CLASSES}, x AS (SELECT method, run, CASE method WHEN 'svm' THEN conf >= 0.5 ELSE conf2 >= 0.5 END AS hit, CASE run WHEN 'all' THEN true WHEN 'presence_only' THEN guess = 'Presence' ELSE conf >= 0.8 END AS pass FROM classes CROSS JOIN (SELECT unnest(['svm', 'glm']) AS method) CROSS JOIN (SELECT unnest(['all', 'presence_only', 'high_confidence']) AS run)) SELECT method, run, count(*) FILTER (pass) AS n, count(*) FILTER (pass AND hit) AS found, round(100.0 * count(*) FILTER (pass AND hit) / count(*) FILTER (pass), 4) AS percent FROM x GROUP BY 1, 2")(lambda s, d: an.run_matrix(classes(s, d), {"svm": F.col("conf") >= 0.5, "glm": F.col("conf2") >= 0.5}, {"all": F.lit(True), "presence_only": F.col("guess") == "Presence", "high_confidence": F.col("conf") >= 0.8}))
register("UDF3", "SELECT l_orderkey, unnest(range(1, CAST(l_linenumber AS BIGINT) + 1)) AS k FROM lineitem")(lambda s, d: tb.repeated(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_linenumber", "k").drop("l_linenumber"))
