"""Queries of the relational operators: schema, filters, joins, duplicates, aggregates, windows,
order, reshape and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import fuzzy as fz
from quillspark.operators import models as md
from quillspark.operators import tables as tb

from .registry import CLASSES, DOCS, classes, docs, register, table, texts

# --- projections ------------------------------------------------------------------------------
register("PRJ1", "SELECT o_orderkey, o_totalprice, o_custkey FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey"))
register("PRJ2", "SELECT c_custkey, c_name FROM customer")(lambda s, d: tb.present(table(s, d, "customer"), ["c_custkey", "c_missing", "c_name"]))
register("PRJ3", "SELECT c_custkey AS id, c_name AS c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")(lambda s, d: tb.rename(table(s, d, "customer"), {"c_custkey": "id", "c_name": "c_custkey"}))
register("PRJ4", "SELECT doc_id AS id, text AS abstract, lang, source, n_chars FROM documents")(lambda s, d: tb.rename(table(s, d, "documents"), {"doc_id": "id", "text": "abstract", "AB": "abstract"}))
register("PRJ5", "SELECT p_partkey AS part_key, p_name AS part_name, p_size AS x1_size FROM part")(lambda s, d: tb.clean_names(table(s, d, "part").select(F.col("p_partkey").alias("Part Key"), F.col("p_name").alias("partName"), F.col("p_size").alias("1.size"))))
register("PRJ6", "SELECT s_suppkey, s_name FROM supplier")(lambda s, d: tb.without(table(s, d, "supplier"), ["s_acctbal", "s_nationkey", "s_other"]))
register("PRJ7", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")(lambda s, d: tb.without(table(s, d, "customer").join(table(s, d, "nation").withColumnRenamed("n_nationkey", "key.y"), F.col("c_nationkey") == F.col("`key.y`")).select("c_custkey", "n_name", "`key.y`"), suffixes=[".y"]))
register("PRJ9", "SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS price_text, TRY_CAST(o_orderpriority AS INTEGER) AS priority_number FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("price_text"), F.expr("try_cast(o_orderpriority as int)").alias("priority_number")))
register("PRJ10", "SELECT c_custkey, 'WoS' AS origin FROM customer")(lambda s, d: table(s, d, "customer").select("c_custkey", F.lit("WoS").alias("origin")))
register("PRJ11", "SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS r_comment FROM region")(lambda s, d: tb.aligned(table(s, d, "region"), ["r_regionkey", "r_name", "r_comment"]))
register("PRJ13", "SELECT p_partkey, p_brand || '_' || p_type AS brand_type FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", F.concat_ws("_", "p_brand", "p_type").alias("brand_type")))
register("PRJ14", "SELECT p_partkey, split_part(p_name, ' ', 1) AS word1, split_part(p_name, ' ', 2) AS word2 FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", F.split("p_name", " ")[0].alias("word1"), F.split("p_name", " ")[1].alias("word2")))
register("PRJ15", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS kind FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 200000, "high").when(F.col("o_orderstatus") == "O", "open").otherwise("other").alias("kind")))
register("PRJ16", "SELECT l_orderkey, l_linenumber, round(l_discount * 2, 4) AS l_discount, round(l_tax * 2, 4) AS l_tax FROM lineitem")(lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(F.col(c) * 2, 4).alias(c) for c in ("l_discount", "l_tax")]))
register("PRJ17", "SELECT p_partkey, coalesce(p_name, '') || ' - ' || coalesce(p_type, '') AS full_text FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", F.concat(F.coalesce("p_name", F.lit("")), F.lit(" - "), F.coalesce("p_type", F.lit(""))).alias("full_text")))
register("PRJ19", "SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_type END, p_name) AS final_name, split_part(p_name, ' ', 1) AS genus FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", F.coalesce(F.when(F.col("p_size") > 25, F.col("p_type")), "p_name").alias("final_name"), F.split("p_name", " ")[0].alias("genus")))

# --- filters ----------------------------------------------------------------------------------
register("FLT1", f"WITH {DOCS} SELECT id, n_chars FROM docs WHERE abstract IS NOT NULL AND abstract <> '' AND abstract <> '[No abstract available]'")(lambda s, d: docs(s, d).where(tb.non_empty("abstract")).select("id", "n_chars"))
_KIND = "nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'Article' ELSE 'Review' END, '')"
register("FLT2", f"SELECT o_orderkey, kind FROM (SELECT o_orderkey, {_KIND} AS kind FROM orders) WHERE kind IN ('Article') OR kind IS NULL")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.expr(_KIND).alias("kind")).where(tb.in_or_null("kind", ["Article"])))
register("FLT3", f"SELECT o_orderkey, kind, kind IS NULL AS missing FROM (SELECT o_orderkey, {_KIND} AS kind FROM orders)")(lambda s, d: (lambda t: t.where("kind is not null").withColumn("missing", F.lit(False)).union(t.where("kind is null").withColumn("missing", F.lit(True))))(table(s, d, "orders").select("o_orderkey", F.expr(_KIND).alias("kind"))))
register("FLT4", f"SELECT o_orderkey, kind FROM (SELECT o_orderkey, {_KIND} AS kind FROM orders) WHERE kind <> 'Review'")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.expr(_KIND).alias("kind")).where("kind <> 'Review'"))
register("FLT5", f"SELECT o_orderkey FROM (SELECT o_orderkey, {_KIND} = 'Review' AS flag FROM orders) WHERE flag = FALSE OR flag IS NULL")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.expr(f"{_KIND} = 'Review'").alias("flag")).where("not flag or flag is null").select("o_orderkey"))
register("FLT6", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 30)")(lambda s, d: tb.group_size_at_least(table(s, d, "lineitem"), ["l_partkey"], 30).select("l_orderkey", "l_linenumber"))
register("FLT7", f"WITH {DOCS} SELECT id, CASE WHEN year >= 1990 THEN year END AS year FROM docs WHERE year >= 1985")(lambda s, d: docs(s, d).where("year >= 1985").select("id", F.when(F.col("year") >= 1990, F.col("year")).alias("year")))
register("FLT8", "SELECT p_partkey, p_brand FROM part WHERE NOT regexp_matches(p_brand, '[1-3]')")(lambda s, d: table(s, d, "part").where(~F.col("p_brand").rlike("[1-3]")).select("p_partkey", "p_brand"))
register("FLT10", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_anti").select("doc_id"))
register("FLT12", "SELECT doc_id FROM documents WHERE NOT (text IS NULL AND lang IS NULL AND source IS NULL)")(lambda s, d: table(s, d, "documents").dropna("all", subset=["text", "lang", "source"]).select("doc_id"))
register("FLT14", "SELECT source, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 10")(lambda s, d: tb.counted(table(s, d, "documents"), "source").where("n >= 10"))

# --- joins ------------------------------------------------------------------------------------
register("JN1", "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")(lambda s, d: table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left"))
register("JN2", "SELECT a.doc_id, a.quality, b.quality AS quality_manual FROM labels a LEFT JOIN (SELECT * FROM labels WHERE toxic = 1) b ON a.doc_id = b.doc_id")(lambda s, d: table(s, d, "labels").select("doc_id", "quality").join(table(s, d, "labels").where("toxic = 1").select("doc_id", F.col("quality").alias("quality_manual")), "doc_id", "left"))
register("JN3", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")(lambda s, d: tb.left_many_to_one(table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), table(s, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), ["k"]).select("c_custkey", "n_name"))
register("JN4", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")(lambda s, d: table(s, d, "orders").select("o_orderkey").join(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_linenumber"))


@register("JN5", f"WITH {DOCS}, p AS (SELECT year // 5 * 5 AS period, count(*) AS total FROM docs GROUP BY 1), e AS (SELECT year // 5 * 5 AS period, count(*) AS en FROM docs WHERE lang = 'en' GROUP BY 1), f AS (SELECT year // 5 * 5 AS period, count(*) AS fr FROM docs WHERE lang = 'fr' GROUP BY 1) SELECT period, total, en, fr FROM p LEFT JOIN e USING (period) LEFT JOIN f USING (period)")
def _(s, d):
    x = docs(s, d).withColumn("period", md.period(F.col("year")))
    n = lambda name, where: x.where(where).groupBy("period").agg(F.count("*").alias(name))
    return n("total", "true").join(n("en", "lang = 'en'"), "period", "left").join(n("fr", "lang = 'fr'"), "period", "left")


register("JN6", "SELECT c_custkey, s_suppkey FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey")(lambda s, d: (lambda c, p: c.join(p, (c.c_nationkey == p.s_nationkey) & (c.c_custkey == p.s_suppkey), "left").select("c_custkey", "s_suppkey"))(table(s, d, "customer"), table(s, d, "supplier")))
register("JN7", "SELECT a.o_orderkey, b.o_totalprice AS pointed FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_orderkey")(lambda s, d: (lambda a, b: a.join(b, F.col("o_custkey") == F.col("k"), "left").select("o_orderkey", "pointed"))(table(s, d, "orders"), table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("pointed"))))
register("JN8", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")(lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name"))
register("JN9", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")(lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"))
register("JN10", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")(lambda s, d: tb.not_in_any(table(s, d, "customer"), (table(s, d, "orders").where("o_totalprice > 400000"), "c_custkey", "o_custkey")).select("c_custkey"))
register("JN11", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.095)")(lambda s, d: (lambda l: tb.not_in_any(table(s, d, "part"), (l.where("l_quantity > 49"), "p_partkey", "l_partkey"), (l.where("l_discount > 0.095"), "p_partkey", "l_partkey")).select("p_partkey"))(table(s, d, "lineitem")))
register("JN12", "WITH a AS (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1) SELECT k, coalesce(n_customers, 0) AS n_customers, coalesce(n_suppliers, 0) AS n_suppliers FROM a FULL JOIN b USING (k)")(lambda s, d: tb.full_with_zero(table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_customers")), table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers")), ["k"], ["n_customers", "n_suppliers"]))
register("JN13", "SELECT r_name, t AS threshold FROM region CROSS JOIN (SELECT unnest([0.5::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE]) AS t)")(lambda s, d: table(s, d, "region").select("r_name", F.explode(F.array(F.lit(0.5), F.lit(0.6), F.lit(0.8))).alias("threshold")))
register("JN14", "WITH a AS (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS p FROM region), b AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS p FROM nation) SELECT r_name, n_name FROM a JOIN b USING (p)")(lambda s, d: tb.bind_columns(table(s, d, "region"), table(s, d, "nation"), ["r_regionkey"], ["n_nationkey"]).select("r_name", "n_name"))
register("JN15", "WITH t AS (SELECT DISTINCT lower(p_name) AS term FROM part), q AS (SELECT p_partkey, ' ' || trim(regexp_replace(lower(p_name || ' ' || p_type), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS x FROM part) SELECT p_partkey, term FROM q JOIN t ON contains(x, ' ' || term || ' ')")(lambda s, d: (lambda p: tb.containing(p.withColumn("x", F.concat_ws(" ", "p_name", "p_type")), "x", p.select(F.col("p_name").alias("term")), "term").select("p_partkey", "term"))(table(s, d, "part")))
register("JN16", "SELECT a.s_suppkey, b.c_custkey FROM supplier a JOIN customer b ON a.s_nationkey = b.c_nationkey AND 1 - levenshtein(right(a.s_name, 9), right(b.c_name, 9)) / 9.0 >= 0.88")(lambda s, d: fz.joined(table(s, d, "supplier").withColumn("s", F.expr("right(s_name, 9)")), "s", table(s, d, "customer").withColumn("c", F.expr("right(c_name, 9)")), "c", distance=1, equal={"s_nationkey": "c_nationkey"}, octets=True).select("s_suppkey", "c_custkey"))  # 1 - d / 9 >= 0.88
register("JN18", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'houses' WHEN 'MACHINERY' THEN 'machines' END AS common FROM customer")(lambda s, d: table(s, d, "customer").select("c_custkey", tx.looked_up(F.col("c_mktsegment"), {"BUILDING": "houses", "MACHINERY": "machines"}).alias("common")))
register("JN19", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")(lambda s, d: table(s, d, "customer").join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name"))

# --- duplicates -------------------------------------------------------------------------------
_RANK = "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END"
_DOI = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END"
register("DED1", f"WITH t AS (SELECT o_orderkey, CAST({_DOI} AS VARCHAR) AS doi, {_RANK} AS rk FROM orders) SELECT o_orderkey, doi FROM t WHERE doi IS NULL UNION ALL SELECT o_orderkey, doi FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY rk, o_orderkey) AS rn FROM t WHERE doi IS NOT NULL) WHERE rn = 1")(lambda s, d: tb.first_by_keyed(table(s, d, "orders").select("o_orderkey", F.expr(f"cast({_DOI} as string)").alias("doi"), F.expr(_RANK).alias("rk")), "doi", ["rk", "o_orderkey"]).select("o_orderkey", "doi"))
_NORM = "trim(regexp_replace(regexp_replace(lower({c}), '\\s+', ' ', 'g'), '[!-/:-@\\[-`{{-~]', '', 'g'))"
register("DED2", f"WITH {DOCS}, t AS (SELECT id, {_NORM.format(c='abstract')} AS norm FROM docs) SELECT min(id) AS id FROM t WHERE norm IS NOT NULL AND norm <> '' GROUP BY norm UNION ALL SELECT id FROM t WHERE norm IS NULL OR norm = ''")(lambda s, d: tb.first_by_text(texts(s, d), "abstract", ["id"], ["id"]))
register("DED3", f"WITH t AS (SELECT o_orderkey, o_custkey, {_KIND} AS kind FROM orders), u AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM t) SELECT o_orderkey FROM u WHERE rn = 1 AND (kind = 'Article' OR kind IS NULL)")(lambda s, d: tb.first_by(table(s, d, "orders").withColumn("kind", F.expr(_KIND)), ["o_custkey"], ["o_orderkey"]).where(tb.in_or_null("kind", ["Article"])).select("o_orderkey"))
register("DED4", f"WITH t AS (SELECT o_orderkey, {_DOI} AS title FROM orders) SELECT min(o_orderkey) AS o_orderkey FROM t GROUP BY title")(lambda s, d: tb.first_by(table(s, d, "orders").select("o_orderkey", F.expr(_DOI).alias("title")), ["title"], ["o_orderkey"]).select("o_orderkey"))
register("DED5", "SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1")(lambda s, d: tb.first_by(table(s, d, "lineitem"), ["l_orderkey"], ["l_linenumber"]).select("l_orderkey", "l_linenumber"))
register("DED6", "WITH u AS (SELECT doc_id AS id, 1 AS p FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 2 FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 3 FROM documents) SELECT id, min(p) AS p FROM u GROUP BY id")(lambda s, d: (lambda l: tb.first_by(l.where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit(1).alias("p")).union(l.where("quality = 0").select("doc_id", F.lit(2))).union(table(s, d, "documents").select("doc_id", F.lit(3))), ["id"], ["p"]))(table(s, d, "labels")))
register("DED7", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")(lambda s, d: table(s, d, "lineitem").select("l_returnflag", "l_linestatus").distinct())
register("DED8", "SELECT doc_id FROM documents WHERE (text, lang) NOT IN (SELECT text, lang FROM documents GROUP BY 1, 2 HAVING count(*) > 1)")(lambda s, d: tb.without_duplicated(table(s, d, "documents"), ["text", "lang"]).select("doc_id"))
register("DED9", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")(lambda s, d: tb.first_by(table(s, d, "documents"), ["text"], ["doc_id"], [tb.digest("text")]).select("doc_id", "text"))
register("DED10", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")(lambda s, d: tb.first_by(table(s, d, "orders"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey"))
register("DED11", "SELECT lower(p_name) AS synonym, arg_min(p_brand, p_partkey) AS accepted FROM part GROUP BY 1")(lambda s, d: table(s, d, "part").groupBy(F.lower("p_name").alias("synonym")).agg(F.min_by("p_brand", "p_partkey").alias("accepted")))
register("DED12", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")(lambda s, d: tb.duplicate_report(table(s, d, "lineitem"), ["l_partkey"]))

# --- aggregates -------------------------------------------------------------------------------
register("AG1", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")(lambda s, d: tb.counted(table(s, d, "documents"), "lang", "source"))
register("AG2", "SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percentage FROM documents GROUP BY 1")(lambda s, d: tb.counted_with_share(table(s, d, "documents"), "lang"))
register("AG3", "SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY 1, 2")(lambda s, d: tb.share_within(table(s, d, "documents"), ["lang"], "source"))
register("AG4", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_totalprice > 200000) AS n_large FROM orders GROUP BY 1")(lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.sum((F.col("o_orderstatus") == "O").cast("long")).alias("n_open"), F.sum((F.col("o_totalprice") > 200000).cast("long")).alias("n_large")))
register("AG5", "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned, bool_and(l_returnflag = 'R') AS all_returned FROM lineitem GROUP BY 1")(lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.bool_and(F.col("l_returnflag") == "R").alias("all_returned")))
register("AG6", "SELECT lang, round(avg(n_chars), 4) AS mean, median(n_chars) AS median, round(stddev_samp(n_chars), 4) AS sd, min(n_chars) AS lo, max(n_chars) AS hi FROM documents GROUP BY 1")(lambda s, d: tb.described(table(s, d, "documents"), "n_chars", "lang").withColumnsRenamed({"least": "lo", "most": "hi"}))
register("AG7", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1")(lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("n_parts")))
register("AG8", "SELECT l_orderkey, arg_min(l_partkey, l_linenumber) AS first_part FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey) GROUP BY 1")(lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("m")).select("l_orderkey", F.col("m.l_partkey").alias("first_part")))
register("AG9", "SELECT l_suppkey, max(l_discount) AS most FROM lineitem GROUP BY 1")(lambda s, d: table(s, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_discount").alias("most")))
register("AG10", "SELECT lang, string_agg(DISTINCT source, '; ' ORDER BY source) AS sources FROM documents GROUP BY 1")(lambda s, d: table(s, d, "documents").groupBy("lang").agg(F.array_join(F.sort_array(F.collect_set("source")), "; ").alias("sources")))
register("AG11", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag) || list(l_linestatus))), ',') AS flags FROM lineitem GROUP BY 1")(lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.array_union(F.collect_set("l_returnflag"), F.collect_set("l_linestatus"))), ",").alias("flags")))
register("AG12", f"WITH {DOCS}, a AS (SELECT source, year, count(*) AS n FROM docs GROUP BY 1, 2) SELECT source, max(n) AS most, count(*) AS years FROM a GROUP BY 1")(lambda s, d: tb.counted(docs(s, d), "source", "year").groupBy("source").agg(F.max("n").alias("most"), F.count("*").alias("years")))
register("AG13", "SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS \"1-URGENT\", count(*) FILTER (o_orderpriority = '5-LOW') AS \"5-LOW\" FROM orders GROUP BY 1")(lambda s, d: tb.contingency(table(s, d, "orders"), "o_orderstatus", "o_orderpriority", ["1-URGENT", "5-LOW"]))
register("AG14", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus), 6) AS share FROM lineitem GROUP BY 1, 2")(lambda s, d: tb.share_within(table(s, d, "lineitem"), ["l_linestatus"], "l_returnflag"))
register("AG15", "SELECT 'lang' AS \"column\", count(*) FILTER (lang IS NULL OR lang = '') AS missing FROM documents UNION ALL SELECT 'text', count(*) FILTER (text IS NULL OR text = '') FROM documents")(lambda s, d: tb.missing_profile(table(s, d, "documents"), ["lang", "text"]))
register("AG16", "SELECT min(o_totalprice) AS min, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, round(avg(o_totalprice), 6) AS mean, quantile_cont(o_totalprice, 0.75) AS q3, max(o_totalprice) AS max, count(*) FILTER (o_totalprice IS NULL) AS n_missing FROM orders")(lambda s, d: tb.summary(table(s, d, "orders"), "o_totalprice"))
_M = "tp AS (SELECT count(*) FILTER (label = 'Presence' AND guess = 'Presence') AS tp, count(*) FILTER (label = 'Absence' AND guess = 'Presence') AS fp, count(*) FILTER (label = 'Presence' AND guess = 'Absence') AS fn, count(*) FILTER (label = 'Absence' AND guess = 'Absence') AS tn FROM classes), m AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS acc, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn)) AS ch FROM tp)"
register("AG17", f"WITH {CLASSES}, {_M} SELECT tp, fp, fn, tn, round(acc, 6) AS accuracy, round((acc - ch) / (1 - ch), 6) AS kappa, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(tp / (tp + fp), 6) AS precision, round(2 * tp / (2 * tp + fn + fp), 6) AS f1, round(5 * tp / (5 * tp + 4 * fn + fp), 6) AS f2 FROM m")(lambda s, d: md.metrics(classes(s, d), "label", "guess", "Presence", "Absence"))
register("AG18", f"WITH {CLASSES}, {_M} SELECT round(acc, 6) AS accuracy, round((acc - ch) / (1 - ch), 6) AS kappa FROM m")(lambda s, d: md.metrics(classes(s, d), "label", "guess", "Presence", "Absence").select("accuracy", "kappa"))
register("AG19", f"WITH {CLASSES} SELECT guess, count(*) AS n, round(avg((label = guess)::INT), 6) AS precision, round(1 - avg((label = guess)::INT), 6) AS false_rate FROM classes GROUP BY 1")(lambda s, d: classes(s, d).groupBy("guess").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("guess")).cast("int")), 6).alias("precision"), F.round(1 - F.avg((F.col("label") == F.col("guess")).cast("int")), 6).alias("false_rate")))
register("AG21", f"WITH {CLASSES} SELECT printf('%.1f', (ceil(round(conf / 0.1, 9)) - 1) * 0.1) || '-' || printf('%.1f', ceil(round(conf / 0.1, 9)) * 0.1) AS bin, count(*) AS n FROM classes WHERE conf > 0 GROUP BY 1")(lambda s, d: classes(s, d).withColumn("bin", md.right_closed(F.col("conf"), 0.1)).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n")))
register("AG22", f"WITH {DOCS}, t AS (SELECT CASE WHEN year > 1980 AND year <= 2030 THEN CAST(1980 + 5 * (ceil((year - 1980) / 5.0) - 1) AS BIGINT) END AS a FROM docs) SELECT CASE WHEN a IS NOT NULL THEN a || '-' || (a + 4) END AS period, count(*) AS n FROM t GROUP BY 1")(lambda s, d: docs(s, d).groupBy(md.period_right_closed(F.col("year")).alias("period")).agg(F.count("*").alias("n")))
register("AG25", "SELECT p_brand, count(DISTINCT p_name) AS n_names FROM part GROUP BY 1")(lambda s, d: table(s, d, "part").groupBy("p_brand").agg(F.countDistinct("p_name").alias("n_names")))
register("AG26", f"WITH {CLASSES} SELECT t AS threshold, count(*) FILTER (conf >= t) AS yes, count(*) FILTER (conf <= 1 - t AND conf < t) AS no FROM classes CROSS JOIN (SELECT unnest([0.5::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE]) AS t) GROUP BY 1")(lambda s, d: classes(s, d).withColumn("threshold", F.explode(F.array(F.lit(0.5), F.lit(0.6), F.lit(0.8)))).groupBy("threshold").agg(F.sum((F.col("conf") >= F.col("threshold")).cast("long")).alias("yes"), F.sum(((F.col("conf") <= 1 - F.col("threshold")) & (F.col("conf") < F.col("threshold"))).cast("long")).alias("no")))
register("AG27", "SELECT count(*) AS n, round(avg(length(p_name)), 6) AS mean_length FROM part WHERE p_name <> ''")(lambda s, d: table(s, d, "part").where("p_name <> ''").agg(F.count("*").alias("n"), F.round(F.avg(F.length("p_name")), 6).alias("mean_length")))
register("AG28", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY 1")(lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("n_parts"), F.countDistinct("l_orderkey").alias("n_orders")))

# --- windows ----------------------------------------------------------------------------------
register("WN1", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("rn")))
_PY = f"WITH {DOCS}, y AS (SELECT lang, year, count(*) AS n FROM docs GROUP BY 1, 2)"
register("WN2", f"{_PY} SELECT lang, year, n, round((n - lag(n) OVER w) / lag(n) OVER w * 100, 4) AS growth FROM y WINDOW w AS (PARTITION BY lang ORDER BY year)")(lambda s, d: tb.growth(tb.counted(docs(s, d), "lang", "year"), "n", "year", ["lang"]).drop("cumulative"))
register("WN3", f"{_PY} SELECT lang, year, CAST(sum(n) OVER (PARTITION BY lang ORDER BY year) AS BIGINT) AS cumulative FROM y")(lambda s, d: tb.growth(tb.counted(docs(s, d), "lang", "year"), "n", "year", ["lang"]).select("lang", "year", "cumulative"))
register("WN4", "SELECT p_brand, n FROM (SELECT p_brand, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS rk FROM part GROUP BY 1) WHERE rk <= 3")(lambda s, d: tb.top_with_ties(tb.counted(table(s, d, "part"), "p_brand"), "n", 3))
register("WN5", "SELECT p_brand, p_partkey FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS rk FROM part) WHERE rk <= 2")(lambda s, d: tb.top_with_ties(table(s, d, "part"), "p_retailprice", 2, ["p_brand"]).select("p_brand", "p_partkey"))
register("WN6", "SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY 1")(lambda s, d: tb.first_by(table(s, d, "customer"), ["c_nationkey"], ["c_custkey"]).select("c_nationkey", "c_custkey"))
register("WN7", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n_group FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.count("*").over(Window.partitionBy("o_custkey")).alias("n_group")))
register("WN8", f"{_PY}, r AS (SELECT lang, n, row_number() OVER (PARTITION BY lang ORDER BY year) AS a, row_number() OVER (PARTITION BY lang ORDER BY year DESC) AS b FROM y) SELECT lang, round(avg(n) FILTER (b <= 2) / avg(n) FILTER (a <= 2), 6) AS factor FROM r GROUP BY 1")(lambda s, d: tb.counted(docs(s, d), "lang", "year").select("lang", "n", F.row_number().over(Window.partitionBy("lang").orderBy("year")).alias("a"), F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("year"))).alias("b")).groupBy("lang").agg(F.round(F.avg(F.when(F.col("b") <= 2, F.col("n"))) / F.avg(F.when(F.col("a") <= 2, F.col("n"))), 6).alias("factor")))
register("WN9", f"{_PY} SELECT lang, year, n FROM (SELECT *, max(year) OVER (PARTITION BY lang) AS m FROM y) WHERE year = m")(lambda s, d: tb.counted(docs(s, d), "lang", "year").withColumn("m", F.max("year").over(Window.partitionBy("lang"))).where("year = m").drop("m"))
register("WN10", "WITH t AS (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS w FROM part) SELECT p_partkey, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM t")(lambda s, d: table(s, d, "part").select("p_partkey", F.explode(tx.ngrams(F.split(F.concat_ws(" ", "p_name", "p_type"), " "), 2)).alias("bigram")))
register("WN11", "WITH t AS (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ') AS w FROM part) SELECT p_partkey, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM t")(lambda s, d: table(s, d, "part").select("p_partkey", F.explode(tx.ngrams(F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " "), 3)).alias("g")))

# --- order and sets ---------------------------------------------------------------------------
register("SR1", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey")(lambda s, d: table(s, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey"))
register("SR2", f"SELECT o_orderkey, {_RANK} AS rk FROM orders ORDER BY rk, o_orderkey")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.expr(_RANK).alias("rk")).orderBy("rk", "o_orderkey"))
register("SR4", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")(lambda s, d: table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey"))
register("SR5", "SELECT c_custkey FROM customer ORDER BY abs(c_acctbal - 5000) DESC, c_custkey LIMIT 20")(lambda s, d: table(s, d, "customer").orderBy(F.abs(F.col("c_acctbal") - 5000).desc(), "c_custkey").limit(20).select("c_custkey"))
register("SR7", "SELECT n_name, length(n_name) AS n FROM nation ORDER BY n DESC, n_name")(lambda s, d: table(s, d, "nation").select("n_name", F.length("n_name").cast("long").alias("n")).orderBy(F.desc("n"), "n_name"))
register("SR8", "SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY avg(c_acctbal) DESC, 1 LIMIT 1")(lambda s, d: table(s, d, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("m")).orderBy(F.desc("m"), "c_mktsegment").limit(1).select("c_mktsegment"))
register("SR9", "WITH t AS (SELECT c_mktsegment AS model, avg(c_acctbal) / 10000 AS a, count(*) / 10000 AS b, max(c_acctbal) / 10000 AS c FROM customer GROUP BY 1), s AS (SELECT model, 'balanced' AS scheme, .4 * a + .3 * b + .3 * c AS score FROM t UNION ALL SELECT model, 'conservative', .3 * a + .2 * b + .5 * c FROM t UNION ALL SELECT model, 'aggressive', .3 * a + .5 * b + .2 * c FROM t) SELECT scheme, arg_max(model, score) AS model FROM s GROUP BY 1")(lambda s, d: table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("model")).agg((F.avg("c_acctbal") / 10000).alias("a"), (F.count("*") / 10000).alias("b"), (F.max("c_acctbal") / 10000).alias("c")).selectExpr("model", "stack(3, 'balanced', .4 * a + .3 * b + .3 * c, 'conservative', .3 * a + .2 * b + .5 * c, 'aggressive', .3 * a + .5 * b + .2 * c) as (scheme, score)").groupBy("scheme").agg(F.max_by("model", "score").alias("model")))
register("ST1", "SELECT r_regionkey AS k, r_name AS name, NULL::INTEGER AS n_regionkey FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")(lambda s, d: tb.bind_rows(table(s, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), "n_regionkey")))
_SETS = "SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS a, ['A', 'R'] AS b FROM lineitem GROUP BY 1"
_sets = lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("a")).withColumn("b", F.array(F.lit("A"), F.lit("R")))
register("ST2", f"SELECT l_orderkey, array_to_string(list_sort(list_distinct(a || b)), ',') AS x FROM ({_SETS})")(lambda s, d: _sets(s, d).select("l_orderkey", F.array_join(F.sort_array(F.array_distinct(F.concat("a", "b"))), ",").alias("x")))
register("ST3", f"SELECT l_orderkey, array_to_string(list_sort(list_intersect(a, b)), ',') AS x FROM ({_SETS})")(lambda s, d: _sets(s, d).select("l_orderkey", F.array_join(F.sort_array(F.array_intersect("a", "b")), ",").alias("x")))
register("ST4", f"SELECT l_orderkey, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS x FROM ({_SETS})")(lambda s, d: _sets(s, d).select("l_orderkey", F.array_join(F.array_except("a", "b"), ",").alias("x")))
register("ST5", f"SELECT l_orderkey, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS inside FROM ({_SETS})")(lambda s, d: _sets(s, d).select("l_orderkey", (F.size(F.array_except("a", "b")) == 0).alias("inside")))

# --- reshape ----------------------------------------------------------------------------------
register("RS1", "SELECT s_suppkey, 'nation' AS name, CAST(s_nationkey AS DOUBLE) AS value FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier")(lambda s, d: tb.longer(table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance")), ["s_suppkey"], ["nation", "balance"]))
register("RS2", "SELECT lang, coalesce(max(n) FILTER (source = 'src0'), 0) AS src0, coalesce(max(n) FILTER (source = 'src1'), 0) AS src1 FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")(lambda s, d: tb.wider(tb.counted(table(s, d, "documents"), "lang", "source"), ["lang"], "source", "n", ["src0", "src1"]))
register("RS3", "SELECT p_partkey, trim(w) AS words FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE trim(w) <> ''")(lambda s, d: tb.separated(table(s, d, "part").select("p_partkey", F.col("p_name").alias("words")), "words", " "))
register("RS4", "SELECT l_orderkey, unnest(list_sort(list_distinct(list(l_suppkey)))) AS supp FROM lineitem GROUP BY 1")(lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("x")).select("l_orderkey", F.explode("x").alias("supp")))
register("RS5", f"WITH {DOCS}, y AS (SELECT year, count(*) AS n FROM docs WHERE year % 4 <> 1 GROUP BY 1), g AS (SELECT unnest(range((SELECT min(year) FROM y), (SELECT max(year) FROM y) + 1)) AS year) SELECT g.year, coalesce(n, 0) AS n FROM g LEFT JOIN y ON g.year = y.year")(lambda s, d: tb.completed(tb.counted(docs(s, d).where("year % 4 <> 1"), "year"), "year", ["n"]))
register("RS6", "WITH y AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders WHERE o_totalprice > 250000 GROUP BY 1, 2), g AS (SELECT * FROM (SELECT DISTINCT a FROM y) CROSS JOIN (SELECT DISTINCT b FROM y)) SELECT g.a, g.b, coalesce(n, 0) AS n FROM g LEFT JOIN y ON g.a = y.a AND g.b = y.b")(lambda s, d: tb.completed_pairs(tb.counted(table(s, d, "orders").where("o_totalprice > 250000").select(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b")), "a", "b"), "a", "b", ["n"]))

# --- samples ----------------------------------------------------------------------------------
_DRAW = "CAST('0x' || substr(md5(CAST({k} AS VARCHAR) || ':{seed}'), 1, 13) AS BIGINT)"
register("SM1", f"SELECT o_orderkey FROM orders ORDER BY {_DRAW.format(k='o_orderkey', seed=123)}, o_orderkey LIMIT 100")(lambda s, d: tb.sample_n(table(s, d, "orders"), 100, "o_orderkey", 123).select("o_orderkey"))
_QUOTA = "CASE WHEN lang = 'en' THEN 25 WHEN lang = 'fr' THEN 15 ELSE 5 END"
register("SM2", f"SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW.format(k='doc_id', seed=7)}, doc_id) AS rn FROM documents) WHERE rn <= {_QUOTA}")(lambda s, d: tb.sample_strata(table(s, d, "documents"), "lang", F.expr(_QUOTA), "doc_id", 7).select("doc_id", "lang"))
register("SM5", "SELECT doc_id FROM documents WHERE lang = 'es'")(lambda s, d: tb.sample_strata(table(s, d, "documents").where("lang = 'es'"), "lang", F.lit(2**31 - 1), "doc_id", 7).select("doc_id"))
register("SM6", f"WITH t AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_DRAW.format(k='doc_id', seed=42)}, doc_id) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels) SELECT doc_id, quality, rn <= ceil(n * 0.8::DOUBLE) AS is_train FROM t")(lambda s, d: tb.split(table(s, d, "labels").select("doc_id", "quality"), "quality", 0.8, "doc_id", 42))
register("SM7", f"WITH {CLASSES} SELECT label || '_' || guess || '_' || CASE WHEN conf >= 0.8 THEN 'high' ELSE 'low' END AS stratum, count(*) AS n FROM classes GROUP BY 1")(lambda s, d: classes(s, d).groupBy(F.concat_ws("_", "label", "guess", F.when(F.col("conf") >= 0.8, "high").otherwise("low")).alias("stratum")).agg(F.count("*").alias("n")))
register("SM8", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")(lambda s, d: tb.first_by(table(s, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey"))
register("SM9", f"SELECT f AS fraction, count(*) AS n FROM (SELECT {_DRAW.format(k='doc_id', seed=5)} AS u FROM labels) CROSS JOIN (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS f) WHERE u < f * 4503599627370496 GROUP BY 1")(lambda s, d: table(s, d, "labels").select(tb.draw("doc_id", 5).alias("u")).withColumn("fraction", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).where("u < fraction * 4503599627370496").groupBy("fraction").agg(F.count("*").alias("n")))
