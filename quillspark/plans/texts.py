"""Queries of the text, time, number, model, extraction and analysis operators, and of sources."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import analysis as an
from quillspark.operators import extraction as ex
from quillspark.operators import models as md
from quillspark.operators import tables as tb
from quillspark.sources import files as fl

from .registry import CLASSES, DOCS, classes, docs, register, table, texts

_WORDS = "regexp_extract_all(lower({c}), '([\\p{{L}}\\p{{N}}]+(?:''[\\p{{L}}\\p{{N}}]+)*)', 1)"
_PRE = "lower(regexp_replace({c}, '[!-@\\[-`{{-~]', ' ', 'g'))"
_TOK = "list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')"
_BI = "list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"

# --- text -------------------------------------------------------------------------------------
register("STR1", f"WITH {DOCS} SELECT id, trim(regexp_replace(regexp_replace(lower(abstract), '\\s+', ' ', 'g'), '[!-/:-@\\[-`{{-~]', '', 'g')) AS norm FROM docs")(lambda s, d: docs(s, d).select("id", tx.normalize_text(F.col("abstract")).alias("norm")))
register("STR2", f"WITH {DOCS} SELECT id, {_PRE.format(c='abstract')} AS pre FROM docs")(lambda s, d: docs(s, d).select("id", tx.preprocessed(F.col("abstract")).alias("pre")))
register("STR3", f"WITH {DOCS} SELECT id, len({_TOK.format(c='abstract')}) AS n FROM docs")(lambda s, d: docs(s, d).select("id", F.size(tx.tokens(F.col("abstract"))).cast("long").alias("n")))
register("STR4", f"WITH {DOCS}, w AS (SELECT id, unnest({_WORDS.format(c='abstract')}) AS word FROM docs) SELECT id, word, count(*) AS n FROM w GROUP BY 1, 2")(lambda s, d: docs(s, d).select("id", F.explode(tx.words(F.col("abstract"))).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n")))
register("STR5", f"WITH {DOCS}, w AS (SELECT id, {_WORDS.format(c='abstract')} AS t FROM docs), b AS (SELECT unnest({_BI.format(t='t')}) AS bigram FROM w) SELECT bigram, count(*) AS n FROM b GROUP BY 1")(lambda s, d: docs(s, d).select(F.explode(tx.ngrams(tx.words(F.col("abstract")), 2)).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n")))
#: Letters beyond ASCII are masked where word bounds matter: engines differ in what bounds they make.
_ASCII = DOCS.replace("text AS abstract", "regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS abstract")
_ascii = lambda s, d: docs(s, d).withColumn("abstract", F.regexp_replace("abstract", r"[^\x00-\x7F]", "_"))
_CAND = f"WITH {_ASCII}, t AS (SELECT id, abstract, {_TOK.format(c=_PRE.format(c='abstract'))} AS t FROM docs), c AS (SELECT id, list_distinct(list_transform(regexp_extract_all(abstract, '\\b([A-Z][a-z]+\\s+[a-z]+)\\b', 1) || regexp_extract_all(abstract, '\\b([A-Z]\\.\\s+[a-z]+)\\b', 1) || CASE WHEN len(t) BETWEEN 2 AND 50 THEN list_filter({_BI.format(t='t')}, lambda x: length(x) > 5 AND length(x) < 40) ELSE [] END, lambda x: lower(regexp_replace(x, '\\s+', ' ', 'g')))) AS c FROM t)"
register("STR6", _CAND + " SELECT id, len(c) AS n, array_to_string(list_sort(c), '|') AS names FROM c")(lambda s, d: _ascii(s, d).select("id", tx.candidate_names(F.col("abstract")).alias("c")).select("id", F.size("c").cast("long").alias("n"), F.array_join(F.sort_array("c"), "|").alias("names")))
register("STR8", "SELECT p_partkey, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS name FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", tx.correct_capitalization(F.col("p_name")).alias("name")))
_KEYS = ["ring", "the an", "PCR", "schein", "aux"]
register("STR9", f"WITH {DOCS} SELECT id, regexp_matches(lower(abstract), '{'|'.join(_KEYS)}') AS hit FROM docs")(lambda s, d: docs(s, d).select("id", tx.has_any(F.col("abstract"), _KEYS).alias("hit")))
_CATS = {"molecular": ["the", "heit"], "culture": ["ment", "schein"], "ecology": ["que", "ing"]}
_FLAG = ", ".join(f"regexp_matches(lower(abstract), '{'|'.join(v)}') AS {k}_methods" for k, v in _CATS.items())
register("STR10", f"WITH {DOCS} SELECT id, {_FLAG}, array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches(lower(abstract), {chr(39)}{chr(124).join(v)}{chr(39)}) THEN {chr(39)}{k}{chr(39)} END' for k, v in _CATS.items())}], lambda x: x IS NOT NULL), '; ') AS methods_summary FROM docs")(lambda s, d: ex.methods(docs(s, d), "abstract", _CATS).select("id", *[f"{k}_methods" for k in _CATS], "methods_summary"))
_SIMPLE = ["the", "and", "la", "le", "der"]
register("STR11", f"WITH {_ASCII} SELECT id, array_to_string(regexp_extract_all(lower(abstract), '\\b(the|and|la|le|der)\\b', 1), ' ') AS found FROM docs")(lambda s, d: _ascii(s, d).select("id", F.array_join(tx.extract_words(F.col("abstract"), _SIMPLE), " ").alias("found")))
register("STR12", f"WITH {DOCS} SELECT id, array_to_string(list_filter(['root hair', 'of the', 'th'], lambda x: contains(lower(abstract), x)), '; ') AS found FROM docs")(lambda s, d: docs(s, d).select("id", F.array_join(tx.contained(F.col("abstract"), ["root hair", "of the", "th"]), "; ").alias("found")))
register("STR13", "WITH w AS (SELECT p_partkey, split_part(p_name, ' ', 2) || 's' AS w FROM part) SELECT p_partkey, CASE w WHEN 'boxs' THEN 'case' ELSE CASE WHEN w LIKE '%ies' THEN regexp_replace(w, 'ies$', 'y') WHEN w LIKE '%ves' THEN regexp_replace(w, 'ves$', 'f') WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN regexp_replace(w, 's$', '') ELSE w END END AS one FROM w")(lambda s, d: table(s, d, "part").select("p_partkey", ex.singular(F.concat(F.split("p_name", " ")[1], F.lit("s")), {"boxs": "case"}).alias("one")))
register("STR14", "SELECT n_nationkey, CASE lower(trim(n_name)) WHEN 'nation_1' THEN 'Nation One' WHEN 'nation_2' THEN 'Nation Two' ELSE upper(substr(trim(n_name), 1, 1)) || lower(substr(trim(n_name), 2)) END AS country FROM nation")(lambda s, d: table(s, d, "nation").select("n_nationkey", ex.standard_country(F.col("n_name"), ["Nation Two"], {"NATION_1": "Nation One", "NATION_2": "Nation Two"}).alias("country")))
register("STR20", f"WITH {DOCS} SELECT id, array_to_string(list_distinct(regexp_extract_all(lower(abstract), '\\b(the)\\b', 1)), '; ') AS found FROM docs")(lambda s, d: docs(s, d).select("id", F.array_join(F.array_distinct(tx.extract_words(F.col("abstract"), ["the"])), "; ").alias("found")))
_WEIGHTED = {"strong": (4, ["of the", "and the"]), "weak": (1, ["the", "in * of"])}
register("STR23", f"WITH {_ASCII} SELECT id, CAST(regexp_matches(lower(abstract), '\\bof\\s+the\\b')::INT * 4 + regexp_matches(lower(abstract), '\\band\\s+the\\b')::INT * 4 + regexp_matches(lower(abstract), '\\bthe\\b')::INT + regexp_matches(lower(abstract), '\\bin\\s+.*?\\s+of\\b')::INT AS BIGINT) AS score FROM docs")(lambda s, d: _ascii(s, d).select("id", tx.phrase_score(F.col("abstract"), _WEIGHTED).cast("long").alias("score")))
register("STR26", f"WITH {DOCS} SELECT id, regexp_matches(lower(abstract), '\\bof\\s+the\\b') AS hit FROM docs")(lambda s, d: docs(s, d).select("id", F.lower("abstract").rlike(tx.phrase_pattern("Of The")).alias("hit")))
register("STR30", "SELECT p_partkey, p_name LIKE 's%' AS s, p_name LIKE '%ring' AS e, contains(p_name, 'a') AS c, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, replace(p_name, ' ', '') AS squished FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", F.startswith("p_name", F.lit("s")).alias("s"), F.endswith("p_name", F.lit("ring")).alias("e"), F.contains("p_name", F.lit("a")).alias("c"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.replace("p_name", F.lit(" "), F.lit("")).alias("squished")))
register("STR31", "SELECT o_orderkey, CAST(o_orderkey * 12345 AS BIGINT) AS n FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", tx.leading_count(F.concat(F.format_number(F.col("o_orderkey") * 12345, 0), F.lit(" species"))).alias("n")))
register("STR32", "SELECT c_custkey, regexp_replace(regexp_extract(c_name, '^([^, ]+)', 1), '[^A-Za-z0-9]', '', 'g') || '_' || (2000 + c_custkey % 20) || '.pdf' AS file FROM customer")(lambda s, d: table(s, d, "customer").select("c_custkey", tx.safe_file_name(F.col("c_name"), 2000 + F.col("c_custkey") % 20).alias("file")))
register("STR33", "SELECT o_orderkey, CASE WHEN regexp_matches(lower(o_orderpriority), '^[12]') THEN 'Presence' WHEN regexp_matches(lower(o_orderpriority), '^5') THEN 'Absence' ELSE 'Other' END AS label FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", tx.labelled_by(F.col("o_orderpriority"), {"^[12]": "Presence", "^5": "Absence"}, "Other").alias("label")))
register("STR35", "SELECT c_custkey, printf('%.1f%%', c_acctbal / 100) AS share FROM customer")(lambda s, d: table(s, d, "customer").select("c_custkey", F.concat(tx.fixed(F.col("c_acctbal") / 100, 1), F.lit("%")).alias("share")))
register("STR39", "SELECT p_brand, p_brand || ' (n = ' || count(*) || ')' AS label FROM part GROUP BY 1")(lambda s, d: table(s, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).select("p_brand", tx.with_count(F.col("p_brand"), F.col("n")).alias("label")))
register("MTH6", "SELECT p_partkey, levenshtein(p_name, p_type) AS distance, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) AS similarity FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"), F.round(tx.similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity")))

# --- time and numbers -------------------------------------------------------------------------
register("TIM1", f"WITH {DOCS} SELECT id, year // 10 * 10 AS decade, year // 5 * 5 AS five FROM docs")(lambda s, d: docs(s, d).select("id", md.period(F.col("year"), 10).alias("decade"), md.period(F.col("year")).alias("five")))
register("TIM2", f"WITH {DOCS} SELECT year // 5 * 5 || '-' || (year // 5 * 5 + 4) AS label, count(*) AS n FROM docs GROUP BY 1")(lambda s, d: docs(s, d).groupBy(md.period_label(F.col("year")).alias("label")).agg(F.count("*").alias("n")))
register("TIM3", f"WITH {DOCS} SELECT id, CASE WHEN year > 1980 THEN CAST(1980 + 5 * (ceil((year - 1980) / 5.0) - 1) AS BIGINT) || '-' || CAST(1984 + 5 * (ceil((year - 1980) / 5.0) - 1) AS BIGINT) END AS period FROM docs")(lambda s, d: docs(s, d).select("id", md.period_right_closed(F.col("year")).alias("period")))
register("TIM4", "SELECT o_orderkey, substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS year FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.substring(F.col("o_orderdate").cast("string"), 1, 4).alias("year")))
register("TIM5", f"WITH {DOCS} SELECT source, max(year) - min(year) + 1 AS span FROM docs GROUP BY 1")(lambda s, d: docs(s, d).groupBy("source").agg((F.max("year") - F.min("year") + 1).alias("span")))
register("MTH1", "SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(15, 2)) * CAST(l_discount AS DECIMAL(15, 2)), 2) AS DOUBLE) AS x FROM lineitem")(lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("cast(round(cast(l_extendedprice as decimal(15, 2)) * cast(l_discount as decimal(15, 2)), 2) as double)").alias("x")))
register("MTH2", "SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS lo, CAST(ceil(c_acctbal) AS BIGINT) AS hi, round(sqrt(abs(c_acctbal)), 6) AS root, round(log10(abs(c_acctbal) + 1), 6) AS lg FROM customer")(lambda s, d: table(s, d, "customer").select("c_custkey", F.floor("c_acctbal").alias("lo"), F.ceil("c_acctbal").alias("hi"), F.round(F.sqrt(F.abs("c_acctbal")), 6).alias("root"), F.round(F.log10(F.abs("c_acctbal") + 1), 6).alias("lg")))
register("MTH3", f"WITH {CLASSES} SELECT id, greatest(conf, conf2) AS hi, least(conf, conf2) AS lo FROM classes")(lambda s, d: classes(s, d).select("id", F.greatest("conf", "conf2").alias("hi"), F.least("conf", "conf2").alias("lo")))
register("MTH4", "SELECT d.doc_id, coalesce(quality, 0) AS quality FROM documents d LEFT JOIN labels USING (doc_id)")(lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality")))
_PA = "round(0.6::DOUBLE * conf + 0.4::DOUBLE * conf2, 6) AS presence, round(0.8::DOUBLE * (1 - conf2) + 0.2::DOUBLE * (1 - conf), 6) AS absence"
register("MTH5", f"WITH {CLASSES} SELECT id, {_PA} FROM classes")(lambda s, d: classes(s, d).select("id", md.ensemble_weighted(F.col("conf"), 1 - F.col("conf"), F.col("conf2"), 1 - F.col("conf2")).alias("e")).select("id", "e.presence", "e.absence"))
register("MTH9", "SELECT c_mktsegment, round(sqrt(count(*) / max(count(*)) OVER ()), 6) AS scale FROM customer GROUP BY 1")(lambda s, d: (lambda t: t.crossJoin(F.broadcast(t.agg(F.max("n").alias("m")))).select("c_mktsegment", F.round(F.sqrt(F.col("n") / F.col("m")), 6).alias("scale")))(tb.counted(table(s, d, "customer"), "c_mktsegment")))
register("ARR2", "SELECT p_partkey, string_split(p_name, ' ')[1] AS head, array_to_string(string_split(p_name || ' ' || p_type, ' ')[2:3], ' ') AS tail FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", F.element_at(F.split("p_name", " "), 1).alias("head"), F.array_join(F.slice(F.split(F.concat_ws(" ", "p_name", "p_type"), " "), 2, 2), " ").alias("tail")))
register("MAP1", "SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 END AS code FROM customer")(lambda s, d: table(s, d, "customer").select("c_custkey", tx.looked_up(F.col("c_mktsegment"), {"AUTOMOBILE": 1, "BUILDING": 2}).alias("code")))

# --- models -----------------------------------------------------------------------------------
_STOP = ["the", "of", "and", "de", "la"]
_TC = f"{DOCS}, w AS (SELECT id, unnest({_WORDS.format(c='abstract')}) AS word FROM docs), tc AS (SELECT id, word, count(*) AS n FROM w WHERE NOT regexp_matches(word, '\\d') AND word NOT IN ('the', 'of', 'and', 'de', 'la') GROUP BY 1, 2)"
_terms = lambda s, d: ex.term_counts(texts(s, d), "id", "abstract", _STOP)
register("ML1", f"WITH {_TC}, v AS (SELECT word FROM tc GROUP BY 1 HAVING sum(n) >= 2 ORDER BY sum(n) DESC, word LIMIT 500) SELECT id, word, n FROM tc WHERE word IN (SELECT word FROM v)")(lambda s, d: (lambda t: t.join(F.broadcast(ex.vocabulary(t, "word", "n", 2, 500).select("word")), "word", "left_semi"))(_terms(s, d)))
register("FLT9", f"WITH {DOCS}, w AS (SELECT id, {_WORDS.format(c='abstract')} AS t FROM docs), b AS (SELECT unnest(list_filter({_BI.format(t='t')}, lambda x: split_part(x, ' ', 1) NOT IN ('the', 'of', 'and', 'de', 'la') AND split_part(x, ' ', 2) NOT IN ('the', 'of', 'and', 'de', 'la'))) AS bigram FROM w) SELECT replace(bigram, ' ', '_') AS bigram, count(*) AS n FROM b GROUP BY 1 HAVING count(*) >= 2")(lambda s, d: docs(s, d).select(F.explode(tx.ngrams(tx.words(F.col("abstract")), 2)).alias("b")).where(~F.split("b", " ")[0].isin(*_STOP) & ~F.split("b", " ")[1].isin(*_STOP)).groupBy(F.replace("b", F.lit(" "), F.lit("_")).alias("bigram")).agg(F.count("*").alias("n")).where("n >= 2"))
register("SR6", f"WITH {_TC} SELECT word, CAST(sum(n) AS BIGINT) AS total FROM tc GROUP BY 1 HAVING sum(n) >= 5 ORDER BY total DESC, word LIMIT 100")(lambda s, d: ex.vocabulary(_terms(s, d), "word", "n", 5, 100))
register("MTH8", f"WITH {_TC}, a AS (SELECT id, sum(n) AS total FROM tc GROUP BY 1), f AS (SELECT word, count(*) AS df FROM tc GROUP BY 1), nd AS (SELECT count(DISTINCT id) AS docs FROM tc) SELECT id, word, round(n / total, 6) AS tf, round(ln(docs / df), 6) AS idf FROM tc JOIN a USING (id) JOIN f USING (word) CROSS JOIN nd")(lambda s, d: ex.text_tf_idf(texts(s, d), "id", "abstract", _STOP).select("id", "word", F.round("tf", 6).alias("tf"), F.round("idf", 6).alias("idf")))
register("ML3", f"WITH {_TC}, v AS (SELECT unnest(['est', 'that', 'zzz']) AS word), g AS (SELECT id, word FROM docs CROSS JOIN v) SELECT g.id, g.word, coalesce(n, 0) AS n FROM g LEFT JOIN tc ON g.id = tc.id AND g.word = tc.word")(lambda s, d: docs(s, d).select("id", F.explode(F.array(*map(F.lit, ["est", "that", "zzz"]))).alias("word")).join(_terms(s, d), ["id", "word"], "left").fillna(0, ["n"]))
register("RS7", f"WITH {_TC} SELECT id, coalesce(max(n) FILTER (word = 'est'), 0) AS est, coalesce(max(n) FILTER (word = 'that'), 0) AS that FROM tc GROUP BY 1")(lambda s, d: tb.wider(_terms(s, d), ["id"], "word", "n", ["est", "that"]))
register("RS8", f"WITH {_TC}, p AS (SELECT id, sum(n) AS n FROM tc WHERE word = 'that' GROUP BY 1) SELECT docs.id, CAST(coalesce(n, 0) AS BIGINT) AS n FROM docs LEFT JOIN p ON docs.id = p.id")(lambda s, d: docs(s, d).select("id").join(_terms(s, d).where("word = 'that'").groupBy("id").agg(F.sum("n").alias("n")), "id", "left").fillna(0, ["n"]))
register("ML4", f"WITH {CLASSES} SELECT id, CASE WHEN label IN ('Presence', 'Both') THEN 'Presence' WHEN label = 'Absence' THEN 'Absence' END AS target FROM classes")(lambda s, d: classes(s, d).select("id", F.when(F.col("label").isin("Presence", "Both"), "Presence").when(F.col("label") == "Absence", "Absence").alias("target")))
register("ML6", "SELECT doc_id, toxic, r AS copy FROM labels CROSS JOIN (SELECT unnest([1, 2, 3]) AS r) WHERE toxic = 1 OR r = 1")(lambda s, d: table(s, d, "labels").withColumn("copy", F.explode(F.when(F.col("toxic") == 1, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1))))).select("doc_id", "toxic", "copy"))
register("ML7", "SELECT doc_id, round((SELECT count(*) FROM labels) / (2 * count(*) OVER (PARTITION BY toxic)), 6) AS weight FROM labels")(lambda s, d: (lambda l: l.join(F.broadcast(l.groupBy("toxic").agg(F.count("*").alias("n"))), "toxic").crossJoin(F.broadcast(l.agg(F.count("*").alias("m")))).select("doc_id", F.round(F.col("m") / (2 * F.col("n")), 6).alias("weight")))(table(s, d, "labels")))
_weighted = lambda s, d: classes(s, d).select("id", md.ensemble_weighted(F.col("conf"), 1 - F.col("conf"), F.col("conf2"), 1 - F.col("conf2")).alias("e"), "conf", "conf2")
register("ML12", f"WITH {CLASSES}, e AS (SELECT id, round(0.6::DOUBLE * conf + 0.4::DOUBLE * conf2, 9) AS p, round(0.8::DOUBLE * (1 - conf2) + 0.2::DOUBLE * (1 - conf), 9) AS a FROM classes) SELECT id, CASE WHEN p > a THEN 'Presence' ELSE 'Absence' END AS label FROM e")(lambda s, d: _weighted(s, d).select("id", "e.label"))
register("ML13", f"WITH {CLASSES} SELECT id, CASE WHEN round(0.8::DOUBLE * (1 - conf2) + 0.2::DOUBLE * (1 - conf), 6) > 0.55 THEN 'Absence' ELSE 'Presence' END AS label FROM classes")(lambda s, d: _weighted(s, d).select("id", md.ensemble_threshold(F.col("e.absence")).alias("label")))
register("ML14", f"WITH {CLASSES} SELECT id, t AS threshold, CASE WHEN conf2 > t THEN 'Absence' ELSE label END AS label FROM classes CROSS JOIN (SELECT unnest([0.5::DOUBLE, 0.6::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE]) AS t)")(lambda s, d: classes(s, d).withColumn("threshold", F.explode(F.array(*map(F.lit, (0.5, 0.6, 0.7, 0.8))))).select("id", "threshold", F.when(F.col("conf2") > F.col("threshold"), "Absence").otherwise(F.col("label")).alias("label")))
_LEVELS = {"relevance": ("conf", "Relevant", "Irrelevant", {"loose": "0.5", "medium": "0.6", "strict": "0.8"}), "pa": ("conf2", "Presence", "Absence", {"loose": "0.5", "medium": "0.6", "strict": "0.8", "super_strict": "0.9"})}
register("ML16", f"WITH {CLASSES} SELECT id, " + ", ".join(f"CASE WHEN CAST({c} AS DECIMAL(4, 2)) >= {t} THEN '{yes}' WHEN 1 - CAST({c} AS DECIMAL(4, 2)) >= {t} THEN '{no}' ELSE 'Uncertain' END AS {k}_{level}" for k, (c, yes, no, ts) in _LEVELS.items() for level, t in ts.items()) + " FROM classes")(lambda s, d: classes(s, d).select("id", *[md.threshold_label(F.col(c).cast("decimal(4,2)"), Decimal(t), yes, no).alias(f"{k}_{level}") for k, (c, yes, no, ts) in _LEVELS.items() for level, t in ts.items()]))
register("ML19", f"WITH {CLASSES} SELECT t AS cut, count(*) FILTER (conf >= t AND label = 'Presence') AS tp, count(*) FILTER (conf >= t AND label = 'Absence') AS fp FROM classes CROSS JOIN (SELECT unnest(range(0, 11)) / 10 AS t) GROUP BY 1")(lambda s, d: classes(s, d).withColumn("cut", F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: i / F.lit(10.0)))).groupBy("cut").agg(F.sum(((F.col("conf") >= F.col("cut")) & (F.col("label") == "Presence")).cast("long")).alias("tp"), F.sum(((F.col("conf") >= F.col("cut")) & (F.col("label") == "Absence")).cast("long")).alias("fp")))
register("ML23", "SELECT quality, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percentage, round(avg(n_chars), 4) AS mean_length FROM labels JOIN documents USING (doc_id) GROUP BY 1")(lambda s, d: (lambda j: tb.counted_with_share(j, "quality").join(j.groupBy("quality").agg(F.round(F.avg("n_chars"), 4).alias("mean_length")), "quality"))(table(s, d, "labels").join(table(s, d, "documents"), "doc_id")))
register("AN17", f"WITH {CLASSES} SELECT CASE WHEN conf IS NULL THEN 'Unknown' WHEN conf >= 0.9 THEN 'Very High' WHEN conf >= 0.8 THEN 'High' WHEN conf >= 0.7 THEN 'Medium' WHEN conf >= 0.6 THEN 'Low' ELSE 'Very Low' END AS band, count(*) AS n FROM classes GROUP BY 1")(lambda s, d: classes(s, d).groupBy(md.confidence_band(F.col("conf")).alias("band")).agg(F.count("*").alias("n")))

# --- extraction -------------------------------------------------------------------------------
#: A taxonomy from the parts: names, a fifth of them synonyms of the first.
_TAX = "one AS (SELECT min(p_partkey) AS k FROM part GROUP BY p_name), tax AS (SELECT p_partkey AS taxonID, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS canonicalName, CASE WHEN p_partkey % 5 = 4 THEN 'synonym' ELSE 'accepted' END AS taxonomicStatus, CASE WHEN p_partkey % 5 = 4 THEN 0 END AS acceptedNameUsageID, CASE WHEN p_size > 25 THEN 'Plantae' ELSE 'Fungi' END AS kingdom, p_brand AS phylum, p_type AS family, split_part(p_name, ' ', 1) AS genus FROM part JOIN one ON p_partkey = k)"


def _taxonomy(s, d):
    return tb.first_by(table(s, d, "part"), ["p_name"], ["p_partkey"]).select(F.col("p_partkey").alias("taxonID"), F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substr(p_name, 2)")).alias("canonicalName"), F.expr("if(p_partkey % 5 = 4, 'synonym', 'accepted')").alias("taxonomicStatus"), F.expr("if(p_partkey % 5 = 4, 0L, null)").alias("acceptedNameUsageID"), F.expr("if(p_size > 25, 'Plantae', 'Fungi')").alias("kingdom"), F.col("p_brand").alias("phylum"), F.col("p_type").alias("family"), F.split("p_name", " ")[0].alias("genus"))


_ACC = "acc AS (SELECT lower(canonicalName) AS name, canonicalName AS resolved_name, kingdom, phylum, family, genus FROM tax WHERE taxonomicStatus = 'accepted'), syn AS (SELECT DISTINCT ON (lower(a.canonicalName)) lower(a.canonicalName) AS name, b.canonicalName AS resolved_name, b.kingdom, b.phylum, b.family, b.genus FROM tax a JOIN tax b ON a.acceptedNameUsageID = b.taxonID AND b.taxonomicStatus = 'accepted' WHERE a.taxonomicStatus <> 'accepted' ORDER BY lower(a.canonicalName), a.taxonID)"
_VALID = "SELECT p_name, resolved_name, kingdom, phylum, family, genus, 'ACCEPTED' AS status FROM asked JOIN acc ON lower(p_name) = name UNION ALL SELECT p_name, resolved_name, kingdom, phylum, family, genus, 'SYNONYM' FROM asked JOIN syn ON lower(p_name) = name WHERE lower(p_name) NOT IN (SELECT name FROM acc)"
register("EXT1", f"WITH {_TAX}, {_ACC} SELECT name, resolved_name FROM syn")(lambda s, d: ex.lookups(_taxonomy(s, d)).synonyms.select("name", "resolved_name"))
register("EXT2", f"WITH {_TAX}, {_ACC}, asked AS (SELECT DISTINCT p_name FROM part) {_VALID}")(lambda s, d: ex.validated(table(s, d, "part").select("p_name").distinct(), "p_name", ex.lookups(_taxonomy(s, d))).select("p_name", "resolved_name", "kingdom", "phylum", "family", "genus", "status"))
_TERMS = f"d AS (SELECT p_partkey AS id, {_TOK.format(c=_PRE.format(c='p_name'))} AS t FROM part), terms AS (SELECT DISTINCT id, unnest(t || {_BI.format(t='t')}) AS p_name FROM d)"
_HITS = f"hits AS (SELECT id, 'species' AS match_type, resolved_name, kingdom, phylum, family, genus, status FROM (SELECT id, x.* FROM terms JOIN ({_VALID.replace('asked', '(SELECT DISTINCT p_name FROM terms)')}) x ON terms.p_name = x.p_name) UNION SELECT id, 'genus', genus, kingdom, phylum, family, genus, 'ACCEPTED' FROM terms JOIN (SELECT DISTINCT genus, kingdom, phylum, family FROM acc) ON p_name = lower(genus) UNION SELECT id, 'family', family, kingdom, phylum, family, NULL, 'ACCEPTED' FROM terms JOIN (SELECT DISTINCT kingdom, phylum, family FROM acc) ON p_name = lower(family))"
_FOUND = f"WITH {_TAX}, {_ACC}, {_TERMS}, {_HITS}, every AS (SELECT * FROM hits UNION ALL SELECT p_partkey, 'none', NULL, NULL, NULL, NULL, NULL, 'NO_MATCH' FROM part WHERE p_partkey NOT IN (SELECT id FROM hits))"
_taxa = lambda s, d: ex.taxa(table(s, d, "part").select(F.col("p_partkey").alias("id"), "p_name"), "id", "p_name", ex.lookups(_taxonomy(s, d)))
register("EXT3", f"{_FOUND} SELECT DISTINCT * FROM hits")(lambda s, d: _taxa(s, d).where("match_type <> 'none'"))
register("EXT4", f"{_FOUND} SELECT * FROM every")(_taxa)
register("EXT5", f"{_FOUND} SELECT match_type, count(*) AS n FROM every GROUP BY 1")(lambda s, d: tb.counted(_taxa(s, d), "match_type"))
register("EXT7", f"WITH {DOCS} SELECT id, {_FLAG} FROM docs")(lambda s, d: ex.methods(docs(s, d), "abstract", _CATS).select("id", *[f"{k}_methods" for k in _CATS]))
register("EXT10", "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'Ericoid Mycorrhizal-Saprotroph' ELSE p_type END LIKE '%Ericoid Mycorrhizal%' AS myc FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", ex.is_mycorrhizal(F.when(F.col("p_type") == "ECONOMY", "Ericoid Mycorrhizal-Saprotroph").otherwise(F.col("p_type"))).alias("myc")))
register("EXT12", "SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS with_flag, count(*) FILTER (l_returnflag <> 'R') AS without_flag, bool_and(l_returnflag = 'R') AS only FROM lineitem GROUP BY 1")(lambda s, d: ex.only_such(table(s, d, "lineitem").withColumn("f", F.col("l_returnflag") == "R"), "l_orderkey", "f"))
_ABS = {"direct": (4, ["of the", "and the"]), "weak": (1, ["that", "was"])}
_MET = {"lab": (2, ["in the", "for"]), "field": (1, ["with"])}
_rx = lambda p: f"regexp_matches(lower(abstract), '{tx.phrase_pattern(p)}')"
_sum = lambda c: " + ".join(f"{_rx(p)}::INT * {w}" for w, ps in c.values() for p in ps)
_cat = lambda c: "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(map(_rx, ps))} THEN '{k}' END" for k, (_, ps) in c.items()) + "], lambda x: x IS NOT NULL)"
_EV = f"WITH {DOCS}, e AS (SELECT id, CAST({_sum(_ABS)} AS BIGINT) AS absence_score, CAST({_sum(_MET)} AS BIGINT) AS method_score, {_cat(_ABS)} AS a, {_cat(_MET)} AS m FROM docs), v AS (SELECT id, absence_score, method_score, array_to_string(a, '; ') AS absence_categories, array_to_string(m, '; ') AS method_categories, CASE WHEN absence_score >= 8 AND method_score >= 4 AND len(a) >= 2 THEN 'Very High' WHEN absence_score >= 6 AND method_score >= 3 THEN 'High' WHEN absence_score >= 3 AND method_score >= 2 THEN 'Medium' WHEN absence_score >= 1 AND method_score >= 1 THEN 'Low' ELSE 'None' END AS confidence_level FROM e)"
_evidence = lambda s, d: ex.evidence(texts(s, d), "abstract", _ABS, _MET).select("id", "absence_score", "method_score", "absence_categories", "method_categories", "confidence_level")
register("EXT15", f"{_EV} SELECT * FROM v")(_evidence)
register("EXT16", f"{_EV}, {CLASSES} SELECT confidence_level, label, count(*) AS n FROM v JOIN classes USING (id) GROUP BY 1, 2")(lambda s, d: tb.counted(_evidence(s, d).join(classes(s, d), "id"), "confidence_level", "label"))
register("EXT17", f"{_EV} SELECT year // 5 * 5 AS period, confidence_level, count(*) AS n FROM v JOIN docs USING (id) GROUP BY 1, 2")(lambda s, d: tb.counted(_evidence(s, d).join(docs(s, d).select("id", md.period(F.col("year")).alias("period")), "id"), "period", "confidence_level"))
register("EXT14", f"{_EV} SELECT docs.id, lang, confidence_level, len(a) AS n FROM docs LEFT JOIN v ON docs.id = v.id LEFT JOIN (SELECT id, {_WORDS.format(c='abstract')} AS a FROM docs) w ON docs.id = w.id")(lambda s, d: ex.merged(docs(s, d).select("id", "lang"), "id", _evidence(s, d).select("id", "confidence_level"), docs(s, d).select("id", F.size(tx.words(F.col("abstract"))).cast("long").alias("n"))))
register("EXT20", f"WITH {_TAX} SELECT taxonID FROM tax WHERE kingdom = 'Plantae'")(lambda s, d: _taxonomy(s, d).where("kingdom = 'Plantae'").select("taxonID"))
register("EXT21", f"WITH {DOCS}, {CLASSES} SELECT docs.id, coalesce(source, '') || ' - ' || coalesce(lang, '') AS txt FROM docs JOIN classes ON docs.id = classes.id WHERE label IS NOT NULL")(lambda s, d: docs(s, d).join(classes(s, d).where("label is not null"), "id").select("id", F.concat(F.coalesce("source", F.lit("")), F.lit(" - "), F.coalesce("lang", F.lit(""))).alias("txt")))
register("EXT24", f"WITH {CLASSES}, a AS (SELECT label, count(*) AS n_a FROM classes GROUP BY 1), b AS (SELECT guess AS label, count(*) AS n_b FROM classes GROUP BY 1) SELECT label, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL JOIN b USING (label)")(lambda s, d: tb.full_with_zero(classes(s, d).groupBy("label").agg(F.count("*").alias("n_a")), classes(s, d).groupBy(F.col("guess").alias("label")).agg(F.count("*").alias("n_b")), ["label"], ["n_a", "n_b"]))
register("JN17", f"WITH {_TAX}, asked AS (SELECT DISTINCT upper(substr(p_name, 1, 1)) || '. ' || split_part(p_name, ' ', 2) AS short FROM part) SELECT short, canonicalName FROM asked JOIN tax ON taxonomicStatus = 'accepted' AND lower(substr(short, 1, 1)) = lower(substr(canonicalName, 1, 1)) AND lower(substr(short, 4)) = lower(split_part(canonicalName, ' ', -1))")(lambda s, d: ex.expanded_abbreviations(table(s, d, "part").select(F.concat(F.upper(F.substring("p_name", 1, 1)), F.lit(". "), F.split("p_name", " ")[1]).alias("short")).distinct(), "short", _taxonomy(s, d)).select("short", "canonicalName"))

# --- analyses ---------------------------------------------------------------------------------
register("AN1", f"WITH {DOCS}, y AS (SELECT year, count(*) AS n FROM docs GROUP BY 1) SELECT year, n, round((n - lag(n) OVER (ORDER BY year)) / lag(n) OVER (ORDER BY year) * 100, 4) AS growth, CAST(sum(n) OVER (ORDER BY year) AS BIGINT) AS cumulative FROM y")(lambda s, d: tb.growth(tb.completed(tb.counted(docs(s, d), "year"), "year", ["n"]), "n", "year"))
register("AN2", f"WITH {DOCS} SELECT year // 5 * 5 AS period, count(*) AS n, round(100 * avg(regexp_matches(lower(abstract), 'the|heit')::INT), 4) AS molecular_pct FROM docs GROUP BY 1")(lambda s, d: ex.methods(docs(s, d), "abstract", _CATS).groupBy(md.period(F.col("year")).alias("period")).agg(F.count("*").alias("n"), F.round(100 * F.avg(F.col("molecular_methods").cast("int")), 4).alias("molecular_pct")))
register("AN3", f"WITH {DOCS} SELECT id, CAST((lang = 'en')::INT + (source = 'src0')::INT + (n_chars > 1000)::INT + (year > 2000)::INT AS BIGINT) AS completeness FROM docs")(lambda s, d: docs(s, d).select("id", an.completeness(F.col("lang") == "en", F.col("source") == "src0", F.col("n_chars") > 1000, F.col("year") > 2000).alias("completeness")))
register("AN4", "WITH k AS (SELECT DISTINCT p_brand, p_name FROM part), f AS (SELECT DISTINCT p_name FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_quantity > 49) SELECT p_brand, count(*) AS total, count(f.p_name) AS found, round(100.0 * count(f.p_name) / count(*), 4) AS percent FROM k LEFT JOIN f ON k.p_name = f.p_name GROUP BY 1")(lambda s, d: ex.coverage(table(s, d, "part"), table(s, d, "part").join(table(s, d, "lineitem").where("l_quantity > 49"), F.col("p_partkey") == F.col("l_partkey")), "p_name", "p_brand"))
register("AN5", "SELECT count(DISTINCT p_name) AS n_names, count(DISTINCT p_brand) AS n_brands, count(DISTINCT p_type) AS n_types FROM part")(lambda s, d: table(s, d, "part").agg(F.countDistinct("p_name").alias("n_names"), F.countDistinct("p_brand").alias("n_brands"), F.countDistinct("p_type").alias("n_types")))
register("AN6", "SELECT p_brand, n_name, count(DISTINCT p_partkey) AS n FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")(lambda s, d: table(s, d, "lineitem").select("l_partkey", "l_suppkey").join(table(s, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(table(s, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(table(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("p_brand", "n_name").agg(F.countDistinct("p_partkey").alias("n")))
register("AN7", "SELECT DISTINCT p_name FROM part WHERE p_name NOT IN (SELECT p_name FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_quantity > 49)")(lambda s, d: ex.unrepresented(table(s, d, "part").select("p_name").distinct(), table(s, d, "part").join(table(s, d, "lineitem").where("l_quantity > 49"), F.col("p_partkey") == F.col("l_partkey")), "p_name"))
register("AN8", "WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rn FROM c) SELECT p_brand, string_agg(p_type || ' (' || n || ')', ', ' ORDER BY rn) AS top FROM r WHERE rn <= 5 GROUP BY 1")(lambda s, d: tb.counted(table(s, d, "part"), "p_brand", "p_type").withColumn("rn", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_type"))).where("rn <= 5").groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", F.format_string("%s (%d)", "p_type", "n").alias("x")))), lambda x: x["x"]), ", ").alias("top")))
register("AN10", f"WITH {DOCS}, f AS (SELECT id, {_FLAG} FROM docs) SELECT CASE WHEN molecular_methods AND culture_methods THEN 'Both' WHEN molecular_methods THEN 'Molecular only' WHEN culture_methods THEN 'Culture only' ELSE 'Neither' END AS combination, count(*) AS n FROM f GROUP BY 1")(lambda s, d: ex.methods(docs(s, d), "abstract", _CATS).groupBy(F.expr("case when molecular_methods and culture_methods then 'Both' when molecular_methods then 'Molecular only' when culture_methods then 'Culture only' else 'Neither' end").alias("combination")).agg(F.count("*").alias("n")))
register("AN16", f"WITH {CLASSES} SELECT guess, CASE WHEN conf >= 0.8 THEN 'high' WHEN conf >= 0.6 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM classes GROUP BY 1, 2")(lambda s, d: classes(s, d).groupBy("guess", F.when(F.col("conf") >= 0.8, "high").when(F.col("conf") >= 0.6, "medium").otherwise("low").alias("band")).agg(F.count("*").alias("n")))
register("AN18", "WITH n AS (SELECT 0 AS position, 'identified' AS step, count(*) AS n FROM documents UNION ALL SELECT 1, 'distinct', count(DISTINCT text) FROM documents UNION ALL SELECT 2, 'labelled', count(*) FROM labels WHERE doc_id IN (SELECT min(doc_id) FROM documents WHERE text IS NOT NULL GROUP BY text) UNION ALL SELECT 3, 'kept', count(*) FROM labels WHERE toxic = 0 AND doc_id IN (SELECT min(doc_id) FROM documents WHERE text IS NOT NULL GROUP BY text)) SELECT *, lag(n) OVER (ORDER BY position) - n AS removed FROM n")(lambda s, d: (lambda x, l: (lambda u: an.flow([("identified", x), ("distinct", u), ("labelled", l.join(u, "doc_id", "left_semi")), ("kept", l.where("toxic = 0").join(u, "doc_id", "left_semi"))]))(x.where("text is not null").groupBy(tb.digest("text").alias("_text")).agg(F.min("doc_id").alias("doc_id"))))(table(s, d, "documents"), table(s, d, "labels")))
register("AN20", f"WITH {DOCS}, {CLASSES}, j AS (SELECT label, source, year, n_chars, lang FROM classes JOIN docs ON classes.id = docs.id), b AS (SELECT label, count(*) AS n, min(year) AS y0, max(year) AS y1, min(n_chars) AS c0, avg(n_chars) AS c, max(n_chars) AS c1 FROM j GROUP BY 1) SELECT section, label, name, round(value::DOUBLE, 6) AS value FROM (SELECT label, unnest(['labels', 'years', 'years', 'lengths', 'lengths', 'lengths']) AS section, unnest(['n', 'first', 'last', 'shortest', 'mean', 'longest']) AS name, unnest([n, y0, y1, c0, c, c1]) AS value FROM b UNION ALL SELECT label, 'origins', source, count(*) FROM j GROUP BY 1, 3 UNION ALL SELECT NULL, 'top', lang, n FROM (SELECT lang, count(*) AS n FROM j WHERE lang <> '' GROUP BY 1 ORDER BY n DESC, lang LIMIT 3))")(lambda s, d: an.training_profile(classes(s, d).join(docs(s, d), "id"), "label", "source", "year", "n_chars", "lang", 3))
register("AN22", "WITH g AS (SELECT * FROM (SELECT DISTINCT lang FROM documents) CROSS JOIN (SELECT unnest([0, 1]) AS toxic)), c AS (SELECT lang, toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2) SELECT g.lang, g.toxic, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.toxic = c.toxic")(lambda s, d: (lambda j: j.select("lang").distinct().withColumn("toxic", F.explode(F.array(F.lit(0), F.lit(1)))).join(tb.counted(j.join(table(s, d, "labels"), "doc_id"), "lang", "toxic"), ["lang", "toxic"], "left").fillna(0, ["n"]))(table(s, d, "documents")))

# --- sources and sinks ------------------------------------------------------------------------


@register("SRC2", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def _(s, d):
    to, c = fl.scratch(s, "csv"), table(s, d, "customer")
    fl.write_csv(c.where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_mktsegment"), f"{to}/a")
    fl.write_csv(c.where("c_custkey % 2 = 1").select("c_name", "c_custkey"), f"{to}/b")
    return fl.read_delimited(s, f"{to}/*", empties=True).select("c_custkey", "c_name", "c_mktsegment")


@register("SRC1", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def _(s, d):
    to = fl.scratch(s, "tsv")
    fl.write_csv(table(s, d, "nation"), to, sep="\t")
    return fl.read_delimited(s, to, sep="\t", columns=["n_nationkey", "n_name", "n_missing"], empties=True)


@register("SRC10", "SELECT min(p_partkey) AS p_partkey FROM part WHERE lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_size = 7) GROUP BY p_name")
def _(s, d):
    to = fl.scratch(s, "lookup")
    fl.write_lookup(tb.first_by(table(s, d, "part"), ["p_name"], ["p_partkey"]), "p_name", to)
    return fl.looked_up(table(s, d, "part").where("p_size = 7"), "p_name", to).select("p_partkey")


@register("SNK8", "SELECT min(p_partkey) AS p_partkey, lower(p_name) AS name FROM part GROUP BY 2")
def _(s, d):
    to = fl.scratch(s, "lookup")
    fl.write_lookup(tb.first_by(table(s, d, "part").withColumn("p_name", F.lower("p_name")), ["p_name"], ["p_partkey"]), "p_name", to)
    return fl.looked_up(table(s, d, "part"), "p_name", to).select("p_partkey", F.col("p_name").alias("name"))


@register("SNK2", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def _(s, d):
    return fl.checkpointed(tb.counted(table(s, d, "documents"), "lang"), fl.scratch(s, "stage"))


register("SNK7", "SELECT '@article{paper' || row_number() OVER (ORDER BY o, k) || ', doi={' || k || '}}' AS value FROM (SELECT CAST(o_custkey AS VARCHAR) AS k, min(o_orderkey) AS o FROM orders GROUP BY 1)")(lambda s, d: fl.bibtex(table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("doi"), "o_orderkey"), "doi", "o_orderkey"))
