"""Delimited files, keyed lookup tables, stage checkpoints and report writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.tables import bind_rows, positioned, present, shared_folder


def files(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern, in order, by the file system of the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(f.getPath().toString() for f in found) if found else []


def read_delimited(spark: SparkSession, pattern: str, sep: str = ",", encoding: str = "UTF-8", columns: list[str] | None = None, empties: bool = False) -> DataFrame:
    """All files of a pattern as strings, bound by name: headers may differ. Empty values are null; with
    ``empties``, those in quotes are empty texts, as ``write_csv`` writes them."""
    import uuid

    paths = files(spark, pattern)
    if not paths:
        raise FileNotFoundError(f"no file matches {pattern}")
    null = uuid.uuid4().hex if empties else ""  # what an empty value without quotes becomes, and then null; no text is equal to it
    # without charToEscapeQuoteEscaping, Spark's parser loses the character 0 in quotes
    one = lambda p: spark.read.csv(p, sep=sep, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', charToEscapeQuoteEscaping='"', encoding=encoding, nullValue=null)
    out = bind_rows(*map(one, paths))
    return present(out, columns) if columns else out


def read_first(spark: SparkSession, *patterns: str, **options) -> DataFrame:
    """The first of several places that has files."""
    for p in patterns:
        if files(spark, p):
            return read_delimited(spark, p, **options)
    raise FileNotFoundError(f"none of these has files: {', '.join(patterns)}")


def read_with_fallback(spark: SparkSession, pattern: str, **options) -> DataFrame:
    """UTF-8, or Latin-1 where the bytes of the files aren't UTF-8."""
    out = read_delimited(spark, pattern, **options)
    if spark.read.text(files(spark, pattern)).where(~F.is_valid_utf8("value")).limit(1).count():
        return read_delimited(spark, pattern, encoding="ISO-8859-1", **options)
    return out


def read_taxonomy(spark: SparkSession, path: str, kingdoms: list[str], ranks: list[str]) -> DataFrame:
    out = spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote="")
    return out.where(F.col("kingdom").isin(*kingdoms) & F.col("taxonRank").isin(*ranks))


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Values as they are, blanks and line ends around them too; nulls are empty, empty texts a pair of quotes."""
    df.write.mode("overwrite").csv(path, sep=sep, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def checkpointed(df: DataFrame, path: str, again: bool = False) -> DataFrame:
    """Write a stage's result as Parquet, or read it if it is there."""
    spark = df.sparkSession
    if again or not files(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_lookup(df: DataFrame, key: str, path: str, buckets: int = 16) -> None:
    """A lookup table by lower-cased key, each key once, in files by a hash of the key."""
    keyed = df.withColumn("_key", F.lower(key)).where("_key is not null").dropDuplicates(["_key"])
    keyed.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets))).repartition(buckets, "_bucket").sortWithinPartitions("_key").write.mode("overwrite").partitionBy("_bucket").parquet(path)


def looked_up(names: DataFrame, name: str, path: str, buckets: int = 16) -> DataFrame:
    """The rows of a lookup table whose key is among the names: exact membership."""
    table = names.sparkSession.read.parquet(path)
    keys = names.select(F.lower(name).alias("_key")).distinct().withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)))
    return table.join(keys, ["_key", "_bucket"], "left_semi").drop("_bucket")


def shown(df: DataFrame, most: int) -> tuple[list, str]:
    """The first rows of a result and what to say of the others: nothing, or how many are left out."""
    rows = df.limit(most + 1).collect()
    return rows[:most], f"({df.count() - most} more rows)" if len(rows) > most else ""


def markdown(df: DataFrame, most: int = 100) -> str:
    """A small result as a Markdown table of at most ``most`` rows, and a line that counts any others."""
    rows, rest = shown(df, most)
    lines = [" | ".join(df.columns), " | ".join("---" for _ in df.columns), *(" | ".join("" if v is None else str(v) for v in r) for r in rows)]
    return "\n".join([*(f"| {x} |" for x in lines), *(["", rest] if rest else [])])


def bibtex(df: DataFrame, doi: str, order: str) -> DataFrame:
    """One line of BibTeX per distinct DOI, in a text column."""
    one = df.where(F.col(doi).isNotNull() & (F.col(doi) != "")).groupBy(doi).agg(F.min(order).alias("_o"))
    return positioned(one, ["_o", doi], "_at").select(F.format_string("@article{paper%d, doi={%s}}", F.col("_at") + 1, F.col(doi)).alias("value"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_xml(spark: SparkSession, pattern: str, tag: str, paths: dict[str, str], joined: dict[str, str] | None = None) -> DataFrame:
    """One row per element ``tag`` of all XML files, with the first text at each XPath (null without
    one) and, of those in ``joined``, all texts with a blank between them."""
    rows = spark.read.text(pattern, lineSep=f"</{tag}>").where(F.contains("value", F.lit(f"<{tag}")))
    rows = rows.select(F.concat(F.regexp_extract("value", f"(?s)(<{tag}[ >].*)$", 1), F.lit(f"</{tag}>")).alias("_x")).where(F.length("_x") > len(tag) + 3)
    first = [F.get(F.expr(f"xpath(_x, {_literal(p + '/text()')})"), F.lit(0)).alias(c) for c, p in paths.items()]
    every = [F.array_join(F.expr(f"xpath(_x, {_literal(p + '/text()')})"), " ").alias(c) for c, p in (joined or {}).items()]
    return rows.select(*first, *every)


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def search_string(all_of: list[list[str]], first: int | None = None, last: int | None = None) -> str:
    """A Boolean query: any of the terms of each list, all lists, and a range of publication years."""
    quoted = lambda t: f'"{t}"' if " " in t or "-" in t else t
    out = " AND ".join("( " + " OR ".join(map(quoted, terms)) + " )" for terms in all_of if terms)
    return out if first is None else f"{out} AND ({first}/01/01[PDAT] : {last}/12/31[PDAT])"


def write_batches(df: DataFrame, key: str, path: str, batches: int, each: int = 5, again: bool = False) -> DataFrame:
    """Write the rows in ``batches`` by a hash of the key, ``each`` batches a step; steps that are
    finished are not written again, so a broken run goes on where it ended."""
    spark = df.sparkSession
    dealt = df.withColumn("_batch", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int"))
    for step in range(0, batches, each):
        to = f"{path}/step={step // each}"
        if again or not files(spark, f"{to}/_SUCCESS"):
            dealt.where(F.col("_batch").between(step, step + each - 1)).drop("_batch").write.mode("overwrite").parquet(to)
    return spark.read.parquet(path).drop("step")


def build_lookup(df: DataFrame, key: str, path: str, again: bool = False) -> bool:
    """Write the lookup table unless it is there; says whether it was written."""
    there = bool(files(df.sparkSession, f"{path}/_SUCCESS"))
    if again or not there:
        write_lookup(df, key, path)
    return again or not there


def backup(spark: SparkSession, path: str, folder: str, stamp: str) -> str:
    """Copy a file or folder to ``folder`` under its name with a time stamp; gives the copy's path."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    source, name = hadoop.Path(path), path.rstrip("/").rsplit("/", 1)[-1]
    stem, dot, end = name.partition(".")
    to = f"{folder.rstrip('/')}/{stem}_{stamp}{dot}{end}"
    target = hadoop.Path(to)
    if not hadoop.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf):
        raise OSError(f"{path} could not be copied to {to}")
    return to


def report(title: str, sections: dict[str, DataFrame], most: int = 100) -> list[str]:
    """A text report: a title, and each section's rows as "name: value" lines, at most ``most``, and a line that counts any others."""
    out = [title, "=" * len(title)]
    for name, df in sections.items():
        out += ["", name, "-" * len(name)]
        rows, rest = shown(df, most)
        out += [", ".join(f"{c}: {'NA' if v is None else v}" for c, v in r.asDict().items()) for r in rows]
        out += [rest] if rest else []
    return out


def write_subsets(df: DataFrame, by: str, path: str) -> None:
    """Compressed subsets, one folder a value; a large value is written by as many tasks as hold it."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(by).parquet(path)


_POINTS = "array<array<array<double>>>"


def read_outlines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(name, part, ring): the outlines of GeoJSON features, from files with a feature a line or with one
    collection each. Several polygons of a feature are its parts. Holes are joined to their outline by
    an edge there and back, which the even-odd rule doesn't see; features without polygons are left out.
    """
    feature = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"struct<type:string,features:array<{feature}>,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>").alias("x"))
    single = F.array(F.struct("x.properties", "x.geometry"))
    features = parsed.select(F.explode(F.when(F.col("x.type") == "FeatureCollection", F.col("x.features")).otherwise(single)).alias("f"))
    kind, told = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    polygons = F.when(kind == "Polygon", F.array(F.from_json(told, _POINTS))).when(kind == "MultiPolygon", F.from_json(told, f"array<{_POINTS}>"))
    rows = features.select(F.col("f.properties").getItem(name).alias("name"), F.posexplode(polygons).alias("part", "rings"))
    corners = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    outer = F.get("rings", F.lit(0))
    holes = F.transform(F.slice("rings", F.lit(2), F.greatest(F.size("rings") - 1, F.lit(0))), lambda r: F.concat(r, F.array(F.get(outer, F.lit(0)))))
    return rows.where(F.size("rings") > 0).select("name", "part", corners(F.flatten(F.concat(F.array(outer), holes))).alias("ring"))
