"""Plans of the readers and writers: whole tables are written to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from adagium.functions import fixed
from adagium.plans.registry import query, quoted, table
from adagium.shared import shared_dir
from adagium.sources import books, sinks, tables


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/adagium-files-{uuid.uuid4().hex}/{name}"


_TEXT = "SELECT p_partkey::VARCHAR AS p_partkey, coalesce(p_name, '') AS p_name, coalesce(p_type, '') AS p_type FROM part"


def _parts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("p_partkey"), "p_name", "p_type")


@query(f"WITH p AS ({_TEXT}) SELECT * FROM p")
def csv_there_and_back(spark, d):
    """Delimited text of all columns as text."""
    path = _place(spark, "part.csv")
    sinks.save_table(_parts(spark, d), path, "csv")
    return tables.read_csv(spark, path, keep_na=True)


@query("SELECT doc_id::VARCHAR AS doc_id, max(quality)::VARCHAR AS quality FROM labels GROUP BY doc_id")
def keyed_labels(spark, d):
    """S3: of rows with a key, of a repeated key the last in the file's order."""
    rows = table(spark, d, "labels").filter("doc_id is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").cast("string").alias("quality"))
    blank = rows.limit(0).unionByName(spark.createDataFrame([(" ", "1"), ("", "0")], "doc_id string, quality string"))
    path = _place(spark, "labels.csv")
    sinks.save_table(rows.orderBy("doc_id", "quality").unionByName(blank), path, "csv")
    return tables.read_keyed(spark, path, "doc_id", ["quality"]).select("doc_id", "quality")


@query("SELECT 'region.csv' AS source_file, r_name AS name, '' AS n_nationkey FROM region UNION ALL SELECT 'nation.csv', n_name, n_nationkey::VARCHAR FROM nation")
def many_files(spark, d):
    """Files of a glob by name, columns by name, '' where a file lacks one; the excluded one is left out."""
    place = _place(spark, "")
    region = table(spark, d, "region").select(F.col("r_name").alias("name"))
    nation = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("n_nationkey"))
    for name, df in (("region.csv", region), ("nation.csv", nation), ("master.csv", region)):
        sinks.save_table(df, place + name, "csv")
    return tables.read_many(spark, place + "*.csv", exclude=("master.csv",), keep_na=True).select("source_file", "name", "n_nationkey")


@query("SELECT vec_id AS ref, round(embedding[1]::DOUBLE, 6) AS first, len(embedding)::BIGINT AS n FROM embeddings")
def vectors_by_split(spark, d):
    """Vectors in two splits, read as one."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("ref"), F.col("embedding").cast("array<float>").alias("embedding"))
    paths = [_place(spark, f"split-{k}.parquet") for k in (0, 1)]
    for k, path in enumerate(paths):
        sinks.save_table(rows.filter(F.pmod(F.xxhash64("ref"), F.lit(2)) == k), path)
    return tables.read_splits(spark, paths).select("ref", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.size("embedding").cast("long").alias("n"))


@query("SELECT doc_id, coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS lang, length(text) AS n_chars FROM documents")
def language_folders(spark, d):
    """A folder for each language; the language comes back as a column."""
    path = _place(spark, "by-language")
    table(spark, d, "documents").select("doc_id", "lang", "text").write.partitionBy("lang").parquet(path)
    return tables.read_languages(spark, path).select("doc_id", F.coalesce("lang", F.lit("__HIVE_DEFAULT_PARTITION__")).alias("lang"), F.length("text").cast("long").alias("n_chars"))


_STOP = lambda x: f"trim(rtrim(trim({x}), '.'))"
_ENTRY = "concat(regexp_replace(text, '[_\\n]+', ' ', 'g'), ' _', n_chars::VARCHAR, ' of ', lang, '_ p. ', doc_id::VARCHAR)"


@query(rf"""WITH p AS (SELECT doc_id, {_ENTRY} AS x FROM documents), s AS (SELECT doc_id, {_STOP("regexp_extract(x, '^(.*?)_(.+?)_', 1)")} AS native, trim(regexp_extract(x, '_(.+?)_', 1)) AS english FROM p)
SELECT doc_id, native, english, rtrim(lower(trim(english)), '.') IN ({", ".join(map(quoted, fixed.INDEX_TOKENS))}) OR regexp_matches(native, {quoted(fixed.INDEX_PAGE)}) AS index_row FROM s""")
def italic_pairs(spark, d):
    """Whole texts with an English note between underscores."""
    flat = F.regexp_replace("text", r"[_\n]+", " ")
    x = F.concat(flat, F.lit(" _"), F.col("n_chars").cast("string"), F.lit(" of "), F.col("lang"), F.lit("_ p. "), F.col("doc_id").cast("string"))
    native, english = books.italic_pair(F.col("x"))
    rows = table(spark, d, "documents").select("doc_id", x.alias("x")).select("doc_id", native.alias("native"), english.alias("english"))
    return rows.withColumn("index_row", books.index_row(F.col("native"), F.col("english")))


# A capital follows the white space: what the cut looks ahead to is matched and given back.
_CUT = r"""^(.*?[.?!]["”’»)\]]?)\s+(["“‘«(\[]?[A-Z].*)$"""


@query(rf"""WITH p AS (SELECT doc_id, regexp_replace(text, '\n+', ' ', 'g') AS x FROM documents)
SELECT doc_id, {_STOP(f"regexp_extract(x, {quoted(_CUT)}, 1)")} AS native, trim(regexp_replace(regexp_extract(x, {quoted(_CUT)}, 2), '\s*\([^)]*\)\s*$', '')) AS english FROM p""")
def plain_pairs(spark, d):
    """Whole texts cut after their first sentence that a capital follows."""
    native, english = books.plain_pair(F.col("x"))
    rows = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"\n+", " ").alias("x"))
    return rows.select("doc_id", native.alias("native"), english.alias("english"))


@query("SELECT count(*) AS n, sum(position)::BIGINT AS places, max(position) AS last, bool_and(position = r) AS in_order FROM (SELECT row_number() OVER (ORDER BY text, doc_id) AS position, row_number() OVER (ORDER BY text, doc_id) AS r FROM documents)")
def positions(spark, d):
    """S2's ordinal over a sort of the whole table: dense from 1, in the order of the columns."""
    from pyspark.sql import Window as W

    rows = tables.with_position(table(spark, d, "documents").select("doc_id", "text"), ["text", "doc_id"])
    rows = rows.withColumn("after", F.lag("text").over(W.partitionBy(F.floor(F.col("position") / 1000)).orderBy("position")))
    return rows.agg(F.count("*").alias("n"), F.sum("position").alias("places"), F.max("position").alias("last"), F.bool_and(F.coalesce(F.col("after") <= F.col("text"), F.lit(True))).alias("in_order"))
