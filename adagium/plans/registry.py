"""Registration of queries and their SQL, and the inputs that several plans share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: Sentence templates whose slots take words of a document; they exercise the rule operators on the driver's tables.
TEMPLATES = (
    "Better {a} than {b}.", "He who {a} will {b}.", "Never {a} the {b}.", "If {a}, then you {b}.", "Keep {a} and {b}", "The {a} of {b} brings good {c}.",
    "Waste not, want not {a}", "You should help the poor {a}, {b} loss", "{a} is worth {b}", "{a} is as good as {b}.", "best {a} is {b}", "Early {a} gets the {b}.",
    "{a} {b} {c}", "When {a} {b}, give {c} or fall to ruin", "{a} makes {b}", "Proverb: don't {a} {b} - {c} saying", "must {a}; wise {b} friend",
)


def templated(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, t): the whole text of every document; and, as rules seldom fire on such texts, for each one a
    sentence under the number -1 - doc_id: template doc_id modulo their count, slots from its first three ASCII words.
    """
    low = docs.select("doc_id", "lang", F.lower("text").alias("low"))
    word = lambda i: F.regexp_extract("low", "^" + "[^a-z]*+[a-z]++" * i + "[^a-z]*+([a-z]++)", 1)
    d = low.select("doc_id", "lang", *[F.coalesce(F.nullif(word(i), F.lit("")), F.lit("x")).alias(k) for i, k in enumerate("abc")])
    slot = {k: F.col(k) for k in "abc"}

    def fill(t: str) -> Column:
        parts, rest = [], t
        while "{" in rest:
            head, _, rest = rest.partition("{")
            parts += [F.lit(head), slot[rest[0]]]
            rest = rest[2:]
        return F.concat(*parts, F.lit(rest))

    out = F.lit(None).cast("string")
    for i, t in enumerate(TEMPLATES):
        out = F.when(F.col("doc_id") % len(TEMPLATES) == i, fill(t)).otherwise(out)
    made = d.select((F.lit(-1) - F.col("doc_id")).alias("doc_id"), "lang", out.alias("t"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.coalesce("text", F.lit("")).alias("t")).unionByName(made)


def _fill_sql(t: str) -> str:
    parts, rest = [], t
    while "{" in rest:
        head, _, rest = rest.partition("{")
        parts += [quoted(head), f"coalesce(w[{'abc'.index(rest[0]) + 1}], 'x')"]
        rest = rest[2:]
    return "concat(" + ", ".join([*parts, quoted(rest)]) + ")"


TEMPLATED_SQL = (
    "tc AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents UNION ALL SELECT -1 - doc_id AS doc_id, lang, CASE doc_id % " + str(len(TEMPLATES)) + " " + " ".join(f"WHEN {i} THEN {_fill_sql(t)}" for i, t in enumerate(TEMPLATES)) + " END AS t "
    "FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents))"
)
